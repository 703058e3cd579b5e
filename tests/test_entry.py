import __spark_entry__ as entry_module


def test_contract(spark):
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries)
    # Only operators of the optional subpackage have queries that SQL cannot express.
    assert all(n == "pipeline" or n.startswith("op") for n in set(queries) - set(sql))
    out = entry_module.entry(spark)
    assert out.columns == ["doc_id", "lang", "score", "snippet"] and out.count() == 50
