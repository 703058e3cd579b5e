"""The registered queries on the smallest tables: against their SQL, or non-empty with a stable schema."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]


def test_all_thirteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name, monkeypatch):
    monkeypatch.setattr(compare, "registered", lambda: (entry.queries(), entry.oracle_sql()))
    out = compare.compare(spark, compare.connect(SF), name, SF)
    assert out.startswith("ok" if name in entry.oracle_sql() else "rows"), out
