"""Run registered queries against their SQL on one scale factor.

    python tools/compare.py [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from foliant import build_session  # noqa: E402
from foliant.plans import registered  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(x) -> str:
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return f"{float(x):.6g}" if float(x) != int(x) else str(int(x))
    return str(x)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    fn, sql = registered()[0][name], registered()[1].get(name)
    t = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - t
    if sql is None:
        return f"{'rows' if got else 'EMPTY'} {len(got)} {took:.1f}s"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(columns)}"
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(columns, want)
    if a == b:
        return f"{'ok' if a else 'EMPTY'} {len(a)} {took:.1f}s"
    sa, sb = set(a), set(b)
    return f"DIFF {len(a)} vs {len(b)}: spark only {sorted(sa - sb)[:2]} sql only {sorted(sb - sa)[:2]}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(registered()[0])
    spark = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            out = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on
            out = f"ERROR {type(e).__name__} {str(e)[:700]}"
        bad += not out.startswith(("ok", "rows"))
        print(f"{name:28s} {out}", flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
