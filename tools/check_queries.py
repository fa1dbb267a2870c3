"""Run registered queries beside their SQL in DuckDB and compare every value.

    python tools/check_queries.py /root/testdata/sf0.01 [name-part ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from tallyguard.catalog import QUERIES, SQL
from tallyguard.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def canonical(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and value != value:
        return None
    return value


def compare(mine: list[tuple], other: list[tuple], my_cols, other_cols) -> str:
    if sorted(my_cols) != sorted(other_cols):
        return f"columns {sorted(my_cols)} vs {sorted(other_cols)}"
    if len(mine) != len(other):
        return f"rows {len(mine)} vs {len(other)}"

    def ordered(rows, cols):
        at = [cols.index(c) for c in sorted(cols)]
        return sorted((tuple(canonical(r[i]) for i in at) for r in rows), key=repr)

    a, b = ordered(mine, my_cols), ordered(other, other_cols)
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else ""


def main() -> None:
    sf, parts = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "check", "local[8]", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="8", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    for item in [p for p in parts if "=" in p]:
        spark.conf.set(*item.split("=", 1))
    parts = [p for p in parts if "=" not in p]
    con = connect(sf)
    failed = []
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name in SQL:
                res = con.execute(SQL[name])
                cols = [d[0] for d in res.description]
                problem = compare(rows, res.fetchall(), df.columns, cols)
            else:
                problem = ""
        except Exception as e:  # report and go on with the next query
            took, problem, rows = time.time() - start, f"{type(e).__name__}: {str(e)[:600]}", []
        state = "FAIL" if problem else ("ok" if name in SQL else "ok (rows only)")
        print(f"{state:15s} {name:34s} {len(rows):7d} rows {took:6.2f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
