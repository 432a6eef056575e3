"""Compare registered queries with their SQL on DuckDB.

    python tests/oracle.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return datetime.datetime(v.year, v.month, v.day)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple((type(_plain(r[i])).__name__, _plain(r[i])) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    result = con.execute(sql)
    return _rows([c[0] for c in result.description], result.fetchall())


def difference(df, con, sql: str) -> str | None:
    """What differs, or None. Values must be equal in type and to the last bit."""
    have_names, have = spark_rows(df)
    want_names, want = duck_rows(con, sql)
    if have_names != want_names:
        return f"columns {have_names} != {want_names}"
    if len(have) != len(want):
        return f"rows {len(have)} != {len(want)}; e.g. {have[:1]} / {want[:1]}"
    wrong = [(a, b) for a, b in zip(have, want) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(want)} rows differ, e.g. {wrong[0][0]} / {wrong[0][1]}"
    return None


def main() -> int:
    import __spark_entry__
    from basketlens.runtime import build_session

    ORACLES, QUERIES = __spark_entry__.oracle_sql(), __spark_entry__.queries()

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session(
        master=f"local[{os.environ.get('CPUS', 8)}]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, run in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            df = run(spark, sf_dir)
            if name in ORACLES:
                outcome = difference(df, con, ORACLES[name])
                note = "ok" if outcome is None else f"DIFFERS {outcome}"
            else:
                rows = df.collect()
                note = f"rows only: {len(rows)}"
                outcome = None
        except Exception:
            outcome = note = "FAILED " + traceback.format_exc(limit=3)[-1500:]
        bad += outcome is not None
        print(f"{name:45s} {time.time() - t:6.2f}s {note[:1500]}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
