"""Runs registered queries beside their SQL and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _value(x):
    return round(x, 6) if isinstance(x, float) and math.isfinite(x) else x


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, key: str):
    """(equal, rows, seconds, difference) for one key."""
    start = time.time()
    df = entry.queries()[key](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    equal = got == want and sorted(names) == sorted(df.columns)
    return equal, sum(got.values()), took, (list((got - want).items())[:3], list((want - got).items())[:3])


if __name__ == "__main__":
    from conftest import session
    spark = session()
    sf = sys.argv[1]
    for name in sys.argv[2:] or list(entry.queries()):
        try:
            equal, count, took, diff = compare(spark, sf, name)
            print(f"{name:24s} {'ok ' if equal else 'DIFF'} rows={count} {took:.1f}s", "" if equal else diff, flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} ERROR {str(e)[:600]}", flush=True)
