"""Runs registered queries and their SQL side by side: `python tests/compare.py SF_DIR [names...]`."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return str(value)


FAMILY = {"bigint": "int", "integer": "int", "hugeint": "int", "double": "float", "float": "float",
          "varchar": "string", "string": "string", "boolean": "bool", "int": "int"}


def spark_rows(df):
    names = sorted(df.columns)
    types = dict(df.dtypes)
    rows = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)
    return names, [FAMILY.get(types[n], types[n]) for n in names], rows


def duck_rows(con, sql):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    kinds = [str(rel.types[i]).lower() for i in order]
    rows = sorted((tuple(_plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    return [rel.columns[i] for i in order], [FAMILY.get(k, k) for k in kinds], rows


def differences(left, right):
    for what, a, b in zip(("columns", "types", "row count"), (*left[:2], len(left[2])), (*right[:2], len(right[2]))):
        if a != b:
            return f"{what}: {a} != {b}"
    for a, b in zip(left[2], right[2]):
        if a != b:
            return f"values: {str(a)[:300]} != {str(b)[:300]}"
    return None


def main(sf_dir, *names):
    from queuemill.runtime import build_session
    import __spark_entry__ as entry
    spark = build_session("compare", 8)
    checks, con, bad = entry.oracle_sql(), duck(sf_dir), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = spark_rows(run(spark, sf_dir))
            took = time.time() - start
            if name in checks:
                start = time.time()
                problem = differences(got, duck_rows(con, checks[name]))
                mark = f"sql {time.time() - start:.1f}s"
            else:
                problem, mark = None, "rows only"
            if not got[2]:
                mark += " EMPTY"
        except Exception as error:  # report and go on with the next query
            problem, took, mark, got = f"{type(error).__name__}: {str(error)[:700]}", time.time() - start, "", ([], [], [])
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:26s} {took:6.1f}s {len(got[2]):8d} rows {mark}", problem or "", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
