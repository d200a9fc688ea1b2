"""Run registered queries next to their SQL in DuckDB and compare the results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
DATA = os.environ.get("TRACEMILL_DATA", "/root/testdata")


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def difference(spark, con, fn, sql, sf_dir) -> str | None:
    """Text of the first difference, or None when the results are the same."""
    df = fn(spark, sf_dir)
    got_cols, got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_cols, want = _sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if not want:
        return "no rows"
    if len(got) != len(want):
        return f"{len(got)} rows, wanted {len(want)}: {got[:3]} / {want[:3]}"
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(want)} rows differ, first {wrong[0]}"
    types = {tuple(type(v) for v in r) for r in got[:50]} ^ {tuple(type(v) for v in r) for r in want[:50]}
    return f"types {types}" if types else None


def main(names: list[str]) -> int:
    from tracemill.session import local_session

    import __spark_entry__ as entry

    sf_dir = os.path.join(DATA, os.environ.get("SF", "sf0.01"))
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in queries:
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in oracles:
                text = difference(spark, con, queries[name], oracles[name], sf_dir)
            else:
                text = None if queries[name](spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            text = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += text is not None
        mark = "ok  " if text is None else "FAIL"
        print(f"{mark} {time.time() - start:6.2f}s {'' if name in oracles else '(rows) '}{name} {text or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
