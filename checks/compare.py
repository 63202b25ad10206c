"""Compare registered queries with their oracle SQL: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(frame) -> tuple[list[str], list[tuple]]:
    """Column names and sorted rows with NaN, NaT, NA and None folded together, whole numbers as integers of either type."""
    columns = sorted(frame.columns)

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        v = v.item() if hasattr(v, "item") else v
        return int(v) if isinstance(v, float) and v.is_integer() else v

    rows = [tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None)]
    return columns, sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree, else a short description."""
    df = fn(spark, sf_dir)
    got, want = canonical(df.toPandas()), canonical(con.execute(sql).df())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"spark {a} != oracle {b}"
    return None


def main() -> int:
    from checks import QUERIES
    from hotspan.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(), oracle_connection(sf_dir), 0
    for name in names:
        fn, sql = QUERIES[name]
        start = time.time()
        try:
            note = f"rows only: {fn(spark, sf_dir).count()}" if sql is None else differences(spark, con, fn, sql, sf_dir)
        except Exception as e:  # a failing query must not hide the others
            note = f"{type(e).__name__}: {str(e)[:1500]}"
        failed = note is not None and not note.startswith("rows only")
        bad += failed
        print(f"{'FAIL' if failed else 'ok':4} {name:32} {time.time() - start:6.2f}s {note or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
