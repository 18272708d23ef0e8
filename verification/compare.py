"""Run registered queries in Spark and their SQL in DuckDB and compare.

    python -m verification.compare [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from spendlens.session import build_session

from .oracle import all_sql
from .queries import all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(":memory:")
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns by name, as an ordered list."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


# DuckDB and Spark names of the types the queries return.
TYPE_NAMES = {
    "VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double",
    "BOOLEAN": "boolean", "DATE": "date",
}


def difference(spark, con, sf_dir: str, name: str) -> str:
    """Empty when Spark and SQL agree."""
    df = all_queries()[name](spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(all_sql()[name])
    columns = [d[0] for d in result.description]
    want = normal(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    theirs = {d[0]: TYPE_NAMES.get(str(d[1]), str(d[1])) for d in result.description}
    if theirs != dict(df.dtypes):
        return f"types {sorted(dict(df.dtypes).items() ^ theirs.items())}"
    if got == want:
        return ""
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    first = next((g, w) for g, w in zip(got, want, strict=True) if g != w)
    return f"row {first[0]} != {first[1]}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or sorted(all_queries()):
        start = time.time()
        try:
            problem = difference(spark, con, sf_dir, name) if name in all_sql() else "no SQL"
        except Exception as err:  # noqa: BLE001
            problem = f"{type(err).__name__}: {str(err)[:300]}"
        bad += bool(problem)
        print(f"{'BAD' if problem else 'ok ':4}{time.time() - start:6.2f}s {name} {problem}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
