"""Run queries next to their SQL counterparts: ``python -m checks.compare <sf_dir> [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _sorted_rows(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(df: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """A description of the first difference between both results, or None."""
    want = db.execute(sql)
    columns = [c[0] for c in want.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(columns)}"
    expected, got = _sorted_rows(want.fetchall(), columns), _sorted_rows(df.collect(), df.columns)
    if len(expected) != len(got):
        return f"{len(got)} rows instead of {len(expected)}"
    for e, g in zip(expected, got):
        if e != g:
            return f"got {g!r:.600} instead of {e!r:.600}"
    return None


def main(sf_dir: str, names: list[str]) -> None:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    for name in names or list(QUERIES):
        start = time.time()
        found = difference(QUERIES[name](spark, sf_dir), db, ORACLE[name]) if name in ORACLE else "no SQL"
        print(f"{'ok' if found is None else 'DIFFERS'} {name} {time.time() - start:.2f}s {found or ''}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
