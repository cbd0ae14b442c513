"""Compare registered queries with their SQL: python tests/check_oracle.py [folder] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as registry  # noqa: E402


def compare(spark: SparkSession, connection, name: str, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    frame = registry.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    mine = sorted(tuple(str(v) for v in row) for row in frame.select(*[f"`{c}`" for c in columns]).collect())
    took = time.time() - started
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(mine)} rows, no SQL, {took:.1f}s"
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(str(row[i]) for i in order) for row in result.fetchall())
    ok = mine == theirs and sorted(names) == columns
    note = "" if ok else f" MISMATCH {len(mine)} vs {len(theirs)}: " + str(
        [pair for pair in zip(mine, theirs) if pair[0] != pair[1]][:2]
    )
    return ok, f"{len(mine)} rows, {took:.1f}s{note}"


def connect(sf_dir: str):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    database = connect(folder)
    failures = 0
    for query in sys.argv[2:] or registry.queries():
        good, text = compare(session, database, query, folder)
        failures += not good
        print(f"{'ok  ' if good else 'FAIL'} {query}: {text}", flush=True)
    print(f"{failures} failures")
    sys.exit(bool(failures))
