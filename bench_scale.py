"""Times whole jobs on many copies of the activity table, e.g. one trading day.

    python bench_scale.py COPIES FOLDER [JOB ...]

Each copy has users and events of its own, so orders keep their size while
their number grows. The copies are made once per folder. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from bench import session
from bookloom.operators.lifecycle import lifecycle_table
from bookloom.operators.versions import enrich_events, version_summary
from bookloom.plans import lives, overview
from bookloom.sources.activity import load_order_events, raw_text
from bookloom.sources.order_files import by_table, raw_columns, read_events, save_event_table

SOURCE = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def copies(spark: SparkSession, n: int, folder: str) -> str:
    path = f"{folder}/events.parquet"
    if not Path(path).exists():
        spark.read.parquet(f"{SOURCE}/events.parquet").repartition(64).selectExpr(
            "*", f"explode(sequence(0L, {n - 1}L)) AS copy"
        ).selectExpr(
            "event_id + copy * 10000000 AS event_id",
            "ts",
            "user_id + copy * 10000000 AS user_id",
            "event_type",
            "value",
            "props",
        ).write.parquet(path)
    return folder


def table(spark: SparkSession, folder: str) -> DataFrame:
    """Order events as a stored table, as an ingest job would leave them."""
    path = f"{folder}/order_events"
    if not Path(path).exists():
        load_order_events(spark, folder).write.parquet(path)
    return spark.read.parquet(path)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Order events as raw text files."""
    path = f"{folder}/raw"
    if not Path(path).exists():
        raw_text(table(spark, folder)).write.option("sep", ";").option("header", True).csv(path)
    return read_events(spark, path)


def discard(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def enrich_to_parquet(spark: SparkSession, folder: str) -> None:
    enrich_events(table(spark, folder)).write.mode("overwrite").parquet(f"{folder}/enriched")


BUCKETS = 64
BUCKETED = "bench_events"


def bucketed(spark: SparkSession, folder: str) -> None:
    """The same events bucketed by order, large orders beside the buckets."""
    if not spark.catalog.tableExists(BUCKETED):
        save_event_table(table(spark, folder), BUCKETED, BUCKETS, f"{folder}/bucketed")


def enrich_bucketed(spark: SparkSession, folder: str) -> None:
    """Enriched events from the bucketed table: no shuffle of the events."""
    by_table(spark, BUCKETED, enrich_events).write.mode("overwrite").parquet(f"{folder}/enriched")


def enrich_files(spark: SparkSession, folder: str) -> None:
    """Text files to enriched text files, parsing the input once."""
    files(spark, folder).write.mode("overwrite").parquet(f"{folder}/parsed")
    events = spark.read.parquet(f"{folder}/parsed")
    frame = enrich_events(events, keep=raw_columns(events))
    frame.write.mode("overwrite").option("sep", ";").option("header", True).csv(
        f"{folder}/enriched_csv"
    )


JOBS: dict[str, Callable[[SparkSession, str], None]] = {
    "fact_cube": lambda s, f: discard(overview.fact_cube(table(s, f))),
    "order_size": lambda s, f: discard(overview.order_size(table(s, f))),
    "rolling_intensity": lambda s, f: discard(overview.rolling_intensity(table(s, f))),
    "largest_orders": lambda s, f: discard(overview.largest_orders_windows(table(s, f))),
    "lifecycle_table": lambda s, f: discard(lifecycle_table(table(s, f))),
    "lifetime_stats": lambda s, f: discard(
        lives.lifetime_stats(lifecycle_table(table(s, f), improvements=False))
    ),
    "version_summary": lambda s, f: discard(version_summary(table(s, f))),
    "enrich_to_parquet": enrich_to_parquet,
    "enrich_bucketed": enrich_bucketed,
    "enrich_files": enrich_files,
}


def main() -> None:
    n, folder, *names = sys.argv[1:]
    spark = session()
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", str(8 * cores))
    # A few tasks per core, so that one slow task does not hold up the rest.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionNum", str(4 * cores))
    copies(spark, int(n), folder)
    rows = table(spark, folder).count()
    times = {}
    for name in names or JOBS:
        if name == "enrich_files":
            files(spark, folder)
        if name == "enrich_bucketed":
            bucketed(spark, folder)
        start = time.perf_counter()
        JOBS[name](spark, folder)
        times[name] = round(time.perf_counter() - start, 1)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"rows": rows, "unit": "sec", "jobs": times}))
    spark.stop()


if __name__ == "__main__":
    main()
