"""Order lives kept up day by day: a new day reads its own events and the open orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.operators.lifecycle import is_open, lives, merge_states, order_states

OPEN, CLOSED = "open", "closed"


def first_day(events: DataFrame, base: str, day: str) -> None:
    """Start the tables below ``base`` with the events of a day."""
    _write(order_states(events), base, day)


def add_day(events: DataFrame, base: str, day: str, day_before: str) -> None:
    """Add a day's events to what the day before left open.

    Each day writes folders of its own: the states of orders it closed, and all those open
    at its end. Nothing else is read, and a day that failed can be written again elsewhere.
    """
    spark = events.sparkSession
    still_open = spark.read.parquet(f"{base}/{OPEN}/day={day_before}")
    today = order_states(events)
    _write(merge_states(still_open.unionByName(today.select(*still_open.columns))), base, day)


def _write(states: DataFrame, base: str, day: str) -> None:
    """Both tables from one pass over the states."""
    spark, path = states.sparkSession, f"{base}/states/day={day}"
    states.write.mode("errorifexists").parquet(path)
    stored = spark.read.parquet(path)
    for name, condition in ((OPEN, is_open()), (CLOSED, ~is_open())):
        stored.where(condition).write.mode("errorifexists").parquet(f"{base}/{name}/day={day}")


def lives_until(spark: SparkSession, base: str, day: str, by_fill: bool = False) -> DataFrame:
    """The lifecycle table of all events up to and including a day.

    An order that had events after it was closed is merged with its earlier state.
    """
    closed = spark.read.parquet(f"{base}/{CLOSED}").where(F.col("day") <= day).drop("day")
    still_open = spark.read.parquet(f"{base}/{OPEN}/day={day}")
    states = merge_states(closed.unionByName(still_open.select(*closed.columns)))
    return lives(states, by_fill=by_fill)
