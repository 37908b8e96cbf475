"""Samples and lookups that keep all events of the orders they pick."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions import events as E
from bookloom.functions.keys import SLOTS, key_slot, order_hash
from bookloom.functions.numbers import round_to

# Column of a stored table that its folders are named by.
SLOT = "key_slot"


def one_in(fraction: float) -> int:
    return max(1, round(1.0 / fraction))


def sample_orders(events: DataFrame, fraction: float) -> DataFrame:
    """About this fraction of the orders, each with all its events.

    The choice depends on the order id alone, so it is the same in every run
    and every table. From a stored table only the folders are read that can hold
    chosen orders: one in a hundred for a sample of 1 %.
    """
    n = one_in(fraction)
    if n == 1:
        return events
    chosen = order_hash("order_id") % n == 0
    if SLOT in events.columns:
        chosen &= F.col(SLOT) % gcd(n, SLOTS) == 0
    return events.where(chosen)


def lookup_order(events: DataFrame, order_id: str) -> DataFrame:
    """Events of one order; the filter reaches the scan.

    Of a stored table it names the folder, and the files' bloom filters on the id spare
    most of their row groups.
    """
    wanted = F.col("order_id") == order_id
    if SLOT in events.columns:
        wanted &= F.col(SLOT) == key_slot(F.lit(order_id))
    return events.where(wanted)


def _keyed(orders: DataFrame, events: DataFrame) -> tuple[DataFrame, list[str]]:
    """Chosen orders with the columns to join the events by.

    With the slot among them, the folders of a stored table are pruned by the chosen
    orders while the query runs.
    """
    if SLOT not in events.columns:
        return orders, ["order_id"]
    return orders.withColumn(SLOT, key_slot("order_id")), ["order_id", SLOT]


def events_of(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Events whose order_id is listed; the ids stay in Spark."""
    listed, keys = _keyed(orders.select("order_id"), events)
    return events.join(listed, keys, "left_semi").select(*events.columns)


def modified_orders(events: DataFrame, min_replacements: int = 3, n: int = 5) -> DataFrame:
    """The first n orders that were replaced at least this often.

    If no order was, those replaced at least twice.
    """
    counts = (
        events.where(E.is_regular() & E.is_replace())
        .groupBy("order_id")
        .agg(F.count("*").alias("n_replaced"))
        .where(F.col("n_replaced") >= min(2, min_replacements))
    )
    # Orders reaching the wanted number come first; the others only count
    # when the first row shows there is none.
    reached = F.col("n_replaced") >= min_replacements
    picked = counts.orderBy(
        F.when(reached, 0).otherwise(1), F.col("order_id").asc_nulls_last()
    ).limit(n)
    most = F.max("n_replaced").over(Window.partitionBy())  # over n rows
    return (
        picked.withColumn("_most", most)
        .where(reached | (F.col("_most") < min_replacements))
        .select("order_id")
    )


# The groups of orders shown next to their raw events. They
# exclude each other.
SAMPLE_GROUPS = {
    "TRADED": "ever_traded = 1 AND original_qty > 0",
    "CANCELLED, no fill": "ever_cancelled = 1 AND ever_traded = 0 AND ever_expired = 0",
    "EXPIRED, no fill": "ever_expired = 1 AND ever_traded = 0",
}


def sample_lives(lives: DataFrame, n: int = 3) -> DataFrame:
    """The first n orders of each group, as lifecycle rows.

    One pass labels them; every task keeps at most n rows per group before the
    shuffle.
    """
    whens = " ".join(f"WHEN {test} THEN '{name}'" for name, test in SAMPLE_GROUPS.items())
    label = F.expr(f"CASE {whens} END")
    by_id = Window.partitionBy("sample").orderBy(F.col("order_id").asc_nulls_last())
    rows = (
        lives.withColumn("sample", label)
        .where(F.col("sample").isNotNull())
        .withColumn("_rank", F.row_number().over(by_id))
        .where(F.col("_rank") <= n)
    )
    return rows.select(
        "sample",
        "order_id",
        "stock",
        "side",
        "born_ts",
        "first_fill_ts",
        "last_event_ts",
        "original_qty",
        "traded_lots",
        "event_count",
        round_to("lifetime_seconds", 3).alias("lifetime_s"),
        round_to("time_to_first_fill_seconds", 3).alias("fill_lag_s"),
        "ever_traded",
        "ever_cancelled",
        "ever_expired",
    )


def sample_raw_events(events: DataFrame, samples: DataFrame) -> DataFrame:
    """Events of the sampled orders (a row per group an order was picked for)."""
    picked, keys = _keyed(samples.select("sample", "order_id"), events)
    return (
        events.where(E.is_regular())
        .join(picked, keys)
        .select(
            "sample",
            "order_id",
            "change_reason",
            "entry_ts",
            "change_ts",
            "qty",
            "remaining",
            round_to("price", 4).alias("price"),
            "session",
        )
    )
