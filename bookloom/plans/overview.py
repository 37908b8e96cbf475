"""Market-level questions on order events.

Additive questions work on *facts*: one row per event with its labels, its
measures and a weight ``n``. ``facts`` derives them row by row (unused columns
are pruned), ``fact_cube`` sums them over all labels in one pass; every
question gives the same answer on either, so a full report reads the events
once for all of them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom import schema as S
from bookloom.functions import events as E
from bookloom.functions.numbers import (
    minute_number,
    minute_start,
    ratio,
    round_to,
    share,
    share_or_zero,
)
from bookloom.functions.sessions import broad_session, session_window
from bookloom.operators.ranks import approximate_median, exact_median, largest, slotted, total_before
from bookloom.operators.versions import with_fills

LABELS = (
    "stock",
    "side",
    "change_reason",
    "entry_window",
    "change_window",
    "is_limit",
    "is_iceberg",
    "has_size",
)
MEASURES = ("n", "lots", "tl", "left_lots", "left_tl", "traded_lots", "traded_tl")
CLOSING = "Z_CLOSING"


def facts(events: DataFrame, by_day: bool = False, by_fill: bool = False) -> DataFrame:
    """Labels and measures of every regular event; with the day of entry if so asked.

    Sums of traded lots count an order's earlier fills again with every later one, as
    its events hold totals; ``by_fill`` takes the lots of each fill alone.
    """
    day = [F.to_date("entry_ts").alias("trade_date")] if by_day else []
    traded = "qty - remaining"
    if by_fill:
        events, traded = with_fills(events), "fill_lots"
    return events.where(E.is_regular()).select(
        *day,
        "stock",
        "side",
        "change_reason",
        session_window("entry_ts", "session").alias("entry_window"),
        session_window("change_ts", "session").alias("change_window"),
        F.expr(f"coalesce(order_type = {S.LIMIT_ORDER}, false) AS is_limit"),
        E.is_iceberg().alias("is_iceberg"),
        F.expr("coalesce(qty > 0, false) AS has_size"),
        F.expr("1L AS n"),
        F.expr("qty AS lots"),
        F.expr("order_tl AS tl"),
        F.expr("remaining AS left_lots"),
        F.expr("remaining * price AS left_tl"),
        F.expr(f"{traded} AS traded_lots"),
        F.expr(f"({traded}) * price AS traded_tl"),
    )


def fact_cube(events: DataFrame, by_day: bool = False, by_fill: bool = False) -> DataFrame:
    """Facts summed over all labels: a few thousand rows per stock (and day) at most."""
    labels = ["trade_date", *LABELS] if by_day else LABELS
    return facts(events, by_day, by_fill).groupBy(*labels).agg(*[F.sum(m).alias(m) for m in MEASURES])


def _count(column: str | Column = "n") -> Column:
    return F.coalesce(F.sum(column), F.lit(0).cast("bigint"))


def _by_label(frame: DataFrame, label: str) -> DataFrame:
    return frame.orderBy(F.col(label).asc_nulls_last())


def new_orders(fact: DataFrame) -> DataFrame:
    return fact.where(E.is_new())


def cancellations(fact: DataFrame) -> DataFrame:
    return fact.where(E.is_cancel())


def long_form(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Several tables as one: ``question``, ``label``, ``measure`` and ``value``.

    Text columns make the label, all others are measures. Made from one cube, the
    tables share its shuffle.
    """
    long = None
    for name, frame in tables.items():
        texts = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.StringType)]
        measures = [c for c in frame.columns if c not in texts]
        rows = frame.select(
            F.concat_ws(" ", *texts).alias("label"),
            *[F.col(m).cast("double").alias(m) for m in measures],
        ).unpivot("label", measures, "measure", "value")
        rows = rows.select(F.lit(name).alias("question"), "label", "measure", "value")
        long = rows if long is None else long.unionByName(rows)
    return long


# Submission


def new_order_totals(fact: DataFrame) -> DataFrame:
    return new_orders(fact).agg(
        _count().alias("new_order_count"),
        F.sum("lots").alias("total_lots"),
        F.sum("tl").alias("total_tl"),
    )


def buy_sell(fact: DataFrame) -> DataFrame:
    """Count, lots and value by side, with shares."""
    new = new_orders(fact)
    sides = new.groupBy("side").agg(
        _count().alias("count"), F.sum("lots").alias("total_lots"), F.sum("tl").alias("total_tl")
    )
    # One row per side, so a window over all of them is small.
    every = Window.partitionBy()
    return _by_label(
        sides.select(
            "side",
            "count",
            share(F.col("count"), F.sum("count").over(every)).alias("pct_count"),
            "total_lots",
            share(F.col("total_lots"), F.sum("total_lots").over(every)).alias("pct_lots"),
            "total_tl",
            share(F.col("total_tl"), F.sum("total_tl").over(every)).alias("pct_tl"),
        ),
        "side",
    )


def top_stocks(fact: DataFrame, k: int = 10) -> DataFrame:
    """The k stocks with the largest submitted value, and their shares of the market."""
    stocks = (
        new_orders(fact)
        .groupBy("stock")
        .agg(F.sum("lots").alias("lots"), F.sum("tl").alias("tl"))
    )
    # A scalar subquery over the same grouped rows, whose shuffle is reused.
    market = stocks.agg(F.struct(F.sum("lots").alias("lots"), F.sum("tl").alias("tl"))).scalar()
    return largest(stocks, "tl", "stock", k).select(
        "stock",
        "lots",
        share(F.col("lots"), market["lots"]).alias("pct_lots"),
        "tl",
        share(F.col("tl"), market["tl"]).alias("pct_tl"),
    )


def top_stocks_share(fact: DataFrame, k: int = 10) -> DataFrame:
    return top_stocks(fact, k).agg(
        F.sum("pct_lots").alias("top_pct_lots"), F.sum("pct_tl").alias("top_pct_tl")
    )


def window_volumes(fact: DataFrame) -> DataFrame:
    """New orders per trading window, of each day where the facts have the day.

    There are some twenty windows; shares are of the day, or of everything.
    """
    day = [c for c in ("trade_date",) if c in fact.columns]
    windows = (
        new_orders(fact)
        .groupBy(*day, F.col("entry_window").alias("time_window"))
        .agg(
            _count().alias("order_count"),
            F.sum("lots").alias("total_lots"),
            F.sum("tl").alias("total_tl"),
        )
    )
    every = Window.partitionBy(*day)
    shares = windows.select(
        *day,
        "time_window",
        "order_count",
        share(F.col("order_count"), F.sum("order_count").over(every)).alias("pct_count"),
        "total_lots",
        "total_tl",
        share(F.col("total_tl"), F.sum("total_tl").over(every)).alias("pct_tl"),
    )
    return shares.orderBy(*[F.col(c).asc_nulls_last() for c in (*day, "time_window")])


def window_peaks(fact: DataFrame) -> DataFrame:
    """The busiest window by orders and by value; the first one wins a tie."""
    windows = window_volumes(fact)
    by_count = largest(windows, "order_count", "time_window").select(
        F.lit("order_count").alias("measure"),
        "time_window",
        F.col("order_count").cast("double").alias("peak"),
        F.col("pct_count").alias("pct"),
    )
    by_value = largest(windows, "total_tl", "time_window").select(
        F.lit("total_tl").alias("measure"),
        "time_window",
        F.col("total_tl").alias("peak"),
        F.col("pct_tl").alias("pct"),
    )
    return by_count.unionByName(by_value)


def window_counts(fact: DataFrame) -> DataFrame:
    """Orders per window, busiest first."""
    return (
        new_orders(fact)
        .groupBy(F.col("entry_window").alias("time_window"))
        .agg(_count().alias("order_count"))
        .orderBy(F.col("order_count").desc(), F.col("time_window").asc_nulls_last())
    )


def busiest_to_calmest(fact: DataFrame) -> DataFrame:
    """Busiest and calmest window and the ratio of their orders; no rows, no result."""
    label = F.struct(F.col("time_window").isNull(), F.col("time_window"))
    count = F.col("order_count")
    edges = window_counts(fact).agg(
        F.min(F.struct(-count, label, "time_window")).alias("top"),
        F.min(F.struct(count, label, "time_window")).alias("low"),
    )
    busiest, calmest = -F.col("top.col1"), F.col("low.order_count")
    return edges.where(F.col("top").isNotNull()).select(
        F.col("top.time_window").alias("busiest"),
        busiest.alias("busiest_count"),
        F.col("low.time_window").alias("calmest"),
        calmest.alias("calmest_count"),
        ratio(busiest, calmest).alias("ratio"),
    )


def order_types(fact: DataFrame) -> DataFrame:
    """Limit and iceberg orders among new orders, by count and lots."""
    some = new_orders(fact).agg(
        _count().alias("total_new"),
        F.sum("lots").alias("total_lots"),
        F.sum(F.when(F.col("is_limit"), F.col("n")).otherwise(0)).alias("limit_count"),
        F.sum(F.when(F.col("is_limit"), F.col("lots")).otherwise(0.0)).alias("limit_lots"),
        F.sum(F.when(F.col("is_iceberg"), F.col("n")).otherwise(0)).alias("iceberg_count"),
        F.sum(
            F.when(F.col("is_iceberg"), F.col("lots")).when(F.col("lots").isNotNull(), 0.0)
        ).alias("iceberg_lots"),
    )

    def pct(part: str, whole: str) -> Column:
        return share(F.col(part), F.col(whole))

    return some.select(
        "total_new",
        "total_lots",
        "limit_count",
        pct("limit_count", "total_new").alias("limit_pct_count"),
        "limit_lots",
        pct("limit_lots", "total_lots").alias("limit_pct_lots"),
        "iceberg_count",
        pct("iceberg_count", "total_new").alias("iceberg_pct_count"),
        "iceberg_lots",
        pct("iceberg_lots", "total_lots").alias("iceberg_pct_lots"),
    )


# Cancellation and trading


def cancel_totals(fact: DataFrame) -> DataFrame:
    return cancellations(fact).agg(
        _count().alias("cancelled_events"),
        F.sum("left_lots").alias("cancelled_lots"),
        F.sum("left_tl").alias("cancelled_tl"),
    )


def expiry_breakdown(fact: DataFrame) -> DataFrame:
    return _by_label(
        cancellations(fact)
        .groupBy(E.cancel_type().alias("cancel_type"))
        .agg(
            _count().alias("events"),
            F.sum("left_lots").alias("lots"),
            F.sum("left_tl").alias("tl"),
        ),
        "cancel_type",
    )


def cancel_windows(fact: DataFrame) -> DataFrame:
    """Cancellations per window of the event time."""
    return _by_label(
        cancellations(fact)
        .groupBy(F.col("change_window").alias("time_window"))
        .agg(
            _count().alias("cancelled_count"),
            F.sum("left_lots").alias("cancelled_lots"),
            F.sum("left_tl").alias("cancelled_tl"),
        ),
        "time_window",
    )


def cancel_peak(fact: DataFrame) -> DataFrame:
    return largest(cancel_windows(fact), "cancelled_count", "time_window").select(
        "time_window", "cancelled_count"
    )


def _stock_ratios(fact: DataFrame) -> DataFrame:
    return (
        fact.groupBy("stock")
        .agg(
            F.sum(F.when(E.is_cancel(), F.col("left_lots")).otherwise(0.0)).alias("cancelled_lots"),
            F.sum(F.when(E.is_trade(), F.col("traded_lots")).otherwise(0.0)).alias("traded_lots"),
        )
        .where(F.col("traded_lots") > 0)
        .withColumn(
            "cancel_to_trade_ratio",
            round_to(ratio(F.col("cancelled_lots"), F.col("traded_lots")), 4),
        )
    )


def cancel_to_trade(fact: DataFrame) -> DataFrame:
    """Cancelled to traded lots per traded stock, highest first."""
    return _stock_ratios(fact).orderBy(
        F.col("cancel_to_trade_ratio").desc_nulls_last(), F.col("stock").asc_nulls_last()
    )


def cancel_to_trade_top(fact: DataFrame, k: int = 10) -> DataFrame:
    return largest(_stock_ratios(fact), "cancel_to_trade_ratio", "stock", k)


def cancel_to_trade_bottom(fact: DataFrame, k: int = 10) -> DataFrame:
    """The last k rows of cancel_to_trade (equal ratios: the later stocks)."""
    return (
        _stock_ratios(fact)
        .orderBy(F.col("cancel_to_trade_ratio").asc_nulls_first(), F.col("stock").desc_nulls_first())
        .limit(k)
    )


def cancel_rate(fact: DataFrame) -> DataFrame:
    """Cancelled as a percentage of submitted lots and value; 0 without any."""

    def total(condition: Column, measure: str) -> Column:
        return F.sum(F.when(condition, F.col(measure)).otherwise(0.0))

    sums = fact.agg(
        total(E.is_new(), "lots").alias("new_lots"),
        total(E.is_new(), "tl").alias("new_tl"),
        total(E.is_cancel(), "left_lots").alias("cancel_lots"),
        total(E.is_cancel(), "left_tl").alias("cancel_tl"),
    )
    return sums.select(
        "*",
        share_or_zero("cancel_lots", "new_lots").alias("pct_lots"),
        share_or_zero("cancel_tl", "new_tl").alias("pct_tl"),
    )


def _top_by(fact: DataFrame, condition: Column, measure: str, key: str, k: int) -> DataFrame:
    sums = fact.where(condition).groupBy(F.col(key).alias("label")).agg(F.sum(measure).alias("tl"))
    return largest(sums, "tl", "label", k)


def volume_overlap(fact: DataFrame, k: int = 10) -> DataFrame:
    """Top k stocks by submitted and by traded value: in both lists or in one."""
    ordered = _top_by(fact, E.is_new(), "tl", "stock", k).select("label")
    traded = _top_by(fact, E.is_trade(), "traded_tl", "stock", k).select("label")
    marked = ordered.withColumn("list", F.lit("order_only")).unionByName(
        traded.withColumn("list", F.lit("trade_only"))
    )
    lists = marked.groupBy("label").agg(F.count("*").alias("n"), F.max("list").alias("only"))
    return lists.select(
        F.when(F.col("n") == 2, F.lit("both")).otherwise(F.col("only")).alias("category"),
        F.col("label").alias("stock"),
    )


def volume_overlap_lists(fact: DataFrame, k: int = 10) -> DataFrame:
    """The overlap as one row per category with a sorted list of at most k stocks."""
    lists = volume_overlap(fact, k).agg(
        *[
            F.array_sort(
                F.collect_list(F.when(F.col("category") == c, F.col("stock")))
            ).alias(c)
            for c in ("order_only", "both", "trade_only")
        ]
    )
    return lists.select(
        F.explode(
            F.create_map(
                *[x for c in ("order_only", "both", "trade_only") for x in (F.lit(c), F.col(c))]
            )
        ).alias("category", "stocks")
    )


def peak_windows(fact: DataFrame) -> DataFrame:
    """Window with most submitted and with most traded value; no row without trades."""
    order = _top_by(fact, E.is_new(), "tl", "entry_window", 1)
    trade = _top_by(fact, E.is_trade(), "traded_tl", "change_window", 1)
    found = order.withColumn("kind", F.lit("order")).unionByName(
        trade.withColumn("kind", F.lit("trade"))
    )

    def of(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    both = found.agg(
        F.count("*").alias("_kinds"),
        of("order", "label").alias("peak_order_window"),
        of("order", "tl").alias("peak_order_tl"),
        of("trade", "label").alias("peak_trade_window"),
        of("trade", "tl").alias("peak_trade_tl"),
    )
    same = F.col("peak_order_window").eqNullSafe(F.col("peak_trade_window"))
    return both.where(F.col("_kinds") == 2).drop("_kinds").withColumn("same_window", same)


def concentration(fact: DataFrame) -> DataFrame:
    """How many equities make half, and 80 %, of the submitted value.

    ``stocks_for_*`` follow the established report, which is one too high: the
    stock that crosses the line is counted, then one is added. ``*_exact`` leave
    that one out.
    """
    stocks = (
        new_orders(fact)
        .where(F.col("stock").like(S.EQUITY_TICKER))
        .groupBy("stock")
        .agg(F.sum("tl").alias("tl"))
    )
    ranked = total_before(stocks, "tl", "stock")

    def needed(part: float) -> Column:
        known = F.col("tl").isNotNull()
        return F.count_if(known & (F.col("total_before") < F.col("total_all") * part))

    return ranked.agg(
        F.count("*").alias("total_stocks"),
        (needed(0.5) + 1).alias("stocks_for_50pct"),
        (needed(0.8) + 1).alias("stocks_for_80pct"),
        needed(0.5).alias("stocks_for_50pct_exact"),
        needed(0.8).alias("stocks_for_80pct_exact"),
    )


def average_lots(fact: DataFrame) -> DataFrame:
    """Mean order size per window over orders with a size, largest mean first."""
    windows = (
        new_orders(fact)
        .where("has_size")
        .groupBy(F.col("entry_window").alias("time_window"))
        .agg(_count().alias("order_count"), F.sum("lots").alias("total_lots"))
    )
    return windows.select(
        "time_window",
        "order_count",
        ratio(F.col("total_lots"), F.col("order_count")).alias("avg_lots_per_order"),
        "total_lots",
    ).orderBy(F.col("avg_lots_per_order").desc(), F.col("time_window").asc_nulls_last())


def average_lots_peak(fact: DataFrame) -> DataFrame:
    return largest(average_lots(fact), "avg_lots_per_order", "time_window").select(
        "time_window", "avg_lots_per_order"
    )


# Questions that need single events


def _new_events(events: DataFrame) -> DataFrame:
    return events.where(E.is_regular() & E.is_new())


def order_size(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Count, mean, median, smallest and largest value by broad session.

    The exact median takes a second look at the events for the middle slot's values;
    the approximate one comes from sketches in the same pass as the rest.
    """
    sized = (
        _new_events(events)
        .where(F.col("order_tl") > 0)
        .select(broad_session("entry_ts", "session").alias("period"), "order_tl")
    )
    ends = [F.min("order_tl").alias("min_order_tl"), F.max("order_tl").alias("max_order_tl")]
    if approximate:
        sizes = sized.groupBy("period").agg(
            F.count("*").alias("order_count"),
            F.avg("order_tl").alias("avg_order_tl"),
            approximate_median("order_tl").alias("median_order_tl"),
            *ends,
        )
    else:
        slots = slotted(sized, "order_tl", ["period"], F.sum("order_tl").alias("_sum"), *ends)
        spread = slots.groupBy("period").agg(
            F.sum("_in_slot").alias("order_count"),
            ratio(F.sum("_sum"), F.sum("_in_slot")).alias("avg_order_tl"),
            F.min("min_order_tl").alias("min_order_tl"),
            F.max("max_order_tl").alias("max_order_tl"),
        )
        middle = exact_median(sized, "order_tl", ["period"], slots)  # three periods
        sizes = spread.join(middle, "period").withColumnRenamed("median", "median_order_tl")
    columns = ["order_count", "avg_order_tl", "median_order_tl", "min_order_tl", "max_order_tl"]
    return _by_label(sizes.select("period", *columns), "period")


def order_size_chart(sizes: DataFrame) -> DataFrame:
    """Mean and median per session in display order."""
    return sizes.select(
        F.substring_index("period", "_", 1).cast("int").alias("position"),
        F.substring_index("period", "_", -1).alias("label"),
        "avg_order_tl",
        "median_order_tl",
    ).orderBy("position")


def largest_orders_windows(events: DataFrame, k: int = 100) -> DataFrame:
    """Windows of the k largest new orders (equal sizes in order of the id)."""
    columns = ["order_id", *(["event_id"] if "event_id" in events.columns else [])]
    window = session_window("entry_ts", "session").alias("time_window")
    top = (
        _new_events(events)
        .where(F.col("qty") > 0)
        .select("qty", window, *columns)
        .orderBy(F.col("qty").desc(), *[F.col(c).asc_nulls_last() for c in columns])
        .limit(k)
    )
    return _by_label(
        top.groupBy("time_window").agg(
            F.count("*").alias("count"), F.sum("qty").alias("total_lots")
        ),
        "time_window",
    )


def largest_orders_closing(events: DataFrame, k: int = 100) -> DataFrame:
    """How many of the k largest orders came in the closing auction, with their lots."""
    closing = F.col("time_window") == CLOSING
    return largest_orders_windows(events, k).agg(
        _count(F.when(closing, F.col("count"))).alias("closing_count"),
        F.coalesce(F.sum(F.when(closing, F.col("total_lots"))), F.lit(0.0)).alias("closing_lots"),
    )


MINUTES_PER_BLOCK = 1440


def rolling_intensity(events: DataFrame, window_minutes: int = 30) -> DataFrame:
    """Orders, lots and value of the trailing window, at each minute with an order.

    Both ends count: with 30 minutes, up to 31 minute bins. Minutes are spread
    over day blocks; those within reach of the next block are also given to
    it, so each block is complete on its own and no window is cut at midnight.
    """
    minutes = (
        _new_events(events)
        .where(F.col("entry_ts").isNotNull())
        .groupBy(minute_number("entry_ts").alias("minute"))
        .agg(
            F.count("*").alias("orders"),
            F.sum("qty").alias("lots"),
            F.sum("order_tl").alias("tl"),
        )
    )

    def block(minute: Column) -> Column:
        return F.floor(minute / MINUTES_PER_BLOCK)

    minute = F.col("minute")
    spread = minutes.select(
        "*",
        block(minute).alias("home"),
        F.explode(F.sequence(block(minute), block(minute + window_minutes))).alias("block"),
    )
    trailing = Window.partitionBy("block").orderBy("minute").rangeBetween(-window_minutes, 0)
    return (
        spread.select(
            "home",
            "block",
            minute_start("minute").alias("minute_ts"),
            F.sum("orders").over(trailing).alias("rolling_order_count"),
            F.sum("lots").over(trailing).alias("rolling_lots"),
            F.sum("tl").over(trailing).alias("rolling_tl"),
        )
        .where(F.col("home") == F.col("block"))
        .drop("home", "block")
        .orderBy("minute_ts")
    )


def rolling_peak(events: DataFrame, window_minutes: int = 30) -> DataFrame:
    return largest(
        rolling_intensity(events, window_minutes), "rolling_order_count", "minute_ts"
    ).select("minute_ts", "rolling_order_count", "rolling_lots")
