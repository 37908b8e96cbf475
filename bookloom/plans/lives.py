"""Questions on the lifecycle table (one row per order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions import lives as L
from bookloom.functions.numbers import ratio, round_to, share
from bookloom.functions.sessions import session_window
from bookloom.operators.ranks import exact_median, largest, slotted


def _pct(part: Column, whole: Column, places: int = 2) -> Column:
    return round_to(share(part, whole), places)


def _pct_of_all(column: str) -> Column:
    """Percentage of the column's total, for grouped frames with a handful of labels."""
    return _pct(F.col(column), F.sum(column).over(Window.partitionBy()))


LIFETIME = "lifetime_seconds"


def _mean_lifetime() -> Column:
    return ratio(F.sum("_seconds"), F.sum("_in_slot"))


def _slots(lives: DataFrame, *more: Column) -> DataFrame:
    """Orders per slot of the lifetime, with sums; the median starts from them."""
    return slotted(lives, LIFETIME, [], F.sum(LIFETIME).alias("_seconds"), *more)


def _median_lifetime(lives: DataFrame, slots: DataFrame) -> Column:
    """Exact median lifetime, as a scalar subquery."""
    return exact_median(lives, LIFETIME, slots=slots).scalar()


# Checks


def lifecycle_summary(lives: DataFrame) -> DataFrame:
    """Totals, typical values, and counters of impossible or odd lives."""
    open_ended = F.expr(f"NOT ({L.TRADED} OR {L.CANCELLED} OR {L.EXPIRED})")
    overfilled = F.expr(f"{L.TRADED} AND traded_lots > original_qty * 1.05D")
    flags = ["ever_traded", "ever_cancelled", "ever_expired"]
    odd = {
        "n_no_terminal_event": open_ended,
        "sanity_neg_lifetime": F.col(LIFETIME) < 0,
        "sanity_neg_fill_lag": F.expr("time_to_first_fill_seconds < 0"),
        "sanity_overfilled": overfilled,
    }
    counts = {
        "total_orders": F.count("*"),
        **{f"n_{c}": F.sum(c) for c in flags},
        "_events": F.sum("event_count"),
        **{name: F.count_if(condition) for name, condition in odd.items()},
    }
    slots = _slots(lives, *[c.alias(name) for name, c in counts.items()])
    total = {name: F.sum(name) for name in counts}
    # Counts of no orders are 0.
    zero = {name: F.coalesce(total[name], F.lit(0)).alias(name) for name in ("total_orders", *odd)}
    return slots.agg(
        zero["total_orders"],
        *[total[f"n_{c}"].alias(f"n_{c}") for c in flags],
        zero["n_no_terminal_event"],
        round_to(_mean_lifetime(), 3).alias("avg_lifetime_s"),
        round_to(ratio(total["_events"], total["total_orders"]), 2).alias("avg_events_per_order"),
        *[zero[name] for name in odd if name.startswith("sanity")],
    ).withColumn("median_lifetime_s", round_to(_median_lifetime(lives, slots), 3))


def flag_distribution(lives: DataFrame) -> DataFrame:
    flags = ["ever_traded", "ever_cancelled", "ever_expired"]
    return (
        lives.groupBy(*flags)
        .agg(F.count("*").alias("n_orders"))
        .withColumn("pct", _pct_of_all("n_orders"))
        .orderBy(*[F.col(f).desc() for f in flags])
    )


# Shares by class


def _shares(lives: DataFrame, label: Column, name: str, lots: str = "total_lots") -> DataFrame:
    """Orders and submitted lots per class, with shares of the whole."""
    return (
        lives.groupBy(label.alias(name))
        .agg(F.count("*").alias("n_orders"), F.sum("original_qty").alias("_lots"))
        .select(
            name,
            "n_orders",
            _pct_of_all("n_orders").alias("pct_orders"),
            round_to(F.col("_lots"), 0).alias(lots),
            _pct_of_all("_lots").alias("pct_lots"),
        )
    )


def lifetime_buckets(lives: DataFrame) -> DataFrame:
    return _shares(lives, L.lifetime_bucket(), "lifetime_bucket").orderBy("lifetime_bucket")


def lifetime_stats(lives: DataFrame) -> DataFrame:
    """Mean and median lifetime and how far they are apart (median of at least 1 ms)."""
    slots = _slots(lives)
    stats = slots.agg(round_to(_mean_lifetime(), 2).alias("mean_lifetime_s")).withColumn(
        "median_lifetime_s", round_to(_median_lifetime(lives, slots), 2)
    )
    gap = ratio(F.col("mean_lifetime_s"), F.greatest(F.col("median_lifetime_s"), F.lit(0.001)))
    return stats.withColumn("mean_to_median", gap)


def lifetime_chart(buckets: DataFrame) -> DataFrame:
    """Known buckets with their display text."""
    return _with_text(
        buckets.where(F.col("lifetime_bucket") != L.UNKNOWN_BUCKET),
        "lifetime_bucket",
        L.BUCKET_TEXT,
    )


def _with_text(frame: DataFrame, column: str, texts: dict[str, str]) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    return frame.withColumn("label", F.try_element_at(names, F.col(column)))


def behavior_classes(lives: DataFrame) -> DataFrame:
    return _shares(lives, L.behavior_class(), "behavior_class").orderBy(
        F.col("pct_orders").desc(), "behavior_class"
    )


def behavior_chart(classes: DataFrame) -> DataFrame:
    """Classes in display order."""
    place = F.array_position(F.array(*[F.lit(c) for c in L.CLASS_ORDER]), F.col("behavior_class"))
    return classes.withColumn("position", place.cast("int")).orderBy("position")


def fleeting_by_stock(lives: DataFrame, k: int = 15) -> DataFrame:
    """Stocks with most fast-trader-like orders, next to all their orders."""
    stocks = lives.groupBy("stock").agg(
        F.count_if(L.is_fleeting()).alias("hft_orders"), F.count("*").alias("total_orders")
    )
    # A scalar subquery over the same grouped rows, whose shuffle is reused.
    market = stocks.agg(F.sum("hft_orders")).scalar()
    return largest(stocks.where(F.col("hft_orders") > 0), "hft_orders", "stock", k).select(
        "stock",
        "hft_orders",
        "total_orders",
        _pct(F.col("hft_orders"), F.col("total_orders")).alias("hft_pct_of_stock"),
        _pct(F.col("hft_orders"), market).alias("pct_of_all_hft"),
    )


def liquidity(lives: DataFrame) -> DataFrame:
    classes = lives.groupBy(L.liquidity_class().alias("liquidity_class")).agg(
        F.count("*").alias("n_orders"),
        F.sum("original_qty").alias("_lots"),
        F.sum("traded_lots").alias("_traded"),
    )
    return classes.select(
        "liquidity_class",
        "n_orders",
        _pct_of_all("n_orders").alias("pct_orders"),
        round_to(F.col("_lots"), 0).alias("total_submitted_lots"),
        round_to(F.col("_traded"), 0).alias("total_traded_lots"),
        _pct_of_all("_lots").alias("pct_submitted_lots"),
    ).orderBy("liquidity_class")


def traded_lots_source(lives: DataFrame) -> DataFrame:
    """Traded lots of orders filled at once and of resting ones."""
    filled = F.expr(f"{L.TRADED} AND {L.HAS_FILL}")
    return (
        lives.where(filled)
        .groupBy(L.fill_source().alias("source"))
        .agg(F.sum("traded_lots").alias("_traded"))
        .select(
            "source",
            round_to(F.col("_traded"), 0).alias("traded_lots"),
            _pct_of_all("_traded").alias("pct_traded_lots"),
        )
        .orderBy("source")
    )


def passive_share(sources: DataFrame) -> DataFrame:
    """Passive percentage of traded lots and the rest; no row without passive lots."""
    return sources.where(F.col("source") == "passive").select(
        F.col("pct_traded_lots").alias("passive_pct"),
        (F.lit(100.0) - F.col("pct_traded_lots")).alias("aggressive_pct"),
    )


def conversion_funnel(lives: DataFrame) -> DataFrame:
    return _shares(
        lives, L.terminal_state(), "terminal_state", "total_submitted_lots"
    ).orderBy("terminal_state")


def funnel_headline(funnel: DataFrame) -> DataFrame:
    """Share of orders and lots that traded at least in part."""
    traded = F.col("terminal_state").isin("1_fully_filled", "2_partially_filled")
    return funnel.where(traded).agg(
        F.sum("pct_orders").alias("pct_orders"), F.sum("pct_lots").alias("pct_lots")
    )


def funnel_chart(funnel: DataFrame) -> DataFrame:
    return _with_text(funnel, "terminal_state", L.STATE_TEXT)


def resting_vs_outcome(lives: DataFrame) -> DataFrame:
    """Outcome percentages within each known lifetime bucket."""
    outcomes = {
        "pct_fully_filled": "1_fully_filled",
        "pct_partial_fill": "2_partially_filled",
        "pct_cancelled": "3_cancelled_no_fill",
        "pct_expired": "4_expired_no_fill",
        "pct_open": "5_other_open",
    }
    ends = lives.select(L.lifetime_bucket().alias("bucket"), L.terminal_state().alias("state"))
    return (
        ends.where(F.col("bucket") != L.UNKNOWN_BUCKET)
        .groupBy("bucket")
        .agg(
            F.count("*").alias("n_orders"),
            *[
                _pct(F.count_if(F.col("state") == state), F.count("*"), 1).alias(name)
                for name, state in outcomes.items()
            ],
        )
        .orderBy("bucket")
    )


def outcome_observations(outcomes: DataFrame) -> DataFrame:
    """Plain means of bucket percentages: orders below a second, orders over 5 minutes."""

    def mean(column: str, *buckets: str) -> Column:
        return F.avg(F.when(F.col("bucket").isin(*buckets), F.col(column)))

    short, long = ("1_sub_0.1s", "2_0.1-1s"), ("6_5-30min", "7_gt30min")
    return outcomes.agg(
        mean("pct_fully_filled", *short).alias("subsecond_filled_pct"),
        mean("pct_cancelled", *short).alias("subsecond_cancelled_pct"),
        mean("pct_fully_filled", *long).alias("long_filled_pct"),
    )


def fleeting_by_window(lives: DataFrame) -> DataFrame:
    """Fast-trader-like share per birth window (clock only, no session name)."""
    return (
        lives.where(F.col("born_ts").isNotNull())
        .groupBy(session_window("born_ts").alias("time_window"))
        .agg(
            F.count("*").alias("total_orders"),
            F.count_if(L.is_fleeting()).alias("hft_orders"),
        )
        .withColumn("hft_pct", _pct(F.col("hft_orders"), F.col("total_orders")))
        .orderBy("time_window")
    )


def fleeting_peak(windows: DataFrame) -> DataFrame:
    return largest(windows, "hft_pct", "time_window").select(
        "time_window", "hft_pct", "hft_orders"
    )


def fleeting_chart(windows: DataFrame) -> DataFrame:
    """Windows of continuous trading only."""
    return windows.where(~F.col("time_window").isin("A_OPENING", "Z_CLOSING"))


def order_versions(lives: DataFrame, rows: int | None = None) -> DataFrame:
    """Orders per number of improvements; the first rows of the table if so asked."""
    return _first(version_counts(lives, "n_qualifying_improvements", "versions_created"), rows)


def _first(frame: DataFrame, rows: int | None) -> DataFrame:
    return frame if rows is None else frame.limit(rows)


def version_counts(frame: DataFrame, number: str, name: str) -> DataFrame:
    """Orders per version number, with shares.

    N events hold at most sqrt(2 N) different version numbers, so the window
    over all groups stays small.
    """
    return (
        frame.groupBy(F.col(number).alias(name))
        .agg(F.count("*").alias("n_orders"))
        .withColumn("pct_of_orders", _pct_of_all("n_orders"))
        .orderBy(F.col(name).asc_nulls_last())
    )


def improved_share(frame: DataFrame, number: str) -> DataFrame:
    """Orders, those improved at least once, and their share; over all orders."""
    return frame.agg(
        F.count("*").alias("total_orders"),
        F.count_if(F.col(number) > 0).alias("improved_orders"),
    ).withColumn(
        "pct_improved",
        F.coalesce(share(F.col("improved_orders"), F.col("total_orders")), F.lit(0.0)),
    )
