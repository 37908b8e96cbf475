"""The named queries, each from a folder of tables to a result frame.

Sums and means of doubles depend on the order of addition in the last digits,
so they are rounded here (not in the plans) to make results comparable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom import schema as S
from bookloom.functions import events as E
from bookloom.functions.numbers import round_to
from bookloom.functions.sessions import broad_session, session_window
from bookloom.operators import samples, versions
from bookloom.operators.lifecycle import lifecycle_table, lives as lives_of, merge_states, order_states
from bookloom.operators.ranks import largest
from bookloom.operators.staging import shared_folder
from bookloom.plans import lives, overview, repricing
from bookloom.sources.activity import load_order_events, raw_lines, raw_text
from bookloom.sources.order_files import REJECTED, parse_lines, scan_losses, typed_events
from bookloom.sources.sinks import finish_run, read_run, run_folder, write_results

Query = Callable[[SparkSession, str], DataFrame]

# Additive tables: the plan, its sums and its percentages.
ADDITIVE: dict[str, tuple[Callable[[DataFrame], DataFrame], tuple[str, ...], tuple[str, ...]]] = {
    "q01_new_orders": (overview.new_order_totals, ("total_lots", "total_tl"), ()),
    "q02_buy_sell": (
        overview.buy_sell,
        ("total_lots", "total_tl"),
        ("pct_count", "pct_lots", "pct_tl"),
    ),
    "q03_top_stocks": (overview.top_stocks, ("lots", "tl"), ("pct_lots", "pct_tl")),
    "q04_windows": (
        overview.window_volumes,
        ("total_lots", "total_tl"),
        ("pct_count", "pct_tl"),
    ),
    "q05_order_types": (
        overview.order_types,
        (),
        ("limit_pct_count", "limit_pct_lots", "iceberg_pct_count", "iceberg_pct_lots"),
    ),
    "q06_window_counts": (overview.window_counts, (), ()),
    "q07_cancellations": (overview.cancel_totals, ("cancelled_lots", "cancelled_tl"), ()),
    "q07b_expiry_breakdown": (overview.expiry_breakdown, ("lots", "tl"), ()),
    "q08_cancel_windows": (overview.cancel_windows, ("cancelled_lots", "cancelled_tl"), ()),
    "q09_ratio": (overview.cancel_to_trade, ("cancelled_lots", "traded_lots"), ()),
    "q10_cancel_rate": (
        overview.cancel_rate,
        ("new_lots", "new_tl", "cancel_lots", "cancel_tl"),
        ("pct_lots", "pct_tl"),
    ),
    "q13_concentration": (overview.concentration, (), ()),
    "q14_avg_lots": (overview.average_lots, ("avg_lots_per_order", "total_lots"), ()),
}

SUM_PLACES = 3
PCT_PLACES = 6
# Rows of the printed version tables; the full tables are registered as well.
FIRST_ROWS = 15
# An order of the test table, looked up by its id.
KNOWN_ORDER = "O7-2024-01-05"
# Rows of a piece that cut even small orders.
CUT_ABOVE = 3


def settle(frame: DataFrame, *sums: str, pct: tuple[str, ...] = ()) -> DataFrame:
    """Round sums to 3 places and percentages to 6."""
    if not sums and not pct:
        return frame
    return frame.withColumns(
        {
            **{c: round_to(c, SUM_PLACES) for c in sums},
            **{c: round_to(c, PCT_PLACES) for c in pct},
        }
    )


def _on_events(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(load_order_events(spark, sf_dir))


def _on_facts(
    plan: Callable[[DataFrame], DataFrame], *sums: str, pct: tuple[str, ...] = ()
) -> Query:
    return _on_events(lambda ev: settle(plan(overview.facts(ev)), *sums, pct=pct))


def _on_lives(
    plan: Callable[[DataFrame], DataFrame],
    *,
    pct: tuple[str, ...] = (),
    improvements: bool = False,
) -> Query:
    return _on_events(lambda ev: settle(plan(lifecycle_table(ev, improvements)), pct=pct))


def _on_versions(plan: Callable[[DataFrame], DataFrame], *, pct: tuple[str, ...] = ()) -> Query:
    return _on_events(lambda ev: settle(plan(repricing.max_versions(ev)), pct=pct))


def _parsed(events: DataFrame) -> DataFrame:
    """The events written as delimited lines and parsed again."""
    return parse_lines(raw_lines(events), S.RAW_COLUMNS)


def _on_cut(plan: Callable[..., DataFrame]) -> Query:
    """The same plan with every order of more than a few events cut into pieces."""
    return _on_events(lambda ev: plan(ev, piece_rows=CUT_ABOVE))


def _longest_order(events: DataFrame) -> DataFrame:
    """Detail of the order with most events, found by the query itself."""
    counts = events.where(E.is_regular()).groupBy("order_id").agg(F.count("*").alias("n"))
    return versions.order_detail(samples.events_of(events, largest(counts, "n", "order_id")))


def _reused_ids(events: DataFrame) -> DataFrame:
    """The events with ids that are used again on another day."""
    return events.withColumn("order_id", F.substring_index("order_id", "-", 1))


def _enriched_by_day(events: DataFrame) -> DataFrame:
    """Versions of orders told apart by id and day of entry."""
    dated = _reused_ids(events).withColumn("entry_day", F.to_date("entry_ts"))
    return versions.enrich_events(
        dated, keep=list(events.columns), keys=("order_id", "entry_day")
    )


def _merged_lives(events: DataFrame) -> DataFrame:
    """Lives of orders of many days, from a state per order and day."""
    dated = _reused_ids(events).withColumn("day", F.to_date("change_ts"))
    return lives_of(merge_states(order_states(dated, keys=("order_id", "day")).drop("day")))


def _through_sink(plan: Callable[[DataFrame], DataFrame], fmt: str) -> Query:
    """The plan's rows, written as a run in the shared folder and read back from there."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = run_folder(f"{shared_folder(spark)}/sinks")
        write_results({"result": plan(load_order_events(spark, sf_dir))}, folder, fmt)
        finish_run(spark, folder, {"format": fmt})
        return read_run(spark, folder, verify=True)["result"]

    return query


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every additive table in long form, from one pass over the events."""
    cube = overview.fact_cube(load_order_events(spark, sf_dir))
    tables = {
        name: settle(plan(cube), *sums, pct=pct) for name, (plan, sums, pct) in ADDITIVE.items()
    }
    return overview.long_form(tables)


def _sample_with_events(events: DataFrame) -> DataFrame:
    return samples.sample_raw_events(events, samples.sample_lives(lifecycle_table(events, False)))


def queries() -> dict[str, Query]:
    o, lf = overview, lives
    return {
        # Scan and labels
        "scan_typed_events": _on_events(
            lambda ev: typed_events(raw_text(ev)).select("event_id", *S.ENGINE_COLUMNS)
        ),
        "scan_delimited_events": _on_events(
            lambda ev: typed_events(_parsed(ev).where(f"{REJECTED} IS NULL")).select(
                "event_id", *S.ENGINE_COLUMNS
            )
        ),
        "scan_rejects": _on_events(lambda ev: scan_losses(_parsed(ev))),
        "session_windows": _on_events(
            lambda ev: ev.select(
                "event_id",
                session_window("entry_ts", "session").alias("entry_window"),
                session_window("change_ts", "session").alias("change_window"),
            )
        ),
        "broad_sessions": _on_events(
            lambda ev: ev.select(
                "event_id", broad_session("entry_ts", "session").alias("period")
            )
        ),
        # Market overview
        **{name: _on_facts(plan, *sums, pct=pct) for name, (plan, sums, pct) in ADDITIVE.items()},
        "overview_report": _report,
        "q09_ratio_by_fill": _on_events(
            lambda ev: settle(
                o.cancel_to_trade(o.facts(ev, by_fill=True)), "cancelled_lots", "traded_lots"
            )
        ),
        "q03_top10_share": _on_facts(o.top_stocks_share, pct=("top_pct_lots", "top_pct_tl")),
        "q04_windows_by_day": _on_events(
            lambda ev: settle(
                o.window_volumes(overview.facts(ev, by_day=True)),
                "total_lots",
                "total_tl",
                pct=("pct_count", "pct_tl"),
            ).withColumn("trade_date", F.col("trade_date").cast("string"))
        ),
        "q04_peaks": _on_facts(o.window_peaks, "peak", pct=("pct",)),
        "q04b_rolling": _on_events(
            lambda ev: settle(o.rolling_intensity(ev), "rolling_lots", "rolling_tl")
        ),
        "q04b_peak": _on_events(lambda ev: settle(o.rolling_peak(ev), "rolling_lots")),
        "q06_ratio": _on_facts(o.busiest_to_calmest),
        "q08_peak": _on_facts(o.cancel_peak),
        "q09_top10": _on_facts(o.cancel_to_trade_top, "cancelled_lots", "traded_lots"),
        "q09_bottom10": _on_facts(o.cancel_to_trade_bottom, "cancelled_lots", "traded_lots"),
        "q11_overlap": _on_facts(o.volume_overlap),
        "q11_overlap_lists": _on_facts(
            lambda f: o.volume_overlap_lists(f).withColumn("stocks", F.array_join("stocks", ","))
        ),
        "q12_peak_windows": _on_facts(o.peak_windows, "peak_order_tl", "peak_trade_tl"),
        "q14_peak": _on_facts(o.average_lots_peak, "avg_lots_per_order"),
        "q15_order_size": _on_events(
            lambda ev: settle(o.order_size(ev), "avg_order_tl", "median_order_tl")
        ),
        "q15_order_size_approx": _on_events(
            lambda ev: settle(
                o.order_size(ev, approximate=True), "avg_order_tl", "median_order_tl"
            )
        ),
        "q15_chart": _on_events(
            lambda ev: settle(
                o.order_size_chart(o.order_size(ev)), "avg_order_tl", "median_order_tl"
            )
        ),
        "q16_top100": _on_events(lambda ev: settle(o.largest_orders_windows(ev), "total_lots")),
        "q16_closing": _on_events(lambda ev: settle(o.largest_orders_closing(ev), "closing_lots")),
        # Order versions
        "qualifying_improvements": _on_events(
            lambda ev: versions.versioned_events(ev).select(
                "event_id",
                "order_id",
                "change_reason",
                "side",
                "price",
                "prev_price",
                "qty",
                "prev_qty",
                "qualifies",
                "sub_order_number",
            )
        ),
        "enrich_events": _on_events(versions.enrich_events),
        "enrich_events_by_day_key": _on_events(_enriched_by_day),
        "sink_parquet_roundtrip": _through_sink(versions.enrich_events, "parquet"),
        "sink_csv_roundtrip": _through_sink(versions.order_detail, "csv"),
        "order_detail": _on_events(versions.order_detail),
        "order_detail_header": _on_events(
            lambda ev: versions.order_detail_header(versions.order_detail(ev))
        ),
        "order_lookup": _on_events(_longest_order),
        "order_lookup_by_id": _on_events(
            lambda ev: versions.order_detail(samples.lookup_order(ev, KNOWN_ORDER))
        ),
        "version_summary": _on_events(versions.version_summary),
        "version_summary_display": _on_events(
            lambda ev: versions.version_summary_display(versions.version_summary(ev))
        ),
        "version_distribution": _on_versions(
            lambda v: repricing.version_distribution(v, rows=FIRST_ROWS)
        ),
        "version_distribution_full": _on_versions(repricing.version_distribution),
        "version_distribution_headline": _on_versions(
            lambda v: lf.improved_share(v, "max_version"), pct=("pct_improved",)
        ),
        "version_distribution_meaning": _on_versions(
            lambda v: repricing.distribution_meaning(
                repricing.version_distribution(v, rows=FIRST_ROWS)
            )
        ),
        "repricing_by_stock": _on_versions(repricing.repricing_by_stock),
        # Samples
        "sample_modified_orders": _on_events(samples.modified_orders),
        "sample_orders_by_key": _on_events(lambda ev: samples.sample_orders(ev, 0.01)),
        "sample_orders_lifecycle": _on_lives(samples.sample_lives),
        "sample_orders_raw_events": _on_events(_sample_with_events),
        # Order lives
        "lifecycle_table": _on_events(lifecycle_table),
        "lifecycle_table_by_fill": _on_events(lambda ev: lifecycle_table(ev, by_fill=True)),
        "lifecycle_merged": _on_events(_merged_lives),
        "lifecycle_summary": _on_lives(lf.lifecycle_summary),
        "flag_distribution": _on_lives(lf.flag_distribution),
        "l1_lifetime_buckets": _on_lives(lf.lifetime_buckets),
        "l1_lifetime_stats": _on_lives(lf.lifetime_stats),
        "l1_chart": _on_lives(lambda t: lf.lifetime_chart(lf.lifetime_buckets(t))),
        "l2_behavior_classes": _on_lives(lf.behavior_classes),
        "l2_chart": _on_lives(lambda t: lf.behavior_chart(lf.behavior_classes(t))),
        "l2_hft_by_stock": _on_lives(lf.fleeting_by_stock),
        "l3_liquidity": _on_lives(lf.liquidity),
        "l3_traded_lots_source": _on_lives(lf.traded_lots_source),
        "l3_passive_share": _on_lives(lambda t: lf.passive_share(lf.traded_lots_source(t))),
        "l4_conversion_funnel": _on_lives(lf.conversion_funnel),
        "l4_headline": _on_events(
            lambda ev: lf.funnel_headline(lf.conversion_funnel(lifecycle_table(ev, False))).select(
                *[round_to(c, 2).alias(c) for c in ("pct_orders", "pct_lots")]
            )
        ),
        "l4_chart": _on_lives(lambda t: lf.funnel_chart(lf.conversion_funnel(t))),
        "l5_resting_vs_outcome": _on_lives(lf.resting_vs_outcome),
        "l5_observations": _on_lives(
            lambda t: lf.outcome_observations(lf.resting_vs_outcome(t)),
            pct=("subsecond_filled_pct", "subsecond_cancelled_pct", "long_filled_pct"),
        ),
        "l6_hft_intraday": _on_lives(lf.fleeting_by_window),
        "l6_peak": _on_lives(lambda t: lf.fleeting_peak(lf.fleeting_by_window(t))),
        "l6_chart": _on_lives(lambda t: lf.fleeting_chart(lf.fleeting_by_window(t))),
        "order_versions": _on_lives(
            lambda t: lf.order_versions(t, rows=FIRST_ROWS), improvements=True
        ),
        "order_versions_full": _on_lives(lf.order_versions, improvements=True),
        # The same with orders of a few events treated as too large for one task
        "enrich_events_cut": _on_cut(versions.enrich_events),
        "order_detail_cut": _on_cut(versions.order_detail),
        "version_summary_cut": _on_cut(versions.version_summary),
        "lifecycle_table_cut": _on_cut(lifecycle_table),
        "order_versions_headline": _on_lives(
            lambda t: lf.improved_share(t, "n_qualifying_improvements"),
            pct=("pct_improved",),
            improvements=True,
        ),
    }
