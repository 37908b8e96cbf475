"""Whole reports: every result of an analysis as tables below one run folder."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from bookloom import schema as S
from bookloom.operators import samples, versions
from bookloom.operators.lifecycle import lifecycle_table
from bookloom.operators.staging import stage
from bookloom.plans import lives, overview, repricing
from bookloom.sources.order_files import raw_columns
from bookloom.sources.sinks import WRITERS, finish_run, run_folder, write_results


def overview_results(events: DataFrame, fact: DataFrame) -> dict[str, DataFrame]:
    """Market questions; ``fact`` is ``facts(events)`` or ``fact_cube(events)``."""
    return {
        "q01_new_orders": overview.new_order_totals(fact),
        "q02_buy_sell": overview.buy_sell(fact),
        "q03_top_stocks": overview.top_stocks(fact),
        "q04_windows": overview.window_volumes(fact),
        "q04b_rolling": overview.rolling_intensity(events),
        "q05_order_types": overview.order_types(fact),
        "q06_window_counts": overview.window_counts(fact),
        "q07_cancellations": overview.cancel_totals(fact),
        "q07b_expiry_breakdown": overview.expiry_breakdown(fact),
        "q08_cancel_windows": overview.cancel_windows(fact),
        "q09_ratio": overview.cancel_to_trade(fact),
        "q10_cancel_rate": overview.cancel_rate(fact),
        "q11_overlap": overview.volume_overlap_lists(fact),
        "q12_peak_windows": overview.peak_windows(fact),
        "q13_concentration": overview.concentration(fact),
        "q14_avg_lots": overview.average_lots(fact),
        "q15_order_size": overview.order_size(events),
        "q16_top100": overview.largest_orders_windows(events),
    }


def lifecycle_results(table: DataFrame) -> dict[str, DataFrame]:
    return {
        "lifecycle_summary": lives.lifecycle_summary(table),
        "flag_distribution": lives.flag_distribution(table),
        "l1_lifetime_buckets": lives.lifetime_buckets(table),
        "l1_lifetime_stats": lives.lifetime_stats(table),
        "l2_behavior_classes": lives.behavior_classes(table),
        "l2_hft_by_stock": lives.fleeting_by_stock(table),
        "l3_liquidity": lives.liquidity(table),
        "l3_traded_lots_source": lives.traded_lots_source(table),
        "l4_conversion_funnel": lives.conversion_funnel(table),
        "l5_resting_vs_outcome": lives.resting_vs_outcome(table),
        "l6_hft_intraday": lives.fleeting_by_window(table),
        "order_versions": lives.order_versions(table),
    }


def write_overview(
    events: DataFrame, base: str, fmt: str = "parquet", now: datetime | None = None
) -> str:
    """All market questions. One pass over the events serves the additive ones."""
    folder = run_folder(base, now)
    cube = stage(overview.fact_cube(events))
    write_results(overview_results(events, cube), folder, fmt)
    return finish_run(events.sparkSession, folder, {"report": "overview"})


def write_lifecycle(
    events: DataFrame,
    base: str,
    fraction: float = 1.0,
    fmt: str = "parquet",
    now: datetime | None = None,
) -> str:
    """The lifecycle table of all orders, its checks and questions.

    The table is written first and every question reads it from there. A sample
    of the orders is taken only when a smaller fraction is asked for; the run's
    settings, next to the results, say which.
    """
    folder = run_folder(base, now)
    path = f"{folder}/order_lifecycle"
    lives_of = lifecycle_table(samples.sample_orders(events, fraction))
    lives_of.write.mode("errorifexists").parquet(path)
    table = events.sparkSession.read.parquet(path)
    picked = samples.sample_lives(table)
    results = {
        **lifecycle_results(table),
        "sample_orders_lifecycle": picked,
        "sample_orders_raw_events": samples.sample_raw_events(events, picked),
    }
    write_results(results, folder, fmt)
    return finish_run(events.sparkSession, folder, {"report": "lifecycle", "fraction": fraction})


def write_validation(
    events: DataFrame,
    base: str,
    fraction: float = 1.0,
    fmt: str = "parquet",
    now: datetime | None = None,
) -> str:
    """History of some often modified orders, and versions over all orders (or a sample)."""
    folder = run_folder(base, now)
    chosen = stage(samples.events_of(events, samples.modified_orders(events)))
    tops = stage(repricing.max_versions(events, fraction))
    results = {
        **history(chosen),
        "version_distribution": repricing.distribution_meaning(
            repricing.version_distribution(tops)
        ),
        "repricing_by_stock": repricing.repricing_by_stock(tops),
    }
    write_results(results, folder, fmt)
    return finish_run(events.sparkSession, folder, {"report": "validation", "fraction": fraction})


def history(events: DataFrame) -> dict[str, DataFrame]:
    """Event by event and version by version, for a few orders.

    Events are in the order in which versions are numbered, versions by number.
    """
    detail = versions.order_detail(events, sort=True)
    return {
        "order_detail": detail,
        "order_detail_header": versions.order_detail_header(detail),
        "version_summary": versions.version_summary_display(
            versions.version_summary(events, sort=True)
        ),
    }


def lookup(events: DataFrame, order_id: str) -> dict[str, DataFrame]:
    """History of one order; empty frames if there is none of that id."""
    return history(samples.lookup_order(events, order_id))


def write_enriched(
    events: DataFrame,
    path: str,
    keep: list[str] | None = None,
    fmt: str = "parquet",
) -> None:
    """Every regular event with its version; tasks write their own files.

    By default the columns of the raw file, where the frame has them, else all.
    """
    if keep is None and set(S.RAW_COLUMNS) <= set(events.columns):
        keep = [c for c in raw_columns(events) if c != "trade_date"]
    WRITERS[fmt](versions.enrich_events(events, keep), path)
