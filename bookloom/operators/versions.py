"""Order versions: a new one starts with each change that loses queue priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.functions import events as E
from bookloom.functions.numbers import round_to, seconds_between
from bookloom.operators.runs import (
    ALONG,
    BORDERS,
    HOT,
    ORDER,
    PIECE,
    PIECE_ROWS,
    OrderRuns,
    carried,
    event_order,
    order_runs,
)

PREVIOUS = {"prev_price": "price", "prev_qty": "qty"}
NUMBER = "sub_order_number"


def mark_improvements(run: OrderRuns) -> OrderRuns:
    """Add prev_price, prev_qty and qualifies (0 or 1)."""
    return run.previous(PREVIOUS).add(f"{E.improves_queue_entry_sql()} AS qualifies")


# The columns of a stretch's first event, and of the last one before it, that
# ``improves_queue_entry_sql`` needs.
BORDER_COLUMNS = (
    "first_event.change_reason",
    "first_event.price",
    "first_event.qty",
    "first_event.side AS _side",
    *[f"_before.{old} AS {new}" for new, old in PREVIOUS.items()],
)
IMPROVES_ACROSS = E.improves_queue_entry_sql("_side")


def edge_events(place: str) -> list[str]:
    """Folds of the first and the last event of a stretch."""
    return [
        f"min_by(struct(change_reason, side, price, qty), {place}) AS first_event",
        f"max_by(struct(price, qty), {place}) AS last_event",
    ]


def _carry_versions(pieces: OrderRuns) -> DataFrame:
    """To each piece the last price and size before it, and the improvements so far."""
    marked = mark_improvements(pieces)
    states = (
        marked.fold(*edge_events(pieces.place), "sum(qualifies) AS _inside")
        .selectExpr("*", f"lag(last_event) OVER ({ALONG}) AS _before")
        .selectExpr(HOT, PIECE, BORDERS, "_inside", "_before", *BORDER_COLUMNS)
        .selectExpr("*", f"_inside + {IMPROVES_ACROSS} AS _number")
    )
    earlier = f"{ALONG} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return carried(
        states,
        **{new: f"_before.{old}" for new, old in PREVIOUS.items()},
        _number=f"sum(_number) OVER ({earlier})",
    )


def number_versions(run: OrderRuns) -> OrderRuns:
    """Add sub_order_number (0 before the first improvement) and composite_id."""
    run = mark_improvements(run).running_sum("qualifies", "_number")
    return run.add(f"cast(_number AS int) AS {NUMBER}").add(
        f"{E.composite_id_sql(run.keys)} AS composite_id"
    )


def _numbered(
    events: DataFrame, piece_rows: int = PIECE_ROWS, keys: Sequence[str] = ORDER
) -> OrderRuns:
    return number_versions(
        order_runs(events.where(E.is_regular()), piece_rows, keys, _carry_versions)
    )


def _carry_fills(pieces: OrderRuns) -> DataFrame:
    """To each piece of TRADE events the total traded before it."""
    states = pieces.fold(f"max_by(_done, {pieces.place}) AS _last")
    return carried(states, _before=f"lag(_last) OVER ({ALONG})")


def with_fills(events: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Regular events with ``fill_lots``: lots of this fill alone, NULL for other events."""
    regular = events.where(E.is_regular()).selectExpr("*", f"{E.TRADED_SO_FAR} AS _done")
    fills = order_runs(regular.where("_done IS NOT NULL"), piece_rows, carry=_carry_fills)
    filled = fills.previous({"_before": "_done"}).result()
    lots = filled.selectExpr("*", f"{E.fill_lots_sql('_done', '_before')} AS fill_lots").drop("_before")
    others = regular.where("_done IS NULL").selectExpr("*", "cast(NULL AS double) AS fill_lots")
    return lots.unionByName(others).drop("_done")


def versioned_events(
    events: DataFrame, piece_rows: int = PIECE_ROWS, keys: Sequence[str] = ORDER
) -> DataFrame:
    """Regular events with previous values, qualifies, version and composite id."""
    return _numbered(events, piece_rows, keys).result().drop("_number")


def enrich_events(
    events: DataFrame,
    keep: list[str] | None = None,
    piece_rows: int = PIECE_ROWS,
    keys: Sequence[str] = ORDER,
) -> DataFrame:
    """Every regular event with its columns plus sub_order_number, composite_id.

    ``keep`` names the columns to carry, by default all. For frames read from
    raw files pass the raw columns to leave the typed ones out.
    """
    carried = events.columns if keep is None else keep
    numbered = versioned_events(events, piece_rows, keys)
    return numbered.select(*[f"`{c}`" for c in carried], "sub_order_number", "composite_id")


def order_detail(
    events: DataFrame, piece_rows: int = PIECE_ROWS, sort: bool = False
) -> DataFrame:
    """Event by event: rounded prices and sizes, version, and what changed, in words.

    ``sort`` puts the rows in the order in which versions were numbered, for the
    few orders of a history.
    """
    rounded = {"price": 4, "prev_price": 4, "qty": 0, "prev_qty": 0}
    rows = versioned_events(events, piece_rows)
    if sort:
        rows = rows.orderBy(F.col("order_id").asc_nulls_last(), *event_order(events))
    rows = rows.withColumns(
        {name: round_to(name, places) for name, places in rounded.items()}
    )
    return rows.select(
        "order_id",
        "side",
        "stock",
        "change_reason",
        "change_ts",
        "price",
        "prev_price",
        "qty",
        "prev_qty",
        "remaining",
        "qualifies",
        "sub_order_number",
        "composite_id",
        E.reason_name("change_reason").alias("event"),
        E.change_text().alias("improvement"),
        F.when(F.col("qualifies") == 1, "YES").otherwise("").alias("qualified"),
        E.side_name("side").alias("side_full"),
    )


def order_detail_header(detail: DataFrame) -> DataFrame:
    """Per order: number of versions and of improvements."""
    return detail.groupBy("order_id").agg(
        F.max("stock").alias("stock"),
        F.max("side_full").alias("side_full"),
        (F.max("sub_order_number") + 1).alias("n_versions"),
        F.sum("qualifies").alias("n_improvements"),
    )


def version_summary(
    events: DataFrame, piece_rows: int = PIECE_ROWS, sort: bool = False
) -> DataFrame:
    """One row per version: what started it, and how long until the next one.

    Version 0 starts with the NEW event (none: no version 0), later ones with
    the improvement. The last version has no end. ``sort`` puts the rows by order
    and version number.
    """
    numbered = _numbered(events, piece_rows)
    first = E.is_new() & F.expr("sub_order_number = 0")
    starts = numbered.with_rows(numbered.rows.where(F.expr("qualifies = 1") | first))
    rows = starts.following({"version_end_ts": "change_ts"}).rows
    if sort:
        by_number = [F.col(c).asc_nulls_last() for c in ("order_id", "sub_order_number")]
        rows = rows.orderBy(*by_number, "change_ts")
    seconds = seconds_between("change_ts", "version_end_ts")
    return rows.select(
        "composite_id",
        "stock",
        "side",
        F.col("change_ts").alias("version_start_ts"),
        round_to("price", 4).alias("version_price"),
        round_to("qty", 0).alias("version_qty"),
        "version_end_ts",
        round_to(seconds, 2).alias("version_duration_s"),
    )


def version_summary_display(summary: DataFrame) -> DataFrame:
    """The summary with end and duration as text, also for the open version."""
    return summary.withColumns(
        {
            "version_end_ts": F.coalesce(
                F.date_format("version_end_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
                F.lit("(last version — see order events)"),
            ),
            "version_duration_s": F.when(
                F.col("version_duration_s").isNotNull(),
                F.format_string("%.2fs", F.col("version_duration_s")),
            ).otherwise(F.lit("(ongoing)")),
        }
    )
