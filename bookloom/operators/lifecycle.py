"""One row per order, from all its events, at once or day by day.

An order's state is a fold of some consecutive events that can be joined to the
fold of the next ones: largest values, sums, and its first and last event, which
decide whether the change across the border was an improvement. Pieces of a large
order and the days of a long one are merged the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions import events as E
from bookloom.functions.numbers import seconds_between
from bookloom.operators.runs import CUT, ORDER, PIECE, PIECE_ROWS, order_runs
from bookloom.operators.versions import (
    BORDER_COLUMNS,
    IMPROVES_ACROSS,
    edge_events,
    mark_improvements,
)

NEEDED = (
    "order_id",
    "stock",
    "side",
    "change_reason",
    "entry_ts",
    "change_ts",
    "price",
    "qty",
    "remaining",
)
# Folded values and how two of them become one.
MERGED = {
    "stock": F.max,
    "side": F.max,
    "born_ts": F.min,
    "last_event_ts": F.max,
    "first_fill_ts": F.min,
    "original_qty": F.max,
    "event_count": F.sum,
    "ever_traded": F.max,
    "ever_cancelled": F.max,
    "ever_expired": F.max,
    "traded_lots": F.max,
    "n_modifications": F.sum,
}
IMPROVEMENTS = "n_qualifying_improvements"
# Lots of single fills summed up.
FILLS = "filled_lots"
# First and last event of a state, and where they stand in time; first and last fill.
EDGES = ("first_event", "last_event", "first_place", "last_place")
FILL_EDGES = ("first_fill", "last_fill")


def _ever(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False)).cast("int")


def _folded() -> list[Column]:
    traded = F.expr("qty - remaining")
    return [
        F.max("stock").alias("stock"),
        F.max("side").alias("side"),
        F.min(F.when(E.is_new(), F.col("entry_ts"))).alias("born_ts"),
        F.max("change_ts").alias("last_event_ts"),
        F.min(F.when(E.is_trade(), F.col("change_ts"))).alias("first_fill_ts"),
        F.max(F.when(E.is_new(), F.col("qty"))).alias("original_qty"),
        F.count("*").alias("event_count"),
        _ever(E.is_trade()).alias("ever_traded"),
        _ever(E.is_cancel()).alias("ever_cancelled"),
        _ever(E.is_expiry()).alias("ever_expired"),
        # qty - remaining is cumulative, so the largest one is the total.
        F.coalesce(F.max(F.when(E.is_trade(), traded)), F.lit(0.0)).alias("traded_lots"),
        F.count_if(E.is_replace()).alias("n_modifications"),
    ]


def merge_states(states: DataFrame, keys: Sequence[str] = ORDER) -> DataFrame:
    """One state per order, from states of any consecutive stretches of its events.

    The first event of a stretch may improve on the last one of the stretch before;
    within a stretch it had nothing to improve on.
    """
    keys = list(keys)
    along = f"PARTITION BY {', '.join(keys)} ORDER BY first_place"
    added, merged = [f"{IMPROVES_ACROSS} AS _improves"], [
        f"cast(sum({IMPROVEMENTS} + _improves) AS int) AS {IMPROVEMENTS}",
        "min_by(first_event, first_place) AS first_event",
        "max_by(last_event, last_place) AS last_event",
        "min(first_place) AS first_place",
        "max(last_place) AS last_place",
    ]
    if FILLS in states.columns:
        earlier = f"{along} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        filled = f"last_value(last_fill) IGNORE NULLS OVER ({earlier})"
        # The first fill was counted as if there were none before.
        refilled = f"{E.fill_lots_sql('first_fill', filled)} - {E.fill_lots_sql('first_fill', 'NULL')}"
        added.append(f"coalesce({refilled}, 0D) AS _refilled")
        merged += [
            f"sum({FILLS} + _refilled) AS {FILLS}",
            "min_by(first_fill, if(first_fill IS NULL, NULL, first_place)) AS first_fill",
            "max_by(last_fill, if(last_fill IS NULL, NULL, last_place)) AS last_fill",
        ]
    border = (
        states.selectExpr("*", f"lag(last_event) OVER ({along}) AS _before")
        .selectExpr("*", *BORDER_COLUMNS)
        .selectExpr("*", *added)
    )
    return border.groupBy(*keys).agg(
        *[merge(c).alias(c) for c, merge in MERGED.items()], *map(F.expr, merged)
    )


def order_states(
    events: DataFrame,
    piece_rows: int = PIECE_ROWS,
    keys: Sequence[str] = ORDER,
    fills: bool = True,
) -> DataFrame:
    """State of every regular order (and day, if that is a key) in the events.

    Previous-row lookup and fold share one shuffle. Only orders that were cut into
    pieces are merged afterwards. ``fills``: with what single fills add up to.
    """
    ties = ["event_id"] if "event_id" in events.columns else []
    more = [k for k in keys if k not in NEEDED]
    slim = events.where(E.is_regular()).select(*NEEDED, *ties, *more)
    runs = order_runs(slim, piece_rows, keys)
    # Inside a piece only: what crosses its border is settled by merging.
    marked = mark_improvements(runs)
    folds = [
        f"cast(sum(qualifies) AS int) AS {IMPROVEMENTS}",
        *edge_events(runs.place),
        f"min({runs.place}) AS first_place",
        f"max({runs.place}) AS last_place",
    ]
    columns = [*keys, *MERGED, IMPROVEMENTS, *EDGES]
    if fills:
        marked = marked.add(f"{E.TRADED_SO_FAR} AS _done").latest("_done", "_filled")
        fill_place = f"if(_done IS NULL, NULL, {runs.place})"
        folds += [
            f"coalesce(sum({E.fill_lots_sql('_done', '_filled')}), 0D) AS {FILLS}",
            f"min_by(_done, {fill_place}) AS first_fill",
            f"max_by(_done, {fill_place}) AS last_fill",
        ]
        columns += [FILLS, *FILL_EDGES]
    states = marked.rows.groupBy(*runs.piece).agg(*_folded(), *map(F.expr, folds))
    whole = states.where(f"NOT {CUT}").select(*columns)
    return whole.union(merge_states(states.where(CUT), keys).select(*columns))


def lives(
    states: DataFrame,
    improvements: bool = True,
    keys: Sequence[str] = ORDER,
    by_fill: bool = False,
) -> DataFrame:
    """The lifecycle table: states of orders that have a NEW event with a time."""
    return states.where("born_ts IS NOT NULL").select(
        *keys,
        "stock",
        "side",
        "born_ts",
        "last_event_ts",
        "first_fill_ts",
        "original_qty",
        "event_count",
        "ever_traded",
        "ever_cancelled",
        "ever_expired",
        F.col(FILLS if by_fill else "traded_lots").alias("traded_lots"),
        seconds_between("born_ts", "last_event_ts").alias("lifetime_seconds"),
        seconds_between("born_ts", "first_fill_ts").alias("time_to_first_fill_seconds"),
        "n_modifications",
        *([IMPROVEMENTS] if improvements else []),
    )


def lifecycle_table(
    events: DataFrame,
    improvements: bool = True,
    piece_rows: int = PIECE_ROWS,
    keys: Sequence[str] = ORDER,
    by_fill: bool = False,
) -> DataFrame:
    """Life of every regular order that has a NEW event with a time.

    Without ``improvements`` there is no previous-row lookup and no column for it:
    events are then combined before the shuffle, however many an order has. Traded lots
    are the largest total seen, or, ``by_fill``, what single fills added to it.
    """
    if not improvements and not by_fill:
        return lives(events.where(E.is_regular()).groupBy(*keys).agg(*_folded()), False, keys)
    states = order_states(events, piece_rows, keys, fills=by_fill)
    return lives(states, improvements, keys, by_fill)


def is_open() -> Column:
    """Of a state: neither cancelled, expired nor filled, so more events are expected."""
    return F.expr("ever_cancelled = 0 AND NOT coalesce(traded_lots >= original_qty, false)")
