"""Events of each order in time order: previous and next row, running sums.

A segmented prefix scan. Rows are keyed by order and piece; one shuffle and one
sort serve all window functions, which run inside a piece. Nearly every order is one
piece. An order with more events than one task should hold is cut into
consecutive pieces; each is folded, the folds are combined along the order, and what a
piece takes over from those before it (their last row, their sums) is broadcast with
the borders, one entry per piece.

Nobody has to name such orders. A bounded heavy-hitter sketch finds them in the same
query, and a sample of their rows, taken by a hash, gives the borders, so the pieces
are about equal whatever the times are. Where there is no such order, adaptive
execution sees an empty side table and drops every step that deals with them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom import schema as S

# Events of one order that one task sorts without trouble.
PIECE_ROWS = 1_000_000
# Orders the sketch can name, and the ids it keeps counters of. An order is missed
# only if it holds fewer than 1 in 0.75 * TRACKED of all rows.
LISTED = 10_000
TRACKED = 32_768
# Rows looked at for each border, on average.
SAMPLED = 64

ORDER = ("order_id",)
PIECE = "_piece"
CUT = "_cut"
# Of a cut order: its key as text, where its pieces begin, what a piece takes over.
HOT = "_hot"
BORDERS = "_borders"
CARRIED = "_carried"
# The pieces of a cut order, one after another, as a window.
ALONG = f"PARTITION BY {HOT} ORDER BY {PIECE}"


def _sorting(events: DataFrame) -> list[tuple[str, bool]]:
    """Event time, entry time, then what settles equal times; whether the largest comes first."""
    times = [("change_ts", False), ("entry_ts", False)]
    if "event_id" in events.columns:
        return [*times, ("event_id", False)]
    return [
        *times,
        (f"if(change_reason = {S.NEW}, 0, 1)", False),
        ("remaining", True),
        ("change_reason", False),
        ("qty", False),
        ("price", False),
    ]


def event_order(events: DataFrame) -> list[Column]:
    """Sort columns: event time, entry time, then what settles equal times.

    Ties are broken by event_id where there is one, else NEW first, larger
    remaining size first, then code, size and price.
    """
    return [
        F.expr(x).desc_nulls_last() if falling else F.expr(x).asc_nulls_last()
        for x, falling in _sorting(events)
    ]


def order_key(events: DataFrame) -> str:
    """The same order as one value: of two rows the earlier one has the smaller key (SQL)."""
    parts = []
    for x, falling in _sorting(events):
        # The rows without a value come last; of falling numbers NaN is the first.
        parts += [f"{x} IS NULL", f"NOT isnan({x})", f"-{x}"] if falling else [f"{x} IS NULL", x]
    return f"named_struct({', '.join(f"'k{i}', {part}" for i, part in enumerate(parts))})"


def _named(keys: Sequence[str]) -> str:
    """The key of an order as one text, different for different keys and never NULL (SQL)."""
    parts = [f"coalesce(concat('=', cast({k} AS string)), '')" for k in keys]
    return parts[0] if len(parts) == 1 else f"concat_ws('\x1f', {', '.join(parts)})"


def large_orders(
    events: DataFrame, piece_rows: int = PIECE_ROWS, keys: Sequence[str] = ORDER
) -> DataFrame:
    """Orders with more rows than a piece should have (``_hot``, their key as text; ``_rows``).

    At most ``LISTED`` of them, so the result can be broadcast. Nothing is shuffled but
    one sketch per task. The order without id counts as one order.
    """
    sketch = F.expr(f"approx_top_k({_named(keys)}, {LISTED}, {TRACKED}) AS _top")
    return (
        events.agg(sketch)
        .selectExpr("inline(_top)")
        .selectExpr(f"item AS {HOT}", "count AS _rows")
        .where(f"_rows > {piece_rows}")
    )


def split_large(
    events: DataFrame, large: DataFrame, keys: Sequence[str] = ORDER
) -> tuple[DataFrame, DataFrame]:
    """Rows of the large orders, and all others."""
    listed = F.broadcast(large.select(HOT))
    same = F.expr(f"{_named(keys)} = {HOT}")
    return events.join(listed, same, "left_semi"), events.join(listed, same, "left_anti")


def piece_borders(
    events: DataFrame, piece_rows: int = PIECE_ROWS, keys: Sequence[str] = ORDER
) -> DataFrame:
    """For each large order the places at which its pieces after the first begin (``_borders``).

    They are quantiles of a sample of its rows, about ``SAMPLED`` for each piece, so a
    list has a bounded length. The sample depends on the rows alone.
    """
    rows = events.selectExpr(f"{_named(keys)} AS _name", f"{order_key(events)} AS _key")
    large = large_orders(events, piece_rows, keys).selectExpr(
        "*", f"cast((_rows + {piece_rows - 1}) div {piece_rows} AS int) AS _pieces"
    )
    sample = rows.join(F.broadcast(large), F.expr(f"_name = {HOT}")).where(
        f"pmod(xxhash64(_key), _rows) < _pieces * {SAMPLED}"
    )
    listed = sample.groupBy(HOT, "_pieces").agg(F.expr("sort_array(collect_list(_key)) AS _keys"))
    at = "cast(size(_keys) * k / _pieces AS int) + 1"
    return listed.selectExpr(
        HOT, f"transform(sequence(1, _pieces - 1), k -> element_at(_keys, {at})) AS {BORDERS}"
    )


@dataclass(frozen=True)
class OrderRuns:
    """Rows of orders in pieces: ``_piece`` numbers them from 0, ``_cut`` marks cut orders.

    ``_carried``, if there, is what the piece takes over from those before it. ``place`` is
    the order of the rows as one value, ``within`` the window of a row's piece (both SQL).
    """

    rows: DataFrame
    place: str
    within: str
    keys: Sequence[str] = ORDER

    @property
    def piece(self) -> list[str]:
        return [*self.keys, PIECE, CUT]

    def with_rows(self, rows: DataFrame) -> OrderRuns:
        return replace(self, rows=rows)

    def add(self, *columns: str) -> OrderRuns:
        """Add columns, as SQL."""
        return self.with_rows(self.rows.selectExpr("*", *columns))

    def fold(self, *folds: str) -> DataFrame:
        """One row per piece of the cut orders, for what is carried on."""
        folds = (f"any_value({BORDERS}) AS {BORDERS}", *folds)
        return self.rows.groupBy(HOT, PIECE).agg(*map(F.expr, folds))

    def previous(self, columns: Mapping[str, str]) -> OrderRuns:
        """Add, under new names, columns of the previous row of the order.

        The first row of a piece has the values carried to it by these names, if any.
        """
        found = {new: f"lag({old}) OVER ({self.within})" for new, old in columns.items()}
        if CARRIED in self.rows.columns:
            # Of the first row there is no row before.
            first = f"lag(true) OVER ({self.within}) IS NULL"
            found = {new: f"if({first}, {CARRIED}.{new}, {x})" for new, x in found.items()}
        return self.add(*[f"{x} AS {new}" for new, x in found.items()])

    def following(self, columns: Mapping[str, str]) -> OrderRuns:
        """Add, under new names, columns of the next row of the order."""
        found = [f"lead({old}) OVER ({self.within}) AS {new}" for new, old in columns.items()]
        rows = self.rows.selectExpr("*", *found, f"lead(true) OVER ({self.within}) IS NULL AS _last")
        # The first row of each piece of a cut order, handed to the piece before.
        row = ", ".join(f"'{new}', {old}" for new, old in columns.items())
        starts = self.rows.where(CUT).groupBy(*self.piece).agg(
            F.expr(f"min_by(named_struct({row}), {self.place}) AS _row")
        )
        along = f"PARTITION BY {', '.join(self.keys)} ORDER BY {PIECE}"
        handed = starts.selectExpr(
            *[f"{k} AS _of_{k}" for k in [*self.keys, PIECE]],
            f"lead(_row) OVER ({along}) AS _row",
        ).where("_row IS NOT NULL")
        same = " AND ".join([f"{k} <=> _of_{k}" for k in [*self.keys, PIECE]])
        joined = rows.join(F.broadcast(handed), F.expr(f"_last AND {same}"), "left")
        filled = [f"if(_row IS NULL, {new}, _row.{new}) AS {new}" for new in columns]
        return self.with_rows(joined.selectExpr(*[f"`{c}`" for c in self.rows.columns], *filled))

    def latest(self, column: str, name: str) -> OrderRuns:
        """Add the latest value of a column, NULLs left out, in earlier rows of the piece."""
        earlier = f"{self.within} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        return self.add(f"last_value({column}) IGNORE NULLS OVER ({earlier}) AS {name}")

    def running_sum(self, column: str, name: str) -> OrderRuns:
        """Add the sum of a column over the order's rows up to this one.

        A sum carried to the piece by that name counts as well.
        """
        total = f"sum({column}) OVER ({self.within} ROWS UNBOUNDED PRECEDING)"
        if CARRIED in self.rows.columns:
            total += f" + coalesce({CARRIED}.{name}, 0)"
        return self.add(f"{total} AS {name}")

    def result(self) -> DataFrame:
        return self.rows.drop(PIECE, CUT, CARRIED)


def order_runs(
    events: DataFrame,
    piece_rows: int = PIECE_ROWS,
    keys: Sequence[str] = ORDER,
    carry: Callable[[OrderRuns], DataFrame] | None = None,
) -> OrderRuns:
    """The events in time order per order, large orders in pieces of about ``piece_rows``.

    ``keys`` tell orders apart: where ids are used again on another day, the id and
    the day. ``carry`` folds the pieces of the large orders (see ``fold``) and adds what each
    takes over from those before it, a struct ``_carried``. Nothing runs before the result
    is used. Rows that agree in everything the order is made of stay in one piece.
    """
    place = order_key(events)
    order = ", ".join(f"{x} {'DESC' if falling else 'ASC'} NULLS LAST" for x, falling in _sorting(events))
    within = f"PARTITION BY {', '.join([*keys, PIECE, CUT])} ORDER BY {order}"
    side = piece_borders(events, piece_rows, keys)
    same = F.expr(f"{_named(keys)} = {HOT}")
    passed = f"size(filter({BORDERS}, border -> border <= {place}))"
    if carry is not None:
        cut = events.join(F.broadcast(side), same).selectExpr("*", f"{passed} AS {PIECE}", f"true AS {CUT}")
        pieces = carry(OrderRuns(cut, place, within, tuple(keys)))
        side = pieces.groupBy(HOT).agg(
            F.expr(f"any_value({BORDERS}) AS {BORDERS}"),
            F.expr(f"map_from_entries(collect_list(struct({PIECE}, {CARRIED}))) AS {CARRIED}"),
        )
    listed = events.join(F.broadcast(side), same, "left").selectExpr(
        "*", f"if({BORDERS} IS NULL, 0, {passed}) AS {PIECE}"
    )
    taken = [] if carry is None else [f"try_element_at({CARRIED}, {PIECE}) AS {CARRIED}"]
    kept = [f"`{c}`" for c in events.columns]
    rows = listed.selectExpr(*kept, PIECE, f"{BORDERS} IS NOT NULL AS {CUT}", *taken)
    return OrderRuns(rows, place, within, tuple(keys))


def carried(states: DataFrame, **values: str) -> DataFrame:
    """Folded pieces with what each takes over, by name (SQL)."""
    taken = ", ".join(f"'{name}', {value}" for name, value in values.items())
    return states.selectExpr(HOT, PIECE, BORDERS, f"named_struct({taken}) AS {CARRIED}")
