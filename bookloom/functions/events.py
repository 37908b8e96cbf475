"""Predicates and labels of one order event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookloom import schema as S


def is_regular() -> Column:
    return F.expr(f"order_cat = {S.REGULAR_ORDER}")


def is_new() -> Column:
    return F.expr(f"change_reason = {S.NEW}")


def is_trade() -> Column:
    return F.expr(f"change_reason = {S.TRADE}")


def is_replace() -> Column:
    return F.expr(f"change_reason = {S.REPLACED}")


def is_expiry() -> Column:
    return F.expr(f"change_reason = {S.EXPIRED}")


def is_cancel() -> Column:
    return F.expr(f"change_reason IN {S.CANCEL_CODES}")


def is_iceberg() -> Column:
    """Shows less (or more) than its full size. NULL visible size: not hidden."""
    return F.expr("coalesce(visible_qty <> qty, false)")


def cancel_type() -> Column:
    # Wording.
    return F.expr(
        f"if(change_reason = {S.EXPIRED}, 'Expired (reason 19)', 'Other cancellations')"
    )


def improves_queue_entry_sql(side: str = "side") -> str:
    """1 for a replacement that loses queue priority, else 0, as SQL.

    Needs prev_price and prev_qty. A buyer pays more, a seller asks less, or
    the size grows; nothing counts while the previous price is unknown.
    """
    return f"""
        if(change_reason = {S.REPLACED} AND prev_price IS NOT NULL
           AND ({side} = '{S.BUY}' AND price > prev_price
                OR {side} = '{S.SELL}' AND price < prev_price
                OR qty > prev_qty), 1, 0)
    """


def improves_queue_entry() -> Column:
    return F.expr(improves_queue_entry_sql())


# Lots of the order traded up to a TRADE event, NULL for other events.
TRADED_SO_FAR = f"if(change_reason = {S.TRADE}, qty - remaining, NULL)"


def fill_lots_sql(done: str, before: str) -> str:
    """Lots of one fill, from the lots traded up to it and up to the fill before (NULL: none).

    A fill never takes lots back, so a falling total adds nothing.
    """
    return f"greatest({done} - coalesce({before}, 0D), 0D)"


def composite_id_sql(keys: Sequence[str] = ("order_id",)) -> str:
    """The order's key and its version number, as SQL."""
    return f"concat({', '.join(f"{k}, '_'" for k in keys)}, sub_order_number)"


def reason_name(code: str) -> Column:
    """Name of an event code; reason_<n> for an unlisted one, 'nan' for none."""
    names = ", ".join(f"{n}, '{name}'" for n, name in S.REASON_NAMES.items())
    return F.expr(
        f"coalesce(try_element_at(map({names}), {code}), concat('reason_', {code}), 'nan')"
    )


def side_name(side: str) -> Column:
    # Wording.
    return F.expr(f"if({side} = '{S.BUY}', 'BUY (alis)', 'SELL (satis)')")


def change_text() -> Column:
    """What a replacement changed, as text, from the rounded price and size.

    Needs change_reason, side, price, prev_price, qty and prev_qty. Changes of
    at most 1e-9 count as none.
    """
    # Wording of the sentences below.
    gap, lots = "(price - prev_price)", "(qty - prev_qty)"
    moved = f"abs({gap}) > 1e-9D"
    better = (
        f"coalesce(side = '{S.BUY}' AND {gap} > 0D OR side = '{S.SELL}' AND {gap} < 0D, false)"
    )
    gains = f"""concat_ws(', ',
        if({moved} AND {better}, format_string('price %+.4f (better)', {gap}), NULL),
        if({lots} > 1e-9D, format_string('qty %+d', cast({lots} AS bigint)), NULL))"""
    losses = f"""concat_ws(', ',
        if({moved} AND NOT {better}, format_string('price %+.4f (worse)', {gap}), NULL),
        if({lots} < -1e-9D, format_string('qty %d (reduced)', cast({lots} AS bigint)), NULL))"""
    return F.expr(f"""
        CASE WHEN NOT coalesce(change_reason = {S.REPLACED}, false) THEN '-'
             WHEN prev_price IS NULL THEN 'first row — nothing to compare'
             WHEN {gains} <> '' THEN
               concat('IMPROVED: ', {gains}, if({losses} <> '', concat('  |  also: ', {losses}), ''))
             WHEN {losses} <> '' THEN concat('no improvement — ', {losses})
             ELSE 'no change' END
    """)


def versions_meaning(n: str) -> Column:
    """Sentence for the number of times an order was improved."""
    # Wording of the distribution table.
    return F.expr(f"""
        CASE {n}
          WHEN 0 THEN
            'Order was never improved — placed and left as-is, then cancelled/filled/expired'
          WHEN 1 THEN 'One improvement: trader re-competed once, lost time priority once'
          WHEN 2 THEN 'Two improvements: trader actively managed this order twice'
          ELSE concat({n}, ' improvements — highly active order management') END
    """)
