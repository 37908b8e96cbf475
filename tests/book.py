"""Hand-written order events: one small order per rule."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from bookloom import schema as S

DAY = datetime(2026, 5, 6)
SCHEMA = (
    "event_id bigint, order_id string, stock string, side string, session string, "
    "entry_ts timestamp_ntz, change_ts timestamp_ntz, qty double, remaining double, "
    "visible_qty double, price double, change_reason int, order_type int, "
    "exch_order_type int, order_cat int, order_tl double"
)


def at(clock: str) -> datetime:
    hours, minutes, *rest = clock.split(":")
    return DAY + timedelta(
        hours=int(hours), minutes=int(minutes), seconds=float(rest[0]) if rest else 0
    )


class Book:
    """Collects events; each order starts at ``born`` unless told otherwise."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def event(
        self,
        order_id: str | None,
        reason: int | None,
        after: float | None = 0.0,
        *,
        born: datetime | None = at("10:00"),
        qty: float | None = 100.0,
        left: float | None = None,
        price: float | None = 10.0,
        side: str = S.BUY,
        stock: str = "AAA.E",
        session: str | None = "PAY_SUREKLI",
        visible: float | None = None,
        cat: int = 1,
        kind: int = 1,
    ) -> Book:
        changed = None if after is None or born is None else born + timedelta(seconds=after)
        value = None if qty is None or price is None else qty * price
        left = qty if left is None else left
        self.rows.append(
            (len(self.rows), order_id, stock, side, session, born, changed, qty, left, visible,
             price, reason, kind, 0, cat, value)
        )
        return self

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)
