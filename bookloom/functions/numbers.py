"""Arithmetic helpers shared by all plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(x: Column | str, places: int) -> Column:
    """Round a double half away from zero after scaling it by 10^places.

    ``F.round`` rounds the shortest decimal text of the double instead, which
    moves values such as 32.535; scaling first gives the result other engines
    give for the same double.
    """
    if isinstance(x, str):
        return F.expr(f"round({x} * 1e{places}D) / 1e{places}D")
    scale = F.lit(float(10**places))
    return F.round(x * scale) / scale


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def share(part: Column, whole: Column) -> Column:
    """part as a percentage of whole, NULL where whole is 0."""
    return F.try_divide(F.lit(100.0) * part, whole.cast("double"))


def share_or_zero(part: str, whole: str) -> Column:
    """As share, but 0.0 where whole is 0 or NULL."""
    return F.expr(f"if(coalesce({whole}, 0D) = 0D, 0D, 100D * {part} / {whole})")


def micros_between(start: str, end: str) -> Column:
    """Whole microseconds from start to end, both without time zone.

    Goes through the interval, so no session time zone (and no daylight saving
    jump) is involved. Takes SQL expressions.
    """
    gap = f"({end} - {start})"
    minutes = (
        f"(extract(DAY FROM {gap}) * 1440L + extract(HOUR FROM {gap}) * 60L "
        f"+ extract(MINUTE FROM {gap}))"
    )
    return F.expr(
        f"{minutes} * 60000000L + cast(extract(SECOND FROM {gap}) * 1000000 AS bigint)"
    )


def seconds_between(start: str, end: str) -> Column:
    return micros_between(start, end) / F.lit(1e6)


def minute_number(ts: str) -> Column:
    """Minutes since 1970-01-01 00:00, rounded down."""
    micros = micros_between("timestamp_ntz'1970-01-01 00:00:00'", ts)
    return F.floor(micros / F.lit(60_000_000)).cast("bigint")


def minute_start(number: str) -> Column:
    return F.expr(f"timestampadd(MINUTE, {number}, timestamp_ntz'1970-01-01 00:00:00')")
