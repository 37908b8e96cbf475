"""Trading-window labels of a time column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bookloom import schema as S


def _named(session: str | None, patterns: tuple[str, ...]) -> str:
    return "".join(f"{session} LIKE '{p}' OR " for p in patterns) if session else ""


def _opening(ts: str, session: str | None) -> str:
    return _named(session, S.OPENING_SESSIONS) + f"hour({ts}) < {S.CONTINUOUS_FROM_HOUR}"


def _closing(ts: str, session: str | None) -> str:
    return _named(session, S.CLOSING_SESSIONS) + f"hour({ts}) >= {S.CONTINUOUS_TO_HOUR}"


def _half_hour(ts: str) -> str:
    """'10:30-11:00' for any time in that half hour."""
    hour, later = f"lpad(hour({ts}), 2, '0')", f"lpad(hour({ts}) + 1, 2, '0')"
    return (
        f"if(minute({ts}) < 30, concat({hour}, ':00-', {hour}, ':30'), "
        f"concat({hour}, ':30-', {later}, ':00'))"
    )


def session_window(ts: str, session: str | None = None) -> Column:
    """A_OPENING, Z_CLOSING or the half hour. Opening is tested first.

    Without a session name only the clock decides. A NULL time that no session
    name settles has no label.
    """
    return F.expr(
        f"CASE WHEN {_opening(ts, session)} THEN 'A_OPENING' "
        f"WHEN {_closing(ts, session)} THEN 'Z_CLOSING' ELSE {_half_hour(ts)} END"
    )


def broad_session(ts: str, session: str | None = None) -> Column:
    """1_Opening, 3_Closing, else 2_Midday (also for a NULL time)."""
    return F.expr(
        f"CASE WHEN {_opening(ts, session)} THEN '1_Opening' "
        f"WHEN {_closing(ts, session)} THEN '3_Closing' ELSE '2_Midday' END"
    )
