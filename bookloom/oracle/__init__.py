"""The registered queries once more, as SQL for an independent engine."""

from __future__ import annotations

from bookloom.oracle import lives, overview, versions


def all_sql() -> dict[str, str]:
    return {**overview.SQL, **versions.SQL, **lives.SQL}
