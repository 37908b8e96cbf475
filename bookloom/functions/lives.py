"""Classes of one order life (a row of the lifecycle table)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bound in seconds (excluded) and label of each lifetime bucket.
LIFETIME_STEPS = (
    (0.1, "1_sub_0.1s"),
    (1.0, "2_0.1-1s"),
    (5.0, "3_1-5s"),
    (30.0, "4_5-30s"),
    (300.0, "5_30s-5min"),
    (1800.0, "6_5-30min"),
)
LONGEST_BUCKET = "7_gt30min"
EXPIRED_BUCKET = "8_eod"
UNKNOWN_BUCKET = "0_unknown"

# Display text of buckets, states and sessions, in display order.
BUCKET_TEXT = {
    "0_unknown": "unknown",
    "1_sub_0.1s": "<0.1s",
    "2_0.1-1s": "0.1–1s",
    "3_1-5s": "1–5s",
    "4_5-30s": "5–30s",
    "5_30s-5min": "30s–5min",
    "6_5-30min": "5–30min",
    "7_gt30min": ">30min",
    "8_eod": "EOD",
}
STATE_TEXT = {
    "1_fully_filled": "Fully Filled",
    "2_partially_filled": "Partially Filled",
    "3_cancelled_no_fill": "Cancelled (no fill)",
    "4_expired_no_fill": "Expired (no fill)",
    "5_other_open": "Other / Open",
}
# Order of display, and thresholds of the classes.
CLASS_ORDER = ("likely_hft", "aggressive", "likely_passive", "mixed")

FAST_FILL_SECONDS = 0.1
FLEETING_SECONDS = 1.0
PATIENT_SECONDS = 60.0
FULL_FILL_FRACTION = 0.99


# SQL conditions on a lifecycle row, shared by the classes below.
TRADED = "ever_traded = 1"
CANCELLED = "ever_cancelled = 1"
EXPIRED = "ever_expired = 1"
FAST_FILL = f"time_to_first_fill_seconds < {FAST_FILL_SECONDS}D"
HAS_FILL = "time_to_first_fill_seconds IS NOT NULL"
FLEETING = f"(lifetime_seconds < {FLEETING_SECONDS}D AND {CANCELLED} AND NOT {TRADED})"


def lifetime_bucket() -> Column:
    """Expired orders have their own bucket whatever their lifetime."""
    steps = " ".join(f"WHEN lifetime_seconds < {b}D THEN '{name}'" for b, name in LIFETIME_STEPS)
    return F.expr(f"""
        CASE WHEN {EXPIRED} THEN '{EXPIRED_BUCKET}'
             WHEN lifetime_seconds IS NULL OR lifetime_seconds < 0D THEN '{UNKNOWN_BUCKET}'
             {steps} ELSE '{LONGEST_BUCKET}' END
    """)


def terminal_state() -> Column:
    """How the order ended. Expiry also sets the cancel flag, so it is tested first."""
    filled = f"traded_lots >= original_qty * {FULL_FILL_FRACTION}D"
    return F.expr(f"""
        CASE WHEN {TRADED} AND {filled} THEN '1_fully_filled'
             WHEN {TRADED} AND ({CANCELLED} OR {EXPIRED}) THEN '2_partially_filled'
             WHEN {TRADED} THEN '5_other_open'
             WHEN {EXPIRED} THEN '4_expired_no_fill'
             WHEN {CANCELLED} THEN '3_cancelled_no_fill'
             ELSE '5_other_open' END
    """)


def is_fleeting() -> Column:
    """Cancelled within a second without a trade: fast-trader behaviour."""
    return F.expr(FLEETING)


def behavior_class() -> Column:
    return F.expr(f"""
        CASE WHEN {FAST_FILL} THEN 'aggressive'
             WHEN {FLEETING} THEN 'likely_hft'
             WHEN lifetime_seconds > {PATIENT_SECONDS}D AND {HAS_FILL}
                  OR {EXPIRED} AND NOT {TRADED} THEN 'likely_passive'
             ELSE 'mixed' END
    """)


def liquidity_class() -> Column:
    return F.expr(f"""
        CASE WHEN {FAST_FILL} THEN 'aggressive_took_liquidity'
             WHEN {HAS_FILL} THEN 'passive_provided_liquidity'
             ELSE 'never_filled' END
    """)


def fill_source() -> Column:
    return F.expr(f"if({FAST_FILL}, 'aggressive', 'passive')")
