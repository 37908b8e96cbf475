"""Common table expressions every oracle query starts from."""

from __future__ import annotations

# Codes of cancelled events.
CANCELS = "1, 9, 10, 13, 15, 19, 20, 34, 41, 42, 43, 115, 116, 117, 118, 119, 120, 121, 122, 123, 124"

EVENTS = """
src AS (
  SELECT *, CAST(props->>'$.k' AS INTEGER) AS k,
         min(ts) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS born,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn
  FROM events
),
shaped AS (
  SELECT event_id,
         concat('O', user_id, '-', CAST(ts AS DATE)) AS order_id,
         concat('STK', lpad(CAST(user_id % 23 AS VARCHAR), 2, '0'),
                if(user_id % 23 < 19, '.E', '.V')) AS stock,
         CASE user_id % 31 WHEN 5 THEN 'X' WHEN 6 THEN NULL
              ELSE if(user_id % 2 = 0, 'A', 'S') END AS side,
         CASE WHEN user_id % 19 = 3 THEN NULL WHEN hour(born) = 17 THEN 'PAY_KAPANIS'
              WHEN hour(born) = 11 THEN 'PAY_ACS_EMR' ELSE 'PAY_SUREKLI' END AS session,
         born AS entry_ts,
         if(event_id % 97 = 0 AND rn > 1, NULL,
            born + to_microseconds(date_diff('microsecond', born, ts)
                                   // CAST(pow(10, user_id % 7) AS BIGINT))) AS change_ts,
         (user_id % 50 + 1) * 100e0
           + if((rn > 1 OR user_id % 43 = 9) AND event_type IN ('signup', 'view'), k * 10e0, 0e0) AS qty,
         if(event_id % 37 = 0, NULL, value) AS price,
         CAST(CASE WHEN rn = 1 AND user_id % 43 <> 9 THEN 6
              WHEN rn = 1 OR event_type = 'purchase' THEN 3
              WHEN event_type IN ('signup', 'view') THEN 5
              WHEN event_type = 'click' THEN 1
              WHEN event_id % 3 = 0 THEN 13
              ELSE 19 END AS INTEGER) AS change_reason,
         CAST(if(event_id % 10 = 0, 2, 1) AS INTEGER) AS order_type,
         CAST(0 AS INTEGER) AS exch_order_type,
         CAST(if(user_id % 29 = 0, 4, 1) AS INTEGER) AS order_cat
  FROM src
),
ev AS (
  SELECT *,
         if(change_reason = 6, qty, qty * (event_id % 4) / 4e0) AS remaining,
         CASE WHEN event_id % 17 = 0 THEN qty / 10 WHEN event_id % 5 = 0 THEN NULL
              ELSE qty END AS visible_qty,
         qty * price AS order_tl
  FROM shaped
),
reg AS (SELECT * FROM ev WHERE order_cat = 1)
"""

MARKED = """
stepped AS (
  SELECT *, lag(price) OVER run AS prev_price, lag(qty) OVER run AS prev_qty
  FROM reg WINDOW run AS (PARTITION BY order_id ORDER BY change_ts, entry_ts, event_id)
),
marked AS (
  SELECT *,
         CAST(coalesce(change_reason = 5 AND prev_price IS NOT NULL
                       AND ((side = 'A' AND price > prev_price)
                            OR (side = 'S' AND price < prev_price)
                            OR qty > prev_qty), false) AS INTEGER) AS qualifies
  FROM stepped
)
"""

NUMBERED = (
    MARKED
    + """,
numbered AS (
  SELECT *, concat(order_id, '_', sub_order_number) AS composite_id
  FROM (SELECT *, CAST(sum(qualifies) OVER (PARTITION BY order_id
                  ORDER BY change_ts, entry_ts, event_id
                  ROWS UNBOUNDED PRECEDING) AS INTEGER) AS sub_order_number
        FROM marked)
)
"""
)

# Orders whose ids come again on other days.
REUSED = """
reused AS (
  SELECT * REPLACE (split_part(order_id, '-', 1) AS order_id), CAST(entry_ts AS DATE) AS entry_day FROM reg
)
"""

# Lots of single fills: an order's totals after each, less the total before.
FILLED = """
filled AS (
  SELECT *, greatest(total - coalesce(lag(total) OVER (PARTITION BY order_id
                                       ORDER BY change_ts, entry_ts, event_id), 0e0), 0e0) AS fill_lots
  FROM (SELECT *, qty - remaining AS total FROM reg WHERE change_reason = 3)
  WHERE total IS NOT NULL
)
"""

LIVES = (
    MARKED
    + f""",
folded AS (
  SELECT order_id, max(stock) AS stock, max(side) AS side,
         min(entry_ts) FILTER (change_reason = 6) AS born_ts,
         max(change_ts) AS last_event_ts,
         min(change_ts) FILTER (change_reason = 3) AS first_fill_ts,
         max(qty) FILTER (change_reason = 6) AS original_qty,
         count(*) AS event_count,
         CAST(bool_or(change_reason = 3) AS INTEGER) AS ever_traded,
         CAST(bool_or(change_reason IN ({CANCELS})) AS INTEGER) AS ever_cancelled,
         CAST(bool_or(change_reason = 19) AS INTEGER) AS ever_expired,
         coalesce(max(qty - remaining) FILTER (change_reason = 3), 0e0) AS traded_lots,
         count(*) FILTER (change_reason = 5) AS n_modifications,
         CAST(sum(qualifies) AS INTEGER) AS n_qualifying_improvements
  FROM marked GROUP BY order_id
),
lives AS (
  SELECT *,
         date_diff('microsecond', born_ts, last_event_ts) / 1e6 AS lifetime_seconds,
         date_diff('microsecond', born_ts, first_fill_ts) / 1e6 AS time_to_first_fill_seconds
  FROM folded WHERE born_ts IS NOT NULL
),
-- Fixed values: seconds from and below, label.
lifetime_buckets(low, high, label) AS (
  VALUES (0e0, 0.1e0, '1_sub_0.1s'), (0.1e0, 1e0, '2_0.1-1s'), (1e0, 5e0, '3_1-5s'),
         (5e0, 30e0, '4_5-30s'), (30e0, 300e0, '5_30s-5min'), (300e0, 1800e0, '6_5-30min'),
         (1800e0, 'infinity'::DOUBLE, '7_gt30min')
),
classed AS (
  SELECT *,
         CASE WHEN ever_expired = 1 THEN '8_eod'
              WHEN coalesce(lifetime_seconds, -1) < 0 THEN '0_unknown'
              ELSE (SELECT label FROM lifetime_buckets
                    WHERE low <= lifetime_seconds AND lifetime_seconds < high)
         END AS bucket,
         CASE WHEN ever_traded = 1 AND traded_lots >= original_qty * 0.99e0 THEN '1_fully_filled'
              WHEN ever_traded = 1 AND ever_cancelled + ever_expired > 0 THEN '2_partially_filled'
              WHEN ever_traded = 1 THEN '5_other_open'
              WHEN ever_expired = 1 THEN '4_expired_no_fill'
              WHEN ever_cancelled = 1 THEN '3_cancelled_no_fill'
              ELSE '5_other_open' END AS state,
         coalesce(lifetime_seconds < 1 AND ever_cancelled = 1 AND ever_traded = 0, false) AS fleeting,
         coalesce(time_to_first_fill_seconds < 0.1e0, false) AS fast
  FROM lives
),
sorted_out AS (
  SELECT *,
         CASE WHEN fast THEN 'aggressive' WHEN fleeting THEN 'likely_hft'
              WHEN (lifetime_seconds > 60 AND first_fill_ts IS NOT NULL)
                   OR (ever_expired = 1 AND ever_traded = 0) THEN 'likely_passive'
              ELSE 'mixed' END AS class
  FROM classed
)
"""
)


def half_hour(ts: str) -> str:
    bucket = f"time_bucket(INTERVAL 30 MINUTE, {ts})"
    return (
        f"strftime({bucket}, '%H:%M') || '-' || strftime({bucket} + INTERVAL 30 MINUTE, '%H:%M')"
    )


def window(ts: str, named: bool = True) -> str:
    """Trading window of a time; with the session name unless told otherwise."""
    # Hours and patterns of the session names.
    opening, closing = f"hour({ts}) < 10", f"hour({ts}) >= 18"
    if named:
        opening += " OR session LIKE '%ACILIS%' OR session LIKE '%ACS_EMR%'"
        closing += " OR session LIKE '%KAPANIS%' OR session LIKE '%ESLESTIRMETEKFIYAT%'"
    return (
        f"CASE WHEN {opening} THEN 'A_OPENING' WHEN {closing} THEN 'Z_CLOSING' "
        f"ELSE {half_hour(ts)} END"
    )


def broad(ts: str) -> str:
    return (
        f"if({window(ts)} = 'A_OPENING', '1_Opening', "
        f"if({window(ts)} = 'Z_CLOSING', '3_Closing', '2_Midday'))"
    )


def query(body: str, *blocks: str) -> str:
    """A query over the order events and further blocks of expressions."""
    return "WITH " + ",\n".join(b.strip() for b in (EVENTS, *blocks)) + "\n" + body.strip()
