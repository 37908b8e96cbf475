"""Oracle SQL of the lifecycle questions."""

from __future__ import annotations

from bookloom.oracle.base import FILLED, LIVES, REUSED, query, window


def shares(label: str, name: str, lots: str = "total_lots") -> str:
    return f"""
SELECT {label} AS {name}, count(*) AS n_orders,
       round(100e0 * count(*) / (SELECT count(*) FROM lives), 2) AS pct_orders,
       round(sum(original_qty), 0) AS {lots},
       round(100e0 * sum(original_qty) / (SELECT sum(original_qty) FROM lives), 2) AS pct_lots
FROM sorted_out GROUP BY {name}
"""


def percent(condition: str, places: int) -> str:
    return f"round(100e0 * count(*) FILTER ({condition}) / count(*), {places})"


BUCKETS = f"buckets AS ({shares('bucket', 'lifetime_bucket')})"
CLASSES = f"classes AS ({shares('class', 'behavior_class')})"
FUNNEL = f"funnel AS ({shares('state', 'terminal_state', 'total_submitted_lots')})"
OUTCOMES = f"""
outcomes AS (
  SELECT bucket, count(*) AS n_orders,
         {percent("state = '1_fully_filled'", 1)} AS pct_fully_filled,
         {percent("state = '2_partially_filled'", 1)} AS pct_partial_fill,
         {percent("state = '3_cancelled_no_fill'", 1)} AS pct_cancelled,
         {percent("state = '4_expired_no_fill'", 1)} AS pct_expired,
         {percent("state = '5_other_open'", 1)} AS pct_open
  FROM classed WHERE bucket <> '0_unknown' GROUP BY bucket
)
"""
INTRADAY = f"""
intraday AS (
  SELECT {window('born_ts', named=False)} AS time_window, count(*) AS total_orders,
         count(*) FILTER (fleeting) AS hft_orders, {percent('fleeting', 2)} AS hft_pct
  FROM classed WHERE born_ts IS NOT NULL GROUP BY time_window
)
"""
SOURCES = """
sources AS (
  SELECT if(fast, 'aggressive', 'passive') AS source, sum(traded_lots) AS lots
  FROM classed WHERE ever_traded = 1 AND first_fill_ts IS NOT NULL GROUP BY source
),
source_shares AS (
  SELECT source, round(lots, 0) AS traded_lots,
         round(100e0 * lots / (SELECT sum(lots) FROM sources), 2) AS pct_traded_lots
  FROM sources
)
"""
# Display texts.
BUCKET_TEXT = (
    "MAP {'0_unknown': 'unknown', '1_sub_0.1s': '<0.1s', '2_0.1-1s': '0.1–1s', "
    "'3_1-5s': '1–5s', '4_5-30s': '5–30s', '5_30s-5min': '30s–5min', "
    "'6_5-30min': '5–30min', '7_gt30min': '>30min', '8_eod': 'EOD'}"
)
STATE_TEXT = (
    "MAP {'1_fully_filled': 'Fully Filled', '2_partially_filled': 'Partially Filled', "
    "'3_cancelled_no_fill': 'Cancelled (no fill)', '4_expired_no_fill': 'Expired (no fill)', "
    "'5_other_open': 'Other / Open'}"
)

SQL = {
    "lifecycle_table": query(
        """
SELECT order_id, stock, side, born_ts, last_event_ts, first_fill_ts, original_qty, event_count,
       ever_traded, ever_cancelled, ever_expired, traded_lots, lifetime_seconds,
       time_to_first_fill_seconds, n_modifications, n_qualifying_improvements
FROM lives
""",
        LIVES,
    ),
    "lifecycle_summary": query(
        """
SELECT count(*) AS total_orders,
       CAST(sum(ever_traded) AS BIGINT) AS n_ever_traded,
       CAST(sum(ever_cancelled) AS BIGINT) AS n_ever_cancelled,
       CAST(sum(ever_expired) AS BIGINT) AS n_ever_expired,
       count(*) FILTER (ever_traded + ever_cancelled + ever_expired = 0) AS n_no_terminal_event,
       round(avg(lifetime_seconds), 3) AS avg_lifetime_s,
       round(median(lifetime_seconds), 3) AS median_lifetime_s,
       round(avg(event_count), 2) AS avg_events_per_order,
       count(*) FILTER (lifetime_seconds < 0) AS sanity_neg_lifetime,
       count(*) FILTER (time_to_first_fill_seconds < 0) AS sanity_neg_fill_lag,
       count(*) FILTER (ever_traded = 1 AND traded_lots > original_qty * 1.05e0)
         AS sanity_overfilled
FROM lives
""",
        LIVES,
    ),
    "flag_distribution": query(
        """
SELECT ever_traded, ever_cancelled, ever_expired, count(*) AS n_orders,
       round(100e0 * count(*) / (SELECT count(*) FROM lives), 2) AS pct
FROM lives GROUP BY ALL
""",
        LIVES,
    ),
    "l1_lifetime_buckets": query("SELECT * FROM buckets", LIVES, BUCKETS),
    "l1_lifetime_stats": query(
        """
SELECT *, mean_lifetime_s / greatest(median_lifetime_s, 0.001e0) AS mean_to_median
FROM (SELECT round(avg(lifetime_seconds), 2) AS mean_lifetime_s,
             round(median(lifetime_seconds), 2) AS median_lifetime_s
      FROM lives)
""",
        LIVES,
    ),
    "l1_chart": query(
        f"""
SELECT *, {BUCKET_TEXT}[lifetime_bucket] AS label
FROM buckets WHERE lifetime_bucket <> '0_unknown'
""",
        LIVES,
        BUCKETS,
    ),
    "l2_behavior_classes": query("SELECT * FROM classes", LIVES, CLASSES),
    "l2_chart": query(
        """
SELECT *, CAST(list_position(['likely_hft', 'aggressive', 'likely_passive', 'mixed'],
                             behavior_class) AS INTEGER) AS position
FROM classes
""",
        LIVES,
        CLASSES,
    ),
    "l2_hft_by_stock": query(
        f"""
SELECT stock, count(*) FILTER (fleeting) AS hft_orders, count(*) AS total_orders,
       {percent('fleeting', 2)} AS hft_pct_of_stock,
       round(100e0 * count(*) FILTER (fleeting)
             / (SELECT count(*) FROM classed WHERE fleeting), 2) AS pct_of_all_hft
FROM classed GROUP BY stock HAVING bool_or(fleeting)
ORDER BY hft_orders DESC, stock LIMIT 15
""",
        LIVES,
    ),
    "l3_liquidity": query(
        """
SELECT CASE WHEN fast THEN 'aggressive_took_liquidity'
            WHEN first_fill_ts IS NOT NULL THEN 'passive_provided_liquidity'
            ELSE 'never_filled' END AS liquidity_class,
       count(*) AS n_orders,
       round(100e0 * count(*) / (SELECT count(*) FROM lives), 2) AS pct_orders,
       round(sum(original_qty), 0) AS total_submitted_lots,
       round(sum(traded_lots), 0) AS total_traded_lots,
       round(100e0 * sum(original_qty) / (SELECT sum(original_qty) FROM lives), 2)
         AS pct_submitted_lots
FROM classed GROUP BY liquidity_class
""",
        LIVES,
    ),
    "l3_traded_lots_source": query("SELECT * FROM source_shares", LIVES, SOURCES),
    "l3_passive_share": query(
        """
SELECT pct_traded_lots AS passive_pct, 100e0 - pct_traded_lots AS aggressive_pct
FROM source_shares WHERE source = 'passive'
""",
        LIVES,
        SOURCES,
    ),
    "l4_conversion_funnel": query("SELECT * FROM funnel", LIVES, FUNNEL),
    "l4_headline": query(
        """
SELECT round(sum(pct_orders), 2) AS pct_orders, round(sum(pct_lots), 2) AS pct_lots
FROM funnel WHERE terminal_state IN ('1_fully_filled', '2_partially_filled')
""",
        LIVES,
        FUNNEL,
    ),
    "l4_chart": query(
        f"SELECT *, {STATE_TEXT}[terminal_state] AS label FROM funnel", LIVES, FUNNEL
    ),
    "l5_resting_vs_outcome": query("SELECT * FROM outcomes", LIVES, OUTCOMES),
    "l5_observations": query(
        """
SELECT round(avg(pct_fully_filled) FILTER (bucket < '3'), 6) AS subsecond_filled_pct,
       round(avg(pct_cancelled) FILTER (bucket < '3'), 6) AS subsecond_cancelled_pct,
       round(avg(pct_fully_filled) FILTER (bucket > '6' AND bucket < '8'), 6) AS long_filled_pct
FROM outcomes
""",
        LIVES,
        OUTCOMES,
    ),
    "l6_hft_intraday": query("SELECT * FROM intraday", LIVES, INTRADAY),
    "l6_peak": query(
        """
SELECT time_window, hft_pct, hft_orders FROM intraday ORDER BY hft_pct DESC, time_window LIMIT 1
""",
        LIVES,
        INTRADAY,
    ),
    "l6_chart": query(
        "SELECT * FROM intraday WHERE time_window NOT IN ('A_OPENING', 'Z_CLOSING')",
        LIVES,
        INTRADAY,
    ),
    "order_versions": query(
        """
SELECT n_qualifying_improvements AS versions_created, count(*) AS n_orders,
       round(100e0 * count(*) / (SELECT count(*) FROM lives), 2) AS pct_of_orders
FROM lives GROUP BY versions_created ORDER BY versions_created LIMIT 15
""",
        LIVES,
    ),
    "order_versions_headline": query(
        """
SELECT count(*) AS total_orders,
       count(*) FILTER (n_qualifying_improvements > 0) AS improved_orders,
       round(100e0 * count(*) FILTER (n_qualifying_improvements > 0) / count(*), 6)
         AS pct_improved
FROM lives
""",
        LIVES,
    ),
    "order_versions_full": query(
        """
SELECT n_qualifying_improvements AS versions_created, count(*) AS n_orders,
       round(100e0 * count(*) / (SELECT count(*) FROM lives), 2) AS pct_of_orders
FROM lives GROUP BY versions_created
""",
        LIVES,
    ),
}
# Cutting large orders changes how rows are shared out, not the result.
SQL["lifecycle_table_cut"] = SQL["lifecycle_table"]
TABLE = """
SELECT order_id, stock, side, born_ts, last_event_ts, first_fill_ts, original_qty, event_count,
       ever_traded, ever_cancelled, ever_expired, {traded} AS traded_lots, lifetime_seconds,
       time_to_first_fill_seconds, n_modifications, n_qualifying_improvements
FROM lives
"""
SQL["lifecycle_merged"] = query(
    TABLE.format(traded="traded_lots"), REUSED, LIVES.replace("FROM reg", "FROM reused")
)
SQL["lifecycle_table_by_fill"] = query(
    TABLE.format(traded="coalesce(filled, 0e0)")
    + "LEFT JOIN (SELECT order_id, sum(fill_lots) AS filled FROM filled GROUP BY order_id) USING (order_id)",
    LIVES,
    FILLED,
)
