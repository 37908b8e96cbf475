"""Oracle SQL of the market-level questions."""

from __future__ import annotations

from bookloom.oracle.base import CANCELS, FILLED, broad, query, window

NEW = f"""
fresh AS (
  SELECT *, {window('entry_ts')} AS time_window, {broad('entry_ts')} AS period
  FROM reg WHERE change_reason = 6
)
"""
GONE = f"""
gone AS (
  SELECT *, {window('change_ts')} AS time_window, remaining * price AS left_tl
  FROM reg WHERE change_reason IN ({CANCELS})
)
"""
FILLS = f"""
fills AS (
  SELECT *, {window('change_ts')} AS time_window, (qty - remaining) * price AS traded_tl
  FROM reg WHERE change_reason = 3
)
"""
STOCKS = """
stocks AS (SELECT stock, sum(qty) AS lots, sum(order_tl) AS tl FROM fresh GROUP BY stock),
best AS (
  SELECT stock, lots, 100e0 * lots / (SELECT sum(lots) FROM stocks) AS pct_lots,
         tl, 100e0 * tl / (SELECT sum(tl) FROM stocks) AS pct_tl
  FROM stocks ORDER BY tl DESC, stock LIMIT 10
)
"""
WINDOWS = """
volumes AS (
  SELECT time_window, count(*) AS order_count, sum(qty) AS lots, sum(order_tl) AS tl
  FROM fresh GROUP BY ALL
),
windows AS (
  SELECT time_window, order_count,
         100e0 * order_count / (SELECT sum(order_count) FROM volumes) AS pct_count,
         lots AS total_lots, tl AS total_tl,
         100e0 * tl / (SELECT sum(tl) FROM volumes) AS pct_tl
  FROM volumes
)
"""
GONE_WINDOWS = """
gone_windows AS (
  SELECT time_window, count(*) AS cancelled_count, sum(remaining) AS cancelled_lots,
         sum(left_tl) AS cancelled_tl
  FROM gone GROUP BY ALL
)
"""
RATIOS = f"""
ratios AS (
  SELECT *, round(cancelled_lots / traded_lots, 4) AS cancel_to_trade_ratio
  FROM (SELECT stock,
               coalesce(sum(remaining) FILTER (change_reason IN ({CANCELS})), 0e0) AS cancelled_lots,
               coalesce(sum(qty - remaining) FILTER (change_reason = 3), 0e0) AS traded_lots
        FROM reg GROUP BY stock)
  WHERE traded_lots > 0
)
"""
OVERLAP = """
by_order AS (SELECT stock FROM fresh GROUP BY stock ORDER BY sum(order_tl) DESC, stock LIMIT 10),
by_trade AS (SELECT stock FROM fills GROUP BY stock ORDER BY sum(traded_tl) DESC, stock LIMIT 10),
overlap AS (
  SELECT CASE WHEN t.stock IS NULL THEN 'order_only' WHEN o.stock IS NULL THEN 'trade_only'
              ELSE 'both' END AS category,
         coalesce(o.stock, t.stock) AS stock
  FROM by_order o FULL JOIN by_trade t ON o.stock = t.stock
)
"""
ROLLING = """
minutes AS (
  SELECT date_trunc('minute', entry_ts) AS minute_ts, count(*) AS n, sum(qty) AS lots,
         sum(order_tl) AS tl
  FROM fresh WHERE entry_ts IS NOT NULL GROUP BY ALL
),
rolling AS (
  SELECT minute_ts, CAST(sum(n) OVER reach AS BIGINT) AS rolling_order_count,
         round(sum(lots) OVER reach, 3) AS rolling_lots,
         round(sum(tl) OVER reach, 3) AS rolling_tl
  FROM minutes
  WINDOW reach AS (ORDER BY minute_ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW)
)
"""
LARGEST = """
big AS (
  SELECT time_window, qty FROM fresh WHERE qty > 0
  ORDER BY qty DESC, order_id, event_id LIMIT 100
)
"""
SIZES = """
sizes AS (
  SELECT period, count(*) AS order_count, round(avg(order_tl), 3) AS avg_order_tl,
         round(median(order_tl), 3) AS median_order_tl,
         min(order_tl) AS min_order_tl, max(order_tl) AS max_order_tl
  FROM fresh WHERE order_tl > 0 GROUP BY period
)
"""
LOTS = """
mean_lots AS (
  SELECT time_window, count(*) AS order_count, round(avg(qty), 3) AS avg_lots_per_order,
         round(sum(qty), 3) AS total_lots
  FROM fresh WHERE qty > 0 GROUP BY time_window
)
"""

# What reading the spoiled text of the fixture gives.
TYPED = """
SELECT event_id, order_id, stock, side, session,
       TRY_CAST(CAST(entry_ts AS VARCHAR) AS TIMESTAMP) AS entry_ts,
       TRY_CAST(if(event_id % 47 = 0, 'not a time', CAST(change_ts AS VARCHAR)) AS TIMESTAMP)
         AS change_ts,
       TRY_CAST(CAST(qty AS VARCHAR) AS DOUBLE) AS qty,
       TRY_CAST(CAST(remaining AS VARCHAR) AS DOUBLE) AS remaining,
       TRY_CAST(CAST(visible_qty AS VARCHAR) AS DOUBLE) AS visible_qty,
       TRY_CAST(if(event_id % 41 = 0, 'n/a', CAST(price AS VARCHAR)) AS DOUBLE) AS price,
       TRY_CAST(if(event_id % 43 = 0, change_reason || '.4', CAST(change_reason AS VARCHAR))
                AS INTEGER) AS change_reason,
       TRY_CAST(CAST(order_type AS VARCHAR) AS INTEGER) AS order_type,
       TRY_CAST(CAST(exch_order_type AS VARCHAR) AS INTEGER) AS exch_order_type,
       TRY_CAST(CAST(order_cat AS VARCHAR) AS INTEGER) AS order_cat,
       if(event_id % 41 = 0, NULL, qty * price) AS order_tl
"""
WHOLE_LINE = "event_id % 53 <> 0 AND event_id % 59 <> 0"

SQL = {
    "scan_typed_events": query(f"{TYPED} FROM ev"),
    "scan_delimited_events": query(f"{TYPED} FROM ev WHERE {WHOLE_LINE}"),
    "scan_rejects": query(
        f"""
SELECT "column", CAST(CASE "column"
         WHEN 'change_ts' THEN (SELECT count(*) FROM ev WHERE event_id % 47 = 0 AND {WHOLE_LINE})
         WHEN 'price' THEN (SELECT count(*) FROM ev WHERE event_id % 41 = 0 AND {WHOLE_LINE})
         WHEN '_rejected' THEN (SELECT count(*) FROM ev WHERE NOT ({WHOLE_LINE}))
         ELSE 0 END AS BIGINT) AS lost
FROM (VALUES ('entry_ts'), ('change_ts'), ('qty'), ('remaining'), ('visible_qty'), ('price'),
             ('change_reason'), ('order_type'), ('exch_order_type'), ('order_cat'), ('_rejected')) AS names("column")
"""
    ),
    "session_windows": query(
        f"""
SELECT event_id, {window('entry_ts')} AS entry_window, {window('change_ts')} AS change_window
FROM ev
"""
    ),
    "broad_sessions": query(f"SELECT event_id, {broad('entry_ts')} AS period FROM ev"),
    "q01_new_orders": query(
        """
SELECT count(*) AS new_order_count, round(sum(qty), 3) AS total_lots,
       round(sum(order_tl), 3) AS total_tl
FROM fresh
""",
        NEW,
    ),
    "q02_buy_sell": query(
        """
SELECT side, count(*) AS count,
       round(100e0 * count(*) / (SELECT count(*) FROM fresh), 6) AS pct_count,
       round(sum(qty), 3) AS total_lots,
       round(100e0 * sum(qty) / (SELECT sum(qty) FROM fresh), 6) AS pct_lots,
       round(sum(order_tl), 3) AS total_tl,
       round(100e0 * sum(order_tl) / (SELECT sum(order_tl) FROM fresh), 6) AS pct_tl
FROM fresh GROUP BY side
""",
        NEW,
    ),
    "q03_top_stocks": query(
        """
SELECT stock, round(lots, 3) AS lots, round(pct_lots, 6) AS pct_lots,
       round(tl, 3) AS tl, round(pct_tl, 6) AS pct_tl
FROM best
""",
        NEW,
        STOCKS,
    ),
    "q03_top10_share": query(
        """
SELECT round(sum(pct_lots), 6) AS top_pct_lots, round(sum(pct_tl), 6) AS top_pct_tl FROM best
""",
        NEW,
        STOCKS,
    ),
    "q04_windows": query(
        """
SELECT time_window, order_count, round(pct_count, 6) AS pct_count,
       round(total_lots, 3) AS total_lots, round(total_tl, 3) AS total_tl,
       round(pct_tl, 6) AS pct_tl
FROM windows
""",
        NEW,
        WINDOWS,
    ),
    "q04_windows_by_day": query(
        """
SELECT trade_date, time_window, order_count,
       round(100e0 * order_count / sum(order_count) OVER day, 6) AS pct_count,
       round(lots, 3) AS total_lots, round(tl, 3) AS total_tl,
       round(100e0 * tl / sum(tl) OVER day, 6) AS pct_tl
FROM (SELECT CAST(CAST(entry_ts AS DATE) AS VARCHAR) AS trade_date, time_window, count(*) AS order_count,
             sum(qty) AS lots, sum(order_tl) AS tl
      FROM fresh GROUP BY ALL)
WINDOW day AS (PARTITION BY trade_date)
""",
        NEW,
    ),
    "q04_peaks": query(
        """
(SELECT 'order_count' AS measure, time_window, CAST(order_count AS DOUBLE) AS peak,
        round(pct_count, 6) AS pct
 FROM windows ORDER BY order_count DESC, time_window LIMIT 1)
UNION ALL
(SELECT 'total_tl', time_window, round(total_tl, 3), round(pct_tl, 6)
 FROM windows ORDER BY total_tl DESC, time_window LIMIT 1)
""",
        NEW,
        WINDOWS,
    ),
    "q04b_rolling": query("SELECT * FROM rolling", NEW, ROLLING),
    "q04b_peak": query(
        """
SELECT minute_ts, rolling_order_count, rolling_lots
FROM rolling ORDER BY rolling_order_count DESC, minute_ts LIMIT 1
""",
        NEW,
        ROLLING,
    ),
    "q05_order_types": query(
        """
SELECT total_new, total_lots, limit_count,
       round(100e0 * limit_count / total_new, 6) AS limit_pct_count,
       limit_lots, round(100e0 * limit_lots / total_lots, 6) AS limit_pct_lots,
       iceberg_count, round(100e0 * iceberg_count / total_new, 6) AS iceberg_pct_count,
       iceberg_lots, round(100e0 * iceberg_lots / total_lots, 6) AS iceberg_pct_lots
FROM (SELECT count(*) AS total_new, sum(qty) AS total_lots,
             count(*) FILTER (order_type = 1) AS limit_count,
             sum(if(order_type = 1, qty, 0e0)) AS limit_lots,
             count(*) FILTER (visible_qty <> qty) AS iceberg_count,
             sum(if(visible_qty <> qty, qty, 0e0)) AS iceberg_lots
      FROM fresh)
""",
        NEW,
    ),
    "q06_window_counts": query(
        "SELECT time_window, count(*) AS order_count FROM fresh GROUP BY time_window", NEW
    ),
    "q06_ratio": query(
        """
SELECT b.time_window AS busiest, b.order_count AS busiest_count,
       c.time_window AS calmest, c.order_count AS calmest_count,
       b.order_count / c.order_count AS ratio
FROM (SELECT * FROM volumes ORDER BY order_count DESC, time_window LIMIT 1) b,
     (SELECT * FROM volumes ORDER BY order_count, time_window LIMIT 1) c
""",
        NEW,
        WINDOWS,
    ),
    "q07_cancellations": query(
        """
SELECT count(*) AS cancelled_events, round(sum(remaining), 3) AS cancelled_lots,
       round(sum(left_tl), 3) AS cancelled_tl
FROM gone
""",
        GONE,
    ),
    "q07b_expiry_breakdown": query(
        """
SELECT if(change_reason = 19, 'Expired (reason 19)', 'Other cancellations') AS cancel_type,
       count(*) AS events, round(sum(remaining), 3) AS lots, round(sum(left_tl), 3) AS tl
FROM gone GROUP BY cancel_type
""",
        GONE,
    ),
    "q08_cancel_windows": query(
        """
SELECT time_window, cancelled_count, round(cancelled_lots, 3) AS cancelled_lots,
       round(cancelled_tl, 3) AS cancelled_tl
FROM gone_windows
""",
        GONE,
        GONE_WINDOWS,
    ),
    "q08_peak": query(
        """
SELECT time_window, cancelled_count
FROM gone_windows ORDER BY cancelled_count DESC, time_window LIMIT 1
""",
        GONE,
        GONE_WINDOWS,
    ),
    "q09_ratio": query(
        """
SELECT stock, round(cancelled_lots, 3) AS cancelled_lots, round(traded_lots, 3) AS traded_lots,
       cancel_to_trade_ratio
FROM ratios
""",
        RATIOS,
    ),
    "q09_top10": query(
        """
SELECT stock, round(cancelled_lots, 3) AS cancelled_lots, round(traded_lots, 3) AS traded_lots,
       cancel_to_trade_ratio
FROM ratios ORDER BY cancel_to_trade_ratio DESC, stock LIMIT 10
""",
        RATIOS,
    ),
    "q09_bottom10": query(
        """
SELECT stock, round(cancelled_lots, 3) AS cancelled_lots, round(traded_lots, 3) AS traded_lots,
       cancel_to_trade_ratio
FROM ratios ORDER BY cancel_to_trade_ratio, stock DESC LIMIT 10
""",
        RATIOS,
    ),
    "q10_cancel_rate": query(
        f"""
SELECT round(nl, 3) AS new_lots, round(nt, 3) AS new_tl, round(cl, 3) AS cancel_lots,
       round(ct, 3) AS cancel_tl,
       round(if(coalesce(nl, 0) = 0, 0e0, 100e0 * cl / nl), 6) AS pct_lots,
       round(if(coalesce(nt, 0) = 0, 0e0, 100e0 * ct / nt), 6) AS pct_tl
FROM (SELECT sum(if(change_reason = 6, qty, 0e0)) AS nl,
             sum(if(change_reason = 6, order_tl, 0e0)) AS nt,
             sum(if(change_reason IN ({CANCELS}), remaining, 0e0)) AS cl,
             sum(if(change_reason IN ({CANCELS}), remaining * price, 0e0)) AS ct
      FROM reg)
"""
    ),
    "q11_overlap": query("SELECT category, stock FROM overlap", NEW, FILLS, OVERLAP),
    "q11_overlap_lists": query(
        """
SELECT c.category, coalesce(string_agg(o.stock, ',' ORDER BY o.stock), '') AS stocks
FROM (VALUES ('order_only'), ('both'), ('trade_only')) c(category)
LEFT JOIN overlap o ON o.category = c.category
GROUP BY c.category
""",
        NEW,
        FILLS,
        OVERLAP,
    ),
    "q12_peak_windows": query(
        """
SELECT o.w AS peak_order_window, round(o.tl, 3) AS peak_order_tl,
       t.w AS peak_trade_window, round(t.tl, 3) AS peak_trade_tl,
       o.w IS NOT DISTINCT FROM t.w AS same_window
FROM (SELECT time_window AS w, sum(order_tl) AS tl FROM fresh GROUP BY w
      ORDER BY tl DESC, w LIMIT 1) o,
     (SELECT time_window AS w, sum(traded_tl) AS tl FROM fills GROUP BY w
      ORDER BY tl DESC, w LIMIT 1) t
""",
        NEW,
        FILLS,
    ),
    "q13_concentration": query(
        """
SELECT count(*) AS total_stocks,
       count(*) FILTER (upto - tl < 0.5e0 * whole) + 1 AS stocks_for_50pct,
       count(*) FILTER (upto - tl < 0.8e0 * whole) + 1 AS stocks_for_80pct,
       count(*) FILTER (upto - tl < 0.5e0 * whole) AS stocks_for_50pct_exact,
       count(*) FILTER (upto - tl < 0.8e0 * whole) AS stocks_for_80pct_exact
FROM (SELECT tl, sum(tl) OVER () AS whole,
             sum(tl) OVER (ORDER BY tl DESC, stock ROWS UNBOUNDED PRECEDING) AS upto
      FROM stocks WHERE stock LIKE '%.E')
""",
        NEW,
        STOCKS,
    ),
    "q14_avg_lots": query("SELECT * FROM mean_lots", NEW, LOTS),
    "q14_peak": query(
        """
SELECT time_window, avg_lots_per_order
FROM mean_lots ORDER BY avg_lots_per_order DESC, time_window LIMIT 1
""",
        NEW,
        LOTS,
    ),
    "q15_order_size": query("SELECT * FROM sizes", NEW, SIZES),
    "q15_chart": query(
        """
SELECT CAST(period[1] AS INTEGER) AS position, period[3:] AS label, avg_order_tl,
       median_order_tl
FROM sizes
""",
        NEW,
        SIZES,
    ),
    "q16_top100": query(
        """
SELECT time_window, count(*) AS count, round(sum(qty), 3) AS total_lots
FROM big GROUP BY time_window
""",
        NEW,
        LARGEST,
    ),
    "q16_closing": query(
        """
SELECT count(*) AS closing_count, round(coalesce(sum(qty), 0e0), 3) AS closing_lots
FROM big WHERE time_window = 'Z_CLOSING'
""",
        NEW,
        LARGEST,
    ),
}

SQL["q15_order_size_approx"] = query(
    "SELECT * FROM sizes", NEW, SIZES.replace("median(order_tl)", "quantile_disc(order_tl, 0.5)")
)
SQL["q09_ratio_by_fill"] = query(
    f"""
SELECT stock, round(cancelled_lots, 3) AS cancelled_lots, round(traded_lots, 3) AS traded_lots,
       round(cancelled_lots / traded_lots, 4) AS cancel_to_trade_ratio
FROM (SELECT stock, coalesce(sum(remaining) FILTER (change_reason IN ({CANCELS})), 0e0) AS cancelled_lots
      FROM reg GROUP BY stock)
JOIN (SELECT stock, sum(fill_lots) AS traded_lots FROM filled GROUP BY stock) USING (stock)
WHERE traded_lots > 0
""",
    FILLED,
)


def _long(name: str, labels: str, measures: str) -> str:
    """The rows of a query, one per label and measure."""
    listed = measures.split()
    columns = ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in listed)
    label = f"coalesce({labels}, '')" if labels else "''"
    return (
        f"SELECT '{name}' AS question, label, measure, value "
        f"FROM (SELECT {label} AS label, {columns} FROM ({SQL[name]})) "
        f"UNPIVOT INCLUDE NULLS (value FOR measure IN ({', '.join(listed)}))"
    )


# The tables of the report with their labels and measures.
REPORT = (
    ("q01_new_orders", "", "new_order_count total_lots total_tl"),
    ("q02_buy_sell", "side", "count total_lots total_tl pct_count pct_lots pct_tl"),
    ("q03_top_stocks", "stock", "lots tl pct_lots pct_tl"),
    ("q04_windows", "time_window", "order_count pct_count total_lots total_tl pct_tl"),
    (
        "q05_order_types",
        "",
        "total_new total_lots limit_count limit_pct_count limit_lots limit_pct_lots "
        "iceberg_count iceberg_pct_count iceberg_lots iceberg_pct_lots",
    ),
    ("q06_window_counts", "time_window", "order_count"),
    ("q07_cancellations", "", "cancelled_events cancelled_lots cancelled_tl"),
    ("q07b_expiry_breakdown", "cancel_type", "events lots tl"),
    ("q08_cancel_windows", "time_window", "cancelled_count cancelled_lots cancelled_tl"),
    ("q09_ratio", "stock", "cancelled_lots traded_lots cancel_to_trade_ratio"),
    ("q10_cancel_rate", "", "new_lots new_tl cancel_lots cancel_tl pct_lots pct_tl"),
    (
        "q13_concentration",
        "",
        "total_stocks stocks_for_50pct stocks_for_80pct stocks_for_50pct_exact stocks_for_80pct_exact",
    ),
    ("q14_avg_lots", "time_window", "order_count avg_lots_per_order total_lots"),
)
SQL["overview_report"] = "\nUNION ALL\n".join(_long(*table) for table in REPORT)
