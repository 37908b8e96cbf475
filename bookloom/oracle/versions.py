"""Oracle SQL of order versions, samples and repricing."""

from __future__ import annotations

from bookloom.oracle.base import LIVES, NUMBERED, REUSED, query

EV = (
    "event_id, order_id, stock, side, session, entry_ts, change_ts, qty, remaining, "
    "visible_qty, price, change_reason, order_type, exch_order_type, order_cat, order_tl"
)
DETAIL = """
-- Fixed values: names of codes, and the wording of the sentences below.
names(code, event) AS (
  VALUES (1, 'CANCEL_USER'), (3, 'TRADE'), (5, 'REPLACED'), (6, 'NEW'), (9, 'CANCEL_SYS'),
         (10, 'CANCEL_BEHALF'), (13, 'ICE_REFRESH'), (15, 'CANCEL_LIMIT'), (19, 'EXPIRED'),
         (20, 'CANCEL_ISS'), (34, 'CANCEL_AUCTION'), (41, 'CANCEL_MM_DELTA'),
         (42, 'CANCEL_MM_ABS'), (43, 'CROSSING_DEL')
),
rounded AS (
  SELECT event_id, order_id, side, stock, change_reason, change_ts,
         round(price, 4) AS price, round(prev_price, 4) AS prev_price,
         round(qty, 0) AS qty, round(prev_qty, 0) AS prev_qty,
         remaining, qualifies, sub_order_number, composite_id
  FROM numbered
),
gaps AS (
  SELECT *, price - prev_price AS dp, qty - prev_qty AS dq,
         coalesce((price - prev_price) * CASE side WHEN 'A' THEN 1 WHEN 'S' THEN -1 END > 0, false) AS better
  FROM rounded
),
worded AS (
  SELECT *,
         concat_ws(', ', if(abs(dp) > 1e-9 AND better, printf('price %+.4f (better)', dp), NULL),
                         if(dq > 1e-9, printf('qty %+d', CAST(dq AS BIGINT)), NULL)) AS plus,
         concat_ws(', ', if(abs(dp) > 1e-9 AND NOT better, printf('price %+.4f (worse)', dp), NULL),
                         if(dq < -1e-9, printf('qty %d (reduced)', CAST(dq AS BIGINT)), NULL)) AS minus
  FROM gaps
),
detail AS (
  SELECT order_id, side, stock, change_reason, change_ts, price, prev_price, qty, prev_qty,
         remaining, qualifies, sub_order_number, composite_id,
         coalesce(event, 'reason_' || change_reason) AS event,
         CASE WHEN change_reason <> 5 THEN '-'
              WHEN prev_price IS NULL THEN 'first row — nothing to compare'
              WHEN plus <> '' AND minus <> '' THEN 'IMPROVED: ' || plus || '  |  also: ' || minus
              WHEN plus <> '' THEN 'IMPROVED: ' || plus
              WHEN minus <> '' THEN 'no improvement — ' || minus
              ELSE 'no change' END AS improvement,
         if(qualifies = 1, 'YES', '') AS qualified,
         if(side = 'A', 'BUY (alis)', 'SELL (satis)') AS side_full
  FROM worded LEFT JOIN names ON code = change_reason
)
"""
SUMMARY = """
starts AS (
  SELECT * FROM numbered WHERE qualifies = 1 OR (change_reason = 6 AND sub_order_number = 0)
),
summary AS (
  SELECT composite_id, stock, side, change_ts AS version_start_ts,
         round(price, 4) AS version_price, round(qty, 0) AS version_qty,
         lead(change_ts) OVER nxt AS version_end_ts,
         round(date_diff('microsecond', change_ts, lead(change_ts) OVER nxt) / 1e6, 2)
           AS version_duration_s
  FROM starts WINDOW nxt AS (PARTITION BY order_id ORDER BY sub_order_number, event_id)
)
"""
VERSIONS = """
tops AS (
  SELECT order_id, max(stock) AS stock, max(sub_order_number) AS max_version
  FROM numbered GROUP BY order_id
),
every_number AS (
  SELECT max_version AS times_improved, count(*) AS n_orders,
         round(100e0 * count(*) / (SELECT count(*) FROM tops), 2) AS pct_of_orders
  FROM tops GROUP BY max_version
),
distribution AS (SELECT * FROM every_number ORDER BY times_improved LIMIT 15)
"""
MODIFIED = """
replaced AS (
  SELECT order_id, count(*) AS n FROM reg WHERE change_reason = 5 GROUP BY order_id
),
chosen AS (
  SELECT order_id FROM replaced
  WHERE n >= if((SELECT max(n) FROM replaced) >= 3, 3, 2)
  ORDER BY order_id LIMIT 5
)
"""
LONGEST = """
longest AS (
  SELECT order_id FROM reg GROUP BY order_id ORDER BY count(*) DESC, order_id LIMIT 1
)
"""
PICKS = """
picks AS (
  SELECT CASE WHEN ever_traded = 1 AND original_qty > 0 THEN 'TRADED'
              WHEN ever_traded = 0 AND ever_expired = 1 THEN 'EXPIRED, no fill'
              WHEN ever_traded = 0 AND ever_cancelled = 1 THEN 'CANCELLED, no fill' END AS sample,
         *
  FROM lives
  QUALIFY sample IS NOT NULL
          AND row_number() OVER (PARTITION BY sample ORDER BY order_id) <= 3
)
"""

SQL = {
    "qualifying_improvements": query(
        """
SELECT event_id, order_id, change_reason, side, price, prev_price, qty, prev_qty, qualifies,
       sub_order_number
FROM numbered
""",
        NUMBERED,
    ),
    "enrich_events": query(
        f"SELECT {EV}, sub_order_number, composite_id FROM numbered", NUMBERED
    ),
    "order_detail": query("SELECT * FROM detail", NUMBERED, DETAIL),
    "order_detail_header": query(
        """
SELECT order_id, max(stock) AS stock, max(side_full) AS side_full,
       max(sub_order_number) + 1 AS n_versions, CAST(sum(qualifies) AS BIGINT) AS n_improvements
FROM detail GROUP BY order_id
""",
        NUMBERED,
        DETAIL,
    ),
    "order_lookup": query(
        "SELECT d.* FROM detail d SEMI JOIN longest USING (order_id)", NUMBERED, DETAIL, LONGEST
    ),
    "order_lookup_by_id": query(
        "SELECT * FROM detail WHERE order_id = 'O7-2024-01-05'", NUMBERED, DETAIL
    ),
    "version_summary": query("SELECT * FROM summary", NUMBERED, SUMMARY),
    "version_summary_display": query(
        """
SELECT composite_id, stock, side, version_start_ts, version_price, version_qty,
       coalesce(strftime(version_end_ts, '%Y-%m-%d %H:%M:%S.%f'),
                '(last version — see order events)') AS version_end_ts,
       coalesce(printf('%.2fs', version_duration_s), '(ongoing)') AS version_duration_s
FROM summary
""",
        NUMBERED,
        SUMMARY,
    ),
    "version_distribution": query("SELECT * FROM distribution", NUMBERED, VERSIONS),
    "version_distribution_full": query("SELECT * FROM every_number", NUMBERED, VERSIONS),
    "version_distribution_headline": query(
        """
SELECT count(*) AS total_orders, count(*) FILTER (max_version > 0) AS improved_orders,
       round(100e0 * count(*) FILTER (max_version > 0) / count(*), 6) AS pct_improved
FROM tops
""",
        NUMBERED,
        VERSIONS,
    ),
    "version_distribution_meaning": query(
        """
SELECT *, CASE times_improved
    WHEN 0 THEN 'Order was never improved — placed and left as-is, then cancelled/filled/expired'
    WHEN 1 THEN 'One improvement: trader re-competed once, lost time priority once'
    WHEN 2 THEN 'Two improvements: trader actively managed this order twice'
    ELSE times_improved || ' improvements — highly active order management' END AS meaning
FROM distribution
""",
        NUMBERED,
        VERSIONS,
    ),
    "repricing_by_stock": query(
        """
SELECT stock, count(*) AS total_orders,
       count(*) FILTER (max_version > 0) AS orders_with_improvements,
       round(100e0 * count(*) FILTER (max_version > 0) / count(*), 2) AS pct_improved,
       round(avg(max_version) FILTER (max_version > 0), 2) AS avg_versions_when_improved
FROM tops GROUP BY stock HAVING count(*) >= 10
ORDER BY orders_with_improvements DESC, stock LIMIT 20
""",
        NUMBERED,
        VERSIONS,
    ),
    "sample_modified_orders": query("SELECT order_id FROM chosen", MODIFIED),
    "sample_orders_by_key": query(
        f"""
SELECT {EV} FROM ev
WHERE CAST('0x' || md5(order_id)[1:8] AS BIGINT) % 100 = 0
"""
    ),
    "sample_orders_lifecycle": query(
        """
SELECT sample, order_id, stock, side, born_ts, first_fill_ts, last_event_ts, original_qty,
       traded_lots, event_count, round(lifetime_seconds, 3) AS lifetime_s,
       round(time_to_first_fill_seconds, 3) AS fill_lag_s, ever_traded, ever_cancelled,
       ever_expired
FROM picks
""",
        LIVES,
        PICKS,
    ),
    "sample_orders_raw_events": query(
        """
SELECT sample, order_id, change_reason, entry_ts, change_ts, qty, remaining,
       round(price, 4) AS price, session
FROM reg JOIN (SELECT sample, order_id FROM picks) USING (order_id)
""",
        LIVES,
        PICKS,
    ),
}
# Cutting large orders changes how rows are shared out, not the result.
SQL |= {
    f"{name}_cut": SQL[name] for name in ("enrich_events", "order_detail", "version_summary")
}
SQL["sink_parquet_roundtrip"] = SQL["enrich_events"]
SQL["sink_csv_roundtrip"] = SQL["order_detail"]
SQL["enrich_events_by_day_key"] = query(
    f"SELECT {EV}, sub_order_number, composite_id FROM numbered",
    REUSED,
    NUMBERED.replace("FROM reg", "FROM reused")
    .replace("PARTITION BY order_id", "PARTITION BY order_id, entry_day")
    .replace("concat(order_id, '_', sub", "concat(order_id, '_', entry_day, '_', sub"),
)
