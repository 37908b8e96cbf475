"""Order events derived from the generic activity table ``events``.

All events of a user on a day are one order. The rules below only spread the
rows over every code, window and class; FIXTURES.md lists them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookloom import schema as S
from bookloom.functions.numbers import micros_between
from bookloom.operators.runs import large_orders, split_large


def _opened(rows: DataFrame) -> DataFrame:
    """Add entry_ts and opens, from the first row of each order."""
    by_time = Window.partitionBy("order_id").orderBy(
        F.col("ts").asc_nulls_last(), F.col("event_id").asc_nulls_last()
    )
    return rows.select(
        "*",
        F.first("ts").over(by_time).alias("entry_ts"),
        (F.row_number().over(by_time) == 1).alias("opens"),
    )


def _opened_hot(rows: DataFrame) -> DataFrame:
    """The same for orders too large for one task; there are few of them."""
    first = rows.groupBy(F.col("order_id").alias("_order")).agg(
        F.min(F.struct(F.col("ts").isNull(), "ts", "event_id")).alias("_first")
    )
    same = F.col("order_id").eqNullSafe(F.col("_order"))
    return rows.join(F.broadcast(first), same).selectExpr(
        *rows.columns,
        "_first.ts AS entry_ts",
        "ts <=> _first.ts AND event_id <=> _first.event_id AS opens",
    )


def order_events(activity: DataFrame, hot_order_rows: int | None = None) -> DataFrame:
    """Typed order events (with event_id as extra column).

    The first event of each order is found on rows shuffled by order_id, so
    later operators on the order need no shuffle of their own. With a limit, orders
    of more rows are combined before the shuffle instead.
    """
    rows = activity.withColumn(
        "order_id", F.expr("concat('O', user_id, '-', cast(cast(ts AS date) AS string))")
    )
    if hot_order_rows is None:
        return _typed(_opened(rows))
    large, rest = split_large(rows, large_orders(rows, hot_order_rows))
    return _typed(_opened(rest).unionByName(_opened_hot(large)))


def _typed(opened: DataFrame) -> DataFrame:
    resized = "event_type IN ('signup', 'view')"
    delay = F.floor(micros_between("entry_ts", "ts") / F.expr("pow(10D, user_id % 7)"))
    # Later lines refer to columns named on earlier ones.
    return (
        opened.withColumn("delay", delay)
        .selectExpr(
            "event_id",
            "order_id",
            "concat('STK', lpad(user_id % 23, 2, '0'), if(user_id % 23 < 19, '.E', '.V')) AS stock",
            f"CASE user_id % 31 WHEN 5 THEN 'X' WHEN 6 THEN NULL "
            f"ELSE if(user_id % 2 = 0, '{S.BUY}', '{S.SELL}') END AS side",
            "CASE WHEN user_id % 19 = 3 THEN NULL WHEN hour(entry_ts) = 17 THEN 'PAY_KAPANIS' "
            "WHEN hour(entry_ts) = 11 THEN 'PAY_ACS_EMR' ELSE 'PAY_SUREKLI' END AS session",
            "entry_ts",
            "if(event_id % 97 = 0 AND NOT opens, NULL, timestampadd(MICROSECOND, delay, entry_ts)) "
            "AS change_ts",
            f"CASE WHEN opens AND user_id % 43 <> 9 THEN {S.NEW} "
            f"WHEN opens OR event_type = 'purchase' THEN {S.TRADE} "
            f"WHEN {resized} THEN {S.REPLACED} "
            f"WHEN event_type = 'click' THEN {S.CANCELLED_BY_USER} "
            f"WHEN event_id % 3 = 0 THEN 13 ELSE {S.EXPIRED} END AS change_reason",
            f"(user_id % 50 + 1) * 100D + if(change_reason <> {S.NEW} AND {resized}, "
            "cast(get_json_object(props, '$.k') AS int) * 10D, 0D) AS qty",
            f"if(change_reason = {S.NEW}, qty, qty * (event_id % 4) / 4D) AS remaining",
            "CASE WHEN event_id % 17 = 0 THEN qty / 10D WHEN event_id % 5 = 0 THEN NULL "
            "ELSE qty END AS visible_qty",
            "if(event_id % 37 = 0, NULL, value) AS price",
            "if(event_id % 10 = 0, 2, 1) AS order_type",
            "0 AS exch_order_type",
            "if(user_id % 29 = 0, 4, 1) AS order_cat",
            "qty * price AS order_tl",
        )
    )


# Columns of the activity table.
ACTIVITY_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def load_order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_events(spark.read.schema(ACTIVITY_SCHEMA).parquet(f"{sf_dir}/events.parquet"))


def raw_lines(events: DataFrame) -> DataFrame:
    """The same as delimited lines (``value``), some with a field too few or too many."""
    text = raw_text(events)
    fields = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in text.columns if c != "event_id"]
    line = F.concat_ws(";", *fields)
    short = F.concat_ws(";", *fields[:-1])
    eid = F.col("event_id")
    value = F.when(eid % 53 == 0, short).when(eid % 59 == 0, F.concat(line, F.lit(";more")))
    return text.select("event_id", value.otherwise(line).alias("value"))


def raw_text(events: DataFrame) -> DataFrame:
    """The same events as the text columns of a raw file, some of them unreadable."""
    eid = F.col("event_id")
    spoiled = {
        "price": F.when(eid % 41 == 0, F.lit("n/a")),
        "change_reason": F.when(
            eid % 43 == 0, F.concat(F.col("change_reason").cast("string"), F.lit(".4"))
        ),
        "change_ts": F.when(eid % 47 == 0, F.lit("not a time")),
    }
    names = {**S.TEXT_COLUMNS, **S.TIME_COLUMNS, **S.NUMBER_COLUMNS, **S.CODE_COLUMNS}

    def text(column: str):
        plain = F.col(column).cast("string")
        return spoiled[column].otherwise(plain) if column in spoiled else plain

    return events.select("event_id", *[text(c).alias(r) for r, c in names.items()])
