"""Raw order-event files and the typed event frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bookloom import schema as S
from bookloom.functions.keys import key_slot
from bookloom.operators.runs import PIECE_ROWS, event_order, large_orders, split_large
from bookloom.operators.samples import SLOT


def read_raw_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Semicolon-delimited files with a header, every column as text.

    Rows with too few or too many fields are left out. The parser has to read
    whole rows to notice them, hence no column pruning inside the parser; read
    a file often by copying it to Parquet once (``write_event_table``). The
    header of every file is checked against the first one.
    """
    return (
        spark.read.option("sep", ";")
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("mode", "DROPMALFORMED")
        .option("columnPruning", False)
        .option("enforceSchema", False)
        .csv(path)
    )


REJECTED = "_rejected"


def parse_lines(lines: DataFrame, columns: list[str], line: str = "value") -> DataFrame:
    """Delimited lines without a header, as text columns, for audits of raw files.

    Other columns stay. A line with too few or too many fields is kept whole in
    ``_rejected`` (NULL for good lines) and its columns are NULL.
    """
    kinds = ", ".join(f"`{c}` STRING" for c in [*columns, REJECTED])
    options = {"sep": ";", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED}
    parsed = lines.withColumn("_row", F.from_csv(F.col(f"`{line}`"), kinds, options))
    good = F.col(f"_row.{REJECTED}").isNull()
    rest = [F.col(f"`{c}`") for c in lines.columns if c != line]
    fields = [F.when(good, F.col(f"_row.`{c}`")).alias(c) for c in columns]
    return parsed.select(*rest, *fields, F.col(f"_row.{REJECTED}").alias(REJECTED))


def scan_losses(raw: DataFrame, time_format: str | None = None) -> DataFrame:
    """What reading would lose: rejected lines, and unreadable values per column.

    One row per engine column with its count of non-empty texts that become
    NULL, and one named ``_rejected`` with the lines left out. One pass.
    """
    typed = typed_events(raw, time_format)
    names = {**S.TIME_COLUMNS, **S.NUMBER_COLUMNS, **S.CODE_COLUMNS}
    counts = [
        F.count_if((F.length(F.trim(_raw(r))) > 0) & F.col(c).isNull()).alias(c)
        for r, c in names.items()
    ]
    rejected = F.count(REJECTED) if REJECTED in raw.columns else F.lit(0).cast("bigint")
    lost = typed.agg(*counts, rejected.alias(REJECTED))
    return lost.unpivot([], [*names.values(), REJECTED], "column", "lost")


def _raw(name: str) -> Column:
    return F.col(f"`{name}`")


def _code(name: str) -> Column:
    """Integer from text; '6.7' is read as 7, anything else unreadable as NULL."""
    return F.round(_raw(name).try_cast("double")).try_cast("int")


def _time(name: str, time_format: str | None) -> Column:
    if time_format is None:
        return _raw(name).try_cast("timestamp_ntz")
    return F.try_to_timestamp(_raw(name), F.lit(time_format)).cast("timestamp_ntz")


def typed_events(raw: DataFrame, time_format: str | None = None) -> DataFrame:
    """All raw columns, then the engine columns; unreadable values become NULL.

    Times are read as ISO text unless their pattern is given; ``scan_losses``
    counts what did not fit.
    """
    texts = [_raw(r).cast("string").alias(c) for r, c in S.TEXT_COLUMNS.items()]
    times = [_time(r, time_format).alias(c) for r, c in S.TIME_COLUMNS.items()]
    numbers = [_raw(r).try_cast("double").alias(c) for r, c in S.NUMBER_COLUMNS.items()]
    codes = [_code(r).alias(c) for r, c in S.CODE_COLUMNS.items()]
    value = (
        _raw("EMIR MIKTARI").try_cast("double") * _raw("FIYAT").try_cast("double")
    ).alias("order_tl")
    return raw.select("*", *texts, *times, *numbers, *codes, value)


def raw_columns(events: DataFrame) -> list[str]:
    """Columns that are not engine columns: the raw ones and any extras."""
    return [c for c in events.columns if c not in S.ENGINE_COLUMNS]


def read_events(
    spark: SparkSession, path: str | list[str], time_format: str | None = None
) -> DataFrame:
    return typed_events(read_raw_events(spark, path), time_format)


def read_audited_events(
    spark: SparkSession, path: str | list[str], time_format: str | None = None
) -> DataFrame:
    """All lines of raw files as typed events, rejected ones too.

    A line with too few or too many fields is whole in ``_rejected`` and has no values.
    """
    names = read_raw_events(spark, path).columns
    kinds = ", ".join(f"`{c}` STRING" for c in [*names, REJECTED])
    raw = (
        spark.read.schema(kinds)
        .option("sep", ";")
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", REJECTED)
        .option("columnPruning", False)
        .csv(path)
    )
    good = F.col(REJECTED).isNull()
    kept = [F.when(good, _raw(c)).alias(c) for c in names]
    return typed_events(raw.select(*kept, REJECTED), time_format)


# Folders of a table: its events, and the lines that were rejected when it was made.
STATE, GOOD, BAD = "state", "event", "rejected"
DAY = "trade_date"


def ingest_events(
    spark: SparkSession, path: str | list[str], table: str, time_format: str | None = None
) -> dict[str, int]:
    """Read raw files once into an event table; returns what reading lost.

    Counts are observed while the table is written: lines (``lines``), rejected lines
    (``_rejected``) and, per column, texts that could not be read. Rejected lines are kept
    in a folder of the table, see ``read_rejected``.
    """
    events = read_audited_events(spark, path, time_format)
    names = {**S.TIME_COLUMNS, **S.NUMBER_COLUMNS, **S.CODE_COLUMNS}
    lost = Observation("ingest")
    watched = events.observe(
        lost,
        F.count(F.lit(1)).alias("lines"),
        F.count(REJECTED).alias(REJECTED),
        *[
            F.count_if((F.length(F.trim(_raw(r))) > 0) & F.col(c).isNull()).alias(c)
            for r, c in names.items()
        ],
    )
    write_event_table(watched, table)
    return lost.get


def write_event_table(events: DataFrame, path: str) -> None:
    """One-time Parquet copy, in folders by day of the event and by a hash of the order id.

    A question about one day, one order or a sample of the orders reads only their
    folders; files have a bloom filter on the order id. Events read with
    ``read_audited_events`` leave their rejected lines in a folder beside the events.

    The rebalance hint brings the rows of a folder together for large files, and
    lets adaptive execution split one that is far larger than the others.
    """
    rejected = F.col(REJECTED).isNotNull() if REJECTED in events.columns else F.lit(False)
    folders = (STATE, DAY, SLOT)
    (
        events.withColumn(STATE, F.when(rejected, BAD).otherwise(GOOD))
        .withColumn(DAY, F.to_date("change_ts"))
        .withColumn(SLOT, key_slot("order_id"))
        .hint("rebalance", *folders)
        .write.partitionBy(*folders)
        .option("parquet.bloom.filter.enabled#order_id", "true")
        .mode("errorifexists")
        .parquet(path)
    )


def _state(spark: SparkSession, path: str, state: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col(STATE) == state).drop(STATE)


def read_event_table(spark: SparkSession, path: str) -> DataFrame:
    """The events of a table, with ``trade_date`` and ``key_slot``."""
    return _state(spark, path, GOOD).drop(REJECTED)


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """The rejected lines of a table (``_rejected``); none if they were not kept."""
    table = _state(spark, path, BAD)
    return table.select(REJECTED) if REJECTED in table.columns else table.select().limit(0)


def save_event_table(
    events: DataFrame,
    name: str,
    buckets: int,
    path: str | None = None,
    piece_rows: int = PIECE_ROWS,
) -> None:
    """The copy as tables of the session's catalog, bucketed and sorted by order.

    Questions on orders then need no shuffle of the events. Choose the number of
    buckets so that one holds a few hundred MB. Orders of more than ``piece_rows``
    events would fill a bucket of their own; they go to a table beside it
    (``<name>_large``), in pieces by time. See ``by_table``.
    """
    dated = events.withColumn(DAY, F.to_date("change_ts"))
    large, rest = split_large(dated, large_orders(dated, piece_rows))

    def write(frame: DataFrame, suffix: str, bucketed: bool) -> None:
        writer = frame.write.mode("errorifexists")
        if bucketed:
            writer = writer.bucketBy(buckets, "order_id").sortBy("order_id")
        if path:
            writer = writer.option("path", f"{path.rstrip('/')}{suffix}")
        writer.saveAsTable(f"{name}{suffix}")

    write(rest.repartition(buckets, "order_id"), "", True)
    in_time = [F.col("order_id"), *event_order(large)]
    write(large.repartitionByRange(*in_time).sortWithinPartitions(*in_time), LARGE, False)


LARGE = "_large"


def by_table(
    spark: SparkSession, name: str, question: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """A question on orders asked of a saved table: of its buckets and of its large orders.

    Right for questions that deal with each order by itself.
    """
    ordinary, large = (spark.table(f"{name}{suffix}") for suffix in ("", LARGE))
    return question(ordinary).unionByName(question(large))
