"""What the operators share: text rules, staged tables, Arrow rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space and ASCII letters.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have at most so many rows handed to Python at a time: texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(key))
    if held <= 0 or held > rows:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="bookloom-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write the frame as a table in the shared folder and go on from there.

    Tasks lost later read the table again instead of repeating what made it, and
    what depends on the order of rows stays as written.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


ROW = "_row"


def boxed(docs: DataFrame, results: Iterable[str] = ()) -> tuple[list[str], Column]:
    """Names of the columns that stay, and all of them as one struct, ``_row``.

    Rows travel through an operator as that one column, so none of their names can
    clash with the operator's own. ``results`` replace columns of the same name, in
    any case.
    """
    added = {name.lower() for name in results}
    names = [c for c in docs.columns if c.lower() not in added]
    fields = [F.col(f"`{c}`").alias(c) for c in names] or [F.lit(0).alias("_")]
    return names, F.struct(*fields).alias(ROW)


def unboxed(names: Iterable[str], own: Mapping[str, Column] | None = None) -> list[Column]:
    """The columns of ``_row`` again, but those given by name, in any case."""
    given = {name.lower(): column for name, column in (own or {}).items()}
    return [given.get(c.lower(), F.col(f"{ROW}.`{c}`")).alias(c) for c in names]


def ascii_lower(text: Column | str) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column | str, folds: int) -> Column:
    """CRC32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(None))
    return F.pmod(F.crc32(F.coalesce(text.cast("string"), F.lit(""))), F.lit(folds))


def byte_rows(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece holds about ``most`` bytes of a column or one row."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column).cast(pa.binary()))
        start = held = 0
        for row, n in enumerate(lengths.fill_null(0).to_pylist()):
            if held and held + n > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)
