"""Result tables on a file system."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_folder(base: str, now: datetime | None = None) -> str:
    """Folder of a run: stamped to the second, with a part no other run has.

    Ask for it once per run and hand it on.
    """
    return f"{base.rstrip('/')}/run={(now or datetime.now()):%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"


def write_parquet(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").parquet(path)


def flat(frame: DataFrame) -> DataFrame:
    """Columns that delimited text can hold: lists as comma-joined text, times with all digits."""

    def column(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            return F.array_join(c, ",").alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return c.cast("string").alias(field.name)
        return c

    return frame.select(*[column(f) for f in frame.schema.fields])


# Quotes inside a text are doubled.
DELIMITED = {"sep": ";", "header": True, "escape": '"'}
# What a quoted empty text is read as.
EMPTY = "\x00"


def write_csv(frame: DataFrame, path: str) -> None:
    """Semicolon-delimited with a header; see ``flat``."""
    flat(frame).write.mode("errorifexists").options(**DELIMITED).csv(path)


WRITERS = {"parquet": write_parquet, "csv": write_csv}


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    texts = ", ".join(f"`{f.name}` STRING" for f in schema.fields)
    rows = spark.read.schema(texts).options(**DELIMITED).option("emptyValue", EMPTY).csv(path)

    def column(field: T.StructField) -> Column:
        # An empty text is written in quotes, NULL as nothing.
        c = F.replace(F.col(f"`{field.name}`"), F.lit(EMPTY), F.lit(""))
        kept = T.StringType() if isinstance(field.dataType, T.ArrayType) else field.dataType
        return c.cast(kept).alias(field.name)

    return rows.select(*[column(f) for f in schema.fields])


def _sums(frame: DataFrame, fmt: str) -> list[Column]:
    """Rows and a checksum that does not depend on their order."""
    if fmt == "csv":
        columns = [F.col(f"`{c}`").cast("string") for c in frame.columns]
    else:
        columns = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if isinstance(f.dataType, T.MapType)
                   else F.col(f"`{f.name}`") for f in frame.schema.fields]
    # A hash skips NULL; its place is told by the flags.
    hashed = F.xxhash64(*[c.isNull() for c in columns], *columns)
    total = F.coalesce(F.sum(hashed.cast("decimal(20,0)")), F.lit(0)).cast("string")
    return [F.count(F.lit(1)).alias("rows"), total.alias("checksum")]


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Data files of a table and their sizes; no file is opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return listed.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes")
    )


MANIFEST, COMPLETE = "_manifest", "_complete"


def write_results(results: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> str:
    """Write every named result as one table below a run's folder.

    Each is followed by its manifest: format, columns, rows, checksum (both observed while
    it is written) and files with their sizes. ``read_run`` checks a run against it.
    """
    for name, frame in results.items():
        spark, path = frame.sparkSession, f"{folder}/{name}"
        written = Observation(name)
        rows = flat(frame) if fmt == "csv" else frame
        WRITERS[fmt](rows.observe(written, *_sums(rows, fmt)), path)
        files = _files(spark, path).agg(
            F.sort_array(F.collect_list(F.struct("file", "bytes"))).alias("files")
        )
        facts = {"table": name, "format": fmt, "columns": frame.schema.json(), **written.get}
        manifest = files.select(*[F.lit(v).alias(k) for k, v in facts.items()], "files")
        manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/{MANIFEST}/{name}")
    return folder


def finish_run(spark: SparkSession, folder: str, settings: Mapping[str, object]) -> str:
    """Write last what the run was made with (``_complete``): its presence marks success."""
    rows = [(name, str(value)) for name, value in settings.items()]
    frame = spark.createDataFrame(rows, "setting string, value string").coalesce(1)
    frame.write.mode("errorifexists").json(f"{folder}/{COMPLETE}")
    return folder


class DamagedRun(ValueError):
    """A run that is unfinished, or whose files are not those of its manifest."""


MANIFEST_KINDS = (
    "table string, format string, columns string, rows long, checksum string, "
    "files array<struct<file: string, bytes: long>>"
)


def read_run(spark: SparkSession, folder: str, verify: bool = False) -> dict[str, DataFrame]:
    """The tables of a finished run, by name.

    Missing, added and changed files are found by the list of files and sizes; with
    ``verify`` all rows are read and compared with the row counts and checksums too.
    """
    try:
        spark.read.json(f"{folder}/{COMPLETE}").schema
        manifests = spark.read.schema(MANIFEST_KINDS).json(f"{folder}/{MANIFEST}/*").collect()
    except AnalysisException as missing:
        raise DamagedRun(f"{folder} is not a finished run") from missing
    tables = {}
    for made in manifests:
        path = f"{folder}/{made['table']}"
        expected = {(f["file"], f["bytes"]) for f in made["files"]}
        try:
            found = {(f["file"], f["bytes"]) for f in _files(spark, path).collect()}
        except AnalysisException:
            found = set()
        if odd := sorted(expected ^ found):
            raise DamagedRun(f"{path}: files differ from the manifest: {odd}")
        schema = T.StructType.fromJson(json.loads(made["columns"]))
        frame = _read(spark, path, made["format"], schema)
        if verify:
            now = frame.agg(*_sums(frame, made["format"])).first()
            if (now["rows"], now["checksum"]) != (made["rows"], made["checksum"]):
                raise DamagedRun(f"{path}: rows differ from the manifest")
        tables[made["table"]] = frame
    return tables
