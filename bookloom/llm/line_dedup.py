"""Line dedup: lines that several documents share stay in one of them only.

Lines are exploded and normalised, their keys hashed, and documents counted per
hash; lines over the threshold go, and the rest is put together by position.
All DataFrame functions. What a document loses travels as positions, so the
text itself is shuffled once, for the final join.

Skew: counting combines before the shuffle. The joins have a table on either
side, so adaptive execution sees sizes and splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import LOWER, UPPER, WHITE, boxed, stored, unboxed

RESULTS = ("n_lines", "n_dropped")


def _tag(text: str) -> F.Column:
    """Tells rows of one id but different texts apart."""
    return F.xxhash64(F.lit("text"), text)


def keyed_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """Place and hash of every line whose key has at least ``min_chars`` code points.

    The key is the line without ASCII white space at its ends and with A-Z
    lower-cased; two hashes of 64 bits, the second of another seed, stand for it.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.col(f"`{doc_id}`")
    lines = docs.where(key.isNotNull()).select(
        key.alias("_doc"), _tag(body).alias("_tag"), F.posexplode(F.split(body, "\n", -1))
    )
    key = F.translate(F.btrim("col", F.lit(WHITE)), UPPER, LOWER)
    return (
        lines.select("_doc", "_tag", F.col("pos").alias("_pos"), key.alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select(
            "_doc",
            "_tag",
            "_pos",
            F.xxhash64("_key").alias("_h1"),
            F.xxhash64(F.lit("line"), "_key").alias("_h2"),
        )
    )


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """Keys of at least ``min_docs`` documents, with the smallest id that holds them."""
    if min_docs <= 2:
        counted = lines.groupBy("_h1", "_h2").agg(
            F.min("_doc").alias("_keeper"), F.max("_doc").alias("_last")
        )
        return counted.where(F.col("_keeper") < F.col("_last")).drop("_last")
    counted = lines.groupBy("_h1", "_h2").agg(
        F.min("_doc").alias("_keeper"), F.countDistinct("_doc").alias("_n")
    )
    return counted.where(F.col("_n") >= min_docs).drop("_n")


def drop_repeated_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
) -> DataFrame:
    """The documents without lines held by a smaller document too.

    Returns every row with all its columns, the text replaced by the lines that
    stay, and ``n_lines`` (before) and ``n_dropped``; these replace input columns
    of the same name, in any case. Other names are free. A very long text is split
    like any other.

    A null text counts as one empty line and comes back empty. Rows without an
    id stay as they are and don't count as documents. Rows of one id are one
    document: a line is compared with other ids only. No rows give no rows.
    """
    lines = stored(keyed_lines(docs, doc_id, text, min_chars), "line-keys")
    repeated = stored(repeated_keys(lines, min_docs), "line-repeats")
    drops = stored(
        lines.join(repeated, ["_h1", "_h2"])
        .where(F.col("_doc") > F.col("_keeper"))
        .groupBy("_doc", "_tag")
        .agg(F.collect_set("_pos").alias("_drop")),
        "line-drops",
    )
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names, _ = boxed(docs, RESULTS)
    _, row = boxed(docs, (*RESULTS, text))
    split = docs.select(
        row,
        F.col(f"`{doc_id}`").alias("_doc"),
        _tag(body).alias("_tag"),
        F.split(body, "\n", -1).alias("_lines"),
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    left = F.when(F.col("_drop").isNull(), F.array_join("_lines", "\n")).otherwise(
        F.array_join(F.transform(kept, lambda at: F.get("_lines", at)), "\n")
    )
    return split.join(drops, ["_doc", "_tag"], "left").select(
        *unboxed(names, {text: left}),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
