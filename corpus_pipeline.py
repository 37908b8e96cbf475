"""The pipeline over documents: each stage works on what the one before kept.

Every stage takes (spark, docs, sf_dir); its rows are written as Parquet and
read again as the documents of the next. All but the last keep the columns of
documents, whatever further ones there are and what they are called. Without rows a
stage gives no rows, and a very long text is handled like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm import decontamination, line_dedup, packing, quality, simhash
from bookloom.llm.common import boxed, fold, small_batches, stored, table, unboxed
from bookloom.llm.queries import TOKENIZER

# Documents whose score is below this go.
LEAST_QUALITY = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts. It learns as the registered query does.

    A null or empty text is scored like any other; repeated rows stay or go together.
    """
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    model = quality.train(docs, labels)
    names, _ = boxed(docs)
    _, row = boxed(docs, ["text"])
    scored = quality.score(docs.select("text", row), model, into="_quality")
    kept = scored.where(F.col("_quality") >= LEAST_QUALITY)
    return kept.select(*unboxed(names, {"text": F.col("text")}))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a smaller document holds too, ``n_chars`` anew.

    Every row stays, also one that loses all its lines; a null text becomes empty. Rows
    without an id stay as they are, rows of one id are one document.
    """
    names, _ = boxed(docs)
    _, row = boxed(docs, ["text"])
    kept = line_dedup.drop_repeated_lines(docs.select("doc_id", "text", row))
    own = {"text": F.col("text")}
    if "n_chars" in names:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*unboxed(names, own))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id.

    Texts without words are one group. Rows of one id stay or go together, rows without
    an id stay.
    """
    small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with test items; null and empty texts stay."""
    small_batches(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences.

    A null or empty text is the end token alone; repeated rows are packed each.
    """
    small_batches(spark)
    return packing.pack_documents(docs, TOKENIZER, keep_ids=False)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

# The classifier, the hashes of words and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return last(spark, docs, sf_dir)
