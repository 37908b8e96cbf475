"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents and flattened
into arrays; every document is scored by array operations over its statistics.
Nothing is shuffled for scoring; the model has a fixed size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.llm.boosted_trees import Trees, fit
from bookloom.llm.common import byte_rows

# Most labelled documents the trees are fitted on, chosen by hash of the id.
MOST_LABELLED = 20_000

_BYTES = np.arange(256)


def _kind(chars: bytes) -> np.ndarray:
    return np.isin(_BYTES, list(chars))


# Classes of bytes.
CLASSES = {
    "lower": _kind(b"abcdefghijklmnopqrstuvwxyz"),
    "upper": _kind(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digit": _kind(b"0123456789"),
    "space": _kind(b" \t"),
    "line": _kind(b"\n\r"),
    "stop": _kind(b".?"),
    "comma": _kind(b",;:"),
    "shout": _kind(b"!"),
    "quote": _kind(b"'\"()[]"),
    "bar": _kind(b"|"),
    "mark": _kind(b"#$%&*+/<=>@\\^_`{}~-"),
    "beyond": _BYTES >= 128,
    "control": (_BYTES < 32) & ~_kind(b"\t\n\r"),
}
_CLASS_ROWS = np.stack(list(CLASSES.values())).astype(np.float64)


def statistics(text: bytes) -> list[float]:
    """Shares of byte classes, and figures of words and lines; zeros for no text."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    shares = counts / n
    used = shares[shares > 0]
    words = text.split()
    many = max(1, len(words))
    tally = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    lines = text.split(b"\n")
    again = sum(map(bytes.__eq__, words, words[1:]))
    edge = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    return [
        *(_CLASS_ROWS @ shares),
        float(-(used * np.log2(used)).sum()),
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        float(lengths.mean()) if words else 0.0,
        float(lengths.std()) if words else 0.0,
        float(lengths.max()) if words else 0.0,
        len(tally) / many,
        max(tally.values(), default=0) / many,
        again / many,
        edge / many,
        sum(map(bytes.isupper, words)) / many,
        sum(map(bytes.istitle, words)) / many,
        float((lengths == 1).sum()) / many,
        len(words) / len(lines),
        len(set(lines)) / len(lines),
        sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
    ]


WIDTH = len(statistics(b""))


def _matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(x) for x in texts], np.float64).reshape(len(texts), WIDTH)


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _matrix(byte_rows(batch.column("_text"))).tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_label"), pa.array(rows, pa.list_(pa.float64()))],
            names=["_id", "_label", "x"],
        )


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    most: int = MOST_LABELLED,
) -> Trees:
    """Fit trees on at most ``most`` labelled documents.

    ``labels`` holds the rows that may be learned from. If there are more, those
    with the smallest hash of the id are taken, so the choice is the same in
    every run. Labels other than 0 and 1 or without an id are left out. Rows of one id
    are learned from each, as far as ``most`` allows. Without labels or documents, or
    with one kind only, the model gives every text the same score.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(most)
    )
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = chosen.schema["_id"].dataType.simpleString()
    # At most ``most`` rows of two numbers.
    rows = (
        texts.join(F.broadcast(chosen), "_id")
        .select("_id", "_label", "_text")
        .mapInArrow(_statistics_rows, f"_id {kind}, _label int, x array<double>")
        # An id may occur many times.
        .orderBy(F.xxhash64("_id"), "_id", "_label", "x")
        .limit(most)
        .toArrow()
    )
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(-1, WIDTH)
    y = rows["_label"].to_numpy().astype(np.float64)
    order = np.lexsort((y, *x.T, rows["_id"].to_numpy()))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Trees, text: str = "text", into: str = "score") -> DataFrame:
    """Add the probability of label 1, from the text alone.

    Null is scored as the empty text, repeated rows each, a very long text whole, and
    the column replaces one of the same name. No rows give no rows.
    """
    docs = docs.drop(into)
    kinds = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])
    return docs.mapInArrow(_score_rows(model, text, into), kinds)


def _score_rows(model: Trees, text: str, into: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.probability(_matrix(byte_rows(batch.column(text))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found)], names=[*batch.schema.names, into]
            )

    return run
