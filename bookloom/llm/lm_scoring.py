"""Language-model scores by logistic context mixing, and by single words.

Learning is a few jobs over all training documents:

1. counts of words and of byte pairs, summed by key;
2. the code of bytes, from the pairs;
3. counts of zeros and ones per context slot: every task fills tables of fixed
   size, which are cut into slices, and each slice is summed in a stream;
4. the mixing weights and the adaptive map, learned online from one part of the
   training documents (one fold of the four) with tables that were counted without
   that part, so that they fit unseen text. The part is dealt into units of fixed
   size by a hash, whatever the table's partitions; weights are averaged over units
   by what they saw. The part's own counts are in the final tables.

The model has a fixed size however large the corpus is; everything in it comes
from all training documents. Words are looked up in a table of the HEAD most
frequent ones that every task holds, and the rest by a join on their hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm import mixing_model as M
from bookloom.llm.common import byte_rows, fold, slices, stored

FOLDS = 5
HELD_OUT = 1
# Part of the training documents that mixing weights are learned from.
MIXING = 0
HEAD = 200_000
# Distinct words a task counts before it hands them on.
TALLY = 300_000
BLOCK_BYTES = 8 << 20
# Text from which one set of mixing weights is learned in order.
UNIT_BYTES = 8 << 20
SLICE = 1 << 16
# No word holds white space.
END_WORD = b"\n"


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _count_rows(tally: Counter, pairs: np.ndarray | None) -> pa.RecordBatch:
    at = np.flatnonzero(pairs) if pairs is not None else np.zeros(0, np.int64)
    words = list(tally)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None] * len(words) + at.tolist(), pa.int32()),
            pa.array(words + [None] * len(at), pa.binary()),
            pa.array([*tally.values(), *(pairs[at].tolist() if len(at) else [])], pa.int64()),
        ],
        names=["pair", "word", "n"],
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally: Counter = Counter()
    pairs = np.zeros(M.CODES * M.SYMBOLS, np.int64)
    for batch in slices(batches, "text", BLOCK_BYTES):
        texts = byte_rows(batch.column("text"))
        pairs += M.pair_counts(texts)
        for text in texts:
            tally.update(text.lower().split())
            if len(tally) > TALLY:
                yield _count_rows(tally, None)
                tally = Counter()
        tally[END_WORD] += len(texts)
    yield _count_rows(tally, pairs)


def word_counts(docs: DataFrame) -> DataFrame:
    """Counts of words (with hash ``h``) and of byte pairs; the end counts as a word."""
    counted = docs.select("text").mapInArrow(_count, "pair int, word binary, n bigint")
    summed = counted.groupBy("pair", "word").agg(F.sum("n").alias("n"))
    return stored(summed, "lm-words")


def _encode(cells: np.ndarray) -> tuple[bool, bytes] | None:
    """Counts of a slice: places and counts, or low bytes and what is above them."""
    at = np.flatnonzero(cells).astype(np.uint32)
    if not len(at):
        return None
    if 6 * len(at) < len(cells):
        return False, np.concatenate([at, cells[at]]).tobytes()
    high = np.flatnonzero(cells >> np.uint32(8)).astype(np.uint32)
    rest = np.concatenate([high, cells[high] >> np.uint32(8)]).astype(np.uint32)
    return True, cells.astype(np.uint8).tobytes() + rest.tobytes()


def _decode(dense: bool, payload: bytes, into: np.ndarray) -> None:
    """Add the counts of a slice."""
    head = len(into) if dense else 0
    rest = np.frombuffer(payload, np.uint32, offset=head)
    at, counts = rest[: len(rest) // 2], rest[len(rest) // 2 :].astype(np.uint64)
    if dense:
        into += np.frombuffer(payload, np.uint8, count=head)
        counts = counts << np.uint64(8)
    into[at] += counts


def _fill(code: tuple, part: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = M.empty_counts()
        for batch in slices(batches, "text", BLOCK_BYTES):
            M.count(byte_rows(batch.column("text")), M.Code(*code), tables)
        place = 0
        for table in tables:
            for start in range(0, len(table), 2 * SLICE):
                found = _encode(table[start : start + 2 * SLICE])
                if found:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "slice": pa.array([place], pa.int32()),
                            "part": pa.array([part], pa.int32()),
                            "dense": pa.array([found[0]]),
                            "payload": pa.array([found[1]], pa.binary()),
                        }
                    )
                place += 1

    return run


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Log-odds of each slice, without and with the mixing part's counts."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for place, part, dense, payload in zip(*[c.to_pylist() for c in batch.columns]):
            if place not in sums:
                sums[place] = [np.zeros(2 * SLICE, np.uint64) for _ in range(2)]
            _decode(dense, payload, sums[place][part])
    for place, (first, second) in sums.items():
        yield pa.RecordBatch.from_pydict(
            {
                "slice": pa.array([place], pa.int32()),
                "mixing": pa.array([M.log_odds(first).tobytes()], pa.binary()),
                "final": pa.array([M.log_odds(first + second).tobytes()], pa.binary()),
            }
        )


def _tables(rows: list, column: str) -> list[np.ndarray]:
    whole = np.zeros(sum(M.SLOTS), np.int8)
    for row in rows:
        values = np.frombuffer(row[column], np.int8)
        whole[row["slice"] * SLICE :][: len(values)] = values
    return np.split(whole, np.cumsum(M.SLOTS)[:-1])


def _learn(handle, code: tuple) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, learned = M.Mixer.start(), 0
        for batch in slices(batches, "text", BLOCK_BYTES):
            learned += M.learn(byte_rows(batch.column("text")), M.Code(*code), handle.value, mixer)
        weights = mixer.weights.ravel().astype(np.float64)
        value = np.concatenate([weights * learned, mixer.ones])
        weight = np.concatenate([np.full(len(weights), float(learned)), mixer.seen])
        at = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(value[at]), pa.array(weight[at])],
            names=["cell", "value", "weight"],
        )

    return run


def _units(texts: DataFrame) -> DataFrame:
    """The texts in units of about UNIT_BYTES, one per partition, each in an order of its own.

    Both follow from hashes of the texts, so what is learned online does not depend on
    how the table was partitioned.
    """
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    units = max(1, -(-size // UNIT_BYTES))
    hashed = texts.select(
        "text", F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit("unit"), "text").alias("_h2")
    )
    unit = F.pmod("_h1", F.lit(units)).cast("int")
    return hashed.repartitionById(units, unit).sortWithinPartitions("_h2", "_h1").select("text")


@dataclass
class Model:
    code: tuple
    tables: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray
    words: DataFrame
    head: dict[bytes, int]
    train_tokens: int
    train_words: int


def train(docs: DataFrame, mixing: str = "mixing") -> Model:
    """Learn from rows with ``text`` and a boolean that marks the mixing part.

    No documents give a model that predicts every decision evenly.
    """
    context = docs.sparkSession.sparkContext
    counts = word_counts(docs)
    words = counts.where(F.col("word").isNotNull()).select("word", "n")
    totals = words.agg(F.sum("n"), F.count("*")).first()
    top = words.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    head = dict(zip(map(bytes, top["word"].to_pylist()), top["n"].to_pylist()))
    pairs = np.zeros(M.CODES * M.SYMBOLS, np.int64)
    # At most CODES * SYMBOLS rows.
    for row in counts.where(F.col("pair").isNotNull()).select("pair", "n").collect():
        pairs[row["pair"]] = row["n"]
    code = astuple(M.huffman(pairs))

    parts = [docs.where(~F.col(mixing)).select("text"), docs.where(F.col(mixing)).select("text")]
    kinds = "slice int, part int, dense boolean, payload binary"
    # Each task sends whole tables. The mixing part is about a quarter of the texts, so a task of it
    # takes the partitions of four.
    rest = parts[1].coalesce(max(1, -(-parts[1].rdd.getNumPartitions() // (FOLDS - 1))))
    filled = parts[0].mapInArrow(_fill(code, 0), kinds).union(rest.mapInArrow(_fill(code, 1), kinds))
    summed = stored(
        filled.repartition("slice").mapInArrow(_sum_slices, "slice int, mixing binary, final binary"),
        "lm-tables",
    )
    # Fixed size: one byte per slot.
    handle = context.broadcast(_tables(summed.select("slice", "mixing").collect(), "mixing"))
    learned = _units(parts[1]).mapInArrow(_learn(handle, code), "cell int, value double, weight double")
    learned = learned.groupBy("cell").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight"))
    mixer = M.Mixer.start()
    cells = mixer.weights.size
    for row in learned.collect():
        if row["cell"] < cells:
            mixer.weights.flat[row["cell"]] = row["value"] / row["weight"]
        else:
            mixer.ones[row["cell"] - cells] = row["value"]
            mixer.seen[row["cell"] - cells] = row["weight"]
    handle.unpersist()
    tables = _tables(summed.select("slice", "final").collect(), "final")
    return Model(code, tables, mixer.weights, mixer.refined(), words, head, totals[0] or 0, totals[1])


def _score_rows(handle) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tables, weights, refined, head, floor = handle.value
        chance = {word: float(np.log10(n + 0.5)) - floor for word, n in head.items()}
        key = TaskContext.get().partitionId() << 36
        for batch in slices(batches, "text", BLOCK_BYTES):
            texts = byte_rows(batch.column("text"))
            found = M.score(texts, M.Code(*code), tables, weights, refined)
            n_tokens, n_known, base, tails = [], [], [], []
            for text in texts:
                words = [*text.lower().split(), END_WORD]
                found_words = list(map(chance.get, words))
                known = [x for x in found_words if x is not None]
                n_tokens.append(len(words))
                n_known.append(len(known))
                base.append(float(sum(known)))
                tails.append([_hash(w) for w, x in zip(words, found_words) if x is None])
            keys = np.arange(key, key + len(texts))
            key += len(texts)
            yield pa.RecordBatch.from_pydict(
                {
                    "_key": pa.array(keys, pa.int64()),
                    "_id": batch.column("_id"),
                    "n_tokens": pa.array(n_tokens, pa.int64()),
                    "n_known": pa.array(n_known, pa.int64()),
                    "base_score": pa.array(base, pa.float64()),
                    "score": pa.array(found, pa.float64()),
                    "n_bytes": pa.array([len(x) for x in texts], pa.int64()),
                    "_tail": pa.array(tails, pa.list_(pa.int64())),
                }
            )

    return run


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every row, by a model of the rows that are not held out.

    ``doc_id``, ``held_out`` (CRC32 of the id as text, modulo 5, is 1),
    ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (single words),
    ``score`` (log10 probability of the text with its end), ``n_bytes`` and
    ``bits_per_byte`` (of the text and its end).

    Null is the empty text: its end alone. Rows without an id count as those
    with an empty one, so they are learned from. Repeated rows are learned from
    and scored each. Without training documents every word is unknown. A text of
    more than 256 KiB is scored in pieces of that size, each with contexts of its own.
    Other columns play no part, whatever their names. Scores do not depend on how the
    table is partitioned, beyond the order in which doubles are added.
    """
    narrow = docs.select(
        F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text"), fold(doc_id, FOLDS).alias("_fold")
    )
    training = narrow.where(F.col("_fold") != HELD_OUT)
    model = train(training.select("text", (F.col("_fold") == MIXING).alias("mixing")))
    floor = float(np.log10(model.train_tokens + 0.5 * (model.train_words + 1)))
    handle = docs.sparkSession.sparkContext.broadcast(
        (model.code, model.tables, model.weights, model.refined, model.head, floor)
    )
    kind = docs.schema[doc_id].dataType.simpleString()
    scored = stored(
        narrow.select("_id", "text").mapInArrow(
            _score_rows(handle),
            f"_key bigint, _id {kind}, n_tokens bigint, n_known bigint, base_score double, score double,"
            " n_bytes bigint, _tail array<bigint>",
        ),
        "lm-scored",
    )
    known = tail_counts(model)
    tails = scored.select("_key", F.explode("_tail").alias("h")).join(known, "h", "left")
    chance = F.log10(F.coalesce("n", F.lit(0)) + 0.5) - floor
    added = tails.groupBy("_key").agg(
        F.sum(chance).alias("_more"), F.count("n").alias("_known")
    )
    whole = scored.drop("_tail").join(added, "_key", "left")
    bits = -F.col("score") / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)
    return whole.select(
        F.col("_id").alias(doc_id),
        (fold("_id", FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_more", F.lit(0.0))).alias("base_score"),
        "score",
        "n_bytes",
        bits.alias("bits_per_byte"),
    )


def tail_counts(model: Model) -> DataFrame:
    """Counts of the words beyond the head, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [_hash(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), batch.column("n")], names=["h", "n"])

    rest = model.words
    if model.head:
        least = min(model.head.values())
        last = max(w for w, n in model.head.items() if n == least)
        after = (F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > F.lit(last)))
        rest = rest.where(after)
    return stored(rest.mapInArrow(run, "h bigint, n bigint"), "lm-tail")
