"""Phrase mining: word sequences that occur more often than their parts suggest.

All sequences of one to four words within a piece of text are counted per
language, exactly, without ever moving the rare ones as text:

1. Tasks hash the sequences of a block of text and send each hash partition its
   keys with their counts. A partition merges them into a Misra-Gries summary
   whose capacity exceeds its mass divided by the allowed loss, so every sequence
   that reaches the threshold survives, and a partition's memory is bounded.
2. Survivors become a bit filter of bounded size. Tasks read the texts again
   and send only sequences that pass, as text, to the same partitions, which count them
   exactly. What the filter lets through in error falls below the threshold there.

Scores, cuts and containment are DataFrame operations on the frequent sequences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookloom.llm.common import byte_rows, small_batches, stored
from bookloom.llm.misra_gries import Summary
from bookloom.llm.word_hashes import mix

# Text of a block that one task counts at once, and text behind a hash partition.
BLOCK_BYTES = 8 << 20
PARTITION_BYTES = 32 << 20
# Counters a partition's summary starts with.
CAPACITY = 1 << 16
# Bits of the filter for each survivor, and its bounds (2 to this power).
BITS_EACH = 64
LEAST_BITS, MOST_BITS = 20, 29
# Different words a task keeps by number.
MOST_WORDS = 1 << 20
# Candidates of one language are first cut to the best of each of so many shares.
SHARES = 64

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytearray(bytes(range(256)).lower())
for _byte in SEPARATORS:
    _TABLE[_byte] = 10
_TABLE[9] = 32
_TABLE = bytes(_TABLE)

_ODD = np.uint64(0x9E3779B97F4A7C15)
NOTHING, BORDER = 0, 1


class Words(dict):
    """Numbers of words, given as they turn up; 0 is no word, 1 a border."""

    def __init__(self):
        super().__init__({b"": NOTHING, b"\n": BORDER})
        self.texts = [b"", b"\n"]
        self.hashes = [0, 0]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.texts)
        self.texts.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return number

    def numbers(self, text: bytes) -> np.ndarray:
        """The words and borders of a text, in order."""
        found = text.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.__getitem__, found), np.int32, len(found))
        return ids[ids != NOTHING]


def blocks(
    batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES
) -> Iterator[tuple[bytes, bytes]]:
    """Language and lower-cased text of blocks of about ``most`` bytes, borders between texts.

    A longer text is cut at a border, so that no sequence of words is lost.
    """
    held: dict[bytes, list[bytes]] = {}
    sizes: dict[bytes, int] = {}
    waiting = 0
    for batch in batches:
        langs, texts = (byte_rows(batch.column(c)) for c in ("lang", "text"))
        for lang, text in zip(langs, texts):
            text = text.translate(_TABLE)
            while len(text) > most:
                cut = text.rfind(b"\n", 0, most)
                cut = text.find(b"\n", most) if cut < 0 else cut
                if cut < 0:
                    break
                yield lang, text[:cut]
                text = text[cut + 1 :]
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text) + 1
            waiting += len(text) + 1
            if sizes[lang] > most:
                waiting -= sizes.pop(lang)
                yield lang, b"\n".join(held.pop(lang))
            elif waiting > 2 * most:  # many languages
                for each, parts in held.items():
                    yield each, b"\n".join(parts)
                held, sizes, waiting = {}, {}, 0
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


def sequences(
    words: Words, ids: np.ndarray, lang: bytes, longest: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and 64-bit keys of all sequences of words in a block."""
    hashes = np.array(words.hashes, np.uint64)[ids]
    key = mix(hashes + np.uint64(xxhash.xxh64_intdigest(lang, seed=1)))
    whole = ids != BORDER
    yield 1, np.flatnonzero(whole), key[whole]
    inside = whole
    for n in range(2, longest + 1):
        if len(ids) < n:
            return
        inside = inside[:-1] & whole[n - 1 :]
        key = mix(key[:-1] * _ODD + hashes[n - 1 :])
        yield n, np.flatnonzero(inside), key[inside]


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32 as planes of equal bytes, the empty ones left out."""
    used = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :used]
    return bytes([used]) + planes.T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    held = np.frombuffer(planes, np.uint8, offset=1).reshape(planes[0], -1)
    out = np.zeros((held.shape[1], 4), np.uint8)
    out[:, : planes[0]] = held.T
    return out.view("<u4").ravel()


def _counted(parts: int, longest: int):
    """Task of the first pass: counted keys of each block, a row per hash partition."""

    def run(batches):
        words = Words()
        top = parts.bit_length() - 1
        for lang, text in blocks(batches):
            if len(words) > MOST_WORDS:
                words = Words()
            ids = words.numbers(text)
            keys = np.concatenate([k for _, _, k in sequences(words, ids, lang, longest)])
            # The upper bits of a key name its partition; 32 more are kept.
            keys >>= np.uint64(32 - top)
            keys.sort()
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            if not len(keys):
                continue
            counts = np.diff(first, append=len(keys))
            keys = keys[first]
            edges = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
            low = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            rows = []
            for part in range(parts):
                here = slice(edges[part], edges[part + 1])
                if edges[part] < edges[part + 1]:
                    steps = np.diff(low[here], prepend=0)
                    rows.append((part, _planes(steps), _planes(counts[here])))
            for part, steps, times in rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([steps]), pa.array([times])],
                    names=["part", "steps", "times"],
                )

    return run


COUNTED = "part int, steps binary, times binary"
SURVIVED = "part int, mass long, lost long, capacity long, keys binary"


def _summarised(threshold: int):
    """Task of a hash partition: its survivors."""

    def run(batches):
        part, summary = None, None

        def result():
            keys = summary.survivors()
            row = (part, summary.mass, summary.lost, summary.capacity, keys.tobytes())
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array([x], kind) for x, kind in zip(row, kinds)]
            return pa.RecordBatch.from_arrays(
                arrays, names=["part", "mass", "lost", "capacity", "keys"]
            )

        for batch in batches:
            for at in range(batch.num_rows):
                here, steps, times = (batch.column(c)[at].as_py() for c in range(3))
                if here != part:
                    if summary is not None:
                        yield result()
                    part, summary = here, Summary(threshold, threshold // 3, CAPACITY)
                keys = np.cumsum(_numbers(steps), dtype=np.uint64).astype(np.uint32)
                summary.add(keys, _numbers(times).astype(np.int64))
        if summary is not None:
            yield result()

    return run


def survivors(texts: DataFrame, parts: int, threshold: int, longest: int) -> DataFrame:
    """Per hash partition: mass, loss and capacity of its summary, and surviving keys.

    ``parts`` is a power of two. A partition is one task's, whatever its keys.
    """
    counted = texts.mapInArrow(_counted(parts, longest), COUNTED)
    placed = counted.repartitionById(parts, F.col("part"))
    return stored(placed.mapInArrow(_summarised(threshold), SURVIVED), "phrase-survivors")


def bit_filter(survived: DataFrame, parts: int) -> tuple[int, bytes]:
    """Power of two and bits of the filter: bit k is set if a survivor's key begins with k.

    Its size follows the number of survivors up to 2**MOST_BITS bits (64 MB), the most
    that is sent to the driver and back.
    """
    top = parts.bit_length() - 1
    n = survived.agg(F.sum(F.octet_length("keys")) / 4).first()[0] or 1
    wanted = max(math.ceil(math.log2(n * BITS_EACH)), LEAST_BITS)
    power = min(max(min(wanted, MOST_BITS), top + 3), top + 32)
    share = 1 << (power - top)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bits = np.zeros(share, np.bool_)
                keys = np.frombuffer(row["keys"], np.uint32)
                bits[keys >> np.uint32(32 - (power - top))] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]], pa.int32()), pa.array([np.packbits(bits).tobytes()])],
                    names=["part", "bits"],
                )

    made = survived.select("part", "keys").mapInArrow(run, "part int, bits binary")
    slices = {row["part"]: bytes(row["bits"]) for row in made.collect()}
    empty = bytes(share // 8)
    return power, b"".join(slices.get(part, empty) for part in range(parts))


def _unique(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of one example of each different row, and how often the row occurs."""
    columns = [c.astype(np.uint64) for c in columns]
    while len(columns) > 1:
        pair = (columns[0] << np.uint64(32)) | columns[1]
        if len(columns) == 2:
            columns = [pair]
        else:
            ranks = np.unique(pair, return_inverse=True)[1]
            columns = [ranks.astype(np.uint64), *columns[2:]]
    _, example, times = np.unique(columns[0], return_index=True, return_counts=True)
    return example, times


PASSED = "part int, lang string, size int, phrases binary, times binary"


def _passed(power: int, parts: int, shared, longest: int):
    """Task of the second pass: sequences that pass the filter, as text, with counts.

    A row holds those of a block that one hash partition gets, joined by line ends.
    """

    def row(part: int, lang: bytes, n: int, phrases: list[bytes], times: np.ndarray):
        arrays = [
            pa.array([part], pa.int32()),
            pa.array([lang], pa.binary()).view(pa.string()),
            pa.array([n], pa.int32()),
            pa.array([b"\n".join(phrases)], pa.binary()),
            pa.array([times.astype(np.int64).tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["part", "lang", "size", "phrases", "times"])

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        top = parts.bit_length() - 1
        words = Words()
        for lang, text in blocks(batches):
            if len(words) > MOST_WORDS:
                words = Words()
            ids = words.numbers(text)
            yield row(0, lang, 0, [b""], np.array([np.count_nonzero(ids != BORDER)]))
            for n, places, keys in sequences(words, ids, lang, longest):
                slot = keys >> np.uint64(64 - power)
                byte = bits[(slot >> np.uint64(3)).astype(np.int64)]
                passed = ((byte >> (7 - (slot & np.uint64(7))).astype(np.uint8)) & 1).astype(np.bool_)
                places, keys = places[passed], keys[passed]
                if not len(places):
                    continue
                columns = [ids[places + k] for k in range(n)]
                example, times = _unique(columns)
                # The partition is the upper bits of the key, as in the first pass.
                part = (keys[example] >> np.uint64(32)).astype(np.int64) >> (32 - top)
                order = np.argsort(part, kind="stable")
                example, times = example[order], times[order]
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                texts = words.texts
                rows = zip(*[c[example].tolist() for c in columns])
                phrases = [b" ".join([texts[i] for i in r]) for r in rows]
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    here = slice(edges[k], edges[k + 1])
                    yield row(k, lang, n, phrases[here], times[here])

    return run


EXACT = "lang string, size int, phrase string, times long"


def _summed(threshold: int):
    """Task of a hash partition: exact counts of its sequences, those that are frequent."""

    def run(batches):
        sums: dict[tuple[str, int], dict[bytes, int]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                _, lang, n, phrases, times = (c[at].as_py() for c in batch.columns)
                held = sums.setdefault((lang, n), {})
                count = held.get
                for phrase, more in zip(phrases.split(b"\n"), np.frombuffer(times, np.int64).tolist()):
                    held[phrase] = count(phrase, 0) + more
        for (lang, n), held in sums.items():
            kept = {p: c for p, c in held.items() if c >= threshold or n == 0}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(kept), pa.string()),
                    pa.array([n] * len(kept), pa.int32()),
                    pa.array(list(kept), pa.binary()).view(pa.string()),
                    pa.array(list(kept.values()), pa.int64()),
                ],
                names=["lang", "size", "phrase", "times"],
            )

    return run


def _partitions(texts: DataFrame) -> int:
    """Hash partitions, a power of two that follows the bytes of all texts."""
    held = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return 1 << max(0, math.ceil(math.log2(max(1, held / PARTITION_BYTES))))


def frequent_sequences(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    threshold: int = 30,
    longest: int = 4,
    no_lang: str = "und",
) -> DataFrame:
    """Sequences of words that occur at least ``threshold`` times in a language.

    Columns ``lang``, ``size`` (words), ``phrase`` (joined by spaces) and ``times``; a row
    of size 0 and no phrase holds the number of all words of the language. The result
    is a stored table.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(no_lang)).alias("lang"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    parts = _partitions(texts)
    power, bits = bit_filter(survivors(texts, parts, threshold, longest), parts)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    passed = texts.mapInArrow(_passed(power, parts, shared, longest), PASSED)
    placed = passed.repartitionById(parts, F.col("part"))
    found = stored(placed.mapInArrow(_summed(threshold), EXACT), "phrase-counts")
    shared.unpersist()
    return found


def _whole(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def score(a: str, left: str, right: str) -> Column:
    """2,000,000 a / (l + r), rounded down, in integers of any length."""
    doubled = F.lit(2_000_000).cast("decimal(7,0)") * _whole(a)
    return F.call_function("div", doubled, _whole(left) + _whole(right))


def _part(words: str, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _weakest_cuts(found: DataFrame) -> DataFrame:
    """Every candidate with its lowest-scoring cut: ``l``, ``r`` and ``score``."""
    cuts = (
        found.where(F.col("size") >= 2)
        .withColumn("_words", F.split("phrase", " "))
        .withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        .withColumn("_left", _part("_words", F.lit(1), F.col("_k")))
        .withColumn("_right", _part("_words", F.col("_k") + 1, F.col("size") - F.col("_k")))
    )
    for side in ("_left", "_right"):
        counts = found.select("lang", F.col("phrase").alias(side), F.col("times").alias(f"{side}_n"))
        cuts = cuts.join(counts, ["lang", side])
    cut = F.struct(score("times", "_left_n", "_right_n").alias("score"), "_k", "_left_n", "_right_n")
    lowest = cuts.groupBy("lang", "size", "phrase", "times").agg(F.min(cut).alias("_cut"))
    return lowest.select(
        "lang",
        "size",
        "phrase",
        F.col("times").alias("a"),
        F.col("_cut._left_n").alias("l"),
        F.col("_cut._right_n").alias("r"),
        F.col("_cut.score").alias("score"),
    )


def _contained(found: DataFrame) -> DataFrame:
    """Sequences inside longer candidates, with the count of the most frequent one."""
    longer = found.where(F.col("size") >= 3).withColumn("_words", F.split("phrase", " "))
    sizes = longer.withColumn("_k", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    starts = sizes.withColumn(
        "_at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_k") + 1))
    )
    inner = starts.select("lang", _part("_words", F.col("_at"), F.col("_k")).alias("phrase"), "times")
    return inner.groupBy("lang", "phrase").agg(F.max("times").alias("_longer"))


def mine_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    threshold: int = 30,
    longest: int = 4,
    inside: int = 80,
    best: int = 2000,
) -> DataFrame:
    """The ``best`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase has 2 to ``longest`` words, ``a`` occurrences (``threshold`` or more, overlaps
    included) and the score of its weakest cut (ties: the shorter first part). Phrases
    that lie in a longer one with at least ``inside`` percent of their occurrences go.
    Equal scores rank by occurrences, then by the phrase's bytes.

    A null text is empty, a null language ``und``; an empty text, or one of separators
    alone, adds nothing, and repeated rows count as often as they occur. A very long
    text is cut at separators, never within a piece. No rows, or no phrase that
    occurs often enough, give no rows. Other columns play no part, whatever their names.
    """
    found = frequent_sequences(docs, text, lang, threshold, longest)
    totals = found.where(F.col("size") == 0).select("lang", F.col("times").alias("n"))
    kept = (
        _weakest_cuts(found)
        .join(_contained(found), ["lang", "phrase"], "left")
        .where(
            F.col("_longer").isNull()
            | (_whole("_longer") * F.lit(100) < _whole("a") * F.lit(inside))
        )
    )
    by = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    # A language may hold most candidates: the best of each share first.
    for keys in (["lang", "_share"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
        kept = kept.withColumn("_share", share).withColumn("rank", rank).where(F.col("rank") <= best)
    return kept.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
