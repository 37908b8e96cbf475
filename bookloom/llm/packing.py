"""Packing token sequences: first-fit decreasing in randomised groups.

Documents become token ids; a document longer than a sequence is cut into whole
sequences and one rest. Pieces get a random group; in each group they are put,
longest first, into the first sequence with room, found through a tournament
tree over what room each sequence has left. Groups are independent tasks of a
bounded number of pieces, so nothing grows with the data in one task.

The token ids themselves need not be shuffled: the assignment needs lengths only.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import byte_rows, slices, stored
from bookloom.llm.word_hashes import edges, hashes

SEQUENCE = 4096
END = 2
GROUP_PIECES = 8192
# Words whose ids a worker keeps, in each of two generations.
CACHE_WORDS = 80_000
BLOCK_BYTES = 1 << 19
# Text, chosen by a hash, that names the words every worker knows from the start, and
# how many those are. They save time; no id depends on them.
COMMON_BYTES = 64 << 20
COMMON_WORDS = 200_000
# Words that are given to the tokenizer as one text, with a mark between them.
TOGETHER = 256
MARK = "\x01"


def _lower_ascii(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words of ASCII alone in lower case, all others as they are."""
    if joined.isascii():
        return joined.lower()
    raw = np.frombuffer(joined, np.uint8)
    lower = np.frombuffer(joined.lower(), np.uint8)
    high = np.concatenate([[0], np.cumsum(raw >= 128, dtype=np.int32)])
    kept = np.flatnonzero(high[ends] > high[starts])
    at = np.zeros(len(raw) + 1, np.int8)
    at[starts[kept]] = 1
    at[ends[kept]] = -1
    return np.where(np.cumsum(at[:-1], dtype=np.int8), raw, lower).tobytes()


class Known:
    """Ids of words by hash, as arrays: looked up for a whole block at once."""

    def __init__(self, words: list[bytes], ids: list[bytes]):
        raw = np.frombuffer(b"\n".join(words), np.uint8)
        found = hashes(raw, *edges(raw)) if words else np.zeros(0, np.uint64)
        length = np.array([len(x) // 4 for x in ids], np.int64)
        order = np.argsort(found, kind="stable")
        self.hash = found[order]
        self.length = length[order]
        self.offset = (np.cumsum(length) - length)[order]
        self.flat = np.frombuffer(b"".join(ids), "<u4")

    def places(self, found: np.ndarray) -> np.ndarray:
        """Where sorted hashes stand, -1 for those that are not known."""
        at = np.searchsorted(self.hash, found)
        here = at < len(self.hash)
        here[here] = self.hash[at[here]] == found[here]
        return np.where(here, at, -1)


class WordIds:
    """Ids of texts through the ids of their words.

    The tokenizer drops white space and joins nothing across it, so the ids of a
    text are those of its parts between white space. A part of ASCII alone has the
    same ids in lower case; any other is kept as it is, as some letters compose
    with a mark in one case only. Texts with a special token's marks are given to
    it whole.
    """

    def __init__(self, path: str, common: Known | None = None, marks: bytes = b"<|"):
        # Spark has a task per core; threads of the tokenizer would only add memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.common = common or Known([], [])
        self.marks = marks
        self.mark = int(self._whole([MARK])[0][0])
        self.young: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in found]

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word; many words go to the tokenizer at a time."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        out: list[bytes] = []
        for group, ids in zip(groups, self._whole([f" {MARK} ".join(g) for g in groups])):
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(group) - 1:  # a word holds the mark itself
                out += [x.tobytes() for x in self._whole(group)]
                continue
            raw = ids.tobytes()
            edges = [-1, *cuts.tolist(), len(ids)]
            out += [raw[4 * a + 4 : 4 * b] for a, b in zip(edges, edges[1:])]
        return out

    def learn(self, found: list[int], words: Callable[[list[int]], list[bytes]]) -> list[bytes]:
        """Ids of distinct words by hash; ``words`` gives those that are new, by place."""
        known = list(map(self.young.get, found))
        known = [self.old.get(h) if x is None else x for h, x in zip(found, known)]
        fresh = [i for i, x in enumerate(known) if x is None]
        new = self._encode([w.decode(errors="replace") for w in words(fresh)])
        for i, x in zip(fresh, new):
            known[i] = x
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young.update(zip(found, known))
        return known

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers.

        Words are found and told apart by array operations over all the texts.
        """
        special = [i for i, x in enumerate(texts) if self.marks in x]
        plain = [b"" if self.marks in x else x for x in texts]
        joined = b"\n".join(plain)
        starts, ends = edges(np.frombuffer(joined, np.uint8))
        joined = _lower_ascii(joined, starts, ends)
        raw = np.frombuffer(joined, np.uint8)
        found, first, which = np.unique(hashes(raw, starts, ends), return_index=True, return_inverse=True)
        at = self.common.places(found)
        rare = np.flatnonzero(at < 0)
        where = first[rare]

        def words(places: list[int]) -> list[bytes]:
            spots = where[places]
            return [joined[a:b] for a, b in zip(starts[spots].tolist(), ends[spots].tolist())]

        learned = self.learn(found[rare].tolist(), words)
        # Ids of the common words, then of the rest, one after another.
        flat = np.concatenate([self.common.flat, np.frombuffer(b"".join(learned), "<u4")])
        lengths = np.empty(len(found), np.int64)
        offsets = np.empty(len(found), np.int64)
        common = at >= 0
        lengths[common], offsets[common] = self.common.length[at[common]], self.common.offset[at[common]]
        lengths[rare] = [len(x) // 4 for x in learned]
        offsets[rare] = len(self.common.flat) + np.cumsum(lengths[rare]) - lengths[rare]
        own = lengths[which]
        done = np.cumsum(own)
        at = np.arange(done[-1] if len(done) else 0) + np.repeat(offsets[which] - (done - own), own)
        ids = flat[at].tobytes()
        # Where each text's words end among all words, and its ids among all ids.
        text_ends = np.cumsum([len(x) + 1 for x in plain])
        last = np.searchsorted(starts, text_ends, "left")
        cuts = [0, *(np.concatenate([[0], done])[last] * 4).tolist()]
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in special:
            out[i] = self._whole([texts[i].decode(errors="replace")])[0].tobytes()
        return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 16 * BLOCK_BYTES):
        seen: Counter = Counter()
        for text in byte_rows(batch.column("text")):
            seen.update(text.split())
        # As the ids of a word of ASCII alone are kept.
        rows = Counter()
        for word, n in seen.items():
            rows[word.lower() if word.isascii() else word] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(rows), pa.binary()), pa.array(list(rows.values()), pa.int64())],
            names=["word", "n"],
        )


def common_words(docs: DataFrame, tokenizer: str, text: str = "text") -> Known:
    """Ids of the most frequent words of some texts: at most COMMON_WORDS, of bounded length."""
    body = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    size = body.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    one_in = max(1, -(-size // COMMON_BYTES))
    some = body.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
    counted = some.mapInArrow(_tally, "word binary, n bigint").where(
        (F.octet_length("word") <= 64) & ~F.contains("word", F.lit(b"<|"))
    )
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > 1)
    top = stored(top.orderBy(F.desc("n"), "word").limit(COMMON_WORDS).select("word"), "packing-words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        for batch in batches:
            ids = words.of(list(map(bytes, batch.column("word").to_pylist())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.array(ids, pa.binary())], names=["word", "ids"]
            )

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = top.repartition(min(parts, 16)).mapInArrow(run, "word binary, ids binary").toArrow()
    return Known(made["word"].to_pylist(), made["ids"].to_pylist())


PIECES = "`{id}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, piece_key bigint"


def pieces(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    most: int = SEQUENCE,
    end: int = END,
) -> DataFrame:
    """Token ids of every document, in pieces of at most ``most``.

    ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit numbers),
    ``doc_tokens`` and ``piece_key``, which no two pieces share. A null or empty
    text is the end token alone. Repeated rows give pieces each. A very long text
    is handled whole. No rows give no rows. Other columns of the documents, whatever their names, are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    # What a worker holds: the common words' ids and, from its first task on, the
    # tokenizer with the words met since.
    shared = docs.sparkSession.sparkContext.broadcast([common_words(docs, tokenizer, text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if len(held) == 1:
            held.append(WordIds(tokenizer, held[0]))
        words = held[1]
        key = TaskContext.get().partitionId() << 36
        tail = np.array([end], "<u4").tobytes()
        for batch in slices(batches, text, BLOCK_BYTES):
            ids, starts, parts, totals, rows = [], [], [], [], []
            for row, own in enumerate(words.of(byte_rows(batch.column(text)))):
                own += tail
                total = len(own) // 4
                for start in range(0, total, most):
                    rows.append(row)
                    starts.append(start)
                    parts.append(own[4 * start : 4 * (start + most)])
                    totals.append(total)
            ids = batch.column(doc_id).take(pa.array(rows, pa.int64()))
            keys = pa.array(np.arange(key, key + len(rows)), pa.int64())
            key += len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(starts, pa.int64()),
                    pa.array([len(p) // 4 for p in parts], pa.int64()),
                    pa.array(parts, pa.binary()),
                    pa.array(totals, pa.int64()),
                    keys,
                ],
                names=[doc_id, "start", "length", "ids", "doc_tokens", "piece_key"],
            )

    narrow = docs.select(F.col(doc_id), F.col(text).cast("string"))
    return narrow.mapInArrow(run, PIECES.format(id=doc_id, kind=kind))


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence and offset for each length (longest first), by a tournament tree.

    The tree's leaves are the room left in each sequence, opened or not, and each
    node holds the larger room below it; going down to the left where there is
    room enough finds the first sequence that fits.
    """
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for n in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < n:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - room[node])
        room[node] -= n
        node >>= 1
        while node:
            larger = max(room[2 * node], room[2 * node + 1])
            if room[node] == larger:
                break
            room[node] = larger
            node >>= 1
    return bins, offsets


def pack(parts: DataFrame, most: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (see ``pieces``); other columns stay.

    The number of groups follows the number of pieces; a piece's group is a hash
    of its key, which no two pieces share, so copies of one document spread too.
    Ties in length are settled by key, so the result depends on the pieces alone.
    """
    groups = F.ceil(parts.select(F.count("*")).scalar() / F.lit(group_pieces))
    group = F.pmod(F.xxhash64("piece_key"), F.greatest(groups, F.lit(1)))
    lists = (
        parts.select("piece_key", F.col("length").cast("int").alias("length"), group.alias("_group"))
        .groupBy("_group")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("n"), "piece_key"))).alias("_all"))
    )
    placed = lists.select("_group", "_all.n", "_all.piece_key").mapInArrow(
        _place(most), "piece_key bigint, sequence_id bigint, offset bigint"
    )
    rest = [f"`{c}`" for c in parts.columns if c not in ("sequence_id", "offset")]
    return parts.select(*rest).join(placed, "piece_key")


def _place(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                group, n, keys = (c[row].as_py() for c in batch.columns)
                bins, offsets = first_fit([-x for x in n], most)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array([(group << 32) + b for b in bins], pa.int64()),
                        pa.array(offsets, pa.int64()),
                    ],
                    names=["piece_key", "sequence_id", "offset"],
                )

    return run


def pack_documents(docs: DataFrame, tokenizer: str, keep_ids: bool = True, **options) -> DataFrame:
    """Pieces of every document with their place; see ``pieces`` and ``pack``.

    Pieces are written to the shared folder before they are placed, so that keys
    stay as they are. ``keep_ids=False`` leaves the ids away and only keeps
    ``ids_crc32``, their CRC32.
    """
    most = options.get("most", SEQUENCE)
    parts = pieces(docs, tokenizer, **options).withColumn("ids_crc32", F.crc32("ids"))
    if not keep_ids:
        parts = parts.drop("ids")
    return pack(stored(parts, "pieces"), most).drop("piece_key")
