"""Substring dedup: runs of words that a smaller document holds too are removed.

Documents are streamed through suffix automata of reference shards. A shard is
not sent to every task: that would be every document against every shard. Each
window of words names the shard it can be found in, by the smallest hash among
its runs of ANCHOR words (its anchor), so a document's windows meet only the
reference text that can match them:

* consecutive windows with the same anchor make one piece; the anchor's own words
  are equal in the whole shard, so a piece carries the words around it;
* each block of documents combines equal pieces before the shuffle: the smallest
  document keeps the piece, the others have lost it already. So a passage that
  very many documents share is one row per block;
* per anchor, distinct pieces are taken in the order of their documents: each is
  streamed through the automaton of all smaller documents' pieces, and where the
  matching statistic reaches the window's length, the window goes.

An anchor with very many different surroundings (the edge of a common passage)
is found by a count beforehand; its windows are dealt out one by one by their
own hashes. Everything is judged on the input, not on what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.llm.common import ROW, boxed, byte_rows, slices, stored, unboxed
from bookloom.llm.suffix_automaton import SuffixAutomaton
from bookloom.llm.word_hashes import hashes, mix

WINDOW = 13
ANCHOR = 7
# Text that is hashed at once, and documents that are combined before the shuffle.
HASH_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20
# Text a bucket of anchors stands for.
BUCKET_BYTES = 16 << 20
# Buckets whose losses meet in one part of the documents.
BUCKETS_A_PART = 8
# Different surroundings beyond which an anchor's windows are dealt out one by
# one; at most a millionth of all anchors' number of anchors is listed.
HOT = 2000
HOT_IN_BLOCK = 4
MOST_HOT = 1_000_000

_PLACE = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _runs_of(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place where so many follow."""
    many = max(0, len(words) - n + 1)
    total = np.zeros(many, np.uint64)
    for j in range(n):
        total += words[j : j + many] * _PLACE[j]
    return mix(total)


class Words:
    """The words of several texts as one run of bytes, and their hashes."""

    def __init__(self, texts: list[bytes]):
        lists = [t.split() for t in texts]
        flat = [w for words in lists for w in words]
        self.joined = b" ".join(flat) + b" "
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        counts = np.array([len(x) for x in lists], np.int64)
        self.text_starts = np.cumsum(counts) - counts
        self.text_of = np.repeat(np.arange(len(texts)), counts)
        self.hashes = hashes(np.frombuffer(self.joined, np.uint8), self.starts, self.ends)

    def pieces(self, window: int, anchor: int) -> tuple[np.ndarray, ...]:
        """Runs of windows with one anchor: its hash and place, first and last window."""
        grams = _runs_of(self.hashes, anchor)
        many = max(0, len(self.hashes) - window + 1)
        whole = self.text_of[:many] == self.text_of[window - 1 : window - 1 + many]
        best, place = grams[:many].copy(), np.arange(many)
        for j in range(1, window - anchor + 1):
            less = grams[j : j + many] < best
            best[less] = grams[j : j + many][less]
            place[less] = np.flatnonzero(less) + j
        at = np.flatnonzero(whole)
        place = place[at]
        new = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(new[1:], len(at))[: len(new)] - 1
        return grams[place[new]], place[new], at[new], at[last]


def _pieces(texts: list[bytes], window: int, anchor: int, hot: set[int]) -> Iterator[tuple[int, int, bytes]]:
    """Text, place of its first word, and key with the words around the anchor."""
    words = Words(texts)
    if len(words.hashes) < window:
        return
    joined, starts, ends = words.joined, words.starts.tolist(), words.ends.tolist()
    keys, place, first, last = words.pieces(window, anchor)
    raw = keys.tobytes()
    own = _runs_of(words.hashes, window).tobytes() if hot else b""
    text_of = words.text_of[first].tolist()
    offset = words.text_starts.tolist()
    is_hot = np.isin(keys, np.fromiter(hot, np.uint64, len(hot))).tolist() if hot else [False] * len(keys)
    rows = zip(text_of, place.tolist(), first.tolist(), last.tolist(), is_hot)
    for i, (text, p, a, b, split) in enumerate(rows):
        if split:
            for j in range(a, b + 1):
                content = joined[starts[j] : ends[j + window - 1]]
                yield text, j - offset[text], own[8 * j : 8 * j + 8] + content
        else:
            left = joined[starts[a] : ends[p - 1]] if p > a else b""
            end = b + window - 1
            right = joined[starts[p + anchor] : ends[end]] if end >= p + anchor else b""
            yield text, a - offset[text], raw[8 * i : 8 * i + 8] + left + b"\t" + right


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about HASH_BYTES."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= HASH_BYTES:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _hot_counter(window: int, anchor: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK_BYTES):
            texts = byte_rows(batch.column("text"))
            found: set[bytes] = set()
            for a, b in _groups(texts):
                found.update(x for _, _, x in _pieces(texts[a:b], window, anchor, set()))
            keys = np.frombuffer(b"".join(x[:8] for x in found), np.uint64)
            keys, counts = np.unique(keys, return_counts=True)
            keep = counts >= HOT_IN_BLOCK
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(keys[keep].view(np.int64), 0)),
                    pa.array(np.append(counts[keep], 0)),
                    pa.array(np.append(np.zeros(keep.sum(), np.int64), counts.sum())),
                ],
                names=["key", "n", "pieces"],
            )

    return run


def hot_anchors(docs: DataFrame, window: int, anchor: int) -> set[int]:
    """Anchors with more than HOT different surroundings; at most MOST_HOT of them."""
    kinds = "key bigint, n bigint, pieces bigint"
    counted = stored(docs.select("text").mapInArrow(_hot_counter(window, anchor), kinds), "spans-anchors")
    total = counted.agg(F.sum("pieces")).first()[0] or 0
    limit = max(HOT, total // MOST_HOT)
    sums = counted.where(F.col("n") > 0).groupBy("key").agg(F.sum("n").alias("n"))
    listed = sums.where(F.col("n") > limit).select("key").toArrow()["key"].to_numpy()
    return set(listed.view(np.uint64).tolist())


def _emit(held: dict[bytes, list[int]], ids: np.ndarray, tags: np.ndarray, buckets: int) -> Iterator[dict]:
    """The block's pieces, packed per bucket."""
    names = list(held)
    keys = np.frombuffer(b"".join(x[:8] for x in names), np.uint64)
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    packer = zstandard.ZstdCompressor(level=3)
    for b in np.flatnonzero(np.diff(edges)).tolist():
        at = order[edges[b] : edges[b + 1]].tolist()
        places = [held[names[i]] for i in at]
        counts = np.array([len(p) for p in places], np.uint32)
        flat = np.array([x for p in places for x in p], np.uint32)
        texts = b"\n".join([names[i][8:] for i in at])
        used, flat[::2] = np.unique(flat[::2], return_inverse=True)
        head = np.array([len(at), len(flat), len(used)], np.uint32)
        parts = [head, keys[at], counts, flat[::2].copy(), flat[1::2].copy(), ids[used], tags[used]]
        yield {"bucket": b, "payload": packer.compress(b"".join(p.tobytes() for p in parts) + texts)}


def _unpack(payload: bytes) -> tuple:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, m, k = np.frombuffer(raw, np.uint32, 3).tolist()
    at = 12
    out = []
    for kind, size in ((np.uint64, n), (np.uint32, n), (np.uint32, m // 2), (np.uint32, m // 2), (np.int64, k), (np.int64, k)):
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    keys, counts, doc, place, ids, tags = out
    return keys, counts // 2, ids[doc], tags[doc], place, raw[at:].split(b"\n")


def _join(ranges: list[tuple[int, int]]) -> bytes:
    """Ranges sorted and joined where they touch, as flat 32-bit numbers."""
    out: list[int] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return np.array(out, np.uint32).tobytes()


def _parts_of(
    lost: dict[tuple[int, int], list[tuple[int, int]]], parts: int
) -> Iterator[tuple[int, bytes]]:
    """What documents lose, packed per part of the documents: ids, tags, and ranges of words."""
    if not lost:
        return
    ids, tags = (np.array([key[k] for key in lost], np.int64) for k in range(2))
    ranges = [_join(r) for r in lost.values()]
    part = (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    packer = zstandard.ZstdCompressor(level=3)
    for k in np.flatnonzero(np.diff(edges)).tolist():
        at = order[edges[k] : edges[k + 1]]
        held = [ranges[i] for i in at.tolist()]
        sizes = np.array([len(x) for x in held], np.int64)
        head = np.array([len(at)], np.int64)
        packed = b"".join(x.tobytes() for x in (head, ids[at], tags[at], sizes)) + b"".join(held)
        yield k, packer.compress(packed)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task of a part of the documents: all that each of them loses."""
    held: dict[tuple[int, int], list[bytes]] = {}
    for batch in batches:
        for packed in batch.column("payload").to_pylist():
            raw = zstandard.ZstdDecompressor().decompress(packed)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            ids, tags, sizes = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n).tolist()
            at = 8 + 24 * n
            for key, size in zip(zip(ids, tags), sizes):
                held.setdefault(key, []).append(raw[at : at + size])
                at += size
    keys = list(held)
    for start in range(0, len(keys), 10_000):
        some = keys[start : start + 10_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in some], pa.int64()),
                pa.array([k[1] for k in some], pa.int64()),
                pa.array([held[k] for k in some], pa.list_(pa.binary())),
            ],
            names=["id", "tag", "_lost"],
        )


def _map(window: int, anchor: int, hot: set[int], buckets: int, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK_BYTES):
            # The smallest document comes first.
            batch = batch.take(pc.sort_indices(batch.column("id")))
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tag"))
            texts = byte_rows(batch.column("text"))
            held: dict[bytes, list[int]] = {}
            lost: dict[int, list[tuple[int, int]]] = {}
            for a, b in _groups(texts):
                for text, place, piece in _pieces(texts[a:b], window, anchor, hot):
                    text += a
                    entry = held.get(piece)
                    if entry is None:
                        held[piece] = [text, place]
                    elif ids[entry[0]] == ids[text]:
                        entry += (text, place)
                    else:
                        lost.setdefault(text, []).append((place, place + _words_in(piece[8:], anchor)))
            own: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for t, r in lost.items():
                own.setdefault((int(ids[t]), int(tags[t])), []).extend(r)
            rows = [
                {"bucket": part % buckets, "part": part, "payload": packed}
                for part, packed in _parts_of(own, parts)
            ]
            rows += _emit(held, ids, tags, buckets)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_PACKED)

    return run


_PACKED = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("payload", pa.binary())])


def _words_in(content: bytes, anchor: int) -> int:
    """Words of a piece: those around the anchor and its own, or those of a whole window."""
    if b"\t" not in content:
        return content.count(b" ") + 1
    left, right = content.split(b"\t")
    return anchor + sum(x.count(b" ") + 1 for x in (left, right) if x)


def _tokens(content: bytes) -> list[bytes]:
    left, tab, right = content.partition(b"\t")
    return left.split() + [tab] * bool(tab) + right.split()


def judge(rows: list[tuple[int, bytes]], window: int, anchor: int) -> dict[int, list[tuple[int, int]]]:
    """Pieces under one key, as (document, content): what each loses, by its place in the list.

    Ranges are of words from the piece's first one. Documents' pieces are streamed
    through the automaton of those of all smaller documents.
    """
    lost: dict[int, list[tuple[int, int]]] = {}
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    first: dict[bytes, int] = {}
    fresh = []
    for i in order:
        doc, content = rows[i]
        if first.setdefault(content, doc) < doc:
            lost[i] = [(0, _words_in(content, anchor))]
        else:
            fresh.append(i)
    if len(first) == 1:
        return lost
    automaton, waiting, now = SuffixAutomaton(), [], None
    for i in fresh:
        doc, content = rows[i]
        if doc != now:
            for tokens in waiting:
                automaton.add(tokens)
            waiting, now = [], doc
        tokens = _tokens(content)
        # The anchor stands as one token for all its words.
        least = window - anchor + 1 if b"\t" in content else window
        found = [
            (end + 1 - least, end + 1 - least + window)
            for end, n in enumerate(automaton.matches(tokens))
            if n >= least
        ]
        if found:
            lost[i] = found
        waiting.append(tokens)
    return lost


def _judge_bucket(payloads: list[bytes], window: int, anchor: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    parts = [_unpack(p) for p in payloads]
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    ids, tags, places = (np.concatenate([p[k] for p in parts]).tolist() for k in (2, 3, 4))
    contents = [c for p in parts for c in p[5]]
    at = (np.cumsum(counts) - counts).tolist()
    many = counts.tolist()
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] + np.uint64(1), append=keys[order][-1:] + np.uint64(1)))
    sizes = np.diff(edges)
    order = order.tolist()
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k in np.flatnonzero(sizes > 1).tolist():
        group = order[edges[k] : edges[k + 1]]
        lost = judge([(ids[at[i]], contents[i]) for i in group], window, anchor)
        for g, ranges in lost.items():
            i = group[g]
            for place in range(at[i], at[i] + many[i]):
                out.setdefault((ids[place], tags[place]), []).extend(
                    (places[place] + a, places[place] + b) for a, b in ranges
                )
    return out


_LOST = pa.schema([("part", pa.int64()), ("payload", pa.binary())])


def _reduce(window: int, anchor: int, parts: int) -> Callable:
    def found(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        if payloads:
            lost = _judge_bucket(payloads, window, anchor)
            rows = [{"part": part, "payload": packed} for part, packed in _parts_of(lost, parts)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_LOST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, part, payload in zip(*[c.to_pylist() for c in batch.columns]):
                if part is not None:
                    # Lost within its block already.
                    yield pa.RecordBatch.from_pylist([{"part": part, "payload": payload}], schema=_LOST)
                    continue
                if bucket != now:
                    yield from found(held)
                    now, held = bucket, []
                held.append(payload)
        yield from found(held)

    return run


RESULTS = ("n_words", "n_removed")


def _cut() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for raw, lost in zip(byte_rows(batch.column("_text")), batch.column("_lost").to_pylist()):
                words = raw.split()
                gone = np.zeros(len(words), bool)
                for part in lost or ():
                    ranges = np.frombuffer(part, np.uint32).tolist()
                    for a, b in zip(ranges[::2], ranges[1::2]):
                        gone[a:b] = True
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
            columns = {
                ROW: batch.column(ROW),
                "_text": pa.array([k.decode(errors="replace") for k in kept], pa.string()),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def drop_repeated_spans(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
) -> DataFrame:
    """The documents without words in a window that a smaller document holds too.

    Every row comes back with all its columns, the text replaced by the words
    that stay, joined by one space, and ``n_words`` (before) and ``n_removed``;
    these replace input columns of those names, in any case; other names are free.
    Ids are whole numbers. A very long text is handled whole.

    A null text has no words. Rows without an id stay whole and take nothing from
    others. Rows of one id are one document and take nothing from each other. No
    rows give no rows.
    """
    names, _ = boxed(docs, RESULTS)
    _, row = boxed(docs, (*RESULTS, text))
    body, key = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{doc_id}`").cast("bigint")
    tag = F.xxhash64(F.lit("text"), body)
    narrow = docs.where(key.isNotNull()).select(key.alias("id"), tag.alias("tag"), body.alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    parts = -(-buckets // BUCKETS_A_PART)
    hot = hot_anchors(narrow, window, anchor)
    packed = narrow.mapInArrow(
        _map(window, anchor, hot, buckets, parts), "bucket bigint, part bigint, payload binary"
    )
    # Each bucket is one task's, and so is each part of the documents.
    judged = packed.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(
        _reduce(window, anchor, parts), "part bigint, payload binary"
    )
    lost = stored(
        stored(judged, "spans-lost")
        .repartitionById(parts, F.col("part").cast("int"))
        .mapInArrow(_merge, "id bigint, tag bigint, _lost array<binary>"),
        "spans",
    )
    whole = docs.select(row, body.alias("_text"), key.alias("id"), tag.alias("tag"))
    joined = whole.join(lost, ["id", "tag"], "left").select(ROW, "_text", "_lost")
    kinds = T.StructType([*joined.schema.fields[:2], *[T.StructField(n, T.LongType()) for n in RESULTS]])
    cut = joined.mapInArrow(_cut(), kinds)
    return cut.select(*unboxed(names, {text: F.col("_text")}), *RESULTS)
