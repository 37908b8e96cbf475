"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits in five segments on a ring. If two fingerprints differ
in at most ``most`` bits, then from some segment on every chain of l consecutive
segments differs in at most l * most / 5 bits. With four bits or fewer that
chain starts with an equal segment followed by one with at most one difference,
so the two agree in the first segment and in three quarters of the second:
those are the keys under which candidates meet. Candidates must then keep the
budgets of the whole chain, and the last chain is the full Hamming check.

Only distinct fingerprints are compared. A key's fingerprints beyond
``BUCKET`` are dealt into parts, and every two parts meet in a task of their
own, so no task holds an unbounded group and no pair is lost. Each task returns
a forest of links that connects what it found connected, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import byte_rows, stored
from bookloom.llm.components import components

SHINGLE = 4
MOST = 4
SEED = 42
BUCKET = 2048
# Bits of each segment, from the lowest.
SEGMENTS = (13, 13, 13, 13, 12)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half the hashes of the word shingles.

    Words are what lies between ASCII white space, A-Z lower-cased; shingles keep
    repeats; fewer words than a shingle are one shingle; no words give zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(
        (
            xxhash.xxh64_intdigest(joined[a:b], SEED)
            for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())
        ),
        np.uint64,
        n,
    )
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        block = hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_doc`` and ``fp`` of every row; ``fp`` as a signed long. Null text: no words."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x) for x in byte_rows(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=["_doc", "fp"]
            )

    narrow = docs.select(F.col(doc_id).alias("_doc"), F.col(text).cast("string"))
    return narrow.mapInArrow(run, f"_doc {kind}, fp bigint")


def _segment(at: int) -> tuple[int, int]:
    """Lowest bit and width of a segment of the ring."""
    at %= len(SEGMENTS)
    return sum(SEGMENTS[:at]), SEGMENTS[at]


def ring_masks(start: int) -> list[int]:
    """Bits of the chains of 1, 2, ... segments from a segment on."""
    masks, held = [], 0
    for step in range(len(SEGMENTS)):
        low, width = _segment(start + step)
        held |= ((1 << width) - 1) << low
        masks.append(held)
    return masks


def key_masks(start: int) -> list[int]:
    """A segment and the next one without one of its four quarters."""
    first, (low, width) = ring_masks(start)[0], _segment(start + 1)
    cuts = [low + width * q // 4 for q in range(5)]
    rest = ((1 << width) - 1) << low
    return [
        first | rest & ~(((1 << (b - a)) - 1) << a) for a, b in zip(cuts, cuts[1:])
    ]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def keyed(prints: DataFrame) -> DataFrame:
    """Each distinct fingerprint under its twenty keys (``k`` which, ``v`` its bits)."""
    masks = [m for start in range(len(SEGMENTS)) for m in key_masks(start)]
    keys: list[Column] = [
        F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v"))
        for k, m in enumerate(masks)
    ]
    return prints.select("fp", "node", F.inline(F.array(*keys)))


def buckets(rows: DataFrame, size: int = BUCKET) -> DataFrame:
    """Fingerprints that meet: under one key, or two parts of a key with many."""
    hot = stored(
        rows.groupBy("k", "v")
        .count()
        .where(F.col("count") > size)
        .select("k", "v", F.ceil(F.col("count") * 2 / size).cast("int").alias("parts")),
        "simhash-hot",
    )
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("fp"), parts).cast("int")
    dealt = rows.join(hot, ["k", "v"], "left").select(
        "k", "v", "fp", "node", part.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")
    )
    return (
        dealt.groupBy("k", "v", F.least("own", "other"), F.greatest("own", "other"))
        .agg(F.collect_list("fp").alias("fps"), F.collect_list("node").alias("nodes"))
        .where(F.size("fps") > 1)
        .select("k", "fps", "nodes")
    )


def _near(fp: np.uint64, others: np.ndarray, masks: list[np.uint64], most: int) -> np.ndarray:
    """Places of the others that keep every chain's budget; the last is the full check."""
    at = np.arange(len(others))
    differ = others ^ fp
    for step, mask in enumerate(masks, 1):
        keep = np.bitwise_count(differ & mask) <= step * most // len(masks)
        at, differ = at[keep], differ[keep]
        if not len(at):
            break
    return at


def forest(fps: np.ndarray, nodes: np.ndarray, start: int, most: int) -> list[tuple[int, int]]:
    """Links that connect all fingerprints connected by chains from ``start``."""
    masks = [np.uint64(m) for m in ring_masks(start)]
    links = []
    while len(fps) > 1:
        front = [(fps[0], nodes[0])]
        fps, nodes = fps[1:], nodes[1:]
        while front and len(fps):
            fp, node = front.pop()
            at = _near(fp, fps, masks, most)
            if len(at):
                links += [(int(node), int(n)) for n in nodes[at]]
                front += zip(fps[at], nodes[at])
                fps, nodes = np.delete(fps, at), np.delete(nodes, at)
    return links


def _links(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            ks, fps, nodes = batch.columns
            at = fps.offsets.to_numpy()
            flat = np.ascontiguousarray(fps.values.to_numpy(zero_copy_only=False)).view(np.uint64)
            ids = nodes.values.to_numpy(zero_copy_only=False)
            for k, a, b in zip(ks.to_pylist(), at[:-1], at[1:]):
                out += forest(flat[a:b], ids[a:b], k // 4, most)
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
            )

    return run


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST
) -> DataFrame:
    """``doc_id``, ``fp`` (signed long) and ``component_id`` of every row.

    The component is the smallest id reachable over fingerprints that differ in
    at most ``most`` (0 to 4) bits. Documents without words have fingerprint
    zero and are linked like any other. A row without an id has a fingerprint,
    links nothing and has no component. Rows of one id are one document. No rows
    give no rows.
    """
    if not 0 <= most < len(SEGMENTS):
        raise ValueError("keys are made for at most 4 differing bits")
    prints = stored(fingerprints(docs, doc_id, text), "simhash-prints")
    known = prints.where(F.col("_doc").isNotNull())
    distinct = stored(
        known.groupBy("fp").agg(F.min("_doc").cast("bigint").alias("node")), "simhash-distinct"
    )
    met = buckets(stored(keyed(distinct), "simhash-keys"))
    # Two fingerprints of one id are one document too.
    same = (
        known.groupBy("_doc")
        .agg(F.min("fp").alias("fp"), F.max("fp").alias("last"))
        .where(F.col("fp") != F.col("last"))
        .select(F.col("_doc").alias("node"))
        .join(known.withColumnRenamed("_doc", "node"), "node")
        .join(distinct.withColumnRenamed("node", "least"), "fp")
        .select(F.col("node").cast("bigint").alias("a"), F.col("least").alias("b"))
    )
    links = met.mapInArrow(_links(most), "a bigint, b bigint").union(same)
    root = components(links)
    named = stored(
        distinct.join(root, "node", "left").select(
            "fp", F.coalesce("root", "node").alias("component_id")
        ),
        "simhash-named",
    )
    return prints.join(named, "fp", "left").select(
        F.col("_doc").alias(doc_id),
        "fp",
        F.when(F.col("_doc").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST
) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id.

    Rows keep all columns. Rows of one id stay or go together; rows without an
    id stay.
    """
    found = near_duplicates(docs, doc_id, text, most)
    gone = stored(
        found.where(F.col(doc_id) != F.col("component_id")).select(F.col(doc_id).alias("_gone")).distinct(),
        "simhash-gone",
    )
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
