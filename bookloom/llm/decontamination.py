"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds every window of the normalised test items; each document is
normalised the same way and scanned once. Hits are mapped from the normalised
text to words and on to code points of the original. There is no shuffle.

The items are sent to every executor. ``max_item_bytes`` bounds what one
automaton holds; more items than that are scanned in further passes over blocks
of items, each within the bound, and the hits are merged per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookloom.llm.common import boxed, byte_rows, unboxed

WINDOW = 13
MAX_ITEM_BYTES = 4 << 20

# A word is made of digits, letters and all beyond ASCII.
_WORD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def item_windows(items: list[tuple[str, bytes]], window: int = WINDOW) -> dict[str, tuple[str, ...]]:
    """Windows, as text with a space around each word, and the items that hold them."""
    found: dict[str, dict[str, None]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            key = b" " + b" ".join(words[i : i + window]) + b" "
            found.setdefault(key.decode(), {})[item] = None
    return {key: tuple(ids) for key, ids in found.items()}


def build(windows: dict[str, tuple[str, ...]]) -> ahocorasick.Automaton | None:
    if not windows:
        return None
    automaton = ahocorasick.Automaton()
    for key, ids in windows.items():
        automaton.add_word(key, (len(key), key.count(" ") - 1, ids))
    automaton.make_automaton()
    return automaton


def scan(automaton: ahocorasick.Automaton | None, text: bytes) -> tuple[int, list[int], set[str]]:
    """Number of words, hit words as flat pairs (first, past the last), items found."""
    words = words_of(text)
    if automaton is None or not words:
        return len(words), [], set()
    joined = (b" " + b" ".join(words) + b" ").decode(errors="replace")
    spans: list[int] = []
    items: set[str] = set()
    spaces = None
    for end, (chars, n, ids) in automaton.iter(joined):
        if spaces is None:
            spaces = np.flatnonzero(np.array(list(joined)) == " ")
        first = int(np.searchsorted(spaces, end - chars + 1))
        items.update(ids)
        spans += (first, first + n)
    return len(words), merge(spans), items


def merge(spans: list[int]) -> list[int]:
    """Flat pairs, sorted and joined where they touch."""
    out: list[int] = []
    for first, end in sorted(zip(spans[::2], spans[1::2])):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += (first, end)
    return out


def original_offsets(text: str, spans: list[int]) -> list[int]:
    """Spans of words as code points of the text they were read from."""
    if not spans:
        return []
    chars = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ascii_word = np.zeros(128, bool)
    ascii_word[[b for b in range(128) if _WORD[b] != 32]] = True
    word = (chars >= 128) | ascii_word[np.minimum(chars, 127)]
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out: list[int] = []
    for first, end in zip(spans[::2], spans[1::2]):
        out += (int(starts[first]), int(ends[end - 1]))
    return out


RESULTS = {
    "n_words": (T.LongType(), pa.int64()),
    "n_hit": (T.LongType(), pa.int64()),
    "items": (T.ArrayType(T.StringType()), pa.list_(pa.string())),
    "hit_words": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "hit_chars": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
}


def item_blocks(
    items: DataFrame, item_id: str, text: str, max_bytes: int
) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of at most ``max_bytes`` of text (or one item).

    They come through the driver one partition at a time. Rows without an id or
    a text have no windows. There is always one block, be it empty.
    """
    block: list[tuple[str, bytes]] = []
    held = blocks = 0
    chosen = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull())
    for row in chosen.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        raw = row[1].encode()
        if held and held + len(raw) > max_bytes:
            yield block
            block, held, blocks = [], 0, blocks + 1
        block.append((row[0], raw))
        held += len(raw)
    if block or not blocks:
        yield block


def find_items(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_item_bytes: int = MAX_ITEM_BYTES,
) -> DataFrame:
    """Add what of the items occurs in each document.

    ``n_words``; ``n_hit`` words inside an occurrence of a window; ``items``
    (ids as text, sorted) with occurring windows; ``hit_words`` and ``hit_chars``,
    flat pairs of first and end of the merged hits, in words and in code points
    of the text. They replace input columns of those names.

    A window is ``window`` consecutive words; an item of fewer words is one
    window; an item without words or without an id has none. A null text has no
    words. Repeated items are one, repeated documents are scanned each, no rows
    give no rows.
    """
    spark = docs.sparkSession
    out = docs.drop(*RESULTS)
    for block in item_blocks(items, item_id, item_text, max_item_bytes):
        handle = spark.sparkContext.broadcast(item_windows(block, window))
        more = [T.StructField(n, t) for n, (t, _) in RESULTS.items() if n not in out.columns]
        out = out.mapInArrow(_scanner(text, handle), T.StructType([*out.schema.fields, *more]))
    return out


def _scanner(text: str, handle) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(handle.value)
        for batch in batches:
            names = batch.schema.names
            kept = {n: batch.column(i) for i, n in enumerate(names) if n not in RESULTS}
            again = "hit_words" in names
            old = zip(
                *[batch.column(n).to_pylist() if again else [[]] * batch.num_rows for n in ("hit_words", "items")]
            )
            hits: list[tuple] = []
            for raw, (spans, items) in zip(byte_rows(kept[text]), old):
                n, more, found = scan(automaton, raw)
                spans = merge([*spans, *more])
                chars = original_offsets(raw.decode(errors="replace"), spans)
                hit = sum(spans[1::2]) - sum(spans[::2])
                hits.append((n, hit, sorted({*items, *found}), spans, chars))
            columns = list(zip(*hits)) if hits else [()] * len(RESULTS)
            kept |= {n: pa.array(c, t) for (n, (_, t)), c in zip(RESULTS.items(), columns)}
            yield pa.RecordBatch.from_pydict(kept)

    return run


def contaminated(min_share: int = 20) -> F.Column:
    """At least one word in ``min_share`` is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * min_share >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their columns as they were."""
    text = options.pop("text", "text")
    names, _ = boxed(docs)
    _, row = boxed(docs, [text])
    found = find_items(docs.select(row, F.col(f"`{text}`").alias("text")), items, **options)
    return found.where(~contaminated()).select(*unboxed(names, {text: F.col("text")}))
