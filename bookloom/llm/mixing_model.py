"""Logistic context mixing over bits, in numpy.

A byte (or the end of a text) is coded by a Huffman code that depends on the byte
before it, or on the two before it where both are common, so a symbol is a few binary decisions. Each decision is predicted in
several contexts (what chose the code, the two to four bytes before, the word so
far, that and the word before it); contexts but the first are hashed into tables of fixed size that count zeros and ones. The log-odds of the
counts are combined by weights that a gate selects, and an adaptive map refines
the mixed probability by the byte before. All figures are static while texts are
scored, so whole blocks of texts are scored by array operations.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

END = 256
SYMBOLS = 257
# Bytes that are common in running text.
COMMON = b"abcdefghijklmnopqrstuvwxyz \n.,\xc3"
CODES = 256 + (len(COMMON) + 1) ** 2
# Longer texts are read in pieces of this many bytes; contexts begin anew.
PIECE = 1 << 18
BLOCK = 1 << 16
# Where nothing is learned in order, blocks are smaller, so that their arrays stay in a core's cache.
SMALL_BLOCK = 1 << 14
PAD = 4
# Bits of the number of slots of each hashed context's table.
BITS = {"order2": 20, "order3": 21, "order4": 22, "word": 23, "two words": 22}
CONTEXTS = ("code", *BITS)
# A code's own nodes have a slot each.
SLOTS = [CODES << 8, *(1 << bits for bits in BITS.values())]
# Log-odds are kept as small integers in steps of 1 / STEP.
STEP = 14.0
PRIOR = 0.2
# Bit patterns of the seen contexts, at the first and at later decisions.
GATES = 32
# Decisions after which weights change.
STRIDE = 1 << 14
BUCKETS = 33
RANGE = 8.0
RATE = 0.03

# White space, and what stands before a text.
_BREAK = np.zeros(256, bool)
_BREAK[[0, 9, 10, 11, 12, 13, 32]] = True
_PLACE = np.zeros(256, np.int32)
_PLACE[list(COMMON)] = np.arange(1, len(COMMON) + 1)
_rng = np.random.Generator(np.random.PCG64(20))
_BYTE_HASH = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_MASK = (1 << 64) - 1


def pieces(texts: list[bytes]) -> Iterator[tuple[int, bytes, bool]]:
    """Texts in pieces: number of the text, bytes, whether its end comes here."""
    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text)), PIECE):
            yield i, text[start : start + PIECE], start + PIECE >= len(text)


def blocks(texts: list[bytes], most: int = BLOCK) -> Iterator[tuple[np.ndarray, list[tuple[bytes, bool]]]]:
    """Groups of pieces of about so many bytes, with the number of each one's text."""
    rows, held, size = [], [], 0
    for i, part, last in pieces(texts):
        rows.append(i)
        held.append((part, last))
        size += len(part)
        if size >= most:
            yield np.array(rows), held
            rows, held, size = [], [], 0
    if rows:
        yield np.array(rows), held


def pair_counts(texts: list[bytes]) -> np.ndarray:
    """How often each symbol follows what chooses its code."""
    total = np.zeros(CODES * SYMBOLS, np.int64)
    for _, held in blocks(texts, SMALL_BLOCK):
        s = Stream(held)
        total += np.bincount(s.code() * SYMBOLS + s.symbol, minlength=len(total))
    return total


class Stream:
    """Symbols of a block of pieces and the bytes before each."""

    def __init__(self, held: list[tuple[bytes, bool]]):
        pad = b"\0" * PAD
        joined = b"".join(pad + part + (b"\0" if last else b"") for part, last in held)
        self.bytes = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(part) + last for part, last in held])
        starts = np.cumsum(sizes + PAD) - sizes
        self.sizes = sizes
        self.at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        self.symbol = self.bytes.take(self.at).astype(np.int32)
        ends = np.cumsum(sizes)[[last for _, last in held]] - 1
        self.symbol[ends] = END

    def before(self, n: int) -> np.ndarray:
        return self.bytes.take(self.at - n)

    def code(self) -> np.ndarray:
        """Which code each symbol is written in."""
        one, two = self.before(1), self.before(2)
        first, second = _PLACE.take(one), _PLACE.take(two)
        both = (first > 0) & (second > 0)
        return np.where(both, 256 + second * (len(COMMON) + 1) + first, one).astype(np.int64)

    def contexts(self) -> list[np.ndarray]:
        """A hash of each context but the code, per symbol."""
        h = self.before(1).astype(np.uint32)
        out = []
        for n in (2, 3, 4):
            h = h | (self.before(n).astype(np.uint32) << np.uint32(8 * (n - 1)))
            out.append((h * np.uint32(0x85EBCA6B)) ^ (h >> np.uint32(15)) * np.uint32(0xC2B2AE35))
        n = len(self.bytes)
        powers, inverses = _powers(n + 1)
        summed = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_HASH.take(self.bytes) * powers[:n])])
        breaks = np.where(_BREAK.take(self.bytes), np.arange(1, n + 1), 0)
        breaks = np.maximum.accumulate(breaks)
        here, start = summed.take(self.at), breaks.take(self.at - 1)
        word = (here - summed.take(start)) * inverses.take(start)
        # The break before the last one; a run of white space counts as words of no length.
        start = breaks.take(np.maximum(start - 2, 0))
        two = (here - summed.take(start)) * inverses.take(start)
        for x in (word, two + np.uint64(1)):
            mixed = (x ^ (x >> np.uint64(29))) * np.uint64(_MULTIPLIER)
            out.append((mixed >> np.uint64(32)).astype(np.uint32))
        return out


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 2 * (PIECE + BLOCK))
        _POWERS[:] = [
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, np.uint64(m), np.uint64))])
            for m in (_MULTIPLIER, _INVERSE)
        ]
    return _POWERS[0], _POWERS[1]


@dataclass
class Code:
    """Huffman codes, chosen by what is before: decisions as (node, bit)."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def _paths(row: np.ndarray, overall: np.ndarray) -> list[list[tuple[int, int]]]:
    """Decisions of each symbol, from the root."""
    # Rare symbols are told apart by how common they are altogether.
    weight = row.astype(float) + 1e-3 + 1e-6 * overall / max(1, overall.sum())
    heap = [(w, i) for i, w in enumerate(weight.tolist())]
    heapq.heapify(heap)
    parent = [0] * (2 * SYMBOLS - 1)
    for node in range(SYMBOLS, 2 * SYMBOLS - 1):
        low, left = heapq.heappop(heap)
        high, right = heap[0]
        parent[left], parent[right] = 2 * (node - SYMBOLS), 2 * (node - SYMBOLS) + 1
        heapq.heapreplace(heap, (low + high, node))
    # Nodes are numbered from the root, so that 0 is the first decision.
    found: list = [None] * (2 * SYMBOLS - 1)
    found[-1] = []
    for node in range(2 * SYMBOLS - 3, -1, -1):
        above, bit = divmod(parent[node], 2)
        found[node] = [*found[SYMBOLS + above], (SYMBOLS - 2 - above, bit)]
    return found[:SYMBOLS]


def huffman(counts: np.ndarray) -> Code:
    """Codes from pair counts; every symbol has one, however rare."""
    overall = counts.reshape(CODES, SYMBOLS).sum(0)
    known: dict[bytes, list] = {}
    paths: list[list[tuple[int, int]]] = []
    for row in counts.reshape(CODES, SYMBOLS):
        key = row.tobytes()
        if key not in known:
            known[key] = _paths(row, overall)
        paths += known[key]
    length = np.array([len(p) for p in paths])
    flat = np.array([x for p in paths for x in p], np.int16)
    return Code(
        (np.cumsum(length) - length).astype(np.int64),
        length,
        flat[:, 0].astype(np.uint8),
        flat[:, 1].astype(np.uint8),
    )


@dataclass
class Decisions:
    """The binary decisions of a block: slots per context, bits, their symbols."""

    slots: list[np.ndarray]
    bit: np.ndarray
    before: np.ndarray
    first: np.ndarray
    per_symbol: np.ndarray


def decisions(stream: Stream, code: Code) -> Decisions:
    before, chosen = stream.before(1), stream.code()
    pair = chosen * SYMBOLS + stream.symbol
    length = code.length.take(pair)
    ends = np.cumsum(length)
    # The symbol of each decision.
    of = np.repeat(np.arange(len(length)), length)
    entry = np.arange(len(of)) + (code.start.take(pair) - (ends - length)).take(of)
    node = code.node.take(entry)
    bytes_before = before.take(of)
    # Nodes of different codes have nothing in common.
    own = (chosen.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    salt = (own.take(of) + node) * np.uint32(0x01000193)
    slots = [((chosen << 8).take(of) | node).astype(np.intp, copy=False)]
    for hashed, bits in zip(stream.contexts(), BITS.values()):
        mixed = hashed.take(of)
        mixed ^= salt
        mixed *= np.uint32(0x2C1B3C6D)
        mixed >>= np.uint32(32 - bits)
        slots.append(mixed.astype(np.intp))
    return Decisions(slots, code.bit.take(entry), bytes_before, node == 0, length)


def empty_counts() -> list[np.ndarray]:
    """Per context, counts of zeros and ones side by side."""
    return [np.zeros(2 * n, np.uint32) for n in SLOTS]


def count(texts: list[bytes], code: Code, into: list[np.ndarray]) -> None:
    for _, held in blocks(texts, SMALL_BLOCK):
        d = decisions(Stream(held), code)
        bit = d.bit.astype(np.intp)
        for table, slot in zip(into, d.slots):
            slot <<= 1
            slot |= bit
            np.add.at(table, slot, np.uint32(1))


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Of a one, in steps; zero where nothing was counted."""
    zero, one = counts[::2].astype(np.float32), counts[1::2].astype(np.float32)
    return np.clip(np.rint(STEP * np.log((one + PRIOR) / (zero + PRIOR))), -127, 127).astype(np.int8)


@dataclass
class Mixer:
    """Weights per gate, and the adaptive map: ones and all, per byte before and bucket."""

    weights: np.ndarray
    ones: np.ndarray
    seen: np.ndarray

    @staticmethod
    def start() -> Mixer:
        weights = np.full((GATES, len(CONTEXTS)), 0.35 / STEP, np.float32)
        return Mixer(weights, np.zeros(256 * BUCKETS), np.zeros(256 * BUCKETS))

    def refined(self) -> np.ndarray:
        """Log-odds for each byte before and bucket; the bucket's own where little was seen."""
        centre = np.tile(1 / (1 + np.exp(-np.linspace(-RANGE, RANGE, BUCKETS))), 256)
        rate = (self.ones + 20 * centre) / (self.seen + 20)
        rate = np.clip(rate, 1e-6, 1 - 1e-6)
        return np.log(rate / (1 - rate)).astype(np.float32)


def inputs(d: Decisions, tables: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    x = [table.take(slot) for table, slot in zip(tables, d.slots)]
    gate = d.first * np.uint8(16)
    # The two shortest contexts are nearly always seen.
    for k, values in enumerate(x[2:]):
        gate += (values != 0) * np.uint8(1 << k)
    return x, gate.astype(np.intp)


def mixed(x: list[np.ndarray], gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    columns = np.ascontiguousarray(weights.T)
    total = columns[0].take(gate) * x[0]
    for column, values in zip(columns[1:], x[1:]):
        part = column.take(gate)
        part *= values
        total += part
    limit = np.float32(RANGE - 1e-3)
    return np.clip(total, -limit, limit, out=total)


def _buckets(logit: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = (logit + np.float32(RANGE)) * np.float32((BUCKETS - 1) / (2 * RANGE))
    low = place.astype(np.intp)
    return before.astype(np.intp) * BUCKETS + low, place - low.astype(np.float32)


def learn(texts: list[bytes], code: Code, tables: list[np.ndarray], mixer: Mixer) -> int:
    """Refine weights and map on the go; every stride is predicted before it is learned from."""
    learned = 0
    n = len(mixer.ones)
    for _, held in blocks(texts):
        d = decisions(Stream(held), code)
        x, gate = inputs(d, tables)
        for start in range(0, len(d.bit), STRIDE):
            part = slice(start, start + STRIDE)
            values, g, bit = [v[part].astype(np.float32) for v in x], gate[part], d.bit[part]
            logit = mixed(values, g, mixer.weights)
            p = 1 / (1 + np.exp(-logit))
            at, share = _buckets(logit, d.before[part])
            for where, w in ((at, 1 - share), (at + 1, share)):
                mixer.seen += np.bincount(where, w, n)
                mixer.ones += np.bincount(where, w * bit, n)
            error, spread = bit - p, p * (1 - p)
            for k, v in enumerate(values):
                slope = np.bincount(g, error * v, GATES)
                curve = np.bincount(g, spread * v * v, GATES)
                mixer.weights[:, k] += (RATE * slope / (curve + STEP * STEP * 20)).astype(np.float32)
        learned += len(d.bit)
    return learned


def score(texts: list[bytes], code: Code, tables: list[np.ndarray], weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """Log10 probability of each text with its end."""
    out = np.zeros(len(texts))
    for rows, held in blocks(texts, SMALL_BLOCK):
        stream = Stream(held)
        d = decisions(stream, code)
        x, gate = inputs(d, tables)
        logit = mixed(x, gate, weights)
        at, share = _buckets(logit, d.before)
        low = refined.take(at)
        logit += low + share * (refined.take(at + 1) - low)
        logit *= 0.5
        # log(1 + exp(-s)), s positive where the bit was as predicted.
        cost = np.log1p(np.exp(np.where(d.bit, -logit, logit)))
        ends = np.cumsum(d.per_symbol)[np.cumsum(stream.sizes) - 1] if len(rows) else []
        total = np.concatenate([[0.0], np.cumsum(cost, dtype=np.float64)])[ends]
        np.add.at(out, rows, -np.diff(total, prepend=0.0) / np.log(10))
    return out
