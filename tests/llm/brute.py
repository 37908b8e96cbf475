"""Plain versions of what the operators return, row by row."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

SPACE = r"[^\x20\x09-\x0D]+"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return re.findall(SPACE, text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(rows):
    keys = defaultdict(set)

    def key(line):
        return lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))

    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                keys[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [
            x
            for x in lines
            if doc is None or len(key(x)) < 10 or len(keys[key(x)]) < 2 or min(keys[key(x)]) == doc
        ]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def spans(rows, window=13):
    first = {}
    for doc, text in rows:
        if doc is not None:
            w = words(text)
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if doc is not None else ():
            if first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def fingerprint(text):
    w = words(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(prints, most=4):
    """Smallest id reachable, for (id, fingerprint) rows."""
    label = [doc for doc, _ in prints]
    while True:
        new = [
            min(l for (other, f), l in zip(prints, label) if (f ^ fp).bit_count() <= most or other == doc)
            for (doc, fp) in prints
        ]
        if new == label:
            return label
        label = new


def contamination(rows, items, window=13):
    def norm(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))

    windows = defaultdict(set)
    for item, text in items:
        w = norm(text)
        for i in range(max(1, len(w) - window + 1) if w and item is not None else 0):
            windows[tuple(w[i : i + window])].add(str(item))
    out = []
    for doc, text in rows:
        w = norm(text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i : i + n]))
                if ids:
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def personal(text):
    out = []
    patterns = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    for kind, pattern in patterns:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                values = [int(d) for d in digits[::-1]]
                total = sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def base_scores(rows, held_out):
    tokens = [(doc, [*words(lower(text or "")), None]) for doc, text in rows]
    counts = Counter(w for doc, ws in tokens if not held_out(doc) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [
        (doc, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        for doc, ws in tokens
    ]


def bm25(rows, queries, k):
    docs = [(d, Counter(words(lower(t or "")))) for d, t in rows if d is not None]
    mean = sum(sum(c.values()) for _, c in docs) / max(1, len(docs))
    df = Counter(w for _, c in docs for w in c)
    out = {}
    for q, text in queries:
        scored = []
        for d, c in docs:
            length = sum(c.values())
            s = sum(
                math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / mean))
                for w in set(words(lower(text or "")))
                if w in c
            )
            if s > 0:
                scored.append((-round(s, 4), d))
        out[q] = sorted(scored)[:k]
    return out
