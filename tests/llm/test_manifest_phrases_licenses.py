"""Merkle manifest, phrase mining and license scan against plain versions, odd rows included."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bookloom.llm import licenses, merkle, phrases
from bookloom.llm.misra_gries import Summary, summed

# ---------------------------------------------------------------- Merkle manifest

CLASHES = "_i long, _t long, _d string, _GROUP string, _place int, leaf string, ROOT string"
ROWS = "doc_id long, source string, lang string, n_chars long, text string, " + CLASHES


def docs_of(spark, rows, parts=3):
    more = (1, 2, "a", "b", 3, "c", "d")
    return spark.createDataFrame([(*r, *more) for r in rows], ROWS).repartition(parts)


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    """All levels of a tree over hex digests, leaves first."""
    found = [nodes]
    while len(found[-1]) > 1:
        below = found[-1]
        found.append([h(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return found


def siblings(tree, at):
    found = []
    for level in tree[:-1]:
        first = at // 3 * 3
        run = range(first, min(first + 3, len(level)))
        found.append((at - first, [level[i] for i in run if i != at]))
        at //= 3
    return found


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof) of every row."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels([r[2] for r in sorted(groups[g], key=lambda r: r[:3])]) for g in order]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, (g, tree) in enumerate(zip(order, trees)):
        for at, row in enumerate(sorted(groups[g], key=lambda r: r[:3])):
            path = siblings(tree, at) + siblings(top, k)
            proof = h(*[s for _, run in path for s in run])
            out.append((row[3], row[2], tree[-1][0], top[-1][0], proof))
    return out


def key(row):
    return tuple((x is not None, x or 0) for x in row)


def manifest_rows(docs, **more):
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256")
    return [tuple(r[c] for c in columns) for r in merkle.build_manifest(docs, **more).proofs().collect()]


ODD = [
    (1, "a", "en", 5, "hello"),
    (2, "a", None, None, None),
    (3, None, "en", 0, ""),
    (None, "a", "en", 1, "x"),
    (None, None, None, None, None),
    (None, None, None, None, None),
    (4, "é", "fr", 3, "été\n"),
    (4, "é", "fr", 3, "été\n"),
    (4, "é", "fr", 3, "autre"),
    (5, "", "en", 2_000_000, "long " * 400_000),
    (6, "Z", "en", 1, "\U0001f600\n\n"),
    (7, "a", "en", 1, "one more"),
    (8, "a", "en", 1, "and one"),
]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_equals_plain_trees(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "LEAVES", 3**height)
    rows = ODD + [(100 + i, "hot" if i % 3 else f"s{i % 7}", "en", i, f"text {i}") for i in range(150)]
    assert sorted(manifest_rows(docs_of(spark, rows)), key=key) == sorted(plain_manifest(rows), key=key)


@pytest.mark.parametrize("rows", [ODD[:1], ODD[:2], [], [(i, f"s{i}", "", 0, "") for i in range(9)]])
def test_manifest_of_few_rows(spark, rows):
    assert sorted(manifest_rows(docs_of(spark, rows, 1)), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_finds_changed_rows(spark):
    rows = [(i, f"s{i % 3}", "en", 1, f"line {i}\nmore" if i % 2 else f"line {i}") for i in range(60)]
    docs = docs_of(spark, rows)
    copy = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [F.translate("text", "\n", "")]
    found = merkle.build_manifest(docs, claimed=copy).proofs().collect()
    assert {r["doc_id"] for r in found if not r["verified"]} == {i for i in range(60) if i % 2}
    for r in found:
        assert (r["folded_root"] == r["root"]) == r["verified"]
        path = bytes(r["proof"])
        assert merkle.fold(bytes.fromhex(r["leaf"]), path).hex() == r["root"]
        listed = "".join(s.hex() for _, run in merkle.steps(path) for s in run)
        assert sha256(listed.encode()).hexdigest() == r["proof_sha256"]


@pytest.mark.parametrize("n", range(1, 8))
def test_layout_keeps_half_height_subtrees_together(n):
    places = merkle.addresses(n)
    assert sorted(np.concatenate(places).tolist()) == list(range((3**n - 1) // 2))
    if n > 1:
        top = n // 2
        assert sorted(np.concatenate(places[:top]).tolist()) == list(range((3**top - 1) // 2))
        size = (3 ** (n - top) - 1) // 2
        for k in range(3**top):
            below = [places[top + d][k * 3**d : (k + 1) * 3**d] for d in range(n - top)]
            held = sorted(np.concatenate(below).tolist())
            assert held == list(range(held[0], held[0] + size))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60))
def test_subtree_paths_lead_to_its_root(n):
    digests = [sha256(bytes([i])).digest() for i in range(n)]
    subtree = merkle.Subtree(n, merkle.height_of(n))
    root = subtree.build(digests)
    assert root.hex() == levels([d.hex() for d in digests])[-1][0]
    again = merkle.Subtree(n, merkle.height_of(n), bytes(subtree.cells))
    assert all(merkle.fold(d, again.path(i)) == root for i, d in enumerate(digests))


# ---------------------------------------------------------------- Misra-Gries


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.lists(st.integers(0, 40), max_size=60), max_size=12),
    st.integers(2, 12),
    st.integers(1, 6),
    st.booleans(),
)
def test_summary_keeps_every_frequent_item(parts, threshold, capacity, merged):
    slack = threshold // 2
    whole = Summary(threshold, slack, capacity)
    pieces = [Summary(threshold, 0 if merged else slack, capacity)]
    for part in parts:
        keys, counts = np.unique(np.array(part, np.uint32), return_counts=True)
        whole.add(keys, counts)
        pieces.append(Summary(threshold, 0, capacity))
        pieces[-1].add(keys, counts)
    for piece in pieces:
        pieces[0].merge(piece) if piece is not pieces[0] else None
    truth = Counter(x for part in parts for x in part)
    frequent = {k for k, n in truth.items() if n >= threshold}
    for summary in (whole, pieces[0]):
        kept = set(summary.survivors().tolist())
        assert frequent <= kept
        assert summary.mass == sum(truth.values())
        assert summary.lost <= summary.slack < threshold
        assert not summary.slack or summary.capacity > summary.mass / summary.slack
        assert len(summary.counts) <= summary.capacity
        held = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
        for k, n in truth.items():
            assert held.get(k, 0) <= n <= held.get(k, 0) + summary.lost


def test_summed():
    keys, counts = summed(np.array([3, 1, 3], np.uint32), np.array([1, 2, 5]))
    assert keys.tolist() == [1, 3] and counts.tolist() == [2, 6]
    assert len(summed(np.zeros(0, np.uint32), np.zeros(0, np.int64))[0]) == 0


# ---------------------------------------------------------------- phrases

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_phrases(rows, threshold=30, best=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        kept = []
        for p, a in candidates.items():
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = [
                b for q, b in candidates.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            ]
            if not any(100 * b >= 80 * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


PHRASE_ROWS = [
    ("the Cat sat on the mat. the cat sat", "en"),
    (None, "en"),
    ("", None),
    (" \t\n..;", None),
    ("no language here; no language here", None),
    ("a a a a a a a", "en"),
    ("Été chaud vif, été chaud vif", "fr"),
    ("x\x00y z\x1cw " * 3, ""),
    ("word " * 3000, "de"),
    ("one,two!three?four;five:six\vseven\feight\rnine ten", "en"),
    ("the cat sat on the mat", "EN"),
]


def phrase_frame(spark, rows, parts=3):
    more = "phrase string, `lang_` int, size int, A string, score string, rank string, _words string"
    extra = ("p", 1, 2, "a", "s", "r", "w")
    return spark.createDataFrame(
        [(*r, *extra) for r in rows], "text string, lang string, " + more
    ).repartition(parts)


def mined(frame, **more):
    return sorted(tuple(r) for r in phrases.mine_phrases(frame, **more).collect())


@pytest.mark.parametrize("threshold", [1, 3, 30])
@pytest.mark.parametrize("small", [False, True])
def test_phrases_equal_plain_counts(spark, monkeypatch, threshold, small):
    if small:
        monkeypatch.setattr(phrases, "BLOCK_BYTES", 64)
        monkeypatch.setattr(phrases.blocks, "__defaults__", (64,))
        monkeypatch.setattr(phrases, "PARTITION_BYTES", 1 << 12)
        monkeypatch.setattr(phrases, "CAPACITY", 4)
        monkeypatch.setattr(phrases, "MOST_WORDS", 20)
    rows = PHRASE_ROWS * 7
    assert mined(phrase_frame(spark, rows), threshold=threshold) == plain_phrases(rows, threshold)


def test_phrases_of_nothing(spark):
    assert mined(phrase_frame(spark, [], 1)) == []
    assert mined(phrase_frame(spark, [(None, None), ("", "en")], 1)) == []


def test_best_phrases_of_each_language(spark):
    rows = [(f"w{i} v{i} " * 3 + ".", "en" if i % 2 else "de") for i in range(60)] * 2
    assert mined(phrase_frame(spark, rows), threshold=3, best=7) == plain_phrases(rows, 3, 7)


def test_scores_pass_64_bits(spark):
    big = 2**61
    frame = spark.createDataFrame([(big, big, big + 2)], "a long, l long, r long")
    assert frame.select(phrases.score("a", "l", "r")).first()[0] == 2_000_000 * big // (2 * big + 2)


def test_survivors_hold_all_frequent_keys(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").limit(50)
    found = phrases.survivors(texts, 4, 10, 2).collect()
    assert {r["part"] for r in found} == {0, 1, 2, 3}
    for r in found:
        assert r["lost"] < 10 and r["capacity"] > r["mass"] / 3
        assert len(r["keys"]) // 4 <= r["capacity"]


# ---------------------------------------------------------------- licenses

MIT = licenses.TEMPLATES[5][1]
LICENSE_ROWS = [
    (1, "Licensed under CC BY-NC 4.0. Also CC-BY, cc by!"),
    (2, None),
    (3, ""),
    (4, " .,;\x00\x7f\n"),
    (5, "Released under the\nMIT License"),
    (6, "All rights\treserved. ALL RIGHTS RESERVED all rights"),
    (7, "Été general public licenseé general public license"),
    (8, f"{'word ' * 300}{MIT}{' tail' * 40}"),
    (8, f"{'word ' * 300}{MIT}{' tail' * 40}"),
    (9, MIT.replace("Permission is", "Leave was").replace("modify", "change")),
    (10, " ".join(MIT.split()[:20])),
    (None, "Licensed under the Apache License, Version 2.0"),
    (11, "license the under " + "x " * 40 + "released mit"),
    (12, "y " * 200_000 + "licensed under the apache license version 2 0"),
    (13, "cc"),
    (14, "by cc by"),
]


def plain_licenses(rows, share=licenses.SHARE):
    templates = licenses.prepared(licenses.TEMPLATES, {}, share)
    out = []
    for doc, text in rows:
        words = licenses.template_words(text or "")
        places, named, best = [], set(), 0.0
        for label, phrase in licenses.PHRASES:
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            named |= {label} if at else set()
        labels = set(named)
        for t in templates:
            m = t.size_class
            for start in range(0, len(words), m):
                shared = len(set(words[start : start + 2 * m]) & set(t.words))
                if shared >= t.needed:
                    labels.add(t.label)
                    best = max(best, shared / len(t.words))
        score = 1.0 if places else best
        edges = (min(places), max(places)) if places else (None, None)
        out.append((doc, len(words), len(places), *edges, ",".join(sorted(named)), ",".join(sorted(labels)), score))
    return sorted(out, key=key)


def license_frame(spark, rows, parts=3):
    more = "N_WORDS string, labels int, _row string, _h1 string, _words int, word string, size string, _part string"
    extra = ("n", 1, "r", "h", 2, "w", "s", "p")
    return spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, " + more).repartition(parts)


def scanned(frame, **more):
    found = licenses.scan_licenses(frame, **more)
    assert set(found.columns) == (set(frame.columns) - {"N_WORDS", "labels"}) | set(licenses.RESULTS)
    rows = found.select("doc_id", *licenses.RESULTS).collect()
    return sorted([tuple(r) for r in rows], key=key)


@pytest.mark.parametrize("share", [60, 90, 100])
def test_licenses_equal_brute_force(spark, share):
    assert scanned(license_frame(spark, LICENSE_ROWS), share=share) == plain_licenses(LICENSE_ROWS, share)


def test_licenses_of_copies_and_nothing(spark):
    rows = [(i % 3, MIT) for i in range(90)] + [(7, "nothing to see here")] * 5
    assert scanned(license_frame(spark, rows)) == plain_licenses(rows)
    assert scanned(license_frame(spark, [], 1)) == []


def test_prefix_reaches_every_large_share():
    counts = {"license": 50, "the": 900, "mit": 3}
    for t in licenses.prepared(licenses.TEMPLATES, counts, 90):
        assert len(t.words) - len(t.prefix) + 1 == t.needed
        ranks = [(counts.get(w, 0), w) for w in t.words]
        assert ranks == sorted(ranks)
        assert 2 * t.size_class >= 2 * len(t.words)


def test_templates_must_have_words_and_a_bound(spark):
    frame = license_frame(spark, LICENSE_ROWS[:1], 1)
    with pytest.raises(ValueError):
        licenses.scan_licenses(frame, templates=[("none", ".,;")])
    assert scanned(frame, templates=[])[0][5:7] == ("cc-by", "cc-by")
