"""Operators against plain versions, on rows that hold every odd case."""

from __future__ import annotations

import sys
import zlib
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

from bookloom.llm import (  # noqa: E402
    decontamination,
    line_dedup,
    lm_scoring,
    packing,
    pii,
    quality,
    search,
    simhash,
    substring_dedup,
    url_filter,
)

SEA = "the quick brown fox jumps over the lazy dog and then swims across a wide cold river home"
EXTRA = ", n_lines string, n_words string, key string, pos int, score string, fp string, items string, _x int"
KINDS = "doc_id long, text string" + EXTRA

TEXTS = [
    (1, f"{SEA}\nA shared line of text\nunique one here"),
    (2, f"  a SHARED line of TEXT \r\n{SEA} again and again\nshort\nshort"),
    (3, f"{SEA}\nA shared line of text\nunique one here"),
    (4, None),
    (5, ""),
    (6, " \n\t\n"),
    (7, "\u00c9t\u00e9 " + "mot " * 30 + "\n\u00c9T\u00c9 a shared line of text \U0001f600"),
    (8, SEA.upper()),
    (9, "one two"),
    (10, "one two"),
    (10, "one two"),
    (None, f"{SEA}\nA shared line of text"),
    (12, "word " * 20000 + SEA),
    (13, "x" * 50000),
    (14, f"start {SEA} middle {SEA} end"),
    (15, f"{SEA.replace('lazy', 'sleepy')} of mine"),
    (16, f"before it all {SEA.split(' over ')[1]} and further on"),
    (11, f"begin with other words then {' '.join(SEA.split()[2:15])} stop"),
]


def frame(spark, rows, parts=3):
    more = ("a", "b", "c", 1, "d", "e", "f", 2)
    return spark.createDataFrame([(*r, *more) for r in rows], KINDS).repartition(parts)


def rows_of(result, *columns):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r[c] for c in columns) for r in result.collect()), key=key)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_line_dedup(spark):
    found = line_dedup.drop_repeated_lines(frame(spark, TEXTS))
    assert set(found.columns) == {"doc_id", "text", "n_lines", "n_dropped", "n_words", "key", "pos", "score", "fp", "items", "_x"}
    assert rows_of(found, "doc_id", "n_lines", "n_dropped", "text") == ordered(brute.line_dedup(TEXTS))


def test_line_dedup_with_higher_threshold(spark):
    found = line_dedup.drop_repeated_lines(frame(spark, TEXTS), min_docs=5)
    assert {r["n_dropped"] for r in found.collect()} == {0}


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "HOT_IN_BLOCK", 1)
    found = substring_dedup.drop_repeated_spans(frame(spark, TEXTS))
    assert rows_of(found, "doc_id", "n_words", "n_removed", "text") == ordered(brute.spans(TEXTS))


def test_simhash(spark):
    found = simhash.near_duplicates(frame(spark, TEXTS))
    known = [(d, brute.fingerprint(t)) for d, t in TEXTS if d is not None]
    want = [(d, f, c) for (d, f), c in zip(known, brute.reach(known))]
    want += [(None, brute.fingerprint(t), None) for d, t in TEXTS if d is None]
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found.collect()]
    assert ordered(got) == ordered(want)


def test_simhash_finds_every_link_in_crowded_keys(spark, monkeypatch):
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(1))
    centres = rng.integers(0, 2**63, 8, dtype=np.uint64)
    prints = set()
    while len(prints) < 500:
        f = int(centres[rng.integers(8)])
        for b in rng.integers(0, 64, rng.integers(0, 8)).tolist():
            f ^= 1 << b
        prints.add(f)
    rows = list(enumerate(sorted(prints)))
    signed = [(f - 2**64 if f >> 63 else f, i) for i, f in rows]
    keyed = simhash.keyed(spark.createDataFrame(signed, "fp long, node long"))
    met = simhash.buckets(keyed, size=20)
    from bookloom.llm.components import components

    root = {r["node"]: r["root"] for r in components(met.mapInArrow(simhash._links(4), "a long, b long")).collect()}
    assert [root.get(i, i) for i, _ in rows] == brute.reach(rows)


def test_near_duplicates_leave_one(spark):
    kept = simhash.drop_near_duplicates(frame(spark, TEXTS))
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 3 not in ids and None in ids and 4 in ids and 5 not in ids


ITEMS = [(1, SEA), (2, "One, TWO!"), (3, None), (4, "..."), (None, "mot mot"), (10, SEA + " tail words"), (2, "One, TWO!")]


@pytest.mark.parametrize("size", [1 << 20, 10])
def test_decontamination(spark, size):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontamination.find_items(frame(spark, TEXTS), items, max_item_bytes=size)
    assert rows_of(found, "doc_id", "n_words", "n_hit", "items") == ordered(brute.contamination(TEXTS, ITEMS))
    for r in found.collect():
        chars, words = r["hit_chars"], r["hit_words"]
        plain = brute.re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(r["text"] or ""))
        for a, b, x, y in zip(chars[::2], chars[1::2], words[::2], words[1::2]):
            inside = brute.re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(r["text"][a:b]))
            assert inside == plain[x:y]


def test_decontamination_without_items(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    found = decontamination.find_items(frame(spark, TEXTS), items)
    assert {r["n_hit"] for r in found.collect()} == {0}


PATH = public_tokenizers.path("word_bpe_49k.json")


def test_mixing_backs_off_to_one_and_two_bytes():
    import numpy as np

    from bookloom.llm import mixing_model as M

    seen = [b"KA7 " * 50]
    code = M.huffman(M.pair_counts(seen))
    counts = M.empty_counts()
    M.count(seen, code, counts)
    tables = [M.log_odds(x) for x in counts]
    for text in (b"%A7", b"%%KA7"):
        d = M.decisions(M.Stream([(text, True)]), code)
        x, gate = M.inputs(d, tables)
        logit = M.mixed([v.astype(np.float32) for v in x], gate, M.Mixer.start().weights)
        ends = np.cumsum(d.per_symbol)
        last = slice(ends[-3], ends[-2])
        assert (np.where(d.bit[last], logit[last], -logit[last]) > 0.5).all()


def test_packing_round_trip(spark):
    import numpy as np
    from tokenizers import Tokenizer

    special = [(20, "a <|endoftext|> b <|ENDOFTEXT|>"), (21, "it's we'll\u00a0x. \u0130. '' \x01 q\x01")]
    rows = [*TEXTS, *special]
    found = packing.pack_documents(frame(spark, rows), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    pieces = {}
    sequences = {}
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert want[r["doc_id"]][r["start"] : r["start"] + r["length"]] == ids
        assert r["doc_tokens"] == len(want[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, ids in want.items():
        copies = sum(d == doc for d, _ in rows)
        assert sum(n for _, n in pieces[doc]) == copies * len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_packing_keeps_case_where_letters_compose(spark):
    import numpy as np
    from tokenizers import Tokenizer

    pairs = ["H\u0331", "J\u030c", "T\u0308", "W\u030a", "Y\u030a"]
    rows = [(i, f"{p}arb and {p} THEN x{p.lower()}X {p}") for i, p in enumerate(pairs)]
    rows.append((9, " ".join([*pairs, "H", "\u0331", "\u00c9T\u00c9 A\u00c9"])))
    tokenizer = Tokenizer.from_file(PATH)
    found = packing.pack_documents(frame(spark, rows), PATH).collect()
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in found}
    assert got == {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for d, t in rows}


def test_first_fit_is_the_first_that_fits():
    import random

    random.seed(2)
    lengths = sorted((random.randint(1, 100) for _ in range(300)), reverse=True)
    bins, offsets = packing.first_fit(lengths, 100)
    used = []
    for n, b, o in zip(lengths, bins, offsets):
        first = next((i for i, u in enumerate(used) if u + n <= 100), len(used))
        if first == len(used):
            used.append(0)
        assert (b, o) == (first, used[first])
        used[first] += n


def test_personal_data(spark):
    rows = [
        (1, "a.b@c.d.e._foo@bar.com x@y..z q@r.s@t.u 1.2.3.4.5.6.7.8 300.1.1.1 +1 (555) 555-1234+12 ++123 45678901"),
        (2, None),
        (3, ""),
        (4, "\u00e9\U0001f600 me@x.org 4111 1111-1111 1111 and 4111111111111112, " + "9" * 30000),
        (5, "a." * 20000 + "a@b.c " + "x@" + "y." * 20000 + "z"),
        (None, "+49 30 1234567 john [at] mail [dot] com"),
        (7, "\ue000 a\ue000b@c.de 1\ue0002 4111\ue0001111 0000000000000 1.2.3.0000255 1.2.3.99999999999999999999"),
        (7, "4111 1111 1111 1111 4111111111111111 10.0.0.1"),
        (7, "4111 1111 1111 1111 4111111111111111 10.0.0.1"),
    ]
    docs = frame(spark, rows)
    found = pii.find_personal_data(docs).select("doc_id", pii.as_text("base").alias("b"), pii.as_text("spans").alias("s"))
    assert rows_of(found, "doc_id", "b") == ordered([(d, brute.personal(t)) for d, t in rows])
    for r in found.collect():
        assert set(r["b"].split(",")) <= set(r["s"].split(","))


def test_personal_data_adds_likely_spans(spark):
    rows = [(i, f"mail me: a{i}@mail.com or call +1 (555) 555-{1000 + i} from 10.1.2.{i}") for i in range(40)]
    rows += [(100, "contact john [at] mail [dot] com today"), (101, "order 2669109448945251 of version 1.2.3")]
    found = pii.find_personal_data(frame(spark, rows)).select("doc_id", pii.as_text("spans").alias("s"))
    spans = {r["doc_id"]: r["s"] for r in found.collect()}
    assert spans[100] == "email:8:32"
    assert spans[101] == ""


def test_url_filter(spark):
    rules = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"))
    urls = [f"http://good{i % 7}.com/nice/{i}" for i in range(60)] + [f"http://bad{i % 5}.net/es/casino-{i}" for i in range(60)]
    odd = [
        ("https://WWW.Example.com/en/x?q", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("x://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("http://example.com", "example.com", "", None, None),
        ("http://xcom/", "xcom", "/", None, None),
        ("no scheme.com/", "", "", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
        ("http://h.org/a#b/c?d", "h.org", "/a", None, None),
        ("http://u.org/es/casino-x", "u.org", "/es/casino-x", None, "block"),
        ("http://good3.org/nice/", "good3.org", "/nice/", None, None),
        ("http://\u00e9.com/" + "p" * 5000, "\u00e9.com", "/" + "p" * 5000, "com/", "allow"),
    ]
    rows = [(u, "x", i) for i, u in enumerate([*urls, *[o[0] for o in odd], odd[0][0]])]
    pages = spark.createDataFrame(rows, "url string, rule string, score int").repartition(3)
    found = url_filter.filter_urls(pages, rules)
    assert found.count() == len(rows)
    by_url = {r["url"]: r for r in found.collect()}
    for url, host, path, rule, verdict in odd:
        r = by_url[url]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block")
        if verdict:
            assert r["verdict"] == verdict, url
    assert by_url["http://good3.org/nice/"]["score"] > by_url["http://u.org/es/casino-x"]["score"]
    assert by_url[urls[0]]["score"] > 0 > by_url[urls[-1]]["score"]


def test_lm_scores(spark):
    rows = [(i, f"{SEA} number {i}") for i in range(60)] + TEXTS
    held_out = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    found = lm_scoring.score_documents(frame(spark, rows)).collect()
    want = ordered([(d, n, k, t, round(b, 6)) for d, n, k, t, b in brute.base_scores(rows, held_out)])
    got = ordered([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found])
    assert got == want
    assert all(r["held_out"] == held_out(r["doc_id"]) and r["score"] < 0 for r in found)


def test_mixing_model_is_a_distribution():
    """Probabilities of all symbols after a prefix add up to one."""
    import numpy as np

    from bookloom.llm import mixing_model as M

    texts = [f"{SEA} {i}".encode() for i in range(30)]
    code = M.huffman(M.pair_counts(texts))
    counts = M.empty_counts()
    M.count(texts[:20], code, counts)
    tables = [M.log_odds(c) for c in counts]
    mixer = M.Mixer.start()
    M.learn(texts[20:], code, tables, mixer)
    refined = mixer.refined()

    def cost(ends):
        return M.score(ends, code, tables, mixer.weights, refined)

    # A text's cost is that of its prefix's bytes and of its end.
    prefix = b"the quick br"
    next_bytes = [prefix + bytes([b]) for b in range(256)]
    decisions = [M.decisions(M.Stream([(x, False)]), code) for x in [prefix, *next_bytes]]
    total = 0.0
    base = None
    for d in decisions:
        x, gate = M.inputs(d, tables)
        logit = M.mixed(x, gate, mixer.weights)
        at, share = M._buckets(logit, d.before)
        logit = 0.5 * (logit + refined[at] + share * (refined[at + 1] - refined[at]))
        log_p = -np.log1p(np.exp(np.where(d.bit, -logit, logit))).sum()
        if base is None:
            base = log_p
        else:
            total += np.exp(log_p - base)
    ended = 10 ** cost([prefix])[0] / np.exp(base)
    assert abs(total + ended - 1) < 1e-3


def test_search(spark):
    rows = [(i, f"{SEA} {'fox ' * (i % 4)} n{i} n{i % 3}") for i in range(60)] + TEXTS
    docs = frame(spark, rows)
    found = search.search(docs, docs.where(F.col("doc_id") % 4 == 0), k=5, shard_bytes=2000)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -round(r["score"], 4), r["doc_id"]))
    distinct = list(dict.fromkeys((d, t) for d, t in rows if d is not None and d % 4 == 0))
    single = [q for q in distinct if sum(d == q[0] for d, _ in distinct) == 1]
    want = brute.bm25(rows, single, 5)
    for q, best in want.items():
        mine = sorted(got.get(q, []))
        assert [s for _, s, _ in mine] == pytest.approx([s for s, _ in best], abs=2e-3)
        scores = [s for s, _ in best]
        if len(set(scores)) == len(scores):
            assert [d for _, _, d in mine] == [d for _, d in best]


def test_search_scores_do_not_depend_on_the_shard(spark):
    import random

    random.seed(5)
    common = [f"w{i}" for i in range(900)]

    def text(n):
        return " ".join(random.choices(common, weights=range(900, 0, -1), k=n))

    copied = text(300)
    rows = [(i, copied if i % 7 == 3 else text(random.randint(20, 400))) for i in range(700)]
    docs = frame(spark, rows)
    asked = frame(spark, [(3, copied), (9000, text(300)), (9001, f"{copied} {text(200)}")])
    got = {}
    for r in search.search(docs, asked, k=40, shard_bytes=60_000).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["doc_id"]))
    copies = [i for i, t in rows if t == copied]
    for q in (3, 9001):
        best = sorted(got[q])
        assert [d for _, _, d in best] == copies[:40]
        assert len({s for _, s, _ in best}) == 1
    one = search.search(docs, asked, k=40).collect()
    assert {(r["query_id"], r["rank"], r["score"], r["doc_id"]) for r in one} == {
        (q, *x) for q, found in got.items() for x in found
    }


def test_quality(spark):
    good = [(i, f"{SEA}. It goes on, calmly, for {i} days.") for i in range(80)]
    bad = [(1000 + i, "BUY!! NOW!! | " * (5 + i % 7)) for i in range(80)]
    docs = frame(spark, [*good, *bad, *TEXTS])
    labels = spark.createDataFrame(
        [(i, 1) for i, _ in good[::2]] + [(i, 0) for i, _ in bad[::2]] + [(None, 1), (5000, 0), (1, None)],
        "doc_id long, quality int",
    )
    model = quality.train(docs, labels)
    found = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all(found[i] > 0.7 for i, _ in good) and all(found[i] < 0.3 for i, _ in bad if i >= 1000)
    assert all(0 <= s <= 1 for s in found.values())


def test_quality_without_labels(spark):
    docs = frame(spark, TEXTS)
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(docs, model).collect()} == {0.5}


def test_trees_split_where_classes_part():
    import numpy as np

    from bookloom.llm.boosted_trees import fit

    x = np.random.Generator(np.random.PCG64(4)).random((2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0.6)).astype(float)
    p = fit(x, y).probability(x)
    assert ((p > 0.5) == y).mean() > 0.97


EMPTY = {
    "line_dedup": line_dedup.drop_repeated_lines,
    "spans": substring_dedup.drop_repeated_spans,
    "simhash": simhash.near_duplicates,
    "near_duplicates": simhash.drop_near_duplicates,
    "packing": lambda d: packing.pack_documents(d, PATH),
    "pii": pii.find_personal_data,
    "lm": lm_scoring.score_documents,
    "search": lambda d: search.search(d, d),
    "url": lambda d: url_filter.filter_urls(d, (("allow", "com", "/"),), url="text"),
}


@pytest.mark.parametrize("name", list(EMPTY))
def test_empty_table(spark, name):
    assert EMPTY[name](frame(spark, [], 1)).collect() == []


def test_empty_items_table(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_items(frame(spark, [], 1), items).collect() == []


def test_search_carries_the_kth_into_the_next_round(spark):
    """Shards of later rounds give only what ranks before the k-th so far; copies are ranked each."""
    import random
    from collections import Counter

    random.seed(6)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(random.choices(words, k=40))) for i in range(400)]
    rows += [(1000, rows[0][1])] * 25 + [(1001 + i, rows[20][1]) for i in range(30)]
    docs = frame(spark, rows)
    asked = docs.where("doc_id < 200 AND doc_id % 20 = 0")
    shards = -(-sum(len(t) for _, t in rows) // 3000)
    made = []
    kept = search.stored

    def watched(found, name):
        out = kept(found, name)
        if name == "bm25-found":
            made.append(out.count())
        return out

    search.stored = watched
    try:
        found = search.search(docs, asked, k=10, shard_bytes=3000).collect()
    finally:
        search.stored = kept
    assert shards > 20 and len(made) == 4
    # A round's rows and the best before them, cut at k: never k rows for each shard.
    assert made[-1] == 100
    want = search.search(docs, asked, k=10).collect()
    assert Counter(found) == Counter(want)
    assert [r["doc_id"] for r in found if r["query_id"] == 0].count(1000) == 9


def test_search_gives_only_what_ranks_before_the_kth():
    import numpy as np
    import pyarrow as pa

    ids = pa.array(range(50), pa.int64())
    texts = pa.array([f"a b{i % 5} c{i}" for i in range(50)])
    docs = pa.RecordBatch.from_arrays([ids, texts, pa.array([0] * 50, pa.int32())], names=["id", "text", "shard"])
    sent = [p for b in search._pack_docs(10)(iter([docs])) for p in b.column("payload").to_pylist()]
    shard = search.Shard(sent, 3.0)
    query, at = np.zeros(len(shard.terms), np.int64), np.arange(len(shard.terms))
    weight = np.ones(len(at))
    _, first, scores = shard.best(query, at, weight, 10, np.zeros(1), np.zeros(1, np.int64))
    assert len(first) == 10
    _, rest, _ = shard.best(query, at, weight, 10, scores[4:5], first[4:5])
    assert rest.tolist() == first[:4].tolist()


def test_mixing_counts_and_scores_do_not_depend_on_the_blocks(monkeypatch):
    import numpy as np

    from bookloom.llm import mixing_model as M

    texts = [f"{SEA} {i} \x00 {'é' * (i % 5)}\n".encode() * (i % 40) for i in range(60)]
    found = []
    for size in (1 << 10, M.SMALL_BLOCK, M.BLOCK):
        monkeypatch.setattr(M, "SMALL_BLOCK", size)
        code = M.huffman(M.pair_counts(texts))
        counts = M.empty_counts()
        M.count(texts[:40], code, counts)
        tables = [M.log_odds(c) for c in counts]
        mixer = M.Mixer.start()
        found.append((counts, M.score(texts, code, tables, mixer.weights, mixer.refined())))
    for counts, scores in found[1:]:
        assert all((a == b).all() for a, b in zip(counts, found[0][0]))
        assert np.allclose(scores, found[0][1], rtol=1e-9, atol=0)


def test_mixing_part_is_counted_by_fewer_tasks(spark, monkeypatch):
    """A task sends whole tables, so the smaller part is not dealt to as many tasks as the larger."""
    import re

    docs = spark.range(0, 64, 1, 16).selectExpr("id AS doc_id", f"concat('{SEA} ', id) AS text")
    sent = []
    kept = lm_scoring.stored

    def watched(found, name):
        if name == "lm-tables":
            plan = found._jdf.queryExecution().executedPlan().toString()
            sent.extend(re.findall(r"Coalesce (\d+)", plan))
        return kept(found, name)

    monkeypatch.setattr(lm_scoring, "stored", watched)
    assert lm_scoring.score_documents(docs).count() == 64
    assert sent == ["4"]
