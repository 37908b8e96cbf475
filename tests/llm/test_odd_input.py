"""Columns of any name, repeated and null rows, long texts, empty tables: every operator and stage."""

from __future__ import annotations

import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bookloom.llm import (
    decontamination,
    licenses,
    line_dedup,
    lm_scoring,
    merkle,
    packing,
    phrases,
    pii,
    quality,
    search,
    simhash,
    substring_dedup,
    url_filter,
)
from bookloom.llm.word_hashes import edges, hashes

import numpy as np

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
# Names that operators use inside, and names of their results in other case.
NAMES = (
    "_row _doc _tag _lines _drop _pos _key _id _lost _text _url _gone _quality _at _h1 _h2 _base _more "
    "_fold _part _share _place _piece _group _words _label id tag term df bucket payload shard kind word "
    "N_WORDS N_Hit ITEMS hit_words Score RANK FP node HOST Rule verdict PATH n_LINES N_DROPPED N_removed "
    "start LENGTH ids piece_key SEQUENCE_ID offset Held_Out component_id leaf root labels N_BASE count"
).split()
LONG = "the quick brown fox jumps over the lazy dog, and then it swims across the river.\n" * 12_000
ROWS = [
    (1, "A first line of text\nand a second line of it", "http://www.example.com/en/a"),
    (2, "a first line of text\nbut another second one", "https://a.net/es/b?c"),
    (2, "a first line of text\nbut another second one", "https://a.net/es/b?c"),
    (3, None, None),
    (4, "", ""),
    (None, "a first line of text", "no scheme"),
    (None, None, None),
    (5, LONG, "http://b.com/" + "x" * 3000),
    (6, " \t\n ", "http://example.com/en/"),
]


def odd(spark, rows=ROWS):
    names = ", ".join(f"`{n}` string" for n in NAMES)
    filled = [(*r, "src", "en", 1, *NAMES) for r in rows]
    kinds = f"doc_id long, text string, url string, source string, lang string, n_chars long, {names}"
    return spark.createDataFrame(filled, kinds).repartition(3)


ITEMS = "item_id string, text string, n_hit string, _row string"


def items(spark):
    return spark.createDataFrame([("i", "a first line of text", "n", "r"), ("j", None, "", "")], ITEMS)


def untouched(frame, *changed):
    """Columns of the input that came back hold what they held."""
    gone = {c.lower() for c in changed}
    kept = [n for n in NAMES if n.lower() not in gone]
    assert set(kept) <= set(frame.columns), set(kept) - set(frame.columns)
    for row in frame.select(*[f"`{n}`" for n in kept]).collect():
        assert list(row) == kept


ADDING = {
    "lines": (lambda d, s: line_dedup.drop_repeated_lines(d), line_dedup.RESULTS),
    "spans": (lambda d, s: substring_dedup.drop_repeated_spans(d), substring_dedup.RESULTS),
    "items": (lambda d, s: decontamination.find_items(d, items(s)), tuple(decontamination.RESULTS)),
    "clean": (lambda d, s: decontamination.drop_contaminated(d, items(s)), ()),
    "near": (lambda d, s: simhash.drop_near_duplicates(d), ()),
    "urls": (
        lambda d, s: url_filter.filter_urls(d, [("allow", "com", "/"), ("block", "net", "/es/")]),
        ("host", "path", "rule", "verdict", "score"),
    ),
    "licenses": (lambda d, s: licenses.scan_licenses(d), licenses.RESULTS),
}


@pytest.mark.parametrize("name", ADDING)
def test_names_do_not_clash(spark, name):
    operator, results = ADDING[name]
    found = operator(odd(spark), spark)
    untouched(found, *results)
    rows = len(ROWS) - (2 if name == "clean" else 0)
    assert name == "near" or found.count() >= rows - 3
    assert operator(odd(spark).where("doc_id = -1"), spark).count() == 0


def test_contaminated_rows_go_and_others_stay_as_they_were(spark):
    docs = odd(spark)
    kept = decontamination.drop_contaminated(docs, items(spark))
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert kept.exceptAll(docs).isEmpty()
    assert sorted(r.doc_id for r in docs.exceptAll(kept).collect() if r.doc_id) == [1, 2, 2]


NARROW = {
    "pii": lambda d: pii.find_personal_data(d),
    "packing": lambda d: packing.pack_documents(d, TOKENIZER, keep_ids=False),
    "search": lambda d: search.search(d, d),
    "merkle": lambda d: merkle.build_manifest(d).proofs(),
    "phrases": lambda d: phrases.mine_phrases(d, threshold=3),
}


@pytest.mark.parametrize("name", NARROW)
def test_other_columns_play_no_part(spark, name):
    docs = odd(spark)
    plain = docs.select("doc_id", "text", "source", "lang", "n_chars")
    drop = {"packing": ["sequence_id", "offset"]}.get(name, [])
    one, two = (NARROW[name](d).drop(*drop) for d in (docs, plain))
    assert one.count() == two.count() > 0
    assert one.exceptAll(two).isEmpty()
    assert NARROW[name](docs.where("doc_id = -1")).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd(spark)
    if name != "packing":
        found = stage(spark, docs, sf_dir)
        assert found.columns == docs.columns and found.dtypes == docs.dtypes
        untouched(found)
        assert stage(spark, docs.where("doc_id = -1"), sf_dir).count() == 0
        if name == "lines":
            assert found.count() == docs.count()
            assert found.where("n_chars <> length(text)").isEmpty()
    else:
        found = stage(spark, docs, sf_dir)
        assert found.select("doc_id").distinct().count() == 7
        assert stage(spark, docs.where("doc_id = -1"), sf_dir).count() == 0


def test_quality_without_documents(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    model = quality.train(docs.where("false"), labels)
    assert 0 <= quality.score(docs, model).first()["score"] <= 1
    assert quality.score(docs.where("false"), model).count() == 0
    many = docs.unionByName(docs).unionByName(docs)
    assert quality.score(docs, quality.train(many, labels)).first()["score"] >= 0


def test_personal_data_takes_linear_time(spark):
    """Twice the addresses in a text take about twice the time, not four times."""

    def seconds(n):
        text = " ".join(f"user{i}@host{i}.com" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        found = pii.find_personal_data(docs).first()
        assert len(found["base"]) == n
        assert [(s["a"], s["b"]) for s in found["base"][:2]] == [(0, 15), (16, 31)]
        last = found["base"][-1]
        assert text[last["a"] : last["b"]] == f"user{n - 1}@host{n - 1}.com"
        return time.perf_counter() - start

    seconds(1000)
    small, large = seconds(8000), seconds(32000)
    assert large < 4 * small + 10


def thue_morse(n: int) -> tuple[str, str]:
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_long_words_of_one_polynomial_are_told_apart(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    for n in (1024, 4096):
        one, two = thue_morse(n)
        raw = np.frombuffer(f"{one} {two} {one}".encode(), np.uint8)
        found = hashes(raw, *edges(raw))
        assert found[0] == found[2] != found[1]
        text = f"{one} {two} x {one}"
        ids = np.frombuffer(packing.WordIds(TOKENIZER).of([text.encode()])[0], "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids
        docs = spark.createDataFrame([(1, f"{one} x"), (2, f"{two} y")], "doc_id long, text string")
        found = search.search(docs, docs.where("doc_id = 1")).collect()
        assert [r["doc_id"] for r in found] == [1]


def test_ids_do_not_depend_on_known_words(spark):
    texts = ["The quick brown fox", "Unseen wörds ÉTÉ été <|startoftext|> the", "quick " * 50]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    common = packing.common_words(docs, TOKENIZER)
    raw = np.frombuffer(b"quick the", np.uint8)
    assert all(h in common.hash for h in hashes(raw, *edges(raw)))
    for known in (None, common):
        words = packing.WordIds(TOKENIZER, known)
        plain = packing.WordIds(TOKENIZER)
        assert words.of([t.encode() for t in texts]) == plain.of([t.encode() for t in texts])
    assert packing.pieces(docs, TOKENIZER).count() == 6


def test_scores_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = [
        {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(docs.repartition(n)).collect()}
        for n in (1, 7)
    ]
    assert found[0] == pytest.approx(found[1], rel=1e-6)


def test_search_visits_blocks_until_the_bound(spark):
    """Scores of pruned shards equal those of plain sums over all documents."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    weight = 1 / np.arange(1, 401)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(5, 120), p=weight / weight.sum())) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in search.search(docs, docs.where("doc_id % 30 = 0"), k=7, shard_bytes=100_000).collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["doc_id"]))
    words = [t.split() for t in texts]
    mean = sum(map(len, words)) / len(words)
    sets = [set(w) for w in words]
    for q in range(0, 600, 30):
        scores = []
        for d, held in enumerate(words):
            total = 0.0
            for term in sets[q] & sets[d]:
                df = sum(term in s for s in sets)
                tf = held.count(term)
                total += np.log(1 + (600 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(held) / mean))
            if total:
                scores.append((-round(total, 6), d))
        want = sorted(scores)[:7]
        assert [d for _, d in sorted(got[q])] == [d for _, d in want]
        assert [s for s, _ in sorted(got[q])] == pytest.approx([s for s, _ in want], abs=2e-6)
