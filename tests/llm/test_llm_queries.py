"""The registered queries on the smallest tables, and the pipeline's stages."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from compare import differences, kinds  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402
import corpus_pipeline  # noqa: E402
from bookloom.llm import oracle as sql  # noqa: E402
from bookloom.llm import queries  # noqa: E402

QUERIES = queries.queries()


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", list(sql.all_sql()))
def test_oracle(name, spark, sf_dir, oracle):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), oracle.sql(sql.all_sql()[name]).df()
    for frame in (ours, theirs):
        for c in {"first_word", "last_word"} & set(frame.columns):
            frame[c] = frame[c].astype("Int64")
    assert differences(ours, theirs) is None
    assert kinds(ours) == kinds(theirs)


def _rows(spark, sf_dir, name="documents"):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]


def test_queries_against_plain_versions(spark, sf_dir):
    docs = _rows(spark, sf_dir)
    found = {r["doc_id"]: r for r in QUERIES["op3_substring_dedup"](spark, sf_dir).collect()}
    for doc, n, gone, kept in brute.spans(docs):
        assert tuple(found[doc])[1:] == (n, gone, brute.sha(kept))
    found = {r["doc_id"]: r for r in QUERIES["op4_pii"](spark, sf_dir).collect()}
    for doc, text in docs:
        assert found[doc]["base_sha256"] == brute.sha(brute.personal(text))
    found = {r["doc_id"]: r for r in QUERIES["op8_decontamination"](spark, sf_dir).collect()}
    for doc, n, hit, items in brute.contamination(docs, _rows(spark, sf_dir, "benchmark")):
        want = (n, hit, len(items), brute.sha(",".join(items)), hit > 0 and 20 * hit >= n)
        assert tuple(found[doc])[1:] == want
    found = {r["doc_id"]: r for r in QUERIES["op9_simhash"](spark, sf_dir).collect()}
    prints = [(d, brute.fingerprint(t)) for d, t in docs]
    for (doc, fp), root in zip(prints, brute.reach(prints)):
        assert tuple(found[doc])[1:] == (f"{fp:016x}", root)


def test_quality_tells_held_out_labels(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op6_quality"](spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) / len(rows) > 0.95


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "benchmark", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        before = docs
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if names[k] == "lines":
            assert kept == {d: t for d, _, _, t in brute.line_dedup(rows)}
        elif names[k] == "near_duplicates":
            prints = [(d, brute.fingerprint(t)) for d, t in rows]
            assert kept == {d: t for (d, t), root in zip(rows, brute.reach(prints)) if root == d}
        elif names[k] == "benchmark":
            hits = brute.contamination(rows, _rows(spark, sf_dir, "benchmark"))
            assert set(kept) == {d for d, n, hit, _ in hits if not (hit and 20 * hit >= n)}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(kept)


def test_pipeline_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
