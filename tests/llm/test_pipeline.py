"""The pipeline's stages by brute force on a small corpus."""

from __future__ import annotations

import importlib

import pytest

from tests.conftest import DATA
from tests.llm.test_llm import brute_components, brute_leaks, words

corpus_pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    out.append(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        place = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, DATA).write.parquet(place)
        docs = spark.read.parquet(place)
        out.append(docs)
    return out


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_quality_keeps_the_good_and_drops_the_bad(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    good = {i for i, q in labels.items() if q == 1}
    assert len(good & kept) >= 0.98 * len(good)  # drawn, not cut off
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.1 * sum(q == 0 for q in labels.values())


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert {r.doc_id for r in stages[2].collect()} == {c for _, _, c in brute_components(rows)}


def test_no_passage_is_left_twice(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    first: dict = {}
    for i in sorted(before):
        w = words(before[i])
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    after = {r.doc_id: r for r in stages[3].collect()}
    for i, text in before.items():
        w, gone = words(text), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = [x for k, x in enumerate(w) if k not in gone]
        if not kept and w:
            assert i not in after
        else:
            assert words(after[i].text) == kept and after[i].n_chars == len(after[i].text)
            assert gone or after[i].text == text


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = brute_leaks([(r.doc_id, r.text) for r in stages[3].collect()], items)
    assert {r.doc_id for r in stages[4].collect()} == {i for i, x in want.items() if not x}


def test_all_that_is_left_is_packed(stages):
    packed = {}
    for r in stages[5].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
        assert r.length <= 1024
    assert set(packed) == {r.doc_id for r in stages[4].collect()}


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_columns_of_any_name_come_through(spark):
    """Each stage returns what it was given beside the text, under clashing names and with nulls."""
    names = ["leaks", "kept", "log_weight", "Perturbed", "component_id", "block", "n_shingles", "a.b", "word"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, docs["doc_id"] * 10 + i)
    odd = spark.createDataFrame([(None, None, None, None, None, *[None] * 9), (7777, "", "en", "s", 0, *range(9))], docs.schema)
    rows = docs.union(odd).cache()
    want = {r["doc_id"]: tuple(r[n] for n in names) for r in rows.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, DATA)
        assert out.columns == rows.columns, name
        got = out.collect()
        assert got and all(tuple(r[n] for n in names) == want[r["doc_id"]] for r in got), name
        assert stage(spark, rows.limit(0), DATA).count() == 0, name
    assert corpus_pipeline.pack(spark, rows, DATA).select("doc_id").distinct().count() == len(want)
