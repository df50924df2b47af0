import collections
import re

import corpus_pipeline
from graphloom.llm import secrets
from graphloom.llm.queries import QUERIES
from tests.llm.test_minhash_dedup import brute

SF = "/root/testdata/sf0.001"


def test_each_stage_against_its_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), "test")
        steps[name] = {r.doc_id: r for r in docs.collect()}
    good, single, clean, marked, mixed = steps.values()
    predicted = {r.doc_id: r.predicted for r in QUERIES["op4_quality"](spark, SF).collect()}
    assert set(good) == {i for i, p in predicted.items() if p} and all(good[i] == before[i] for i in good)
    assert set(single) == {i for i, (_, _, kept) in brute([(i, r.text) for i, r in good.items()], round(100 * corpus_pipeline.SIMILARITY)).items() if kept}
    flat = lambda t: f" {' '.join(t.lower().split())} "
    items = [flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i for i, r in single.items() if any(x in flat(r.text) for x in items)}
    assert not held & set(clean) and len(set(single) - set(clean)) <= len(held) + 2
    assert set(marked) == set(clean)
    for i, r in marked.items():
        spans = secrets.base_spans(clean[i].text)
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text) and (spans or r == clean[i] or "[secret]" in r.text)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in marked.items()}
    taken, target = collections.Counter(), {}
    for i, r in mixed.items():
        assert r.size == size[i] and 0 < r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= max(size.values()) for s in target)
    again = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert again == mixed


def test_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, None, None, None, None), (3, "password=secret12", "en", "s", 17)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
