import collections

from graphloom.llm import mixing
from graphloom.llm.queries import QUERIES, SQL
from tests.compare import same


def test_against_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        same(spark, "op2_source_mixing", f"/root/testdata/{sf}", QUERIES, SQL)


def level(sizes, weights, share=1.5, most=2.0):
    left, total, out = dict(sizes), share * sum(sizes.values()), {}
    while left:
        w = sum(weights[s] for s in left)
        over = [s for s in left if total * weights[s] / w >= most * sizes[s]]
        if not over:
            return out | {s: total * weights[s] / w for s in left}
        for s in over:
            out[s] = most * sizes[s]
        total -= sum(most * sizes[s] for s in over)
        for s in over:
            del left[s]
    return out


def test_targets_epochs_and_odd_rows(spark):
    rows = [(i, "w " * (1 + i % 9), s) for s, n in (("a", 400), ("b", 10), ("c", 90), (None, 30)) for i in range(n)] + [(7, None, "b"), (8, "", "d"), (None, "x y", "c"), (None, "x y", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "'x' as bin")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    want = level(size, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    taken = collections.Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == size[r.source]
        assert r.size * (r.target // max(r.source_size, 1)) <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 9 for s in size)
    assert sorted(got, key=str) == sorted(mixing.mix(docs.repartition(5)).collect(), key=str)


def test_heavier_documents_come_first(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'a b' as text", "if(id < 2000, 's', if(id < 4000, 't', 'u')) as source", "if(id % 2 = 0, 4.0, 1.0) as q")
    from pyspark.sql import functions as F

    got = mixing.mix(docs, weights=(1, 3), share=0.5, weight=F.col("q")).where("source = 's' and taken > 0").selectExpr("avg(double(weight = 4.0))").first()[0]
    assert got > 0.7


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
