import numpy as np
from pyspark.sql import functions as F

from graphloom.llm.sampling import SALTS, distinct_sample, parts_of, spread, summed


def test_copies_do_not_swell_the_sample(spark):
    texts = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "one text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    rows = [r.text for r in distinct_sample(texts, 2_000, 40_000, 1).collect()]
    assert len(rows) == len(set(rows)) and 800 <= len(rows) <= 1_200
    assert sorted(rows) == sorted(r.text for r in distinct_sample(texts.repartition(7), 2_000, 40_000, 1).collect())


def test_all_rows_where_the_table_is_small(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("a",), ("",)], "text string")
    assert sorted(r.text for r in distinct_sample(texts, 10, 4, 1).collect()) == ["", "a", "b"]
    assert distinct_sample(texts.limit(0), 10, 0, 1).count() == 0


def test_shares_finer_than_a_millionth(spark):
    low, high, few = spark.range(1_000_000).select(spread("id", 3).alias("x")).agg(F.min("x"), F.max("x"), F.count(F.when(F.col("x") < 2e-5, 1))).first()
    assert 0 <= low < 1e-4 and 1 - 1e-4 < high < 1 and 5 <= few <= 40


def test_sums_over_tasks(spark):
    def run(batches):
        total = np.zeros(100)
        for batch in batches:
            for x in batch.column("id").to_pylist():
                total[x % 100] += x
        yield parts_of(total)

    want = np.bincount(np.arange(5000) % 100, weights=np.arange(5000))
    for tasks in (1, 7, 150):
        assert (summed(spark.range(0, 5000, 1, tasks), run) == want).all()
    assert summed(spark.range(0), run) is None


def test_few_tasks_leave_one_array_for_the_second_step(spark):
    """As many groups as tasks, as it was, shuffled every task's array twice; no group is larger than SALTS."""

    def run(batches):
        yield parts_of(np.ones(100))

    for tasks, groups in ((1, 1), (9, 1), (SALTS, 1), (SALTS + 1, 2), (150, -(-150 // SALTS))):
        rows = spark.range(0, 5000, 1, tasks).mapInArrow(run, "part long, salt long, sums binary").where("part = 0").groupBy("salt").count().collect()
        assert len(rows) == groups and all(r["count"] <= SALTS for r in rows) and sum(r["count"] for r in rows) == tasks
