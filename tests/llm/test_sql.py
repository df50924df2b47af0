import os

import pytest

from graphloom.llm.queries import QUERIES, SQL
from tests.compare import TABLES, same


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(spark, name, "/root/testdata/sf0.01", QUERIES, SQL)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The tables of sf0.001 with copies, near copies, ties and odd rows beside what they hold."""
    at = tmp_path_factory.mktemp("planted")
    for t in TABLES:
        if t not in ("documents", "embeddings"):
            os.symlink(f"/root/testdata/sf0.001/{t}.parquet", at / f"{t}.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    copies = docs.selectExpr("doc_id + 100000 as doc_id", "case doc_id % 5 when 0 then text when 1 then concat(text, ' tail') when 2 then upper(text) when 3 then null else concat('cc by general public license ', text, ' all Rights, reserved') end as text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(-1, "", "en", "s", 0), (-2, " \t\n", "en", None, 3), (-3, "one two", None, "s", 7), (-4, "ONE  two", "en", "s", 8), (-5, "cc\x00by é cc by nc 4 0", "en", "s", 20)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(copies).unionByName(odd).coalesce(1).write.parquet(str(at / "d"))
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    near = vectors.selectExpr("vec_id + 100000 as vec_id", "case vec_id % 4 when 0 then embedding when 1 then transform(embedding, (x, i) -> cast(x * (1 + 0.1 * (i % 3)) as float)) when 2 then transform(embedding, x -> cast(0 as float)) end as embedding", "if(vec_id % 8 = 0, null, label) as label")
    vectors.unionByName(near).coalesce(1).write.parquet(str(at / "e"))
    for name, folder in (("documents", "d"), ("embeddings", "e")):
        next((at / folder).glob("part-*")).rename(at / f"{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(SQL))
def test_planted_rows_against_sql(spark, planted, name):
    same(spark, name, planted, QUERIES, SQL)
