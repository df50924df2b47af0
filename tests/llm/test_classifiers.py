import zlib

from pyspark.sql import functions as F

from graphloom.llm import language_id, quality
from graphloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_quality_of_held_out_documents(spark):
    rows = QUERIES["op4_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    print("auc", auc, "accuracy", sum(r.predicted == r.quality for r in held) / len(held), len(held), "good rejected", sum(g < 0.5 for g in good), len(good))
    assert auc > 0.9


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a b !!", None), (3, "w " * 50000, "z")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (9, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels, F.lit(True)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in quality.quality_scores(docs, labels.where("quality = 9"), F.lit(True)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels, F.lit(True)).count() == 0


def test_language_of_held_out_documents(spark):
    rows = QUERIES["op6_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    print("accuracy", sum(r.lang == r.lang_pred for r in held) / len(held), len(held))
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_of_odd_tables(spark):
    rows = [(1, None, "en"), (2, "12 !", "en"), (3, "the cat", "en"), (4, "le chat", "fr"), (5, "кот", "xx"), (None, "der Hund", None), (3, "the cat", "en"), (6, "the " * 50000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("q"))
    got = language_id.identify(docs, F.lit(True)).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert by[1].lang_pred == by[2].lang_pred == "und" and by[3].lang_pred == "en" and by[4].lang_pred == "fr" and by[5].lang_pred == "xx"
    assert {r.lang_pred for r in language_id.identify(docs, F.lit(False)).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), F.lit(True)).count() == 0
