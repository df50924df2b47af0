import os

import corpus_pipeline
from graphloom.llm import tables

SF = "/root/testdata/sf0.001"


def _left(before):
    return sorted(os.path.basename(path).rsplit("-", 1)[0] for _, path in tables._written if path not in before)


def test_tables_go_when_nothing_reads_them_any_more(spark):
    """A stage keeps what its result reads, and its results are whole without the rest."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage, kept in ((corpus_pipeline.near_dedup, ["gone", "minhash", "several", "star", "star"]), (corpus_pipeline.decontamination, []), (corpus_pipeline.secrets, [])):
        before = {path for _, path in tables._written}
        out = stage(spark, docs, SF)
        assert _left(before) == kept
        assert out.count() == out.distinct().count() > 0


def test_drop_deletes_one_table(spark):
    one, other = (tables.staged(spark.range(k), "test") for k in (3, 4))
    tables.drop(one)
    assert not os.path.exists(one.staged_at) and os.path.exists(other.staged_at) and other.count() == 4
    assert (spark, other.staged_at) in tables._written and all(path != one.staged_at for _, path in tables._written)
