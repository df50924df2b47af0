"""The per-unit steps over a stream of documents: stateless, so batch and stream share one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.functions.text import structured_text
from graphloom.operators.chunking import text_units


def flagged_units(docs: DataFrame, limit: int = 250) -> DataFrame:
    """Text units of a (streaming) table (doc_id, text) with their structured-text flags."""
    units = text_units(docs, limit)
    return units.select("doc_id", "chunk_index", structured_text(units.text_unit).alias("s")).select("doc_id", "chunk_index", "s.*")
