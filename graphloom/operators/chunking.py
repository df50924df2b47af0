"""Text units under a token limit, and entities in groups that fit a context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_units(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, text_unit, n_words): a partition of each text's words, in order, into units of limit words, the last one shorter."""
    words = docs.select(id_col, F.filter(F.split(F.coalesce(text_col, F.lit("")), r"\s+"), lambda w: w != "").alias("words"))
    units = words.where(F.size("words") > 0).select(id_col, F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / limit).cast("int")), lambda k: F.slice("words", k * limit + 1, limit))).alias("chunk_index", "unit"))
    return units.select(id_col, "chunk_index", F.array_join("unit", " ").alias("text_unit"), F.size("unit").alias("n_words"))


def priming_prefix(text: Column, limit: int = 2000) -> Column:
    return F.array_join(F.slice(F.split(text, r"\s+"), 1, limit), " ")


def entity_groups(entities: DataFrame, doc: str, entity: str, text_tokens: Column, context_limit: int = 10_000, instructions: int = 500) -> DataFrame:
    """Each entity with group_id: consecutive groups of a document's entities that fit what the text leaves of the context.

    Token lengths are words. A document's entities are numbered within the document.
    """
    own = Window.partitionBy(doc)
    budget = F.greatest(F.lit(0), F.lit(context_limit) - (text_tokens + instructions))
    length = F.size(F.split(entity, r"\s+"))
    average = F.greatest(F.lit(1), F.floor(F.sum(length).over(own) / F.count(F.lit(1)).over(own)))
    most = F.greatest(F.lit(1), F.floor(budget / average)).cast("long")
    rank = F.row_number().over(own.orderBy(entity)) - 1
    return entities.select(doc, entity, most.alias("max_entities"), F.floor(rank / most).alias("group_id"))


def sample_documents(docs: DataFrame, name: str, limit: int, seed: int = 0) -> DataFrame:
    """A seeded sample without replacement, the same each time."""
    return docs.select(name).distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string"))), name).limit(limit)
