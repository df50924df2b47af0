"""Entities and relationships per text unit: pluggable extractors, with defaults that need no model."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import let

ENTITY = "struct<name: string, type: string, description: string>"


def entities_of(text: Column, least: int = 9) -> Column:
    """ARRAY<STRUCT<name, type>> of a unit's text, in order: words of at least least letters. A word's type is LONG from twelve letters on, else TERM."""
    word = F.regexp_extract_all(text, F.lit(rf"[a-zA-Z]{{{least},}}"), F.lit(0))
    return F.transform(word, lambda w: F.struct(F.upper(w).alias("name"), F.when(F.length(w) >= 12, "LONG").otherwise("TERM").alias("type")))


def relations_of(entities: Column, span: int = 3) -> Column:
    """ARRAY<STRUCT<source, target, strength>> of one unit's entities (entities_of), as extract_relations has them; entities are named once here, so let() it."""
    near = lambda e, k: F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(span)), lambda gap: (k + gap < F.size(entities)) & (F.get(entities, k + gap)["name"] != e["name"])),
        lambda gap: F.struct(e["name"].alias("source"), F.get(entities, k + gap)["name"].alias("target"), (10.0 / gap).alias("strength")),
    )
    return F.flatten(F.transform(entities, near))


def extract_entities(units: DataFrame, extractor: Callable | None = None, least: int = 9, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk_index, ord, name, type): an extractor (a mapInPandas function with this result), or else entities_of each unit."""
    if extractor:
        return units.mapInPandas(extractor, f"{id_col} long, chunk_index int, ord int, name string, type string")
    rows = units.select(id_col, "chunk_index", F.posexplode(entities_of(F.col("text_unit"), least)).alias("ord", "e"))
    return rows.select(id_col, "chunk_index", "ord", "e.name", "e.type")


def extract_relations(entities: DataFrame, span: int = 3, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk_index, source, target, strength): entities that follow one another within span places of a unit; strength 10, 5, 3.33...

    A lead over the unit's own entities takes the place of a self-join, so a unit gives at most span rows an entity.
    """
    own = Window.partitionBy(id_col, "chunk_index").orderBy("ord")
    after = entities.select(id_col, "chunk_index", F.col("name").alias("source"), F.array(*(F.lead("name", k).over(own) for k in range(1, span + 1))).alias("after"))
    ahead = after.select(id_col, "chunk_index", "source", F.posexplode("after").alias("gap", "target"))
    return ahead.where("target is not null and source != target").select(id_col, "chunk_index", "source", "target", (10.0 / (F.col("gap") + 1)).alias("strength"))


def in_range(strength: Column) -> Column:
    return strength.between(0, 10)


def extract_until_valid(units: DataFrame, extract: Callable[[DataFrame, int], DataFrame], loop_required: Callable[[DataFrame], bool], most: int = 3) -> DataFrame:
    """Rounds of extraction, added up, for as long as the feedback asks for another; at most most of them."""
    out = extract(units, 0)
    for turn in range(1, most):
        if not loop_required(out):
            break
        out = out.unionByName(extract(units, turn))
    return out


def extract_rounds(
    units: DataFrame, extract: Callable[[DataFrame, int], DataFrame], ask_again: Callable[[DataFrame, DataFrame], DataFrame], keys: tuple[str, ...], most: int = 3, keep: Callable[[DataFrame], DataFrame] = lambda df: df
) -> tuple[DataFrame, DataFrame]:
    """(rows with their turn, (*keys, turns)): rounds of extraction, at most most of them.

    ask_again(units of the round, rows of the round) gives the keys of the units to extract once more; only those are.
    Entities and relationships take a call each, so each has turns of its own. keep settles a round's rows (a
    written table, say), so that a costly extractor sees a unit once a round.
    """
    rows, asked, left = [], [], units
    for turn in range(most):
        found = keep(extract(left, turn).withColumn("turn", F.lit(turn)))
        rows.append(found)
        asked.append(left.select(*keys).distinct())
        left = left.join(ask_again(left, found).select(*keys).distinct(), list(keys), "left_semi")
    turns = reduce(DataFrame.unionByName, asked).groupBy(*keys).agg(F.count("*").alias("turns"))
    return reduce(DataFrame.unionByName, rows), turns


def rounds_of(unit: Column, extract: Callable[[Column, int], Column], ask_again: Callable[[Column], Column], most: int = 3) -> Column:
    """STRUCT<rounds, turns>: extract_rounds for an extraction that is a column of the unit alone: no unit is sent anywhere, whatever the table's size.

    extract(unit, turn) is an array; ask_again(the array of a round) says whether there is another. rounds: the arrays of
    those that took place; a later one is not computed where an earlier one gave enough.
    """

    def again(turn: int) -> Column:
        if turn == most - 1:
            return F.array(extract(unit, turn))
        return let(extract(unit, turn), lambda found: F.when(ask_again(found), F.concat(F.array(found), again(turn + 1))).otherwise(F.array(found)))

    return let(again(0), lambda rounds: F.struct(rounds.alias("rounds"), F.size(rounds).cast("long").alias("turns")))


def with_fewer(least: int, keys: tuple[str, ...]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Feedback for extract_rounds: units with fewer than least rows in the round are asked again."""
    return lambda units, found: units.join(found.groupBy(*keys).count().where(F.col("count") >= least), list(keys), "left_anti")


def classify(entities: DataFrame, dictionary: DataFrame, name: str = "name") -> DataFrame:
    """Each entity's class from a dictionary (name, class), unclassified where it has none."""
    return entities.join(dictionary, name, "left").withColumn("class", F.coalesce("class", F.lit("unclassified")))


def merge_classes(classified: DataFrame, doc: str, name: str = "name") -> DataFrame:
    """One row per document: method_entities, domain_entities, unclassified, each sorted."""
    pick = lambda k: F.array_sort(F.collect_list(F.when(F.col("class") == k, F.col(name))))
    return classified.groupBy(doc).agg(pick("METHOD").alias("method_entities"), pick("DOMAIN").alias("domain_entities"), pick("unclassified").alias("unclassified"))


def adjudicate(pairs: DataFrame, judge: Callable[[Column], Column] | None = None, name: str = "entity") -> DataFrame:
    """What a judge picks for each unmatched entity; without one, NO_MATCH."""
    return pairs.withColumn("pick", judge(F.col(name)) if judge else F.lit("NO_MATCH"))


def novelty(entities: DataFrame, scorer: Callable[[Column], Column] | None = None, name: str = "entity") -> DataFrame:
    return entities.withColumn("novelty", scorer(F.col(name)) if scorer else F.lit(0.5))
