"""Merging extracted entities and relationships into node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import node_id, types_of


def _joined(rows: Column, value: str, sep: str, distinct: bool) -> Column:
    values = F.transform(rows, lambda r: r[value])
    return F.array_join(F.array_sort(F.array_distinct(values)) if distinct else values, sep)


def merge_nodes(entities: DataFrame, order: list[str], distinct: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per node: types, descriptions and source chunks in the order given, or each once and sorted."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "type", "description", "source_index")))
    merged = entities.withColumn("id", node_id(F.col("name"))).groupBy(*keys, "id").agg(rows.alias("rows"))
    return merged.select(*keys, "id", _joined(F.col("rows"), "type", ", ", distinct).alias("type"), _joined(F.col("rows"), "description", " ; ", distinct).alias("description"), F.transform("rows", lambda r: r["source_index"]).alias("source_index"))


def merge_directed(relations: DataFrame, order: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per (*keys, source, target), keys naming a run and document: the mean strength, descriptions in the order given, and the first place."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "description")))
    out = relations.groupBy(*keys, "source", "target").agg(F.avg("strength").alias("weight"), rows.alias("rows"))
    return out.select(*keys, "source", "target", "weight", _joined(F.col("rows"), "description", " ; ", False).alias("description"), F.struct(*(F.col("rows")[0][c].alias(c) for c in order)).alias("place"))


def fold_undirected(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Edges of both directions as one, within keys: weights added, descriptions joined by a bar, the direction that came first kept."""
    pair = [F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")]
    first = F.array_sort(F.collect_list(F.struct("place", "source", "target", "description", "weight")))
    out = edges.select("*", *pair).groupBy(*keys, "lo", "hi").agg(first.alias("e"))
    weight = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x["weight"])
    return out.select(*keys, F.col("e")[0]["source"].alias("source"), F.col("e")[0]["target"].alias("target"), weight.alias("weight"), _joined(F.col("e"), "description", " | ", False).alias("description"))


def node_types(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.explode(types_of(F.col("type"))).alias("type"))


def new_types(nodes: DataFrame, ontology: DataFrame) -> DataFrame:
    """Types of nodes that the ontology (name) lacks."""
    names = ontology.select(node_id(F.col("name")).alias("type"))
    return node_types(nodes).select("type").distinct().join(names, "type", "left_anti")


def nodes_with_new_types(nodes: DataFrame, ontology: DataFrame, compat: bool = False) -> DataFrame:
    """Nodes of which some type is new. compat leaves the blanks after commas, so that only first types are found."""
    parts = F.split("type", ",") if compat else types_of(F.col("type"))
    return nodes.select("id", F.explode(parts).alias("type")).join(new_types(nodes, ontology), "type", "left_semi").select("id").distinct()


def graph_counts(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(*keys, nodes, edges): how many nodes and edges each graph has."""
    own = nodes.groupBy(*keys).agg(F.count("*").alias("nodes"))
    return own.join(edges.groupBy(*keys).agg(F.count("*").alias("edges")), list(keys), "full").select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("nodes", "edges")))


def nodes_unlike_evaluated(nodes: DataFrame, evaluated: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, id, missing_from) of nodes that were not evaluated and evaluated entities (entity) that are no nodes; empty where the sets are one."""
    a = nodes.select(*keys, "id").distinct().withColumn("node", F.lit(True))
    b = evaluated.select(*keys, node_id(F.col("entity")).alias("id")).distinct().withColumn("told", F.lit(True))
    return a.join(b, [*keys, "id"], "full").where("node is null or told is null").select(*keys, "id", F.when(F.col("node").isNull(), "graph").otherwise("evaluation").alias("missing_from"))
