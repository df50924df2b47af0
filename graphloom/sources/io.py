"""Reading documents, graphs and ontologies; writing results where they are not yet."""

from __future__ import annotations

import atexit
import os
import re
import uuid
from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import node_id


def corpus(spark: SparkSession, path: str, doc: str = "doc_id", order: str = "sentence_id", text: str = "sentence") -> DataFrame:
    """JSON lines of sentences as one text per document, in order."""
    rows = spark.read.json(path, schema=f"`{doc}` string, `{order}` long, `{text}` string")
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), " ").alias("text"))


def document(docs: DataFrame, name: str | None, doc: str = "doc_id") -> DataFrame | None:
    """One document's rows, None without a name."""
    return docs.where(F.col(doc) == name) if name is not None else None


def save_once(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Writes Parquet, unless something is there."""
    df.write.mode("ignore").partitionBy(*partition_by).parquet(path)


def graph(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of node-link JSON files, one graph a file; keys are the folders' columns, which name a graph."""
    node = "struct<id: string, type: string, description: string, source_index: array<int>>"
    edge = "struct<source: string, target: string, weight: double, description: string, source_index: array<int>>"
    named = "".join(f", `{k}` string" for k in keys)
    raw = spark.read.json(path, schema=f"nodes array<{node}>, links array<{edge}>{named}", multiLine=True)
    return raw.select(*keys, F.inline("nodes")), raw.select(*keys, F.inline("links"))


def save_node_link(nodes: DataFrame, edges: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    """One node-link JSON file per graph in a folder of its keys. A graph is one row on the way, so it must be one document's, not the corpus's."""
    gathered = lambda df, name: df.groupBy(*keys).agg(F.collect_list(F.struct(*(c for c in df.columns if c not in keys))).alias(name))
    whole = gathered(nodes, "nodes").join(gathered(edges, "links"), list(keys), "full")
    text = F.to_json(F.struct(*(F.coalesce(c, F.array()).alias(c) for c in ("nodes", "links"))))
    whole.select(*keys, text.alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def ontology(df: DataFrame, name: str = "name") -> DataFrame:
    return df.select(node_id(F.col(name)).alias("name")).where("name != ''").distinct()


#: The three lists of a classification, as the sink writes them.
LISTS = {"method_entities": "METHOD", "domain_entities": "DOMAIN", "unclassified": "unclassified"}


def save_classification(merged: DataFrame, path: str, doc: str = "doc_id") -> None:
    """JSON lines of documents with their three lists (extraction.merge_classes), unless something is there."""
    merged.select(doc, *LISTS).write.mode("ignore").json(path)


def classification(spark: SparkSession, path: str, doc: str = "doc_id") -> DataFrame:
    """(doc, entity, class) of the lists that save_classification wrote."""
    rows = spark.read.json(path, schema=", ".join([f"`{doc}` string", *(f"{c} array<string>" for c in LISTS)]))
    lists = F.array(*(F.struct(F.lit(k).alias("class"), F.col(c).alias("names")) for c, k in LISTS.items()))
    return rows.select(doc, F.inline(lists)).select(doc, F.explode("names").alias("entity"), "class")


def output_folder(path: Column) -> Column:
    """The folder that must be there before path is written: its parent if its last part has a suffix, else itself; null for a path with "input" in it."""
    trimmed = F.regexp_replace(path, "(?<=[^/])/+$", "")
    file = trimmed.rlike(r"(^|/)[^/]+\.[^/.]+$")
    parent = F.regexp_replace(trimmed, "/*[^/]*$", "")
    return F.when(~path.contains("input"), F.when(file, F.when(parent != "", parent).when(trimmed.startswith("/"), "/").otherwise(".")).otherwise(trimmed))


def prepare(paths: Iterable[str]) -> None:
    """Makes output_folder of each path on the driver's file system; Spark's own writers need none of it."""
    for path in (PurePosixPath(p) for p in paths if "input" not in p):
        os.makedirs(path.parent if path.suffix else path, exist_ok=True)


_kept: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir; unset, a local one if all run in this process, else an error), deleted when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(root or '/tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch path and read again, so that what made it runs once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_kept() -> None:
    for spark, path in _kept:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended
            return
