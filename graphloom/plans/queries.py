"""One query per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import prompts as P
from graphloom.functions import text as T
from graphloom.operators import chunking, extraction, graph, matching, metrics
from graphloom.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Evaluation is by document; for parts, a brand stands for one.
DOC = ("p_brand",)
BREAK = "\n\n## **References**\n[1] first entry\n[2] second entry\n\n### Appendix\nmore text"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def structured_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.structured_text(F.col("text")).alias("s")).select("doc_id", "s.*")


@query
def structured_units(spark, d):
    units = table(spark, d, "conversations")
    return units.select("conv_id", "turn", T.structured_text(units.text, min_lines=1).alias("s")).select("conv_id", "turn", "s.*")


@query
def token_shapes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.line_shape(F.col("text")).alias("s"))
    count = lambda k: F.size(F.filter("s", lambda x: x == k)).cast("long").alias(f"n_{k.lower()}")
    return docs.select("doc_id", count("D"), count("W"), count("P"))


@query
def references_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 3 == 0, BREAK).when(F.col("doc_id") % 3 == 1, "\n\n**Bibliography**\nlast entry").otherwise("")).alias("text"))
    return docs.select("doc_id", T.isolate_references(docs.text).alias("r")).select("doc_id", F.md5("r.text").alias("text_md5"), "r.references")


@query
def entity_norm_alnum(spark, d):
    return table(spark, d, "part").select("p_partkey", T.normalize_alnum(F.concat(F.lit(" Éa-"), "p_name", F.lit(" -"))).alias("norm"))


@query
def entity_norm_hyphen(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", T.normalize_hyphen(F.concat("p_name", F.lit(" - multi-task NET-"), "p_size", F.lit("-x  (MTN)"))).alias("norm"))


@query
def names_and_types(spark, d):
    part = table(spark, d, "part").select("p_partkey", T.node_id(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("id"), F.explode(T.types_of(F.concat("p_brand", F.lit(", "), "p_type"))).alias("type"))
    return part.select("*", T.document_name(F.concat(F.lit("doc_"), "id")).alias("doc"), T.file_stem(F.concat(F.lit("/a.b/"), F.col("p_partkey").cast("string"), F.lit(".md"))).alias("stem"))


@query
def text_units(spark, d):
    return chunking.text_units(table(spark, d, "documents"), 250)


@query
def priming_prefix(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(chunking.priming_prefix(F.col("text"), 50)).alias("prefix_md5"))


@query
def entity_groups(spark, d):
    part = table(spark, d, "part").select("p_brand", "p_name").distinct()
    return chunking.entity_groups(part, "p_brand", "p_name", F.lit(9_400))


@query
def document_sample(spark, d):
    return chunking.sample_documents(table(spark, d, "documents"), "doc_id", 20, 1)


@query
def extract_entities(spark, d):
    return extraction.extract_entities(chunking.text_units(table(spark, d, "documents"), 250))


@query
def extract_relations(spark, d):
    return extraction.extract_relations(extract_entities(spark, d))


@query
def classified_entities(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("doc"), F.concat("p_name", F.lit(" "), "p_partkey").alias("name"), "p_size")
    found = extraction.classify(part, part.where("p_size <= 30").select("name", F.when(F.col("p_size") <= 15, "METHOD").otherwise("DOMAIN").alias("class")))
    merged = extraction.merge_classes(found, "doc")
    return merged.select("doc", *(F.array_join(c, "|").alias(c) for c in ("method_entities", "domain_entities", "unclassified")))


def _relations(spark, d):
    """User and part names as edges, some of them both ways."""
    line = table(spark, d, "lineitem").select(F.concat(F.lit("N"), F.col("l_suppkey") % 50).alias("s"), F.concat(F.lit("N"), F.col("l_partkey") % 50).alias("t"), "l_orderkey", "l_linenumber", (F.col("l_quantity") / 5).alias("strength"), F.col("l_returnflag").alias("description"))
    return line.where("s != t").withColumnsRenamed({"s": "source", "t": "target"})


@query
def kg_nodes(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("type"), F.col("p_name").alias("description"), F.col("p_partkey").alias("ord"), F.col("p_size").alias("source_index"))
    nodes = graph.merge_nodes(part, ["ord"])
    return nodes.select("id", F.md5("type").alias("type_md5"), F.md5("description").alias("description_md5"), F.aggregate("source_index", F.lit(0), lambda a, x: a + x).cast("long").alias("index_sum"))


@query
def kg_nodes_distinct(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("description"), F.col("p_partkey").alias("ord"), F.col("p_size").alias("source_index"))
    return graph.merge_nodes(part, ["ord"], distinct=True).select("id", "type", "description")


@query
def kg_edges_directed(spark, d):
    edges = graph.merge_directed(_relations(spark, d), ["l_orderkey", "l_linenumber"])
    return edges.select("source", "target", F.round("weight", 9).alias("weight"), F.md5("description").alias("description_md5"))


@query
def kg_edges_undirected(spark, d):
    edges = graph.fold_undirected(graph.merge_directed(_relations(spark, d), ["l_orderkey", "l_linenumber"]))
    return edges.select("source", "target", F.round("weight", 9).alias("weight"), F.md5("description").alias("description_md5"))


@query
def kg_counts(spark, d):
    rel = _relations(spark, d)
    edges = rel.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct().agg(F.count("*").alias("edges"))
    return rel.select(F.explode(F.array("source", "target")).alias("n")).distinct().agg(F.count("*").alias("nodes")).join(edges, F.lit(True))


def _typed(spark, d):
    part = table(spark, d, "part")
    return part.select(F.col("p_partkey").cast("string").alias("id"), F.concat("p_brand", F.lit(", "), "p_type").alias("type")), io.ontology(part.where("p_size <= 25").select(F.col("p_type").alias("name")))


def _upper(nodes):
    return nodes.withColumn("type", F.upper("type"))


@query
def kg_new_types(spark, d):
    nodes, known = _typed(spark, d)
    return graph.new_types(_upper(nodes), known)


@query
def kg_nodes_with_new_types(spark, d):
    nodes, known = _typed(spark, d)
    own = _upper(nodes)
    a = graph.nodes_with_new_types(own, known).agg(F.count("*").alias("nodes"))
    return a.join(graph.nodes_with_new_types(own, known, compat=True).agg(F.count("*").alias("nodes_compat")), F.lit(True))


@query
def strength_quarantine(spark, d):
    return table(spark, d, "lineitem").groupBy(extraction.in_range(F.col("l_quantity") / 4).alias("valid")).agg(F.count("*").alias("n"))


def _sides(spark, d, doc=()):
    """Gold: names of parts of even size; extracted: those of sizes divisible by three, spelled otherwise. doc: by brand or not."""
    part = table(spark, d, "part").withColumn("name", F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 97).cast("string")))
    gold = part.where("p_size % 2 = 0").select(*doc, F.col("name").alias("entity"), F.array("p_brand").alias("types"))
    found = part.where("p_size % 3 = 0").select(*doc, F.when(F.col("p_partkey") % 2 == 0, F.upper("name")).otherwise(F.concat("name", F.lit(" model"))).alias("entity"), F.array("p_type").alias("types"))
    key = T.normalize_alnum(F.col("entity"))
    return matching.by_key(gold, key, doc=doc), matching.by_key(found, key, doc=doc)


@query
def match_exact(spark, d):
    return matching.match_exact(*_sides(spark, d)).select("key")


@query
def type_consistency(spark, d):
    both = matching.match_exact(*_sides(spark, d))
    return both.select("key", F.array_join(F.array_sort("gold_types"), "|").alias("gold_types"), F.array_join(F.array_sort("extracted_types"), "|").alias("extracted_types"))


@query
def match_fuzzy(spark, d):
    return matching.match_fuzzy(*_sides(spark, d, DOC), doc=DOC)


@query
def match_missed(spark, d):
    gold, found = _sides(spark, d, DOC)
    return matching.missed(gold, found, matching.match_fuzzy(gold, found, doc=DOC), doc=DOC).select(*DOC, "key")


@query
def match_extra(spark, d):
    gold, found = _sides(spark, d, DOC)
    return matching.extracted_only(gold, found, matching.match_fuzzy(gold, found, doc=DOC), doc=DOC).select(*DOC, "key")


@query
def coverage_report(spark, d):
    gold, found = _sides(spark, d, DOC)
    return matching.coverage(gold, found, matching.match_fuzzy(gold, found, doc=DOC), doc=DOC)


@query
def coverage_by_document(spark, d):
    gold, found = _sides(spark, d, DOC)
    return matching.coverage(gold, found, matching.match_fuzzy(gold, found, doc=DOC), doc=DOC, by=DOC).withColumn("coverage_pct", F.round("coverage_pct", 9))


def _named(spark, d, doc=()):
    part = table(spark, d, "part")
    name = F.concat("p_name", F.lit("-net "), (F.col("p_partkey") % 97).cast("string"))
    kind = F.when(F.col("p_size") % 4 < 2, "METHOD").otherwise("DOMAIN").alias("class")
    gold = part.where("p_size % 2 = 0").select(*doc, name.alias("entity"), kind, F.col("p_partkey").alias("ord"))
    found = part.where("p_size % 3 = 0").select(*doc, F.when(F.col("p_partkey") % 2 == 0, F.upper(name)).otherwise(name).alias("entity"), kind)
    return gold, found


@query
def validator_exact(spark, d):
    gold, found = _named(spark, d)
    return matching.exact_spellings(gold, found.select("entity").distinct(), T.normalize_hyphen)


@query
def validator_all(spark, d):
    gold, found = _named(spark, d, DOC)
    return matching.validate(gold, found.select(*DOC, "entity").distinct(), T.normalize_hyphen, doc=DOC)


def _counts(spark, d, compat):
    gold, found = _named(spark, d)
    exact = validator_exact(spark, d)
    novel = extraction.novelty(found.select("entity").distinct().join(exact, "entity", "left_anti"), lambda e: (F.length(e) % 10) / 10.0)
    return metrics.counts(gold, found, matching.matches(exact), novel, compat)


@query
def prf_by_class(spark, d):
    return metrics.scores(_counts(spark, d, True)).select("class", "gold", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("coverage", "precision", "recall", "f1")))


@query
def prf_adjusted(spark, d):
    return metrics.scores(_counts(spark, d, True)).select("class", "novel", *(F.round(c, 9).alias(c) for c in ("adjusted_precision", "adjusted_recall", "adjusted_f1")))


@query
def prf_strict(spark, d):
    return metrics.scores(_counts(spark, d, False)).select("class", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query
def novel_entities(spark, d):
    gold, found = _named(spark, d)
    left = extraction.adjudicate(found.select("entity").distinct().join(validator_exact(spark, d), "entity", "left_anti"))
    return left.where("pick = 'NO_MATCH'").select("entity")


def _adjudicated(spark, d):
    """validator_all, and what a judge picks for what it leaves over."""
    validated = validator_all(spark, d)
    return validated, extraction.adjudicate(validated.where("kind = 'adjudicate'").select(*DOC, "entity"))


def _counts_all(spark, d, compat):
    """As _counts, by document and over all kinds of matches: exact, fuzzy and adjudicated."""
    own = lambda c: F.concat(*DOC, F.lit("\n"), c)
    gold, found = (x.select(own("entity").alias("entity"), "class") for x in _named(spark, d, DOC))
    validated, left = _adjudicated(spark, d)
    unmatched = F.col("pick") == matching.NO_MATCH
    matches = matching.matches(validated.select(own("gold").alias("gold")), left.select(F.when(unmatched, F.col("pick")).otherwise(own("pick")).alias("pick")))
    novel = extraction.novelty(left.where(unmatched), lambda e: (F.length(e) % 10) / 10.0).select(own("entity").alias("entity"), "novelty")
    return metrics.counts(gold, found, matches, novel, compat)


@query
def prf_all_by_class(spark, d):
    return metrics.scores(_counts_all(spark, d, True)).select("class", "gold", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("coverage", "precision", "recall", "f1")))


@query
def prf_all_adjusted(spark, d):
    return metrics.scores(_counts_all(spark, d, True)).select("class", "novel", *(F.round(c, 9).alias(c) for c in ("adjusted_precision", "adjusted_recall", "adjusted_f1")))


@query
def prf_all_strict(spark, d):
    return metrics.scores(_counts_all(spark, d, False)).select("class", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query
def novel_entities_all(spark, d):
    return _adjudicated(spark, d)[1].where(F.col("pick") == matching.NO_MATCH).select(*DOC, "entity")


@query
def prf_by_document(spark, d):
    """From validation to adjusted scores, for each document: exact, fuzzy and adjudicated matches."""
    gold, found = _named(spark, d, DOC)
    validated, left = _adjudicated(spark, d)
    unmatched = left.where(F.col("pick") == matching.NO_MATCH)
    judged = left.where(F.col("pick") != matching.NO_MATCH).select(*DOC, F.col("pick").alias("gold"))
    matches = validated.where("gold is not null").select(*DOC, "gold").unionByName(judged).distinct()
    novel = extraction.novelty(unmatched, lambda e: (F.length(e) % 10) / 10.0).select(*DOC, "entity", "novelty")
    out = metrics.scores(metrics.counts(gold, found, matches, novel, keys=DOC), DOC)
    return out.select(*DOC, "class", "gold", "tp", "fp", "fn", "novel", *(F.round(c, 9).alias(c) for c in ("coverage", "precision", "recall", "f1", "adjusted_precision", "adjusted_recall", "adjusted_f1")))


@query
def match_metadata(spark, d):
    validated, left = _adjudicated(spark, d)
    return matching.match_counts(validated, left, DOC)


@query
def kg_graphs_by_document(spark, d):
    """Nodes, edges and their weight of every document's own graph; a return flag stands for a document."""
    edges = graph.merge_directed(_relations(spark, d).withColumn("doc", F.col("description")), ["l_orderkey", "l_linenumber"], ("doc",))
    folded = graph.fold_undirected(edges, ("doc",))
    nodes = folded.select("doc", F.explode(F.array("source", "target")).alias("id")).distinct()
    weight = folded.groupBy("doc").agg(F.round(F.sum("weight"), 6).alias("weight"))
    return graph.graph_counts(nodes, folded, ("doc",)).join(weight, "doc")


@query
def kg_nodes_unlike_evaluated(spark, d):
    part = table(spark, d, "part")
    nodes = part.where("p_size > 3").select("p_brand", F.upper("p_name").alias("id"))
    return graph.nodes_unlike_evaluated(nodes, part.where("p_size < 48").select("p_brand", F.col("p_name").alias("entity")), DOC)


@query
def run_spread(spark, d):
    orders = table(spark, d, "orders")
    out = metrics.spread(orders, ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderpriority", "n", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"))


@query
def sweep_grid(spark, d):
    """Every setting of the sweep with the units that each document has under its limit: one job for all."""
    grid = spark.range(48).selectExpr("element_at(array(250, 500, 750, 1000), cast(id div 12 as int) + 1) as token_limit", "(id div 6) % 2 = 1 as generic_type_allowance", "(id div 3) % 2 = 1 as priming", "cast(id % 3 as int) as seed")
    arm = F.expr("if(priming, if(generic_type_allowance, 'A3', 'A1'), if(generic_type_allowance, 'A4', 'A2'))")
    words = table(spark, d, "documents").select(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("n"))
    units = words.select(F.explode(F.array(*(F.struct(F.lit(k).alias("token_limit"), F.ceil(F.col("n") / k).alias("units")) for k in (250, 500, 750, 1000)))).alias("u")).groupBy("u.token_limit").agg(F.sum("u.units").alias("units"))
    return grid.withColumn("arm", arm).join(units, "token_limit")


@query
def prompt_algebra(spark, d):
    region = table(spark, d, "region")
    both = P.concat(F.col("r_name"), F.lit("{who} has {{x}}"), F.col("r_name"))
    return region.select("r_regionkey", both.alias("joined"), P.subtract(both, F.col("r_name")).alias("cut"), P.fill(both, who=F.col("r_regionkey")).alias("filled"))


@query
def prompt_paths(spark, d):
    name = F.concat(F.lit("PROMPT_"), F.upper(F.replace("n_name", F.lit(" "), F.lit("_"))), F.when(F.col("n_nationkey") % 2 == 0, "_SYSTEM").otherwise("_NOTE"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(P.path(name), "/").alias("path"), P.constant_name(F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit("role")).alias("constant"))


@query
def resolution_decision(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(" x"))).otherwise(F.lit("other")).alias("b"))
    same = lambda a, b: (F.when(F.lower(a) == F.lower(b), matching.MERGE).otherwise(matching.DEFER), F.lit(1.0))
    apart = lambda a, b: (F.when(~F.startswith(F.lower(b), F.lower(a)), matching.NO_MATCH).otherwise(matching.DEFER), F.lit(0.8))
    return matching.resolve(part, [same, apart]).select("p_partkey", "decision", "confidence")


@query
def document_lookup(spark, d):
    return io.document(table(spark, d, "documents"), 7).select("doc_id", "text")


@query
def corpus_scan(spark, d):
    """Turns of conversations as JSON lines on disk, read as one text per conversation."""
    path = io.scratch(spark, "corpus")
    table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "text").write.json(path)
    return io.corpus(spark, path, "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("text_md5"))


@query
def graph_scan(spark, d):
    """The graphs of kg_graphs_by_document as node-link files, read again: the edges with their graph."""
    edges = graph.merge_directed(_relations(spark, d).withColumn("doc", F.col("description")), ["l_orderkey", "l_linenumber"], ("doc",))
    folded = graph.fold_undirected(edges, ("doc",)).select("doc", "source", "target", "weight")
    path = io.scratch(spark, "graphs")
    io.save_node_link(folded.select("doc", F.explode(F.array("source", "target")).alias("id")).distinct(), folded, path, ("doc",))
    nodes, links = io.graph(spark, path, ("doc",))
    degree = links.select("doc", F.explode(F.array("source", "target")).alias("id"), "weight").groupBy("doc", "id").agg(F.count("*").alias("links"), F.round(F.sum("weight"), 6).alias("weight"))
    return nodes.select("doc", "id").join(degree, ["doc", "id"], "left")


@query
def classification_lists(spark, d):
    """Every brand's three lists written, then read as rows."""
    part = table(spark, d, "part").select(F.col("p_brand").alias("doc_id"), F.concat("p_name", F.lit(" "), "p_partkey").alias("name"), F.when(F.col("p_size") <= 15, "METHOD").when(F.col("p_size") <= 30, "DOMAIN").otherwise("unclassified").alias("class"))
    path = io.scratch(spark, "classes")
    io.save_classification(extraction.merge_classes(part, "doc_id"), path)
    return io.classification(spark, path)


@query
def stored_documents(spark, d):
    """Documents in folders by language and source, where a second write leaves what is there."""
    docs, path = table(spark, d, "documents"), io.scratch(spark, "documents")
    io.save_once(docs, path, ("lang", "source"))
    io.save_once(docs.limit(0), path, ("lang", "source"))
    return spark.read.schema(docs.schema).parquet(path).select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


@query
def extraction_rounds(spark, d):
    """Entities of ever shorter words, then relations over ever wider spans, for units that gave too few; rounds counted apart."""
    units = chunking.text_units(table(spark, d, "documents"), 250)
    few = lambda least: lambda found: F.size(found) < least
    total = lambda rounds: F.aggregate(rounds, F.lit(0).cast("long"), lambda n, found: n + F.size(found))
    entities = extraction.rounds_of(F.col("text_unit"), lambda text, turn: extraction.entities_of(text, 13 - 2 * turn), few(3))
    relations = T.let(extraction.entities_of(F.col("text_unit")), lambda own: F.when(F.size(own) > 0, extraction.rounds_of(own, lambda e, turn: extraction.relations_of(e, 1 + turn), few(2))))
    rounds = lambda x: F.struct(x["turns"].alias("turns"), total(x["rounds"]).alias("n"))
    out = units.select("doc_id", "chunk_index", T.let(entities, rounds).alias("e"), T.let(relations, rounds).alias("r"))
    return out.select("doc_id", "chunk_index", F.col("e.turns").alias("entity_turns"), F.col("e.n").alias("entities"), F.col("r.turns").alias("relation_turns"), F.col("r.n").alias("relations")).na.fill(0, ["relation_turns", "relations"])


@query
def output_folders(spark, d):
    """Where each of several paths, made of names, would be written."""
    paths = ("'out/' || n_name", "'out/' || n_name || '/graph.json'", "'input/' || n_name", "'/' || n_name || '.v1/eval'", "n_name || '.yml'")
    nation = table(spark, d, "nation").select("n_nationkey", F.posexplode(F.array(*map(F.expr, paths))).alias("k", "path"))
    return nation.select("n_nationkey", "k", io.output_folder(F.col("path")).alias("folder"))
