"""Operators against plain Python, on rows made for their edges."""

import re
import unicodedata
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from graphloom.functions import prompts, text
from graphloom.operators import chunking, extraction, graph, matching, metrics
from graphloom.sources import io
from graphloom.streaming.units import flagged_units


def column(spark, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("v"))).collect()]


def test_structured_text(spark):
    got = column(spark, ["one\ntwo", "1 2 3\n4 5 6\n7 8 9", "a, b\n\n  c-d.\nthe end!", None, "x\x85y\x1cz"], text.structured_text)
    assert not got[0].is_structured and got[0].digit_ratio == 0.0
    assert got[1].is_structured and got[1].digit_ratio == 1.0 and got[1].line_similarity == 1.0
    assert got[2].sentence_end_ratio == 2 / 3 and got[2].stopword_ratio > 0
    assert not got[3].is_structured and got[4].line_similarity == 1.0


def test_shapes_and_jaccard(spark):
    assert column(spark, ["foo-bar R2D2 abc (x²) don't"], text.line_shape) == [["P", "D", "W", "P", "D", "P", "P"]]
    pairs = spark.sql("select * from values (array(), array()), (array('a'), array('b', 'a')), (array('a'), array()) as t(a, b)").selectExpr("cast(a as array<string>) a", "cast(b as array<string>) b")
    assert sorted(r[0] for r in pairs.select(text.jaccard(F.col("a"), F.col("b"))).collect()) == [0.0, 0.5, 1.0]


def test_normalisation(spark):
    def plain(e):
        kept = "".join(c for c in unicodedata.normalize("NFKD", e.lower().strip()) if c in "abcdefghijklmnopqrstuvwxyz0123456789 \t\n")
        return __import__("re").sub(r"\s+", " ", kept)

    names = ["foo -", " Éa-b  ç", "GxVAEs", "  K-means++ ", "naïve\tBayes"]
    assert column(spark, names, text.normalize_alnum) == [plain(n) for n in names] and plain("foo -") == "foo "
    assert column(spark, ["MULTI-TASK NETWORK (MTN)", "RESNET-50", "A-B  C-3-D "], text.normalize_hyphen) == ["multitask network (mtn", "resnet-50", "ab c-3-d"]
    assert column(spark, ["doc_7", "a/b/c.tar.gz", "c"], lambda c: F.concat_ws("|", text.document_name(c), text.file_stem(c))) == ["7|doc_7", "a/b/c.tar.gz|c.tar", "c|c"]


def test_references(spark):
    body, mark = "intro\n", "\n\n---References section begin---\n\n---References section end---\n\n"
    texts = [body + "\n### **References**\n\n[1] one\n[2] two\n\n### **Appendix**\nmore", body + "**References**\n## Next\nmore", " no heading ", body + "R E F E R E N C E S\n[1] a", body + "# works cited\nx"]
    got = column(spark, texts, text.isolate_references)
    assert got[0].text == "intro" + mark + "\n\n### **Appendix**\nmore" and got[0].references == "### **References**\n\n[1] one\n[2] two"
    assert got[1].text == "intro" and got[1].references == "**References**\n## Next\nmore"
    assert tuple(got[2]) == (" no heading ", "") and got[3].text == "intro" and got[4].references == "# works cited\nx"


def test_units_and_groups(spark):
    docs = spark.createDataFrame([(1, "a b  c\nd e"), (2, ""), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in chunking.text_units(docs, 2).orderBy("chunk_index").collect()] == [(1, 0, "a b", 2), (1, 1, "c d", 2), (1, 2, "e", 1)]
    names = spark.createDataFrame([("d", f"e{k}") for k in range(5)], "doc string, name string")
    groups = chunking.entity_groups(names, "doc", "name", F.lit(9_498)).orderBy("name").collect()
    assert [(r.max_entities, r.group_id) for r in groups] == [(2, 0), (2, 0), (2, 1), (2, 1), (2, 2)]
    assert {r.max_entities for r in chunking.entity_groups(names, "doc", "name", F.lit(99_999)).collect()} == {1}
    assert chunking.sample_documents(names.withColumnRenamed("name", "n"), "n", 3).collect() == chunking.sample_documents(names.withColumnRenamed("name", "n"), "n", 3).collect()


def test_extraction_rounds(spark):
    one = lambda units, turn: spark.createDataFrame([(turn,)], "turn int")
    assert extraction.extract_until_valid(docs := spark.range(1), one, lambda out: True, 3).count() == 3
    assert extraction.extract_until_valid(docs, one, lambda out: False).count() == 1
    custom = extraction.extract_entities(spark.sql("select 1L as doc_id, 0 as chunk_index, 'x' as text_unit"), lambda it: (p.assign(ord=0, name="X", type="T")[["doc_id", "chunk_index", "ord", "name", "type"]] for p in it))
    assert custom.first().name == "X"


def test_edges_of_both_directions(spark):
    rel = spark.createDataFrame([("A", "B", 8.0, "x", 1), ("B", "A", 9.0, "y", 2), ("B", "A", 8.0, "z", 3), ("B", "A", 9.0, "w", 4)], "source string, target string, strength double, description string, ord int")
    edges = graph.fold_undirected(graph.merge_directed(rel, ["ord"])).collect()
    assert len(edges) == 1 and abs(edges[0].weight - 50 / 3) < 1e-12 and (edges[0].source, edges[0].description) == ("A", "x | y ; z ; w")
    nodes = spark.createDataFrame([("a", "GENERIC", "d", 0, 1), (" A", "METHOD", "e", 0, 2), ("a", "METHOD", "d", 0, 3)], "name string, type string, description string, source_index int, ord int")
    assert tuple(graph.merge_nodes(nodes, ["ord"]).first()) == ("A", "GENERIC, METHOD, METHOD", "d ; e ; d", [0, 0, 0])
    merged, known = graph.merge_nodes(nodes, ["ord"]), spark.createDataFrame([("generic",)], "name string")
    assert graph.new_types(merged, known).collect()[0].type == "METHOD"
    assert graph.nodes_with_new_types(merged, known).count() == 1 and graph.nodes_with_new_types(merged, known, compat=True).count() == 0


def test_best_matches_against_all_pairs(spark):
    import random

    rng = random.Random(8)
    make = lambda: "".join(rng.choice("abcé -1") for _ in range(rng.randrange(1, 14)))
    left, right = sorted({make() for _ in range(80)}), sorted({make() for _ in range(80)})
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    for least in (0.7, 0.85):
        got = {r.left: (r.right, r.score) for r in matching.best_matches(frame(left), frame(right), least).collect()}
        want = {}
        for a in left:
            best = max(((SequenceMatcher(None, a, b).ratio(), b) for b in right), key=lambda x: x[0])
            if best[0] >= least:
                want[a] = (best[1], best[0])
        assert got == want


def test_validation_and_metrics(spark):
    gold = spark.createDataFrame([("multi - task network", 1, "METHOD"), ("FastPose - 5 0", 2, "METHOD"), ("coco", 3, "DOMAIN"), ("CoCo", 4, "DOMAIN")], "entity string, ord int, class string")
    found = spark.createDataFrame([("MULTI-TASK NETWORK (MTN)", "METHOD"), ("FASTPOSE-50", "METHOD"), ("COCO", "DOMAIN"), ("other thing", "DOMAIN")], "entity string, class string")
    got = {r.entity: (r.kind, r.gold) for r in matching.validate(gold, found, text.normalize_hyphen).collect()}
    assert got["COCO"] == ("exact", "coco") and got["FASTPOSE-50"][0] == "adjudicate" and got["other thing"][0] == "adjudicate"
    ratio = SequenceMatcher(None, "multitask network (mtn", "multi task network").ratio()
    assert got["MULTI-TASK NETWORK (MTN)"][0] == ("fuzzy" if ratio >= 0.85 else "adjudicate")
    by = matching.matches(matching.validate(gold, found, text.normalize_hyphen))
    novel = extraction.novelty(found.select("entity"))
    out = {r["class"]: r for r in metrics.scores(metrics.counts(gold, found, by, novel, compat=False)).collect()}
    assert all(out[c].tp + out[c].fn == out[c].gold for c in out) and out[None].gold == 4
    empty = metrics.scores(metrics.counts(gold.limit(0), found.limit(0), by.limit(0), novel.limit(0))).collect()
    assert all((r.precision or 0) == 0 for r in empty)


def test_prompts_and_sources(spark, tmp_path):
    row = spark.range(1).select(prompts.subtract(F.lit("a-b-a"), F.lit("a")), prompts.path(F.lit("PROMPT_X_Y_Human")), prompts.path(F.lit("OTHER")), prompts.constant_name(F.lit("entity_extraction"), F.lit("system"))).first()
    assert tuple(row) == ("-b-", ["X", "Y", "human"], None, "PROMPT_EntityExtraction_SYSTEM")
    (tmp_path / "c.jsonl").write_text('{"doc_id": "d", "sentence_id": 2, "sentence": "two"}\n{"doc_id": "d", "sentence_id": 1, "sentence": "one"}\n')
    corpus = io.corpus(spark, str(tmp_path / "c.jsonl"))
    assert io.document(corpus, "d").first().text == "one two" and io.document(corpus, None) is None
    (tmp_path / "g.json").write_text('{"directed": false, "nodes": [{"id": "A", "type": "T"}], "links": [{"source": "A", "target": "A", "weight": 2.0}]}')
    nodes, edges = io.graph(spark, str(tmp_path / "g.json"))
    io.save_graph(nodes, edges, str(tmp_path / "out"))
    io.save_once(nodes, str(tmp_path / "out" / "nodes"))
    assert spark.read.parquet(str(tmp_path / "out" / "nodes")).count() == 1 and edges.first().weight == 2.0
    assert io.ontology(spark.createDataFrame([(" a ",), ("A",), ("",)], "name string")).collect()[0].name == "A"


def test_units_of_a_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "1 2\n3 4\n5 6"), (2, "a b")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = flagged_units(stream).writeStream.format("memory").queryName("flagged").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("flagged").collect()} == {tuple(r) for r in flagged_units(docs).collect()}


def test_text_functions_over_all_characters(spark):
    """Tokens, digits and names as Python's str and unicodedata have them, for every code point below U+30000."""
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    docs = spark.createDataFrame([(c, chr(c)) for c in points], "c int, x string").repartition(8)
    both = F.concat(F.lit("a"), "x", F.lit("b"))
    rows = docs.select("c", F.size(text.tokens(both)).alias("n"), text.tokens(both)[0].alias("first"), text.numberish(F.col("x")).alias("digit"), text.normalize_alnum(both).alias("name")).collect()
    assert len(rows) == len(points)

    def name(x):
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", unicodedata.normalize("NFKD", x.lower().strip())))

    for r in rows:
        x = f"a{chr(r.c)}b"
        assert (r.n, r.first) == ((1, x) if len(x.split()) == 1 else (2, "a")), hex(r.c)
        assert r.digit == chr(r.c).isdigit(), hex(r.c)
        assert r.name == name(x), hex(r.c)


def test_names_of_other_scripts(spark):
    names = {"Phở Việt": "pho viet", "H²O": "h2o", "ﬁne-tune": "finetune", "ＢＥＲＴ": "bert", "ḿodel": "model", "x₂": "x2", "foo -": "foo ", None: None}
    docs = spark.createDataFrame([(k,) for k in names], "x string")
    assert {r.x: r.n for r in docs.select("x", text.normalize_alnum(F.col("x")).alias("n")).collect()} == names


def test_document_zero(spark):
    docs = spark.range(3).withColumnRenamed("id", "doc_id")
    assert io.document(docs, 0).count() == 1 and io.document(docs, None) is None


def test_counts_of_a_validation(spark):
    kinds = spark.createDataFrame([("a", "A", "exact", "x"), ("a", "B", "fuzzy", "x"), ("a", "C", "adjudicate", None), ("a", "D", "adjudicate", None), ("b", "E", "adjudicate", None)], "doc string, entity string, kind string, gold string")
    judged = spark.createDataFrame([("a", "C", "y"), ("a", "D", "NO_MATCH"), ("b", "E", "NO_MATCH")], "doc string, entity string, pick string")
    get = lambda compat: sorted(map(tuple, matching.match_counts(kinds, judged, ("doc",), compat).collect()))
    assert get(True) == [("a", 1, 1, 2, 2, 2), ("b", 0, 0, 1, 0, 1)] and get(False) == [("a", 1, 1, 2, 2, 1), ("b", 0, 0, 1, 0, 1)]


def test_node_sets_by_document(spark):
    nodes = spark.createDataFrame([("d", "A"), ("d", "B"), ("e", "A")], "doc string, id string")
    told = spark.createDataFrame([("d", "a "), ("e", "A"), ("e", "c")], "doc string, entity string")
    assert sorted(map(tuple, graph.nodes_unlike_evaluated(nodes, told, ("doc",)).collect())) == [("d", "B", "evaluation"), ("e", "C", "graph")]


def test_folders_of_paths(spark, tmp_path):
    from pathlib import PurePosixPath

    paths = ["a/b.json", "a/b", "a/.hidden", "a/b.", "a/b.tar.gz", "/x.y", "x.y", "a.b/c", "input/a", "a/my_input.yml", "a/b/", "a/b.yml/", "a/..b"]
    found = {r.p: r.f for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", io.output_folder(F.col("p")).alias("f")).collect()}
    for p in paths:
        path = PurePosixPath(p)
        want = None if "input" in p else str(path.parent if path.suffix else path)
        assert found[p] == want, p
    io.prepare([str(tmp_path / "k" / "out.json"), str(tmp_path / "m"), str(tmp_path / "input" / "n")])
    assert sorted(x.name for x in tmp_path.iterdir()) == ["k", "m"]


def test_rounds_ask_only_units_that_lack(spark):
    units = spark.createDataFrame([(1, 0), (2, 1), (3, 5)], "doc_id long, gives int")
    seen = []

    def extract(left, turn):
        seen.append(sorted(r.doc_id for r in left.collect()))
        return left.where(F.col("gives") + turn > 0).select("doc_id", F.explode(F.sequence(F.lit(1), F.col("gives") + turn)).alias("k"))

    rows, turns = extraction.extract_rounds(units, extract, extraction.with_fewer(2, ("doc_id",)), ("doc_id",), keep=lambda df: io.kept(df, "rounds"))
    assert seen == [[1, 2, 3], [1, 2], [1]]
    assert {r.doc_id: r.turns for r in turns.collect()} == {1: 3, 2: 2, 3: 1}
    assert sorted((r.doc_id, r.turn, r.k) for r in rows.collect()) == sorted([(1, 1, 1), (1, 2, 1), (1, 2, 2), (2, 0, 1), (2, 1, 1), (2, 1, 2), *((3, 0, k) for k in range(1, 6))])


def test_graphs_and_lists_on_disk(spark, tmp_path):
    nodes = spark.createDataFrame([("d", "A"), ("e", "B")], "doc string, id string")
    edges = spark.createDataFrame([("d", "A", "A", 2.5)], "doc string, source string, target string, weight double")
    io.save_node_link(nodes, edges, str(tmp_path / "g"), ("doc",))
    n, e = io.graph(spark, str(tmp_path / "g"), ("doc",))
    assert sorted((r.doc, r.id) for r in n.collect()) == [("d", "A"), ("e", "B")] and [(r.doc, r.source, r.weight) for r in e.collect()] == [("d", "A", 2.5)]
    merged = extraction.merge_classes(spark.createDataFrame([("d", "x", "METHOD"), ("e", "y", "DOMAIN"), ("e", "z", "unclassified")], "doc_id string, name string, class string"), "doc_id")
    io.save_classification(merged, str(tmp_path / "c"))
    io.save_classification(merged.limit(0), str(tmp_path / "c"))
    assert sorted(map(tuple, io.classification(spark, str(tmp_path / "c")).collect())) == [("d", "x", "METHOD"), ("e", "y", "DOMAIN"), ("e", "z", "unclassified")]


def test_best_matches_in_blocks(spark, monkeypatch):
    """Blocks of a document are any size; documents that are null meet none, nor do null keys; keys of all lengths and characters."""
    import random

    rng = random.Random(3)
    make = lambda: "".join(rng.choice("aé1 \U0001f600z") for _ in range(rng.choice((0, 3, 9, 70, 210))))
    sides = [[(rng.choice((1, 2, None)), x) for x in {make() for _ in range(40)}] + [(1, None), (1, "")] for _ in "ab"]
    sides[1] += [(doc, x[:-2] + "a") for doc, x in sides[0] if x]
    monkeypatch.setattr(matching, "LEFT_KEYS", 7)
    monkeypatch.setattr(matching, "RIGHT_KEYS", 11)
    left, right = (spark.createDataFrame(rows, "doc int, key string") for rows in sides)
    got = {(r.doc, r.left): (r.right, r.score) for r in matching.best_matches(left, right, 0.5, ("doc",)).collect()}
    want = {}
    for doc, a in sides[0]:
        near = [(-SequenceMatcher(None, a, b).ratio(), b) for d, b in sides[1] if doc is not None and d == doc and None not in (a, b)]
        if near and min(near)[0] <= -0.5:
            want[doc, a] = (min(near)[1], -min(near)[0])
    assert got == want and len(want) > 15


def test_best_matches_compare_few_pairs(monkeypatch):
    """Ratios are computed for a few of a left key's pairs, however many there are; before, for each within the bounds."""
    names = [f"{a} {b}" for a in ("large", "hot", "blue", "cold", "small") for b in ("ring", "bolt", "plate", "gear", "rod")]
    left = [f"{n} {k}" for n in names for k in range(0, 90, 3)]
    right = [f"{n} {k} model" for n in names for k in range(90)] + [f"{n} {k}" for n in names for k in range(1, 90, 3)]
    asked, ratio = [], SequenceMatcher.ratio
    monkeypatch.setattr(SequenceMatcher, "ratio", lambda self: asked.append(1) or ratio(self))
    for own in (right[::5], right):
        asked.clear()
        found = matching._best(left, own, 0.7)
        assert len(found) == len(left) and len(asked) < 6 * len(left)
    monkeypatch.setattr(SequenceMatcher, "ratio", ratio)
    for a, b, score in found[::50]:
        assert (-score, b) == min((-SequenceMatcher(None, a, x).ratio(), x) for x in right)


def test_rounds_within_a_unit(spark):
    """rounds_of and relations_of give what extract_rounds and extract_relations do, without an exchange."""
    words = ["alphabetic", "Elephants", "extraordinarily", "short", "transformations", "ELEPHANTS", "gigantic", "wonderfully"]
    units = spark.createDataFrame([(d, 0, " ".join(words[(d * k + k * k) % 8] for k in range(d))) for d in range(12)], "doc_id long, chunk_index int, text_unit string")
    few = lambda least: lambda found: F.size(found) < least
    unit = ("doc_id", "chunk_index")
    rows, turns = extraction.extract_rounds(units, lambda u, turn: extraction.extract_entities(u, least=13 - 2 * turn), extraction.with_fewer(3, unit), unit)
    own = units.select("doc_id", extraction.rounds_of(F.col("text_unit"), lambda text, turn: extraction.entities_of(text, 13 - 2 * turn), few(3)).alias("x")).select("doc_id", "x.*")
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.turns for r in own.collect()} == {r.doc_id: r.turns for r in turns.collect()}
    flat = [(r.doc_id, turn, e.name, e.type) for r in own.collect() for turn, found in enumerate(r.rounds) for e in found]
    assert sorted(flat) == sorted((r.doc_id, r.turn, r.name, r.type) for r in rows.collect())
    for span in (1, 3):
        near = units.select("doc_id", F.inline(text.let(extraction.entities_of(F.col("text_unit")), lambda e: extraction.relations_of(e, span))))
        want = extraction.extract_relations(extraction.extract_entities(units), span).drop("chunk_index")
        assert sorted(map(tuple, near.collect())) == sorted(map(tuple, want.collect())) and near.count() > 10


def test_extraction_rounds_send_no_text(spark):
    """The query's units stay where they are read; before, each round sorted and joined their texts, so a task held ever more of them."""
    from graphloom.plans.queries import QUERIES

    plan = QUERIES["extraction_rounds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
