"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

from graphloom.functions.text import STOPWORDS

_TOKENS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}](?:[^\s]*[\p{{L}}\p{{N}}])?|[^\s]')"
_DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"
_SHAPE = "CASE WHEN regexp_matches({0}, '" + _DIGIT.replace("{", "{{").replace("}", "}}") + r"') THEN 'D' WHEN regexp_full_match({0}, '\p{{L}}+') THEN 'W' ELSE 'P' END"


def _structured(table: str, keys: str, least: int) -> str:
    shape = _SHAPE.format("t")
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return rf"""
WITH a AS (SELECT {keys}, {_TOKENS.format("coalesce(text, '')")} AS tok, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ln FROM {table}),
b AS (SELECT *, list_transform(ln, lambda l: list_sort(list_distinct(list_transform({_TOKENS.format("l")}, lambda t: {shape})))) AS sh FROM a),
c AS (SELECT {keys}, len(tok) AS n, len(ln) AS k, len(list_filter(tok, lambda t: regexp_matches(t, '{_DIGIT}'))) AS dg, len(list_filter(tok, lambda t: lower(t) IN ({stop}))) AS st, len(list_filter(ln, lambda l: regexp_matches(l, '[.!?]$'))) AS en,
    list_sum(list_transform(range(1, len(sh)), lambda i: len(list_intersect(sh[i], sh[i + 1])) / len(list_distinct(list_concat(sh[i], sh[i + 1]))))) AS js FROM b),
e AS (SELECT *, k >= {least} AND n > 0 AS ok FROM c),
f AS (SELECT {keys}, ok, CASE WHEN ok THEN dg / n ELSE 0.0::DOUBLE END AS digit_ratio, CASE WHEN ok THEN st / n ELSE 0.0::DOUBLE END AS stopword_ratio, CASE WHEN ok THEN en / k ELSE 0.0::DOUBLE END AS sentence_end_ratio, CASE WHEN ok AND k > 1 THEN js / (k - 1) ELSE 0.0::DOUBLE END AS line_similarity FROM e)
SELECT {keys}, ok AND (digit_ratio >= 0.36 OR (stopword_ratio <= 0.03 AND line_similarity >= 0.88)) AS is_structured, CAST(digit_ratio AS DOUBLE) AS digit_ratio, CAST(stopword_ratio AS DOUBLE) AS stopword_ratio, CAST(sentence_end_ratio AS DOUBLE) AS sentence_end_ratio, CAST(line_similarity AS DOUBLE) AS line_similarity FROM f"""


_UNITS = r"""u AS (SELECT doc_id, w, i AS chunk_index, w[i * 250 + 1 : i * 250 + 250] AS unit FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 250.0) AS BIGINT))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0))"""
_ENTITIES = rf"""{_UNITS}, x AS (SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, regexp_extract_all(array_to_string(unit, ' '), '[a-zA-Z]{{9,}}') AS ws FROM u),
e AS (SELECT doc_id, chunk_index, CAST(k - 1 AS INT) AS ord, upper(ws[k]) AS name, CASE WHEN length(ws[k]) >= 12 THEN 'LONG' ELSE 'TERM' END AS type FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM x))"""
_REL = """rel AS (SELECT * FROM (SELECT 'N' || (l_suppkey % 50) AS source, 'N' || (l_partkey % 50) AS target, l_orderkey, l_linenumber, l_quantity / 5 AS strength, l_returnflag AS description FROM lineitem) WHERE source <> target)"""
_DIRECTED = f"""{_REL}, dir AS (SELECT source, target, avg(strength) AS weight, string_agg(description, ' ; ' ORDER BY l_orderkey, l_linenumber, description) AS description, min(struct_pack(a := l_orderkey, b := l_linenumber)) AS place FROM rel GROUP BY source, target)"""
_TYPED = """n AS (SELECT CAST(p_partkey AS VARCHAR) AS id, upper(p_brand || ', ' || p_type) AS type FROM part), k AS (SELECT DISTINCT upper(trim(p_type)) AS type FROM part WHERE p_size <= 25),
x AS (SELECT id, unnest(string_split(type, ',')) AS raw FROM n), new AS (SELECT DISTINCT trim(raw) AS type FROM x WHERE trim(raw) NOT IN (SELECT type FROM k))"""
_ALNUM = r"regexp_replace(regexp_replace(strip_accents(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')"
# no lookaround: digits around a hyphen are marked first, twice as one digit may stand between two hyphens
_HYPHEN = r"regexp_replace(trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '(\d)-', '\1@', 'g'), '-(\d)', '@\1', 'g'), '-@', '@@', 'g'), '-', ''), '@', '-'), '\s+', ' ', 'g')), '\)+$', '')"
_SIDES = f"""p AS (SELECT *, p_name || ' ' || (p_partkey % 97) AS name FROM part), g AS (SELECT {_ALNUM.format("name")} AS key, p_brand AS t FROM p WHERE p_size % 2 = 0),
f AS (SELECT {_ALNUM.format("CASE WHEN p_partkey % 2 = 0 THEN upper(name) ELSE name || ' model' END")} AS key, p_type AS t FROM p WHERE p_size % 3 = 0)"""
_NAMED = f"""p AS (SELECT *, p_name || '-net ' || (p_partkey % 97) AS name, CASE WHEN p_size % 4 < 2 THEN 'METHOD' ELSE 'DOMAIN' END AS class FROM part), g AS (SELECT name AS entity, class, p_partkey AS ord FROM p WHERE p_size % 2 = 0),
f AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(name) ELSE name END AS entity, class FROM p WHERE p_size % 3 = 0), gk AS (SELECT {_HYPHEN.format("entity")} AS key, arg_min(entity, ord) AS gold FROM g GROUP BY 1),
m AS (SELECT e.entity, gk.gold FROM (SELECT DISTINCT entity, {_HYPHEN.format("entity")} AS key FROM f) e JOIN gk USING (key)), nov AS (SELECT DISTINCT entity FROM f WHERE entity NOT IN (SELECT entity FROM m)),
ms AS (SELECT DISTINCT gold AS entity FROM m), gc AS (SELECT DISTINCT entity, class FROM g), fc AS (SELECT DISTINCT entity, class FROM f)"""


def _scores(compat: bool) -> str:
    size = "(SELECT count(*) FROM f WHERE class = c.class AND NOT EXISTS (SELECT 1 FROM gc WHERE gc.entity = f.entity AND gc.class = f.class))" if compat else "greatest((SELECT count(*) FROM fc WHERE class = c.class) - (SELECT count(*) FROM gc JOIN ms USING (entity) WHERE class = c.class), 0)"
    fn = "(SELECT count(*) FROM gc WHERE class = c.class AND NOT EXISTS (SELECT 1 FROM fc WHERE fc.entity = gc.entity AND fc.class = gc.class))" if compat else "(SELECT count(*) FROM gc WHERE class = c.class AND entity NOT IN (SELECT entity FROM ms))"
    return f"""WITH {_NAMED}, c AS (SELECT class FROM gc UNION SELECT class FROM fc),
n AS (SELECT class, (SELECT count(*) FROM gc WHERE class = c.class) AS gold, (SELECT count(*) FROM gc JOIN ms USING (entity) WHERE class = c.class) AS tp, {size} AS fp, {fn} AS fn,
    (SELECT count(*) FROM fc WHERE class = c.class AND entity IN (SELECT entity FROM nov WHERE (length(entity) % 10) / 10.0 >= 0.7)) AS novel FROM c),
s AS (SELECT class, CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(novel) AS BIGINT) AS novel FROM n GROUP BY ROLLUP (class)),
r AS (SELECT *, CASE WHEN gold > 0 THEN tp / gold ELSE 0 END AS c_, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p_, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r_, CASE WHEN tp + fp > 0 THEN (tp + novel) / (tp + fp) ELSE 0 END AS ap_, CASE WHEN gold + novel > 0 THEN (tp + novel) / (gold + novel) ELSE 0 END AS ar_ FROM s)
"""


# the longest block two strings share (the first of equals): 1000 * length - its place in a; x <= 0: none
_BLOCK = "list_max(list_transform(range(1, len({0}) + 1), lambda i: 1000 * coalesce(list_max(list_filter(range(1, len({0}) - i + 2), lambda k: contains({1}, substr({0}, i, k)))), 0) - i))"
# Ratcliff-Obershelp: the blocks of what is left and right of each block, until none is shared
_RATIO = f"""cand AS (SELECT row_number() OVER () AS p, * FROM pairs),
seg AS (SELECT p, a, b, {_BLOCK.format("a", "b")} AS x FROM cand
    UNION ALL SELECT p, na, nb, {_BLOCK.format("na", "nb")} FROM (SELECT p, unnest([substr(a, 1, i - 1), substr(a, i + k)]) AS na, unnest([substr(b, 1, j - 1), substr(b, j + k)]) AS nb
        FROM (SELECT *, instr(b, substr(a, i, k)) AS j FROM (SELECT *, (x + 999) // 1000 AS k, ((x + 999) // 1000) * 1000 - x AS i FROM seg WHERE x > 0))) WHERE na <> '' AND nb <> ''),
ratio AS (SELECT doc, a, b, 2.0::DOUBLE * shared / (len(a) + len(b)) AS score FROM cand JOIN (SELECT p, CAST(sum((x + 999) // 1000) AS BIGINT) AS shared FROM seg WHERE x > 0 GROUP BY p) USING (p))"""
_BY_DOC = f"""p AS (SELECT *, p_name || ' ' || (p_partkey % 97) AS name FROM part), g AS (SELECT DISTINCT p_brand AS doc, {_ALNUM.format("name")} AS key FROM p WHERE p_size % 2 = 0),
f AS (SELECT DISTINCT p_brand AS doc, {_ALNUM.format("CASE WHEN p_partkey % 2 = 0 THEN upper(name) ELSE name || ' model' END")} AS key FROM p WHERE p_size % 3 = 0),
rest AS (SELECT * FROM g ANTI JOIN f USING (doc, key)), pairs AS (SELECT rest.doc, rest.key AS a, f.key AS b FROM rest JOIN f USING (doc) WHERE 2 * least(len(rest.key), len(f.key)) >= 0.7 * (len(rest.key) + len(f.key))),
{_RATIO}, fuzzy AS (SELECT doc, a AS key, arg_min(b, (-score, b)) AS "right", max(score) AS score FROM ratio WHERE score >= 0.7 GROUP BY doc, a)"""
_VALID = rf"""p AS (SELECT *, p_name || '-net ' || (p_partkey % 97) AS name, CASE WHEN p_size % 4 < 2 THEN 'METHOD' ELSE 'DOMAIN' END AS class FROM part), g AS (SELECT p_brand AS doc, name AS entity, class, p_partkey AS ord FROM p WHERE p_size % 2 = 0),
f AS (SELECT p_brand AS doc, CASE WHEN p_partkey % 2 = 0 THEN upper(name) ELSE name END AS entity, class FROM p WHERE p_size % 3 = 0),
gk AS (SELECT doc, {_HYPHEN.format("entity")} AS key, arg_min(entity, (ord, entity)) AS gold FROM g GROUP BY 1, 2), e AS (SELECT DISTINCT doc, entity, {_HYPHEN.format("entity")} AS key FROM f),
rest AS (SELECT DISTINCT doc, key FROM e ANTI JOIN gk USING (doc, key)), pairs AS (SELECT rest.doc, rest.key AS a, gk.key AS b FROM rest JOIN gk USING (doc) WHERE 2 * least(len(rest.key), len(gk.key)) >= 0.85 * (len(rest.key) + len(gk.key))),
{_RATIO}, best AS (SELECT doc, a AS key, arg_min(b, (-score, b)) AS b, max(score) AS score FROM ratio WHERE score >= 0.85 GROUP BY doc, a),
near AS (SELECT best.doc, best.key, gk.gold, score FROM best JOIN gk ON gk.doc = best.doc AND gk.key = best.b WHERE regexp_extract_all(best.key, '\d+(?:\.\d+)?') = regexp_extract_all(best.b, '\d+(?:\.\d+)?')),
val AS (SELECT e.doc, entity, CASE WHEN gk.gold IS NOT NULL THEN 'exact' WHEN near.gold IS NOT NULL THEN 'fuzzy' ELSE 'adjudicate' END AS kind, coalesce(gk.gold, near.gold) AS gold, CASE WHEN gk.gold IS NOT NULL THEN 1.0::DOUBLE ELSE score END AS score
    FROM e LEFT JOIN gk USING (doc, key) LEFT JOIN near USING (doc, key))"""
_F1 = "CASE WHEN {0} + {1} > 0 THEN 2 * {0} * {1} / ({0} + {1}) ELSE 0 END"
SQL: dict[str, str] = {
    "structured_text": _structured("documents", "doc_id", 3),
    "structured_units": _structured("conversations", "conv_id, turn", 1),
    "token_shapes": f"""WITH a AS (SELECT doc_id, list_transform({_TOKENS.format("text")}, lambda t: {_SHAPE.format("t")}) AS s FROM documents)
SELECT doc_id, len(list_filter(s, lambda x: x = 'D')) AS n_d, len(list_filter(s, lambda x: x = 'W')) AS n_w, len(list_filter(s, lambda x: x = 'P')) AS n_p FROM a""",
    "references_split": r"""SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') || e'\n\n---References section begin---\n\n---References section end---\n\n\n\n### Appendix\nmore text' WHEN doc_id % 3 = 1 THEN trim(text, e' \n\t') ELSE text END) AS text_md5,
CASE doc_id % 3 WHEN 0 THEN e'## **References**\n[1] first entry\n[2] second entry' WHEN 1 THEN e'**Bibliography**\nlast entry' ELSE '' END AS references FROM documents""",
    "entity_norm_alnum": f"SELECT p_partkey, {_ALNUM.format(chr(39) + ' Éa-' + chr(39) + ' || p_name || ' + chr(39) + ' -' + chr(39))} AS norm FROM part",
    "entity_norm_hyphen": f"SELECT p_partkey, {_HYPHEN.format(chr(40) + 'p_name || ' + chr(39) + ' - multi-task NET-' + chr(39) + ' || p_size || ' + chr(39) + '-x  (MTN)' + chr(39) + chr(41))} AS norm FROM part",
    "names_and_types": "SELECT p_partkey, upper(trim(p_name)) AS id, trim(t) AS type, upper(trim(p_name)) AS doc, CAST(p_partkey AS VARCHAR) AS stem FROM (SELECT *, unnest(string_split(p_brand || ', ' || p_type, ',')) AS t FROM part)",
    "text_units": f"WITH {_UNITS} SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, array_to_string(unit, ' ') AS text_unit, CAST(len(unit) AS INT) AS n_words FROM u",
    "priming_prefix": r"SELECT doc_id, md5(array_to_string(regexp_split_to_array(text, '\s+')[1:50], ' ')) AS prefix_md5 FROM documents",
    "entity_groups": r"""WITH p AS (SELECT DISTINCT p_brand, p_name FROM part), s AS (SELECT *, greatest(1, 100 // greatest(1, CAST(sum(len(regexp_split_to_array(p_name, '\s+'))) OVER w AS BIGINT) // count(*) OVER w)) AS max_entities, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) - 1 AS r FROM p WINDOW w AS (PARTITION BY p_brand))
SELECT p_brand, p_name, CAST(max_entities AS BIGINT) AS max_entities, CAST(r // max_entities AS BIGINT) AS group_id FROM s""",
    "document_sample": "SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents) ORDER BY md5('1:' || doc_id), doc_id LIMIT 20",
    "extract_entities": f"WITH {_ENTITIES} SELECT * FROM e",
    "extract_relations": f"""WITH {_ENTITIES} SELECT a.doc_id, a.chunk_index, a.name AS source, b.name AS target, CAST(10.0 / (b.ord - a.ord) AS DOUBLE) AS strength FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.chunk_index = b.chunk_index AND b.ord > a.ord AND b.ord <= a.ord + 3 AND a.name <> b.name""",
    "classified_entities": """WITH p AS (SELECT p_brand AS doc, p_name || ' ' || p_partkey AS name, CASE WHEN p_size <= 15 THEN 'METHOD' WHEN p_size <= 30 THEN 'DOMAIN' ELSE 'unclassified' END AS class FROM part)
SELECT doc, coalesce(string_agg(name, '|' ORDER BY name) FILTER (class = 'METHOD'), '') AS method_entities, coalesce(string_agg(name, '|' ORDER BY name) FILTER (class = 'DOMAIN'), '') AS domain_entities, coalesce(string_agg(name, '|' ORDER BY name) FILTER (class = 'unclassified'), '') AS unclassified FROM p GROUP BY doc""",
    "kg_nodes": "SELECT upper(trim(p_brand)) AS id, md5(string_agg(p_type, ', ' ORDER BY p_partkey)) AS type_md5, md5(string_agg(p_name, ' ; ' ORDER BY p_partkey)) AS description_md5, CAST(sum(p_size) AS BIGINT) AS index_sum FROM part GROUP BY 1",
    "kg_nodes_distinct": "SELECT upper(trim(p_brand)) AS id, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS type, string_agg(DISTINCT p_brand, ' ; ' ORDER BY p_brand) AS description FROM part GROUP BY 1",
    "kg_edges_directed": f"WITH {_DIRECTED} SELECT source, target, round(weight, 9) AS weight, md5(description) AS description_md5 FROM dir",
    "kg_edges_undirected": f"WITH {_DIRECTED} SELECT arg_min(source, place) AS source, arg_min(target, place) AS target, round(sum(weight), 9) AS weight, md5(string_agg(description, ' | ' ORDER BY place)) AS description_md5 FROM dir GROUP BY least(source, target), greatest(source, target)",
    "kg_counts": f"WITH {_REL} SELECT (SELECT count(*) FROM (SELECT source FROM rel UNION SELECT target FROM rel)) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT least(source, target), greatest(source, target) FROM rel)) AS edges",
    "kg_new_types": f"WITH {_TYPED} SELECT type FROM new",
    "kg_nodes_with_new_types": f"WITH {_TYPED} SELECT (SELECT count(DISTINCT id) FROM x WHERE trim(raw) IN (SELECT type FROM new)) AS nodes, (SELECT count(DISTINCT id) FROM x WHERE raw IN (SELECT type FROM new)) AS nodes_compat",
    "strength_quarantine": "SELECT l_quantity / 4 BETWEEN 0 AND 10 AS valid, count(*) AS n FROM lineitem GROUP BY 1",
    "match_exact": f"WITH {_SIDES} SELECT DISTINCT key FROM g WHERE key IN (SELECT key FROM f)",
    "type_consistency": f"WITH {_SIDES} SELECT a.key, gold_types, extracted_types FROM (SELECT key, string_agg(t, '|' ORDER BY t) AS gold_types FROM g GROUP BY key) a JOIN (SELECT key, string_agg(t, '|' ORDER BY t) AS extracted_types FROM f GROUP BY key) b USING (key)",
    "validator_exact": f"WITH {_NAMED} SELECT entity, gold FROM m",
    "novel_entities": f"WITH {_NAMED} SELECT entity FROM nov",
    "prf_by_class": _scores(True) + f"SELECT class, gold, tp, fp, fn, round(c_, 9) AS coverage, round(p_, 9) AS precision, round(r_, 9) AS recall, round({_F1.format('p_', 'r_')}, 9) AS f1 FROM r",
    "prf_adjusted": _scores(True) + f"SELECT class, novel, round(ap_, 9) AS adjusted_precision, round(ar_, 9) AS adjusted_recall, round({_F1.format('ap_', 'ar_')}, 9) AS adjusted_f1 FROM r",
    "prf_strict": _scores(False) + f"SELECT class, tp, fp, fn, round(p_, 9) AS precision, round(r_, 9) AS recall, round({_F1.format('p_', 'r_')}, 9) AS f1 FROM r",
    "run_spread": "SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS stddev FROM orders GROUP BY 1",
    "sweep_grid": r"""WITH g AS (SELECT t AS token_limit, a AS generic_type_allowance, p AS priming, s AS seed FROM (VALUES (250), (500), (750), (1000)) x(t), (VALUES (false), (true)) y(a), (VALUES (false), (true)) z(p), (VALUES (0), (1), (2)) v(s)),
w AS (SELECT len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT token_limit, generic_type_allowance, priming, seed, CASE WHEN priming THEN CASE WHEN generic_type_allowance THEN 'A3' ELSE 'A1' END ELSE CASE WHEN generic_type_allowance THEN 'A4' ELSE 'A2' END END AS arm, (SELECT CAST(sum(ceil(n / token_limit)) AS BIGINT) FROM w) AS units FROM g""",
    "prompt_algebra": r"""WITH r AS (SELECT *, r_name || e'\n{who} has {{x}}\n' || r_name AS j FROM region) SELECT r_regionkey, j AS joined, replace(j, r_name, '') AS cut, r_name || e'\n' || r_regionkey || e' has {x}\n' || r_name AS filled FROM r""",
    "prompt_paths": """SELECT n_nationkey, replace(upper(replace(n_name, ' ', '_')), '_', '/') || CASE WHEN n_nationkey % 2 = 0 THEN '/system' ELSE '/NOTE' END AS path, 'PROMPT_' || array_to_string(list_transform(string_split(lower(replace(n_name, ' ', '_')), '_'), lambda s: upper(s[1]) || lower(s[2:])), '') || '_ROLE' AS constant FROM nation""",
    "resolution_decision": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'MERGE' WHEN 1 THEN 'DEFER' ELSE 'NO_MATCH' END AS decision, CAST(CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.8 END AS DOUBLE) AS confidence FROM part",
    "document_lookup": "SELECT doc_id, text FROM documents WHERE doc_id = 7",
    "match_fuzzy": f"""WITH RECURSIVE {_BY_DOC} SELECT doc AS p_brand, key AS "left", "right", score FROM fuzzy""",
    "match_missed": f"WITH RECURSIVE {_BY_DOC} SELECT doc AS p_brand, key FROM rest ANTI JOIN fuzzy USING (doc, key)",
    "match_extra": f"WITH RECURSIVE {_BY_DOC} SELECT doc AS p_brand, key FROM f ANTI JOIN g USING (doc, key) ANTI JOIN fuzzy USING (doc, key)",
    "coverage_report": f"""WITH RECURSIVE {_BY_DOC}, n AS (SELECT (SELECT count(*) FROM g) AS total_gold, (SELECT count(*) FROM g SEMI JOIN f USING (doc, key)) AS direct, (SELECT count(*) FROM fuzzy) AS fuzzy)
SELECT *, total_gold - direct - fuzzy AS missed, CASE WHEN total_gold > 0 THEN (direct + fuzzy) / total_gold * 100 ELSE 0.0::DOUBLE END AS coverage_pct FROM n""",
    "coverage_by_document": f"""WITH RECURSIVE {_BY_DOC}, n AS (SELECT g.doc AS p_brand, count(*) AS total_gold, count(f.key) AS direct, count(fuzzy.key) AS fuzzy FROM g LEFT JOIN f USING (doc, key) LEFT JOIN fuzzy USING (doc, key) GROUP BY 1)
SELECT *, total_gold - direct - fuzzy AS missed, round((direct + fuzzy) / total_gold * 100, 9) AS coverage_pct FROM n""",
    "validator_all": f"WITH RECURSIVE {_VALID} SELECT doc AS p_brand, entity, kind, gold, score FROM val",
    "match_metadata": f"""WITH RECURSIVE {_VALID} SELECT doc AS p_brand, count(*) FILTER (kind = 'exact') AS exact, count(*) FILTER (kind = 'fuzzy') AS fuzzy, count(*) FILTER (kind = 'adjudicate') AS adjudicated, count(DISTINCT gold) AS matches, count(*) FILTER (kind = 'adjudicate') AS novel
FROM val GROUP BY doc""",
    "novel_entities_all": f"WITH RECURSIVE {_VALID} SELECT doc AS p_brand, entity FROM val WHERE kind = 'adjudicate'",
    "prf_by_document": f"""WITH RECURSIVE {_VALID}, gc AS (SELECT DISTINCT doc, entity, class FROM g), fc AS (SELECT DISTINCT doc, entity, class FROM f), ms AS (SELECT DISTINCT doc, gold AS entity FROM val WHERE gold IS NOT NULL),
nov AS (SELECT doc, entity FROM val WHERE kind = 'adjudicate' AND (length(entity) % 10) / 10.0 >= 0.7), c AS (SELECT doc, class FROM gc UNION SELECT doc, class FROM fc),
parts AS (SELECT doc, class, 1 AS gold, CAST(EXISTS (SELECT 1 FROM ms WHERE ms.doc = gc.doc AND ms.entity = gc.entity) AS INT) AS tp, 0 AS fp, CAST(NOT EXISTS (SELECT 1 FROM fc WHERE fc.doc = gc.doc AND fc.entity = gc.entity AND fc.class = gc.class) AS INT) AS fn, 0 AS novel FROM gc
    UNION ALL SELECT doc, class, 0, 0, 1, 0, 0 FROM f WHERE NOT EXISTS (SELECT 1 FROM gc WHERE gc.doc = f.doc AND gc.entity = f.entity AND gc.class = f.class)
    UNION ALL SELECT doc, class, 0, 0, 0, 0, 1 FROM fc SEMI JOIN nov USING (doc, entity)),
s AS (SELECT doc, class, CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(novel) AS BIGINT) AS novel
    FROM (SELECT * FROM parts UNION ALL SELECT doc, class, 0, 0, 0, 0, 0 FROM c) GROUP BY GROUPING SETS ((doc, class), (doc))),
r AS (SELECT *, CASE WHEN gold > 0 THEN tp / gold ELSE 0 END AS c_, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p_, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r_, CASE WHEN tp + fp > 0 THEN (tp + novel) / (tp + fp) ELSE 0 END AS ap_, CASE WHEN gold + novel > 0 THEN (tp + novel) / (gold + novel) ELSE 0 END AS ar_ FROM s)
SELECT doc AS p_brand, class, gold, tp, fp, fn, novel, round(c_, 9) AS coverage, round(p_, 9) AS precision, round(r_, 9) AS recall, round({_F1.format('p_', 'r_')}, 9) AS f1, round(ap_, 9) AS adjusted_precision, round(ar_, 9) AS adjusted_recall, round({_F1.format('ap_', 'ar_')}, 9) AS adjusted_f1 FROM r""",
    "kg_graphs_by_document": f"""WITH {_REL}, dir AS (SELECT description AS doc, source, target, avg(strength) AS weight FROM rel GROUP BY ALL), e AS (SELECT doc, least(source, target) AS a, greatest(source, target) AS b, sum(weight) AS weight FROM dir GROUP BY 1, 2, 3),
n AS (SELECT doc, count(*) AS nodes FROM (SELECT doc, a AS id FROM e UNION SELECT doc, b FROM e) GROUP BY doc)
SELECT doc, nodes, edges, weight FROM n JOIN (SELECT doc, count(*) AS edges, round(sum(weight), 6) AS weight FROM e GROUP BY doc) USING (doc)""",
    "kg_nodes_unlike_evaluated": """WITH a AS (SELECT DISTINCT p_brand, upper(p_name) AS id FROM part WHERE p_size > 3), b AS (SELECT DISTINCT p_brand, upper(trim(p_name)) AS id FROM part WHERE p_size < 48)
SELECT *, 'evaluation' AS missing_from FROM a ANTI JOIN b USING (p_brand, id) UNION ALL SELECT *, 'graph' FROM b ANTI JOIN a USING (p_brand, id)""",
    "corpus_scan": "SELECT CAST(conv_id AS VARCHAR) AS conv_id, md5(coalesce(string_agg(text, ' ' ORDER BY turn, text), '')) AS text_md5 FROM conversations GROUP BY conv_id",
    "graph_scan": f"""WITH {_REL}, dir AS (SELECT description AS doc, source, target, avg(strength) AS weight FROM rel GROUP BY ALL), e AS (SELECT doc, least(source, target) AS a, greatest(source, target) AS b, sum(weight) AS weight FROM dir GROUP BY 1, 2, 3)
SELECT doc, id, count(*) AS links, round(sum(weight), 6) AS weight FROM (SELECT doc, a AS id, weight FROM e UNION ALL SELECT doc, b, weight FROM e) GROUP BY doc, id""",
    "classification_lists": """SELECT p_brand AS doc_id, p_name || ' ' || p_partkey AS entity, CASE WHEN p_size <= 15 THEN 'METHOD' WHEN p_size <= 30 THEN 'DOMAIN' ELSE 'unclassified' END AS class FROM part""",
    "stored_documents": "SELECT doc_id, lang, source, md5(text) AS text_md5 FROM documents",
    "extraction_rounds": f"""WITH {_ENTITIES}, n AS (SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, len(list_filter(ws, lambda w: length(w) >= 13)) AS n0, len(list_filter(ws, lambda w: length(w) >= 11)) AS n1, len(ws) AS n2 FROM x),
m AS (SELECT a.doc_id, a.chunk_index, count(*) FILTER (b.ord = a.ord + 1) AS m0, count(*) FILTER (b.ord <= a.ord + 2) AS m1, count(*) FILTER (b.ord <= a.ord + 3) AS m2
    FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.chunk_index = b.chunk_index AND b.ord > a.ord AND b.ord <= a.ord + 3 AND a.name <> b.name GROUP BY ALL),
j AS (SELECT n.*, coalesce(m0, 0) AS m0, coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2 FROM n LEFT JOIN m USING (doc_id, chunk_index))
SELECT doc_id, chunk_index, CAST(1 + (n0 < 3)::INT + (n0 < 3 AND n1 < 3)::INT AS BIGINT) AS entity_turns, CAST(n0 + CASE WHEN n0 < 3 THEN n1 + CASE WHEN n1 < 3 THEN n2 ELSE 0 END ELSE 0 END AS BIGINT) AS entities,
    CASE WHEN n2 = 0 THEN 0 ELSE CAST(1 + (m0 < 2)::INT + (m0 < 2 AND m1 < 2)::INT AS BIGINT) END AS relation_turns, CAST(m0 + CASE WHEN m0 < 2 THEN m1 + CASE WHEN m1 < 2 THEN m2 ELSE 0 END ELSE 0 END AS BIGINT) AS relations FROM j""",
    "output_folders": """SELECT n_nationkey, CAST(k AS INT) AS k, folder FROM (SELECT n_nationkey, unnest([0, 1, 2, 3, 4]) AS k, unnest(['out/' || n_name, 'out/' || n_name, NULL, '/' || n_name || '.v1/eval', '.']) AS folder FROM nation)""",
}
