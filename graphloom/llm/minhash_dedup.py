"""Near-duplicate documents by MinHash with tensored banding (operator 10).

A few small hash collections of a few minhashes each take the place of one long signature: every pair of
collections forms a table, and a table's key is the two collections together. COLLECTIONS * WIDTH = 30
minhashes serve 45 tables of 6 hashes each, which would take 270 minhashes one by one. Two texts share a key
if they agree on two whole collections: a pair at similarity 0.85 does so with probability 0.9987, at 0.9
with 0.99994. Candidates are then verified on the full shingle sets.

Texts with one and the same shingle set are first collapsed to one row, so groups of exact copies cost
nothing later. In each bucket (a table's key) the first text is held against all others. Buckets whose
texts are then still in several classes are looked at pair by pair, without those pairs that bounds exclude
for certain: by the shingles that no other text of such buckets has (two texts share at most what either
has in common with any), and by distances to the first text that differ too much (the Jaccard distance is
a metric). No bucket is capped.

A node is an id with its text. An id that names one text only is its own node; where it names several, the
text of the smallest hash has the id and each other one a number of its own, a 64-bit hash of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.tables import drop, staged
from graphloom.llm.words import mix, slices, words

SHINGLE = 5
SIMILARITY = 0.85
COLLECTIONS, WIDTH = 10, 3
#: Times that texts with too many shingles of their own are set aside before the last pairs are formed.
PRUNINGS = 2
#: Ids of candidate texts that may be broadcast; beyond that the texts are joined by a shuffle.
BROADCAST_IDS = 200_000


def shingles(hashes: np.ndarray, doc_at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin."""
    lengths = np.diff(doc_at)
    weights = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(len(hashes) - k + 1, 0)
    runs = np.zeros(n, np.uint64)
    for j in range(k):
        runs += hashes[j : j + n] * weights[j]
    runs = mix(runs)
    sets, at = [], np.zeros(len(lengths) + 1, np.int64)
    for i, length in enumerate(lengths):
        first = doc_at[i]
        if length >= k:
            s = np.unique(runs[first : first + length - k + 1])
        elif length:
            s = mix(np.sum(hashes[first : first + length] * weights[:length], dtype=np.uint64, keepdims=True) + np.uint64(length))
        else:
            s = runs[:0]
        sets.append(s)
        at[i + 1] = at[i] + len(s)
    return (np.concatenate(sets) if sets else runs[:0]), at


def table_keys(sets: np.ndarray, at: np.ndarray, collections: int, width: int) -> np.ndarray:
    """One key per text that has shingles and pair of collections."""
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return np.zeros((0, collections * (collections - 1) // 2), np.int64)
    rng = np.random.default_rng(10)
    joint = np.zeros((collections, len(full)), np.uint64)
    for c in range(collections):
        for _ in range(width):
            a, b = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
            least = np.minimum.reduceat(sets * (a << np.uint64(1) | np.uint64(1)) + b, at[full])
            joint[c] = mix(joint[c] + least)
    keys = [mix(joint[i] * np.uint64(3) + mix(joint[j] + np.uint64(i * collections + j))) for i in range(collections) for j in range(i + 1, collections)]
    return np.stack(keys, 1).view(np.int64)


def _profile(size: int, collections: int, width: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w = words(part.column("text"))
            sets, at = shingles(w.hashes, w.doc_at, size)
            n = np.diff(at)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sets, dtype=np.uint64)])
            other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets + np.uint64(7)), dtype=np.uint64)])
            keys = table_keys(sets, at, collections, width)
            lists = np.concatenate([np.zeros(1, np.int32), np.cumsum(np.where(n > 0, keys.shape[1], 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n), pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)), pa.array((other[at[1:]] - other[at[:-1]]).view(np.int64)), pa.ListArray.from_arrays(pa.array(lists), pa.array(keys.reshape(-1)))],
                schema=schema,
            )

    return run


def _sets(size: int):
    schema = pa.schema([("id", pa.int64()), ("words", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w = words(part.column("text"))
            sets, at = shingles(w.hashes, w.doc_at, size)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))], schema=schema)

    return run


def _texts_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, words): the shingle sets of the texts whose ids are given."""
    few = ids.count() <= BROADCAST_IDS
    wanted = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return wanted.dropDuplicates(["id"]).mapInArrow(_sets(size), "id long, words array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with jaccard and whether they are linked."""
    a, b = (texts.select(F.col("id").alias(x), F.col("words").alias(f"{x}_words")) for x in "ab")
    shared = F.size(F.array_intersect("a_words", "b_words")).cast("long")
    both = pairs.join(b, "b").join(a, "a").select("a", "b", shared.alias("i"), (F.size("a_words") + F.size("b_words")).cast("long").alias("t"))
    return both.select("a", "b", (F.col("i") / (F.col("t") - F.col("i"))).alias("jaccard"), (100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).alias("linked"))


def _apart(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of those buckets whose texts are in more than one class."""
    return _mixed(placed.join(classes, placed.rep == classes.node, "left").select("key", "rep", "n", "off", F.coalesce("component", "rep").alias("component")))


def _mixed(at: DataFrame) -> DataFrame:
    keys = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    return at.join(keys, "key", "left_semi")


def _linkable(apart: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Without the texts that hold too many shingles of their own to be linked with any other text here.

    What two texts share is at most what either shares with anyone. So a text whose shingles found in
    another text are under 85 % of its own cannot reach 0.85 with any of them.
    """
    reps = apart.select("rep", "n").distinct()
    alone = texts.join(reps, texts.id == reps.rep).select("rep", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("k"), F.min("rep").alias("rep")).where("k = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    own = reps.join(alone, "rep", "left").select("rep", F.coalesce("alone", F.lit(0)).alias("own")).where(f"100 * (n - own) >= {percent} * n")
    return _mixed(apart.drop("own").join(own, "rep"))


def _crossed(apart: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of a bucket that are in different classes, but for those the shingles of their own or the first leader's distances exclude."""
    other = apart.select("key", *(F.col(c).alias(f"{c}_b") for c in ("rep", "n", "own", "component", "off", "keys")))
    near = f"rep < rep_b and component != component_b and abs(off - off_b) <= {1 - percent / 100 + 1e-9} and 100 * least(n - own, n_b - own_b) >= {percent} * (n + n_b - least(n - own, n_b - own_b)) and key = array_min(array_intersect(keys, keys_b))"
    return apart.join(other, "key").where(near).select(F.col("rep").alias("a"), F.col("rep_b").alias("b")).distinct()


def _several(docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """(id, least): the ids that name different texts, with the smallest hash of them; None if there are none."""
    hashed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h")).where("id is not null")
    found = staged(hashed.groupBy("id").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least != most").select("id", "least"), "several")
    return None if found.isEmpty() else found


def _with_nodes(docs: DataFrame, several: DataFrame | None, id_col: str, text_col: str, name: str) -> DataFrame:
    """docs with a column of that name: each row's node."""
    own = F.col(id_col).cast("long")
    if several is None:
        return docs.withColumn(name, own)
    ids = several.select(F.col("id").alias(f"{name}_id"), F.col("least").alias(f"{name}_least"))
    near = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, own == F.col(f"{name}_id"), "left")
    h = F.xxhash64(F.col(text_col).cast("string"))
    return near.withColumn(name, F.when(h != F.col(f"{name}_least"), F.xxhash64(own, h, F.lit(10))).otherwise(own)).drop(f"{name}_id", f"{name}_least")


def _classes(docs: DataFrame, percent: int, shingle: int, collections: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, ...) of docs (id, text), one row per row, and (node, component) of those that are linked; equal ids hold equal texts."""
    rows = staged(docs.mapInArrow(_profile(shingle, collections, width), "id long, n long, s1 long, s2 long, keys array<long>"), "minhash")
    named = rows.where("n > 0 and id is not null")

    # texts of one set stand as one: its smallest id
    alike = staged(named.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")), "sets")
    keyed = alike.select("rep", "n", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).where("size > 1")
    members = staged(keyed.join(buckets, "key").select("key", "leader", "rep", "n"), "buckets")

    led = members.where("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = staged(led, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = staged(_texts_of(docs, ids, shingle), "texts")
    tested = staged(_verified(pairs, texts, percent), "tested")
    off = tested.select(F.col("a").alias("leader"), F.col("b").alias("rep"), (1 - F.col("jaccard")).alias("off"))
    placed = staged(members.join(off, ["leader", "rep"], "left").select("key", "rep", "n", F.coalesce("off", F.lit(0.0)).alias("off")), "placed")
    links = tested.where("linked").select("a", "b")
    classes = staged(components(links), "classes")
    apart = staged(_apart(placed, classes), "apart")
    drop(members, placed)
    for _ in range(PRUNINGS):
        last, apart = apart, staged(_linkable(apart, texts, percent), "apart")
        drop(last)
    crossed = staged(_crossed(apart.join(alike.select("rep", "keys"), "rep"), percent).join(tested, ["a", "b"], "left_anti"), "pairs")
    later = _verified(crossed, texts, percent).where("linked").select("a", "b")
    known = classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(later)
    same_set = named.join(alike.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    # components() writes its links before it returns, so only rows is read after it
    final = components(known.unionByName(same_set))
    drop(alike, pairs, texts, tested, classes, apart, crossed)
    return rows, final


def _nodes_kept(docs: DataFrame, several: DataFrame | None, percent: int, shingle: int = SHINGLE, collections: int = COLLECTIONS, width: int = WIDTH) -> DataFrame:
    """(node, id, n_shingles, component_id, kept), one row per row of docs (id, node, text)."""
    rows, final = _classes(docs.select(F.col("node").alias("id"), "text"), percent, shingle, collections, width)
    if several is None:
        found = rows.join(final, rows.id == final.node, "left").select("id", F.col("id").alias("node"), "n", "component")
    else:
        # a class goes by the smallest id of its texts
        ids = staged(docs.where("node != id").select("node", "id").distinct(), "ids").select(F.col("node").alias("other"), F.col("id").alias("of"))
        named = lambda df, node: df.join(ids, df[node] == ids.other, "left").withColumn("real", F.coalesce("of", node)).drop("other", "of")
        final = staged(final, "classes")
        least = named(final, "node").groupBy("component").agg(F.min("real").alias("least"))
        final = final.join(least, "component").select("node", F.col("least").alias("component"))
        found = named(rows.join(final, rows.id == final.node, "left").drop("node"), "id").select(F.col("real").alias("id"), F.col("id").alias("node"), "n", "component")
    return found.select("node", "id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, collections: int = COLLECTIONS, width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row per row of docs; other columns of docs play no part.

    id_col holds whole numbers that name rows. component_id is the smallest id that verified links reach.
    Null or wordless texts have no shingles and no links; a text of fewer words than a shingle is one
    shingle. Repeated rows (one id, one text) share a result. Different texts under one id are linked, or not, each on its
    own; they need not share a class. A null id gets a null component_id and kept true, and links nothing.
    Ties: of a class's texts only its smallest id decides. An empty table gives an empty result.
    """
    several = _several(docs, id_col, text_col)
    text = F.col(text_col).cast("string").alias("text")
    nodes = _with_nodes(docs.select(F.col(id_col).cast("long").alias("id"), text), several, "id", "text", "node")
    return _nodes_kept(nodes, several, round(100 * similarity), shingle, collections, width).drop("node")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that are kept: of each class of near-duplicates, those with its smallest id. All columns as they are.

    Null and wordless texts stay; so do rows with a null id. Repeated rows stay or go together; of different texts under
    one id only those in a class with a smaller id go. Empty table: empty result.
    The rows that go are few beside the rest; up to BROADCAST_IDS of them are sent to the texts, more are joined by a shuffle.
    """
    several = _several(docs, id_col, text_col)
    name = "node" + "_" * max(map(len, docs.columns))
    noded = _with_nodes(docs, several, id_col, text_col, name)
    own = noded.select(F.col(id_col).cast("long").alias("id"), F.col(name).alias("node"), F.col(text_col).cast("string").alias("text"))
    found = _nodes_kept(own, several, round(100 * similarity))
    gone = staged(found.where("not kept").select(F.col("node").alias(name)).distinct(), "gone")
    return noded.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, name, "left_anti").select(docs.columns)


#: The same rows in DuckDB SQL: all pairs of texts that share a shingle, and what links reach.
SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (SELECT doc_id, len(words) AS n_words, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split),
runs AS (SELECT doc_id, n_words, place, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
s AS (SELECT DISTINCT doc_id, shingle FROM runs WHERE place <= greatest(n_words - 4, 1)),
sized AS (SELECT split.doc_id, count(shingle) AS n FROM split LEFT JOIN s USING (doc_id) GROUP BY split.doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS other FROM ways UNION SELECT r.node, w.b FROM reach r JOIN ways w ON r.other = w.a),
lowest AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, coalesce(least(low, doc_id), doc_id) AS component_id, coalesce(low >= doc_id, TRUE) AS kept FROM sized LEFT JOIN lowest ON node = doc_id
"""
