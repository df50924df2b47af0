"""Near-duplicate embeddings by spherical-cap filters (operator 9).

The filters are caps around the words of a structured random product code: the space is turned at random and
cut into BLOCKS parts with so many unit vectors (codewords) each, and a filter's direction is one codeword from each
part, so scores of all codewords ** BLOCKS directions are sums of a few. List decoding keeps, part by part, the
prefixes that can still reach a vector's threshold. A vector joins every filter whose direction it exceeds
its threshold for: its own best score less a margin of MARGIN standard deviations by which the scores of two
vectors at the least cosine differ, in any number of dimensions. Vectors of one label that share a filter meet and
are verified in double precision.

The number of filters follows the largest label, FILL vectors to a filter, so that the pairs compared grow little
faster than the vectors. Equal vectors are collapsed first. A bucket of more than CELL vectors is dealt out as
pairs of blocks, each its own task's work; tasks return counts and one link per vector and class, never pairs.
A pair that meets in several filters is counted in the first. The recall against brute force is in the tests
and the README.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.tables import staged

COSINE = 0.98
#: Codewords of a part: from the first to the second number, as the table's size asks.
BLOCKS, CODEWORDS = 2, (24, 8192)
FILL, MARGIN = 4, 2.0
CELL = 1024


def codewords(largest: int) -> int:
    """How many codewords a part has for a label of so many vectors."""
    return int(min(max(np.ceil(max(largest, 1) / FILL) ** (1 / BLOCKS), CODEWORDS[0]), CODEWORDS[1]))


@lru_cache(4)
def code(size: int, count: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The turn, and the codewords of each part."""
    rng = np.random.default_rng(9)
    turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
    parts = [len(p) for p in np.array_split(np.arange(size), BLOCKS)]
    words = [rng.normal(size=(count, n)) for n in parts]
    return turn, [w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9) / np.sqrt(BLOCKS) for w in words]


def decode(unit: np.ndarray, count: int, margin: float, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all directions that each unit vector exceeds its threshold for, by row."""
    turn, words = code(unit.shape[1], count)
    cuts = np.cumsum([0] + [w.shape[1] for w in words])
    turned = unit @ turn
    scores = [turned[:, a:b] @ w.T for a, b, w in zip(cuts, cuts[1:], words)]
    least = sum(s.max(1) for s in scores) - margin * np.sqrt((2 - 2 * cosine) / unit.shape[1])
    row, filt, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for k, s in enumerate(scores):
        rest = sum((x.max(1) for x in scores[k + 1 :]), np.zeros(len(unit)))
        found = []
        for at in range(0, len(row), 1024):
            ways = total[at : at + 1024, None] + s[row[at : at + 1024]]
            prefix, word = np.nonzero(ways >= (least - rest)[row[at : at + 1024], None])
            found.append((prefix + at, word, ways[prefix, word]))
        prefix, word, ways = (np.concatenate(x) for x in zip(*found))
        row, filt, total = row[prefix], filt[prefix] * count + word, ways
    return row, filt


def _filters(count: int, margin: float, cosine: float):
    schema = pa.schema([("label", pa.int64()), ("size", pa.int64()), ("filter", pa.int64()), ("rep", pa.int64()), ("copies", pa.int64()), ("unit", pa.binary()), ("filters", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                vectors = [np.array(v, np.float64) for v in part.column("embedding").to_pylist()]
                for size in sorted({len(v) for v in vectors}):  # vectors of other lengths never meet
                    own = np.array([i for i, v in enumerate(vectors) if len(v) == size])
                    unit = np.stack([vectors[i] for i in own])
                    unit /= np.abs(unit).max(1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    row, filt = decode(unit, count, margin, cosine)
                    lists = np.split(filt, np.cumsum(np.bincount(row, minlength=len(own)))[:-1])
                    packed, raw = [x.tobytes() for x in lists], [u.tobytes() for u in unit]
                    take = pa.array(own[row])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("label").take(take), pa.array(np.full(len(filt), size)), pa.array(filt), part.column("rep").take(take), part.column("copies").take(take), pa.array([raw[i] for i in row], pa.binary()), pa.array([packed[i] for i in row], pa.binary())],
                        schema=schema,
                    )

    return run


_OUT = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _verify(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        here = table.column("filter")[0].as_py()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block = table.column("block").to_numpy()
        table = table.take(np.lexsort((table.column("rep").to_numpy(), block != i)))
        first = int((block == i).sum())
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        unit = np.stack([np.frombuffer(x.as_py(), np.float64) for x in table.column("unit")])
        # what comes before this filter: a pair that shares any of it is counted there
        below = [(f := np.frombuffer(x.as_py(), np.int64))[f < here] for x in table.column("filters")]
        before = np.full((len(rep), max(map(len, below), default=0)), -1, np.int64)
        for k, f in enumerate(below):
            before[k, : len(f)] = f
        a, b = (np.arange(len(rep)),) * 2 if i == j else (np.arange(first), np.arange(first, len(rep)))
        links, near = np.zeros(len(rep), np.int64), []
        for at in range(0, len(a), 128):
            rows = a[at : at + 128]
            linked = unit[rows] @ unit[b].T >= cosine
            if i == j:
                linked &= rows[:, None] != b[None, :]
            x, y = np.nonzero(linked)
            new = np.ones(len(x), bool)
            for k in range(0, len(x), 8192):
                p, q = before[rows[x[k : k + 8192]]], before[b[y[k : k + 8192]]]
                for f in range(p.shape[1]):
                    new[k : k + 8192] &= ~((p[:, f, None] == q) & (p[:, f, None] >= 0)).any(1)
            np.add.at(links, rows[x[new]], copies[b[y[new]]])
            if i != j:
                np.add.at(links, b[y[new]], copies[rows[x[new]]])
            near.append((rows, np.packbits(linked, axis=1)))
        # classes within the cell: the smallest row number that links reach, in both directions
        root = np.arange(len(rep))
        while True:
            before = root.copy()
            for rows, bits in near:
                linked = np.unpackbits(bits, axis=1, count=len(b)).astype(bool)
                root[rows] = np.minimum(root[rows], np.where(linked, root[b][None, :], len(rep)).min(1, initial=len(rep)))
                root[b] = np.minimum(root[b], np.where(linked, root[rows][:, None], len(rep)).min(0, initial=len(rep)))
            root = root[root]
            if (root == before).all():
                break
        keep = (links > 0) | (root != np.arange(len(rep)))
        return pa.table([pa.array(rep[keep]), pa.array(links[keep]), pa.array(rep[root][keep])], schema=_OUT)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, margin: float = MARGIN, cell: int = CELL) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of vectors.

    Vectors are linked if their labels are equal and not null and their cosine is at least cosine. Null or empty
    vectors, zero vectors and those with null or non-finite components link with nothing; so do rows with a
    null id (component_id null, kept true) or a null label. Vectors of different lengths don't link. Rows of one id are one node:
    equal rows don't count as links of each other. Extra columns play no part. Empty table: empty result.
    """
    v = F.col("embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    sound = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    plain = F.transform(v, lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    keys = [F.when(sound, F.xxhash64(F.lit(k), "label", plain)).alias(f"s{k}") for k in (1, 2)]
    rows = staged(rows.select("id", "label", *keys, F.when(sound, plain).alias("embedding")), "vectors")
    same = ["label", "s1", "s2"]
    distinct = rows.where("embedding is not null").dropDuplicates(["id", *same])
    alike = staged(distinct.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "alike")

    largest = alike.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    caps = alike.select("label", "rep", "copies", "embedding").mapInArrow(_filters(codewords(largest), margin, cosine), "label long, size long, filter long, rep long, copies long, unit binary, filters binary")
    caps = staged(caps, "caps")
    large = caps.groupBy("label", "size", "filter").agg(F.ceil(F.count("*") / cell).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = caps.join(large, ["label", "size", "filter"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = dealt.select("*", F.explode(F.expr("transform(sequence(0, blocks - 1), k -> named_struct('i', least(block, k), 'j', greatest(block, k)))")).alias("c")).select("label", "size", "filter", "c.i", "c.j", "block", "rep", "copies", "unit", "filters")
    found = staged(cells.groupBy("label", "size", "filter", "i", "j").applyInArrow(_verify(cosine), "rep long, links long, root long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    copies = distinct.join(alike.select(*same, "rep", "copies"), same).select("id", "rep", "copies")
    classes = components(found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(copies.where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))))
    counts = copies.join(links, "rep", "left").groupBy("id").agg(F.sum(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("id").join(counts, "id", "left").join(classes, F.col("id") == F.col("node"), "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


#: The same rows in DuckDB SQL: all pairs of a label, and what links reach.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
sound AS (SELECT vec_id, label, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
counts AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
lowest AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(low, vec_id), vec_id) AS component_id, coalesce(low >= vec_id, TRUE) AS kept
FROM embeddings LEFT JOIN counts ON counts.node = vec_id LEFT JOIN lowest ON lowest.node = vec_id
"""
