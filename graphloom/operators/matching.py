"""Entities against a gold set: exact, by similarity, and what is left over on either side.

Similarity is computed for few pairs only: the best match is looked for from above. With M matched characters the
ratio is 2M / (la + lb), and M is at most the longest common subsequence and the common characters of the two; these
bounds are computed for many pairs together, and pairs bounded below the best so far are passed over, which loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from graphloom.functions.text import numbers

MERGE, NO_MATCH, DEFER = "MERGE", "NO_MATCH", "DEFER"
#: So many left keys of a document meet so many right ones in one task, and so many cells of a matrix are in memory together.
LEFT_KEYS, RIGHT_KEYS, CELLS = 2_000, 64_000, 1 << 20
#: A character's code point modulo this is its column: printable ASCII has a column each.
COLUMNS = 97


def by_key(entities: DataFrame, key: Column, types: str = "types", doc: tuple[str, ...] = ()) -> DataFrame:
    """One row per normalised key, the type lists of its spellings joined (sorted by spelling)."""
    rows = F.array_sort(F.collect_list(F.struct("entity", types)))
    return entities.withColumn("key", key).groupBy(*doc, "key").agg(F.flatten(F.transform(rows, lambda r: r[types])).alias("types"))


def match_exact(gold: DataFrame, extracted: DataFrame, doc: tuple[str, ...] = ()) -> DataFrame:
    return gold.withColumnRenamed("types", "gold_types").join(extracted.withColumnRenamed("types", "extracted_types"), [*doc, "key"])


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings, in this order (it isn't symmetric)."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def _columns(keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys: their lengths, and of their characters, one after the other, the key and the column. Characters may share a column, which only raises a bound."""
    length = np.array([len(k) for k in keys], np.int64)
    codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32)
    return length, np.repeat(np.arange(len(keys)), length), (codes % COLUMNS).astype(np.int64)


def _counted(row: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, feature), sorted by key: a character's second occurrence in a key is another feature than its first, so that shared features are shared characters."""
    at = np.sort(row * COLUMNS + column)
    begins = np.flatnonzero(np.append(True, np.diff(at) > 0)[: len(at)])
    times = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    return at // COLUMNS, times * COLUMNS + at % COLUMNS


def _dense(row: np.ndarray, feature: np.ndarray, lo: int, hi: int, known: np.ndarray) -> np.ndarray:
    """Keys lo to hi as rows of ones where they have a known feature."""
    out = np.zeros((hi - lo, len(known)), np.float32)
    first, last = np.searchsorted(row, [lo, hi])
    place = np.minimum(known.searchsorted(feature[first:last]), len(known) - 1)
    right = known[place] == feature[first:last]
    out[row[first:last][right] - lo, place[right]] = 1
    return out


def _subsequences(masks: np.ndarray, size: np.ndarray, text: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The longest common subsequence of each left key i of at most 64 characters with right key j, a bit per character of the left key."""
    v = np.full(len(i), ~np.uint64(0))
    for k in range(text.shape[1]):
        m = masks[i, text[j, k]]
        u = v & m
        v = (v + u) | (v - u)
    full = ~np.uint64(0) >> (np.uint64(64) - size[i].astype(np.uint64))
    return size[i] - np.bitwise_count(v & full).astype(np.int64)


def _best(left: list[str], right: list[str], least: float) -> list[tuple[str, str, float]]:
    """(left, right, score): the best right key of each left key, ties to the smaller one, if its ratio is at least least.

    The best is looked for from above. Matched characters are a common subsequence, and that is of common characters: a right
    key whose characters, or whose longest common subsequence, bound its ratio below the best so far (or at it, if the key is
    larger) is passed over. The bounds are computed as the ratio is, so they are never below it.
    """
    left, right = sorted(left, key=len), sorted(right, key=len)
    (la, lrow, lcol), (lb, rrow, rcol) = _columns(left), _columns(right)
    (lown, lfeature), (rown, rfeature) = _counted(lrow, lcol), _counted(rrow, rcol)
    known = np.unique(lfeature) if len(lfeature) else np.zeros(1, np.int64)
    at = np.cumsum(lb) - lb
    best, found = np.zeros(len(left)), [None] * len(left)
    high, matcher = np.full(len(left), least), SequenceMatcher(None)  # high: what a ratio must reach

    def look(i: int, j: int) -> None:
        matcher.set_seqs(left[i], right[j])
        score = matcher.ratio()
        if score >= least and (found[i] is None or score > best[i] or (score == best[i] and right[j] < found[i])):
            best[i] = high[i] = score
            found[i] = right[j]

    begin = 0
    while begin < len(right):
        # so many right keys together that neither their features nor their padded texts are many cells
        stop = min(len(right), begin + max(1, CELLS // max(len(known), 256)))
        while stop > begin + 1 and (stop - begin) * lb[stop - 1] > CELLS:
            stop = begin + max(1, (stop - begin) // 2)
        ones = _dense(rown, rfeature, begin, stop, known)
        text = np.full((stop - begin, max(1, int(lb[stop - 1]))), COLUMNS, np.int64)
        own = slice(at[begin], at[stop - 1] + lb[stop - 1])
        text[rrow[own] - begin, np.arange(own.start, own.stop) - at[rrow[own]]] = rcol[own]
        together = max(1, min(CELLS // (stop - begin), CELLS // len(known)))
        for lo in range(0, len(left), together):
            hi = min(len(left), lo + together)
            # by length alone
            if 2.0 * min(la[hi - 1], lb[stop - 1]) < high[lo:hi].min() * (min(la[hi - 1], lb[stop - 1]) + max(la[lo], lb[begin])) - 1e-9:
                continue
            shared = _dense(lown, lfeature, lo, hi, known) @ ones.T
            total = la[lo:hi, None] + lb[None, begin:stop]
            bound = np.where(total > 0, 2.0 * shared / np.maximum(total, 1), 1.0)
            first = bound.argmax(1)
            for i in np.flatnonzero(bound[np.arange(hi - lo), first] >= high[lo:hi]).tolist():
                look(lo + i, begin + int(first[i]))
            i, j = np.nonzero(bound >= high[lo:hi, None])
            bound, total, short = bound[i, j], total[i, j], la[lo + i] <= 64
            masks = np.zeros((hi - lo, COLUMNS + 1), np.uint64)
            chars = slice(*np.searchsorted(lrow, [lo, hi]))
            place = np.arange(chars.start, chars.stop) - (np.cumsum(la) - la)[lrow[chars]]
            fits = place < 64
            np.bitwise_or.at(masks, (lrow[chars][fits] - lo, lcol[chars][fits]), np.uint64(1) << place[fits].astype(np.uint64))
            held = np.flatnonzero(short & (total > 0) & (la[lo + i] > 0))
            for k in range(0, len(held), CELLS):
                some = held[k : k + CELLS]
                bound[some] = 2.0 * _subsequences(masks, la[lo:hi], text, i[some], j[some]) / total[some]
            near = np.flatnonzero(bound >= high[lo + i])
            near = near[np.lexsort((-bound[near], i[near]))]
            for i_, j_, most in zip((lo + i[near]).tolist(), (begin + j[near]).tolist(), bound[near].tolist()):
                if most > high[i_] or (most == high[i_] and (found[i_] is None or right[j_] < found[i_])):
                    look(i_, j_)
        begin = stop
    return [(a, b, float(s)) for a, b, s in zip(left, found, best) if b is not None]


def best_matches(left: DataFrame, right: DataFrame, least: float, doc: tuple[str, ...] = ()) -> DataFrame:
    """For each left key the right key of the highest ratio(left, right), ties to the smaller key: (left, right, score), scores of at least least.

    Keys meet by document, so many left keys with so many right ones in one task, whatever the document's size.
    """
    a, b = (side.select(*(F.col(d).alias(d) for d in doc), F.col("key").alias(name)).dropna() for side, name in ((left, "a"), (right, "b")))
    parts = lambda side, most, name: side.groupBy(*doc).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    together = lambda x, y: x.join(y, list(doc)) if doc else x.crossJoin(y)
    sizes = together(parts(a, LEFT_KEYS, "m"), parts(b, RIGHT_KEYS, "n"))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    one = lambda key, name: F.pmod(F.xxhash64(key), F.col(name)).cast("int")
    block, tasks = [*doc, "i", "j"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = together(a, sizes).select(*doc, one("a", "m").alias("i"), every("n").alias("j"), "a").repartition(tasks, *block)
    b = together(b, sizes).select(*doc, one("b", "n").alias("j"), every("m").alias("i"), "b").repartition(tasks, *block)
    schema = StructType([*(left.schema[d] for d in doc), *(StructField(c, StringType()) for c in ("a", "b")), StructField("score", DoubleType())])
    names = [f.name for f in schema]

    def run(key: tuple[pa.Scalar, ...], x: pa.Table, y: pa.Table) -> pa.Table:
        rows = _best(x.column("a").to_pylist(), y.column("b").to_pylist(), least) if x.num_rows and y.num_rows else []
        own = [pa.array([key[k].as_py()] * len(rows), key[k].type) for k in range(len(doc))]
        kinds = (pa.string(), pa.string(), pa.float64())
        return pa.table([*own, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=names)

    scored = a.groupBy(*block).cogroup(b.groupBy(*block)).applyInArrow(run, schema)
    best = scored.groupBy(*doc, "a").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("b"))).alias("x"))
    return best.select(*doc, F.col("a").alias("left"), F.col("x.b").alias("right"), (-F.col("x.s")).alias("score"))


def match_fuzzy(gold: DataFrame, extracted: DataFrame, least: float = 0.7, doc: tuple[str, ...] = ()) -> DataFrame:
    """Best match of each gold key that has no exact one."""
    return best_matches(gold.join(extracted.select(*doc, "key"), [*doc, "key"], "left_anti"), extracted, least, doc)


def missed(gold: DataFrame, extracted: DataFrame, fuzzy: DataFrame, doc: tuple[str, ...] = ()) -> DataFrame:
    keys = [*doc, "key"]
    return gold.join(extracted.select(*keys), keys, "left_anti").join(fuzzy.withColumnRenamed("left", "key").select(*keys), keys, "left_anti")


def extracted_only(gold: DataFrame, extracted: DataFrame, fuzzy: DataFrame, strict: bool = False, doc: tuple[str, ...] = ()) -> DataFrame:
    """Extracted keys that aren't matched gold keys; strict also takes away those that a gold key matched by similarity."""
    keys = [*doc, "key"]
    found = extracted.join(gold.select(*keys), keys, "left_anti").join(fuzzy.withColumnRenamed("left", "key").select(*keys), keys, "left_anti")
    return found.join(fuzzy.withColumnRenamed("right", "key").select(*keys), keys, "left_anti") if strict else found


def coverage(gold: DataFrame, extracted: DataFrame, fuzzy: DataFrame, doc: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, total_gold, direct, fuzzy, missed, coverage_pct): one row for all, or one for each of by (columns of doc, the columns that keys are compared within)."""
    keys = [*doc, "key"]
    marked = gold.join(extracted.select(*keys, F.lit(1).alias("direct")).distinct(), keys, "left").join(fuzzy.select(*doc, F.col("left").alias("key"), F.lit(1).alias("fuzzy")).distinct(), keys, "left")
    sums = marked.groupBy(*by).agg(F.count("*").alias("total_gold"), F.count("direct").alias("direct"), F.count("fuzzy").alias("fuzzy"))
    pct = F.when(F.col("total_gold") > 0, (F.col("direct") + F.col("fuzzy")) / F.col("total_gold") * 100).otherwise(0.0)
    return sums.select(*by, "total_gold", "direct", "fuzzy", (F.col("total_gold") - F.col("direct") - F.col("fuzzy")).alias("missed"), pct.alias("coverage_pct"))


def match_counts(validated: DataFrame, adjudicated: DataFrame, by: tuple[str, ...] = (), compat: bool = True) -> DataFrame:
    """(*by, exact, fuzzy, adjudicated, matches, novel): what a validation found, in all or for each of by.

    adjudicated: (*by, entity, pick). matches are distinct gold entities. compat counts as novel every entity that was
    adjudicated, as observed; otherwise those that the judge found no match for.
    """
    none = F.col("pick") == NO_MATCH
    kinds = validated.select(*by, F.col("gold"), *((F.col("kind") == k).cast("int").alias(k) for k in ("exact", "fuzzy")), F.lit(0).alias("adjudicated"), F.lit(0).alias("unmatched"))
    judged = adjudicated.select(*by, F.when(~none, F.col("pick")).alias("gold"), F.lit(0).alias("exact"), F.lit(0).alias("fuzzy"), F.lit(1).alias("adjudicated"), none.cast("int").alias("unmatched"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = kinds.unionByName(judged).groupBy(*by).agg(total("exact"), total("fuzzy"), total("adjudicated"), F.countDistinct("gold").alias("matches"), total("unmatched"))
    return sums.select(*by, "exact", "fuzzy", "adjudicated", "matches", F.col("adjudicated" if compat else "unmatched").alias("novel"))


def exact_spellings(gold: DataFrame, extracted: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """(entity, gold): extracted entities whose key a gold entity has, with its first spelling."""
    g = gold.withColumn("key", key(F.col("entity"))).groupBy("key").agg(F.min(F.struct("ord", "entity")).alias("x")).select("key", F.col("x.entity").alias("gold"))
    return extracted.select("entity", key(F.col("entity")).alias("key")).join(g, "key").select("entity", "gold")


def validate(gold: DataFrame, extracted: DataFrame, key: Callable[[Column], Column], least: float = 0.85, doc: tuple[str, ...] = ()) -> DataFrame:
    """(*doc, entity, kind, gold, score): each extracted entity is exact, fuzzy or left to adjudication.

    gold (entity, ord), extracted (entity). Exact: the first gold spelling of the key. Fuzzy: the best key of all,
    if it is close enough and holds the same numbers; that is asked after the best is chosen.
    """
    g = gold.withColumn("key", key(F.col("entity"))).groupBy(*doc, "key").agg(F.min(F.struct("ord", "entity")).alias("x")).select(*doc, "key", F.col("x.entity").alias("gold"))
    keys = [*doc, "key"]
    e = extracted.select(*doc, "entity", key(F.col("entity")).alias("key"))
    fuzzy = best_matches(e.join(g, keys, "left_anti").select(*keys).distinct(), g, least, doc).where(numbers(F.col("left")) == numbers(F.col("right")))
    exact = e.join(g, keys, "left").withColumnRenamed("gold", "exact")
    near = fuzzy.join(g.withColumnRenamed("key", "right"), [*doc, "right"]).select(*doc, F.col("left").alias("key"), F.col("gold").alias("near"), "score")
    kind = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "fuzzy").otherwise("adjudicate")
    return exact.join(near, keys, "left").select(*doc, "entity", kind.alias("kind"), F.coalesce("exact", "near").alias("gold"), F.when(F.col("exact").isNotNull(), 1.0).otherwise(F.col("score")).alias("score"))


def matches(validated: DataFrame, adjudicated: DataFrame | None = None) -> DataFrame:
    """Distinct gold entities matched in any way."""
    found = validated.where("gold is not null").select("gold")
    return (found if adjudicated is None else found.unionByName(adjudicated.where(f"pick != '{NO_MATCH}'").select(F.col("pick").alias("gold")))).distinct()


def resolve(pairs: DataFrame, rules: list[Callable[[Column, Column], tuple[Column, Column]]], a: str = "a", b: str = "b") -> DataFrame:
    """(decision, confidence) of the first rule that doesn't defer; DEFER with 0 if all do."""
    decision, confidence = F.lit(DEFER), F.lit(0.0)
    for rule in reversed(rules):
        d, c = rule(F.col(a), F.col(b))
        decision, confidence = F.when(d != DEFER, d).otherwise(decision), F.when(d != DEFER, c).otherwise(confidence)
    return pairs.select("*", decision.alias("decision"), confidence.alias("confidence"))
