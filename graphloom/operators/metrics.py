"""Coverage, precision, recall and F1 by class and overall, strict and adjusted for novel finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def harmonic(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


def counts(gold: DataFrame, extracted: DataFrame, matches: DataFrame, novel: DataFrame, compat: bool = True, least_novelty: float = 0.7, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, class, gold, tp, fp, fn, novel) for each class; keys name a run and document, and all four tables have them.

    gold, extracted: (entity, class); matches: (gold); novel: (entity, novelty). compat compares raw spellings, so that fp
    counts list entries not literally in the gold class and fn gold entries not literally extracted; otherwise fn are the
    gold entities without a match, and fp the distinct extracted entities beyond the matches.
    """
    pair, by = [*keys, "entity", "class"], [*keys, "class"]
    g = gold.select(*pair).distinct()
    matched = matches.select(*keys, F.col("gold").alias("entity")).distinct().withColumn("hit", F.lit(1))
    hit = g.join(matched, [*keys, "entity"], "left").join(extracted.select(*pair).distinct().withColumn("literal", F.lit(1)), pair, "left")
    tp = F.count("hit")
    own = hit.groupBy(*by).agg(F.count("*").alias("gold"), tp.alias("tp"), (F.count("*") - (F.count("literal") if compat else tp)).alias("fn"))
    e = extracted.select(*pair) if compat else extracted.select(*pair).distinct()
    other = e.join(g.withColumn("known", F.lit(1)), pair, "left").groupBy(*by).agg(F.count("*").alias("size"), (F.count("*") - F.count("known")).alias("wrong"))
    found = novel.where(F.col("novelty") >= least_novelty).select(*keys, "entity").distinct()
    new = extracted.select(*pair).distinct().join(found, [*keys, "entity"], "left_semi").groupBy(*by).agg(F.count("*").alias("novel"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = own.join(other, by, "full").join(new, by, "left")
    fp = zero(F.col("wrong")) if compat else F.greatest(zero(F.col("size")) - zero(F.col("tp")), F.lit(0))
    return out.select(*by, zero(F.col("gold")).alias("gold"), zero(F.col("tp")).alias("tp"), fp.alias("fp"), zero(F.col("fn")).alias("fn"), zero(F.col("novel")).alias("novel"))


def scores(by_class: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row per class and one for all (class null), for each of keys, from one pass of grouping sets: strict and adjusted precision, recall, F1."""
    sums = by_class.groupingSets([[*keys, "class"], list(keys)], *keys, "class").agg(*(F.sum(c).alias(c) for c in ("gold", "tp", "fp", "fn", "novel")))
    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "novel"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    ap, ar = _ratio(tp + n, tp + fp), _ratio(tp + n, F.col("gold") + n)
    return sums.select(*keys, "class", "gold", "tp", "fp", "fn", "novel", _ratio(tp, F.col("gold")).alias("coverage"), p.alias("precision"), r.alias("recall"), harmonic(p, r).alias("f1"), ap.alias("adjusted_precision"), ar.alias("adjusted_recall"), harmonic(ap, ar).alias("adjusted_f1"))


def spread(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and standard deviation of a figure over repeated runs."""
    return runs.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"))
