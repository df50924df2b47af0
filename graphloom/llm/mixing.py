"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 2).

Targets: the sources share a budget by weight, none above a multiple of its size; what a full source
leaves is shared again by weight among the others. A source's documents are then drawn for its target:
whole epochs first (a target of 1.4 sizes takes each document once), the remaining fraction by exponential
keys -ln(u) / w, w a document's quality weight, in ascending order until the budget's words are reached. The
document across the budget's end is taken if that comes nearer to it.

The running sums need no task per source: keys fall into bins, bins are summed per source, and only within
a (source, bin) are documents sorted. The sort and the join with the bins' sums share one exchange of
narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.tables import staged

WORD = r"[^\x20\x09-\x0D]+"
BINS = 1024
#: Characters that prose has few of; a document's weight falls with their share.
ODD = "*$%&#!|@<>{}[]\\^~_=+0123456789"


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: 1 less four times the share of odd characters; 1 for an empty text."""
    odd = F.length(text) - F.length(F.translate(text, ODD, ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * odd / F.greatest(F.length(text), F.lit(1)))


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) that an id and a seed determine, the same in any engine that has md5."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sizes (source, source_size) with target. One row per source: the windows over all sources are small."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    s = sizes.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    # sources fill up in the order of cap / w; the level is what one unit of weight gets once the full ones are set aside
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("rest", share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("full", F.col("cap") * F.col("w_rest") <= F.col("w") * F.col("rest"))
    rest, w_rest = (F.min_by(x, "w_rest_key").over(every) for x in ("rest_open", "w_open"))
    opened = s.withColumn("rest_open", F.when(~F.col("full"), F.col("rest"))).withColumn("w_open", F.when(~F.col("full"), F.col("w_rest"))).withColumn("w_rest_key", F.when(~F.col("full"), -F.col("w_rest")))
    return opened.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * rest / w_rest).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 2, weight: Column | None = None, bins: int = BINS) -> DataFrame:
    """(id, source, size, weight, source_size, target, taken), one row per row of docs; other columns play no part.

    Sources in code point order, null last, weigh weights in turn. size counts words (null text: 0), taken the
    words the mix takes of a row, repeats counted. weight: a positive column of docs, quality_weight otherwise.
    Rows with equal keys (repeated ids) are drawn in order of id and size. Empty texts take 0 words; a source
    without words has target 0; an empty table gives an empty result.
    """
    text = F.col(text_col)
    w = quality_weight(F.coalesce(text, F.lit(""))) if weight is None else weight
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), w.alias("weight"), (-F.log(uniform(F.col(id_col), seed)) / w).alias("draw"))
    rows = staged(rows.withColumn("bin", F.floor((1 - F.exp(-F.col("draw"))) * bins).cast("int")), "mix")

    sums = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    sizes = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    same = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    plan = before.join(sizes, same(before, sizes, "source")).select(before.source.alias("p_source"), before.bin.alias("p_bin"), "before", "source_size", "target")
    order = Window.partitionBy("source", "bin").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = rows.withColumn("run", F.sum("size").over(order))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    part = F.col("target") - epochs * F.col("source_size")
    inside = F.col("before") + F.col("run") - F.col("size") / 2 <= part
    taken = (epochs * F.col("size") + F.when(inside, F.col("size")).otherwise(0)).cast("long")
    return drawn.join(plan, drawn.source.eqNullSafe(plan.p_source) & (drawn.bin == plan.p_bin)).select("id", "source", "size", "weight", "source_size", "target", taken.alias("taken"))


#: The same rows in DuckDB SQL, with a plain running sum per source. {docs} names the table.
SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':2'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) /
    greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '*$%&#!|@<>{}[]\^~_=+0123456789', ''))) / greatest(length(coalesce(text, '')), 1)) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_rest FROM c
    WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, cap * w_rest <= w * rest AS full_ FROM f),
o AS (SELECT rest AS rest_open, w_rest AS w_open FROM g WHERE NOT full_ ORDER BY w_rest DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE w * (SELECT rest_open FROM o) / (SELECT w_open FROM o) END AS target FROM g),
r AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(epochs * size + CASE WHEN run - size / 2.0 <= target - epochs * source_size THEN size ELSE 0 END AS BIGINT) AS taken FROM r
"""
