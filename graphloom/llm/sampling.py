"""Bounded samples of rows for fitting, sums of arrays over tasks, and texts in groups for dense features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.words import slices


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def spread(column: str, seed: int) -> Column:
    """A number in [0, 1) that the column's value determines, fine enough (53 bits) for a share of any table."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 11) / F.lit(2.0**53)


def distinct_sample(texts: DataFrame, most: int, total: int, seed: int) -> DataFrame:
    """About most of total rows of a column text: by hash, each text once, so that copies do not swell the sample."""
    return texts.where(spread("text", seed) < F.lit(min(1.0, most / max(total, 1)))).distinct()


def first_by_hash(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most this many rows, the same ones each time: those with the smallest hashes of the key."""
    return rows.orderBy(F.xxhash64(key, F.lit(4)), key).limit(most)


def groups(batches: Iterator[pa.RecordBatch], rows: int = 256, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches of about 1 MB of text and at most so many rows."""
    for part in slices(batches, column):
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


#: Arrays are summed in PARTS pieces, first over SALTS tasks each and then over these groups.
PARTS, SALTS = 64, 32


def parts_of(array: np.ndarray) -> pa.RecordBatch:
    """A task's array as PARTS rows, for summed()."""
    salt = TaskContext.get().partitionId() // SALTS
    return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int64()), pa.array([salt] * PARTS, pa.int64()), pa.array([x.tobytes() for x in np.array_split(array.reshape(-1).astype(np.float64), PARTS)], pa.binary())], names=["part", "salt", "sums"])


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of this task's pieces, added up as they come: never more than one array of each in memory."""
    totals: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for part, salt, x in zip(*(c.to_pylist() for c in batch.columns)):
            own = totals.setdefault((part, salt), np.zeros(len(x) // 8))
            own += np.frombuffer(x)
    rows = [(part, salt, x.tobytes()) for (part, salt), x in totals.items()]
    for part, salt, x in rows:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([salt], pa.int64()), pa.array([x], pa.binary())], names=["part", "salt", "sums"])


#: The columns of parts_of.
SUMS = "part long, salt long, sums binary"


def summed(df: DataFrame, run) -> np.ndarray | None:
    """The sum over all tasks of the arrays that run makes of df's partitions (parts_of); None without partitions."""
    return total_of(df.mapInArrow(run, SUMS))


def total_of(parts: DataFrame) -> np.ndarray | None:
    """The sum of all tasks' arrays, whose rows (parts_of) these are; None without rows.

    Two steps, so that no task reads a row of every task: by piece and group of tasks, then by piece. The second shuffles an array
    for each group, not for each task: one where there are few tasks.
    """
    rows = parts.repartition("part", "salt").mapInArrow(_total, SUMS)
    whole = rows.withColumn("salt", F.lit(0).cast("long")).repartition("part").mapInArrow(_total, SUMS).collect()
    return np.concatenate([np.frombuffer(bytes(r.sums)) for r in sorted(whole, key=lambda r: r.part)]) if whole else None
