"""Reading the input tables, and tables kept in the cluster's shared folder between steps."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, that driver and executors share. Unset, a local one where all run in this process (tests), else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return path or "/tmp/checkpoints"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, so a lost executor costs no earlier work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes these tables of staged(), when nothing that is still to be computed reads them."""
    for table in tables:
        _written.remove((table.sparkSession, table.staged_at))
        _delete(table.sparkSession, table.staged_at)


def drop_staged() -> None:
    """Deletes the tables that staged() wrote, when no result that reads them is needed any more."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # noqa: BLE001  the session has ended
            return


atexit.register(drop_staged)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
