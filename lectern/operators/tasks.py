"""Shuffles of as many tasks as their data are worth, so that a task's memory doesn't grow with the tables, and tables that are made once."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the files read that are worth a task of their own: a million rows of `lineitem`, of which a sort holds about 140 bytes each.
FILE_BYTES = 16 << 20
#: What Spark says of the size of tables whose size it doesn't know is beyond this.
_KNOWN = 1 << 50


def source_bytes(df: DataFrame) -> int:
    """Bytes of all files that `df` is made from, as often as it reads them; tables of unknown size count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < _KNOWN)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by `keys` over a task for each FILE_BYTES of their sources, where these are more than the session's shuffles have; small tables stay as they are.

    A shuffle of a window or a join has the session's number of tasks however large the
    tables, and each sort in it holds the task's share of the rows.  A join's other side
    follows the dealt one.
    """
    if df.isStreaming:
        return df
    tasks = math.ceil(source_bytes(df) / FILE_BYTES)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    shared = shared or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared}/files-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Rows that an operator reads several times, made once: a table in the shared folder."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
