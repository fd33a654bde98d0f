"""Fixing intermediate tables where every executor can read them again."""

from __future__ import annotations

import gc
import pickle
import time
from collections.abc import Callable
from typing import TypeVar

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession

from tallyspark.session import checkpoint_dir


Shared = TypeVar("Shared")


def share(spark: SparkSession, value: Shared) -> tuple[Callable[[], Shared], Broadcast]:
    """Broadcasts an object of this package's classes, code included; the
    function gives it back inside a task (one copy per call)."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value), sent


def fixed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's checkpoint folder
    (``spark.checkpoint.dir``); lost executors cost nothing that is in it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished, unreferenced steps now
    instead of when the driver next happens to collect its garbage."""
    for _ in range(2):  # Python's handles first, then what they kept alive
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote, through Spark's file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """``df`` with its columns called c0, c1, ..., which no operator uses for
    its own columns, and the function that gives a column's new name."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))), lambda name: f"c{df.columns.index(name)}"


def renamed(df: DataFrame, columns: list[str], new: Callable[[str], str]) -> list[Column]:
    """These columns of the caller, under their own names again."""
    return [df[new(c)].alias(c) for c in columns]


def row_key(id_col: str, text_col: str) -> list:
    """Columns that tell rows apart by id and text, with nulls told from
    values: for joins back to a table whose ids may repeat or be null."""
    from pyspark.sql import functions as F
    return [F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("_id"),
            F.xxhash64(F.col(id_col).isNull(), F.col(text_col).isNull(), F.col(text_col)).alias("_th")]
