"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local master may lack it: there the driver's folder is every task's folder. Elsewhere a missing setting is an error.
    """
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        where = tempfile.mkdtemp(prefix="fieldloom-")
        context.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_dir(spark)}/fieldloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet and read it again: what lies before is never computed twice, whatever executor is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most rows of a table that is broadcast after a count.
SMALL_ROWS = 10_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted to have at most ``most`` (narrow) rows; as it is beyond."""
    return F.broadcast(df) if df.count() <= most else df
