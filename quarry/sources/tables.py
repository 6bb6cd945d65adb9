"""Index tables on disk: upsert, journal, snapshots, caches."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import upsert


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quarry-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the folder in spark.checkpoint.dir; where none is set, one of our own in local mode. A cluster has to name one that all executors share."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(path or _own_dir()).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table under the shared folder, worked out once."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_index(rows: DataFrame, path: str, by: str = "collection", parts: int = 32) -> None:
    """A Parquet table with a folder for each collection, so that a reader of one prunes the others; a large one is written by `parts` tasks."""
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c != by]), F.lit(parts))
    rows.repartition(F.col(by), salt).write.mode("overwrite").partitionBy(by).parquet(path)


def merge(spark: SparkSession, path: str, version: int, incoming: DataFrame, key: str) -> str:
    """Writes version + 1 of a table: stored rows that incoming does not replace, and incoming. Old versions stay readable."""
    stored = spark.read.parquet(f"{path}/v{version}")
    upsert(stored, incoming.select(stored.columns), key).write.parquet(f"{path}/v{version + 1}")
    return f"{path}/v{version + 1}"


def unfinished(journal: DataFrame) -> DataFrame:
    """Transactions (tx_id) that began and neither committed nor rolled back."""
    ended = F.max(F.col("action").isin("COMMIT", "ROLLBACK").cast("int"))
    return journal.groupBy("tx_id").agg(ended.alias("ended"), F.min("at").alias("began")).where("ended = 0").drop("ended")


def snapshot(rows: DataFrame, path: str) -> str:
    """Writes the rows and returns a checksum that does not depend on their order."""
    rows.write.mode("overwrite").parquet(path)
    return checksum(rows.sparkSession.read.parquet(path))


def checksum(rows: DataFrame) -> str:
    mark = F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(mark), F.lit(0))).first()
    return f"{n}:{total}"


def live(cache: DataFrame, now: Column) -> DataFrame:
    """Cache rows that have not expired."""
    return cache.where(F.col("expires_at") >= now)


def lookup(keys: DataFrame, cache: DataFrame, key: str, now: Column) -> DataFrame:
    """keys with the cached value, null on a miss."""
    return keys.join(live(cache, now).select(key, "value"), key, "left")
