"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_ID = -(2**63)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only; a further column whose name differs in case, or repeats, does no harm."""
    place = {}
    for i, name in enumerate(df.columns):
        place.setdefault(name, i)
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select(*[flat[f"_c{place[n]}"].alias(n) for n in names])


def one_case(df: DataFrame) -> DataFrame:
    """All columns but those whose name repeats another's, in any case; of such, one with a name that the first spelling of `documents` has, or else the first, stays."""
    names = df.columns
    held: dict[str, int] = {}
    for i in sorted(range(len(names)), key=lambda i: (names[i] != names[i].lower(), i)):
        held.setdefault(names[i].lower(), i)
    keep = sorted(held.values())
    return df if len(keep) == len(names) else by_place(df).select(*[f"_c{i}" for i in keep]).toDF(*[names[i] for i in keep])


def by_place(df: DataFrame) -> DataFrame:
    """The columns named _c0, _c1, ..., so that no name of theirs clashes with one that an operator adds."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def with_place(df: DataFrame, file: str, row: str) -> DataFrame:
    """Adds where each row stands: its file and its number in it; of a table not read from Parquet, "" and a number that follows the order of rows."""
    try:
        about = df.metadataColumn("_metadata")
        return df.select("*", about["file_path"].alias(file), about["row_index"].alias(row))
    except AnalysisException:
        return df.select("*", F.lit("").alias(file), F.monotonically_increasing_id().alias(row))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is set, one of our own in local mode. A cluster has to name one that all executors share."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return _own_dir()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quarry-")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and lost with no executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bind(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str, rows: int = 4096, weight: str | None = None) -> DataFrame:
    """Adds the long column `rank`: 0, 1, 2, ... within each value of keys, by order; or the sum of `weight` over the rows before.

    A key may hold most of all rows: rows are dealt into buckets by a hash of the
    order columns, numbered inside (key, bucket), and shifted by the rows of the
    key's earlier buckets, which are counted first. Ranks follow the hash, not the
    order's values. Rows equal in keys and order take ranks in either order.
    """
    from pyspark.sql import Window as W

    # the sum, unlike count(), reads the columns that follow anyhow
    n = df.count()
    buckets = max(1, -(-n // rows))
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = df.groupBy(*keys, "_b").agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    inside = W.partitionBy(*keys, "_b").orderBy(*order)
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    numbered = df.withColumn("_r", F.coalesce(F.sum(weight).over(earlier), F.lit(0)) if weight else F.row_number().over(inside) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_b") == F.col("_kb")]
    return numbered.join(shift, on, "left").withColumn(rank, F.col("_r").cast("long") + F.col("_s")).drop("_b", "_kb", "_r", "_s", *[f"_k{i}" for i in range(len(keys))])


def fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])
