"""Collection audits: duplicates, statistics, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def duplicate_groups(rows: DataFrame, key: str, mark: str) -> DataFrame:
    """mark, n, canonical (least key), redundant of each group of two or more; aggregated before the shuffle."""
    return rows.groupBy(mark).agg(F.count("*").alias("n"), F.min(key).alias("canonical")).where("n > 1").withColumn("redundant", F.col("n") - 1)


def duplicate_flags(rows: DataFrame, key: str, mark: str) -> DataFrame:
    """key, is_duplicate, duplicate_of; only groups of two or more meet the rows again."""
    groups = duplicate_groups(rows, key, mark).select(F.col(mark).alias("_m"), "canonical")
    late = F.coalesce(F.col(key) > F.col("canonical"), F.lit(False))
    return rows.join(groups, F.col(mark) == F.col("_m"), "left").select(key, late.alias("is_duplicate"), F.when(late, F.col("canonical")).alias("duplicate_of"))


#: Rows of one key up to which a single task sorts them; keys with more are cut into buckets.
LARGE = 1_000_000


def largest(rows: DataFrame, by: str) -> int:
    """The rows of the largest key; counted in each task before they meet."""
    return rows.groupBy(by).count().agg(F.max("count")).first()[0] or 0


def in_buckets(rows: DataFrame, by: str, value: str, cuts: int = 64) -> DataFrame:
    """Adds _bucket: rows of one key are cut at its approximate quantiles, so that a key with most rows is sorted by many tasks."""
    at = [i / cuts for i in range(1, cuts)]
    bounds = rows.groupBy(by).agg(F.percentile_approx(value, at, 10 * cuts).alias("_cuts")).select(F.col(by).alias("_by"), "_cuts")
    return rows.join(bounds, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c <= F.col(value)))).drop("_by", "_cuts")


def with_before(rows: DataFrame, by: str, weight: str) -> DataFrame:
    """Adds _before, the weight in the key's earlier buckets, and _n, that in all; a key has few buckets."""
    sums = rows.groupBy(by, "_bucket").agg(F.sum(weight).alias("_w"))
    w = W.partitionBy(by).orderBy("_bucket")
    told = sums.select(F.col(by).alias("_by"), F.col("_bucket").alias("_b"), (F.sum("_w").over(w) - F.col("_w")).alias("_before"), F.sum("_w").over(W.partitionBy(by)).alias("_n"))
    return rows.join(told, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bucket") == F.col("_b"))).drop("_by", "_b")


def ranked_in(rows: DataFrame, by: str, value: str, tie: str, rank: str) -> DataFrame:
    """Adds rank: 0, 1, 2, ... within each key, by value, then tie; equal values of a key meet in one task, other rows of a key of over LARGE need not."""
    if largest(rows, by) <= LARGE:
        return rows.withColumn(rank, (F.row_number().over(W.partitionBy(by).orderBy(value, tie)) - 1).cast("long"))
    told = with_before(in_buckets(rows, by, value).withColumn("_one", F.lit(1)), by, "_one")
    inside = F.row_number().over(W.partitionBy(by, "_bucket").orderBy(value, tie)) - 1
    return told.withColumn(rank, F.col("_before") + inside).drop("_before", "_bucket", "_one", "_n")


def nearest_rank(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Values at index int(n * share) of each sorted group, found over counts of equal values, in buckets where a group is of over LARGE rows."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    if largest(rows, by) <= LARGE:
        told = counted.withColumns({"_before": F.lit(0), "_n": F.sum("_c").over(W.partitionBy(by)), "_bucket": F.lit(0)})
        w = W.partitionBy(by).orderBy(value)
    else:
        told = with_before(in_buckets(counted, by, value), by, "_c")
        w = W.partitionBy(by, "_bucket").orderBy(value)
    run = told.withColumn("_hi", F.col("_before") + F.sum("_c").over(w)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    at = lambda p: F.least(F.floor(F.col("_n") * p), F.col("_n") - 1)
    return run.groupBy(by).agg(*[F.max(F.when((at(p) >= F.col("_lo")) & (at(p) < F.col("_hi")), F.col(value))).alias(name) for name, p in shares.items()])
