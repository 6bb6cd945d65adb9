"""From raw documents to packed sequences, in stages that are each written and read again.

Defined results, for every stage: further columns are kept, but of names that
differ in case alone one stays; an empty table gives an empty one. Each stage's
docstring says what becomes of nulls, empty texts, ties and repeated rows; texts
of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, near_copies, packing, quality_rules, secrets
from quarry.llm.common import by_place, one_case, pick, shared_path, with_place, written
from quarry.llm.queries import WEIGHTS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among them. Equal texts are judged alike, and every row that passes stays."""
    docs = one_case(docs)
    flat = by_place(docs)
    return flat.where(quality_rules.good(flat[f"_c{docs.columns.index('text')}"])).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that five-word Jaccard similarity of 0.8 or more links, the document with the smallest doc_id stays; of equal rows with it, one.

    Two texts of one doc_id that no link joins both stay. Null and empty texts
    are one group. Documents without an id count as the largest, by a number made
    from their text, so a group of them keeps one too; of rows with one id and
    text, any one stays.
    """
    docs = one_case(docs)
    names = docs.columns
    doc_id, text = (f"_c{names.index(c)}" for c in ("doc_id", "text"))
    stand_in = F.lit(2**62) + F.pmod(F.xxhash64(text), F.lit(2**61))
    marked = by_place(docs).withColumns({"_id": F.coalesce(doc_id, stand_in), "_node": near_copies.node(text)})
    groups = near_copies.near_copies(docs).select(F.col("node").alias("_n"), "root")
    rooted = marked.select("_id", "_node").join(groups, F.col("_node") == F.col("_n"), "left")
    least = rooted.groupBy(F.coalesce("root", "_node").alias("root")).agg(F.min(F.struct("_id", "_node")).alias("m"))
    first = least.select(F.col("m._id").alias("_kept"), F.col("m._node").alias("_kept_node"))
    kept = marked.join(first, (marked["_id"] == first["_kept"]) & (marked["_node"] == first["_kept_node"]), "left_semi")
    return kept.dropDuplicates(["_id", "_node"]).drop("_id", "_node").toDF(*names)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are put as [SECRET], and n_chars follows; every row stays, null and empty texts as they are."""
    docs = one_case(docs)
    names = docs.columns
    text, n = names.index("text"), names.index("n_chars")
    flat = by_place(docs)
    told = flat.withColumn(f"_c{text}", F.pandas_udf(secrets.redact, "string")(flat[f"_c{text}"]))
    return told.withColumn(f"_c{n}", F.when(F.col(f"_c{n}").isNotNull(), F.length(f"_c{text}").cast("long"))).toDF(*names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mixture's schedule: files by number, and rows in each, which the next stage keeps. A null source is of the pool; equal rows take places of their own."""
    docs = one_case(docs)
    n = len(docs.columns)
    mixed = by_place(mixing.mix(docs, WEIGHTS, carry=True))
    slot, place = (f"_c{n + mixing.ADDED.index(c)}" for c in ("mix_slot", "mix_place"))
    return mixed.orderBy(slot, place).select(*[f"_c{i}" for i in range(n)]).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences that hold every row, packed in windows of the order in which docs stands and numbered along it.

    A null or empty text is the single id 0; equal rows are packed one by one; a null doc_id stays null.
    """
    cut = packing.pieces(with_place(pick(docs, "doc_id", "text"), "file", "row"), placed=True)
    return packing.pack_in_order(written(cut, "pieces"))


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("secret scan", secret_scan), ("mix sources", mix), ("best-fit packing", pack)]

#: SQL has neither the tokenizer nor the schedules; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
