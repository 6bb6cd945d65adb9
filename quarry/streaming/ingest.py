"""Incremental ingest of documents as a stream: index, chunks and entities follow new, changed and deleted documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..operators import chunking, embedding, metadata
from ..operators.incremental import LexicalIndex


def stream_documents(spark: SparkSession, directory: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(directory)


def ingest(docs: DataFrame, key: str, text: str, out: str, checkpoint: str, deleted: str | None = None) -> StreamingQuery:
    """Cleans each batch and keeps an index under out, with the tables documents, chunks and entities, as of the newest text of each document.

    A batch is one transaction of LexicalIndex: what is new or changed is indexed,
    what it replaces no longer counts, what is unchanged is left alone, and rows
    whose column `deleted` is true take their document out. A batch that runs again
    changes nothing; one that was stopped is rolled back, or carried forward, by the
    next. Keys are numbers; of rows with one key in a batch, the one whose text has
    the smallest hash counts. LexicalIndex(spark, out) searches, and reads the tables.
    """
    made = {
        "documents": lambda fresh: fresh.drop("mark"),
        "chunks": lambda fresh: chunking.word_windows(fresh, "key", "text").withColumn("vector", embedding.hash_vector(F.col("content"))),
        "entities": lambda fresh: metadata.equipment(fresh, "key", "text"),
    }

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn(text, tx.clean(F.coalesce(text, F.lit("")))).withColumnsRenamed({key: "key", text: "text"}).withColumn("key", F.col("key").cast("long"))
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        LexicalIndex(batch.sparkSession, out).apply(rows.where(~gone), rows.where(gone).select("key"), made, number, checkpoint)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, by: str, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events a window and kind; rows later than `late` behind the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, length), by).agg(F.count("*").alias("n"))
