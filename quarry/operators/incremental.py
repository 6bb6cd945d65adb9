"""A BM25 index that takes inserts, changes and deletions batch by batch, each a transaction.

A batch is a segment: blocks of what is new or changed, its documents' terms by key
(`docs`, in a folder for each of FOLDERS hashes, null for a deletion), differences
of document frequencies, and `gone`, the places of rows that it replaces. Numbers
of documents and of tokens are sums in the manifest. A batch looks its keys up in
the folders that they fall in, so it reads no texts and no postings of earlier
ones; what is unchanged is left out. Searches equal those on a fresh build.

On disk texts travel once, to the folders and files of their terms, which hold
whole ranges in order, so blocks are read off them; what is looked up are keys,
hashes and sizes, and of earlier terms only those that are replaced travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.transactions import Store, Transaction
from . import lexical

FOLDERS = 64
#: Documents of a file in a folder, about.
FILE_DOCS = 16_384
#: Segments from which a batch is followed by a compaction.
SEGMENTS = 16
#: Slots of the bitmap that tells which documents may have been replaced, 64 in a word: a million words are broadcast at most.
SLOTS = 1 << 26
#: Codec of what a segment keeps.
CODEC = "zstd"
DOCS = "key long, mark long, size int, terms array<string>, tfs array<int>, kb int"
#: From rows of new and changed documents (key, and the columns of the batch), a table that the same transaction stages.
Derived = Callable[[DataFrame], DataFrame]


def folder(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int")


def range_of(key: Column, ranges: Column) -> Column:
    """The range of a key in a segment of so many."""
    return F.pmod(F.xxhash64(key, F.lit(1)), ranges)


def range_in(key: Column, segment: dict) -> Column:
    """The range of a key in a segment; of a large one, `each` ranges for each folder."""
    if "each" in segment:
        return folder(key).cast("long") * segment["each"] + range_of(key, F.lit(segment["each"]))
    return range_of(key, F.lit(segment["ranges"]))


def layout(n: int) -> dict:
    """How many ranges a segment of n documents has."""
    ranges = max(1, -(-n // lexical.RANGE))
    each = -(-ranges // FOLDERS)
    return {"ranges": ranges} if ranges <= FOLDERS else {"ranges": each * FOLDERS, "each": each}


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows (key) of a segment of n documents with kb and part, dealt out by both, so that a folder has a file for each FILE_DOCS, not one of every task, and a range is in one file; groups by kb, part and key are not shuffled again."""
    parts, each = -(-n // (FOLDERS * FILE_DOCS)) or 1, layout(n).get("each", 1)
    part = F.floor(range_of(F.col("key"), F.lit(each)) * parts / each)
    return rows.withColumns({"kb": folder(F.col("key")), "part": part}).repartition("kb", "part")


def forward(rows: DataFrame) -> DataFrame:
    """DOCS of rows (key, mark, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = lexical.Counted(b.column(2).to_pylist())
            edge = pa.array(np.append(0, np.cumsum(c.kinds)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c.lens), pa.ListArray.from_arrays(edge, c.terms), pa.ListArray.from_arrays(edge, pa.array(c.tf))], names=["key", "mark", "size", "terms", "tfs"])

    return rows.select("key", "mark", "text").mapInArrow(run, DOCS.rpartition(",")[0]).withColumn("kb", folder(F.col("key")))


def _blocks_of(rows: pa.Table) -> pa.RecordBatch:
    flat = rows.combine_chunks()
    terms, tfs = flat["terms"].chunk(0), flat["tfs"].chunk(0)
    own = np.repeat(np.arange(len(flat)), np.diff(terms.offsets.to_numpy()))
    return lexical.block_rows(flat["rng"][0].as_py(), flat["key"].to_numpy(), terms.flatten(), own, tfs.flatten().to_numpy(), flat["size"].to_numpy())


def segment_blocks(docs: DataFrame, segment: dict) -> DataFrame:
    """Blocks of the documents' terms, as they are staged.

    The files of a large segment hold whole ranges in order, so a task reads one
    after the other; those of a small one are dealt out by range. A range that two
    tasks read has two blocks of a term, which searches add up.
    """
    rows = docs.select("key", "size", "terms", "tfs", range_in(F.col("key"), segment).alias("rng"))
    if "each" not in segment:
        return rows.groupBy("rng").applyInArrow(lambda t: pa.Table.from_batches([_blocks_of(t)]), lexical.BLOCK)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            rng = b.column(4).to_numpy()
            edges = [0, *(1 + np.flatnonzero(rng[1:] != rng[:-1])).tolist(), len(rng)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi == lo:
                    continue
                if held and held[0].column(4)[0].as_py() != rng[lo]:
                    yield _blocks_of(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield _blocks_of(pa.Table.from_batches(held))

    return rows.mapInArrow(run, lexical.BLOCK)


def among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows (key) whose key is among some keys, and few others: by a bitmap of SLOTS, so rows are not shuffled."""
    slot = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(SLOTS))
    place = F.pmod("slot", F.lit(64)).cast("int")
    words = keys.select(slot.alias("slot")).select(F.shiftright("slot", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    met = rows.withColumn("slot", slot).join(F.broadcast(words), F.shiftright("slot", 6) == F.col("word"))
    return met.where(F.getbit("bits", place) == 1).drop("slot", "word", "bits")


class LexicalIndex:
    """The index under a path. Keys are numbers."""

    def __init__(self, spark: SparkSession, path: str, on_step: Callable[[str], None] = lambda _: None) -> None:
        self.spark, self.store = spark, Store(spark, path, on_step)

    def segments(self) -> list[dict]:
        return self.store.manifest().get("segments", [])

    def _read(self, name: str, schema: str, segments: list[dict] | None = None) -> DataFrame:
        """The rows of a table in all segments, with seg."""
        out = self.spark.createDataFrame([], f"{schema}, seg int")
        for s in self.segments() if segments is None else segments:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.store.path}/data/{s['tx']}/{name}").withColumn("seg", F.lit(s["seg"])))
        return out

    def gone(self) -> DataFrame:
        return self._read("gone", "of int, rng long, key long").select(F.col("of").alias("seg"), "rng", "key")

    def index(self) -> lexical.Index:
        now = self.store.manifest()
        blocks = self._read("blocks", lexical.BLOCK)
        df = self._read("df", "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
        corpus = self.spark.createDataFrame([(now.get("n_docs", 0), now.get("total", 0))], "n_docs long, total long")
        return lexical.Index(blocks, df, corpus, self.gone())

    def search(self, queries: DataFrame, query_key: str, query_text: str, k: int = 10, digits: int | None = 9, prune: bool | None = None) -> DataFrame:
        return lexical.search_index(self.index(), queries, "key", query_key, query_text, k, digits, prune)

    def table(self, name: str) -> DataFrame:
        """A derived table as it stands: the rows of documents that no later batch replaced or deleted."""
        rows = None
        for s in self.segments():
            if name in s["tables"]:
                own = self.spark.read.parquet(f"{self.store.path}/data/{s['tx']}/{name}").withColumn("seg", F.lit(s["seg"]))
                rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            raise KeyError(name)
        return rows.join(self.gone().select("seg", "key"), ["seg", "key"], "left_anti").drop("seg")

    def known(self, keys: DataFrame) -> DataFrame:
        """key, of, mark, size of those keys that the index holds, from the folders that they fall in."""
        folders = [r["kb"] for r in keys.select(folder(F.col("key")).alias("kb")).distinct().collect()]  # FOLDERS at most
        rows = self._read("docs", DOCS).where(F.col("kb").isin(*folders) if folders else F.lit(False)).select("key", "seg", "mark", "size")
        last = rows.join(keys.select("key"), "key", "left_semi").groupBy("key").agg(F.max_by(F.struct(F.col("seg").alias("of"), "mark", "size"), "seg").alias("r"))
        return last.select("key", "r.*").where(F.col("mark").isNotNull())

    def apply(self, upserts: DataFrame, deletes: DataFrame | None = None, derived: dict[str, Derived] | None = None, batch: int | None = None, source: str = "") -> dict[str, int]:
        """Takes upserts (key, text, and what `derived` looks at) and deletes (key); how many were new, modified, unchanged and deleted.

        Of rows with one key, the one whose text has the smallest hash counts; a
        key that is both put and deleted is put; a key that is not there is not
        deleted; rows without a key are left out. A batch of a source whose number,
        or a larger one, has been applied is passed over.
        """
        self.store.recover()
        now = self.store.manifest()
        if batch is not None and now.get("batches", {}).get(source, -1) >= batch:
            return {}
        tx = self.store.begin()
        rows = upserts.where(F.col("key").isNotNull()).withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
        if derived:  # what is derived looks at texts as the terms do
            rows = tx.stage(rows.groupBy("key").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "key"]), "mark").alias("r")).select("key", "r.*"), "batch")
        asked = rows.groupBy("key").agg(F.min("mark").alias("mark")).withColumn("put", F.lit(True))
        if deletes is not None:
            dropped = deletes.where(F.col("key").isNotNull()).select("key").distinct().join(rows.select("key"), "key", "left_anti")
            asked = asked.unionByName(dropped.select("key", F.lit(None).cast("long").alias("mark"), F.lit(False).alias("put")))
        old = self.known(asked)
        told = asked.join(old.withColumnRenamed("mark", "old"), "key", "left")
        kind = F.when(~F.col("put"), F.when(F.col("of").isNotNull(), "deleted")).when(F.col("of").isNull(), "new").when(F.col("mark") == F.col("old"), "unchanged").otherwise("modified")
        changes = tx.stage(told.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("key", "kind", "of", "size"), "changes")
        counts = dict(changes.groupBy("kind").count().collect())
        n = counts.get("new", 0) + counts.get("modified", 0)
        # texts and what is told of their keys travel together, once
        none = lambda t: F.lit(None).cast(t)
        both = rows.select("key", "mark", "text", none("string").alias("kind")).unionByName(changes.select("key", none("long").alias("mark"), none("string").alias("text"), "kind"))
        met = dealt(both, n).groupBy("kb", "part", "key").agg(F.min_by(F.struct("mark", "text"), "mark").alias("r"), F.max("kind").alias("kind"))
        gone = F.col("kind") == "deleted"
        docs = forward(met.where(F.col("kind") != "unchanged").select("key", F.when(~gone, F.col("r.mark")).alias("mark"), F.when(~gone, F.col("r.text")).alias("text")))
        out = self._segment(tx, docs, changes.where(F.col("kind").isin("modified", "deleted")), n, now)
        fresh = rows.join(changes.where(F.col("kind").isin("new", "modified")).select("key"), "key", "left_semi") if derived else None
        for name, make in (derived or {}).items():
            tx.stage(make(fresh), name)
        out["segments"][-1]["tables"] = list(derived or {})
        tx.commit(out | {"batches": now.get("batches", {}) | ({source: batch} if batch is not None else {})})
        for name in ("batch", "changes"):  # no later batch looks at them
            self.store.files.remove(f"data/{tx.tx}/{name}")
        if len(out["segments"]) >= SEGMENTS:
            self.compact()
        return counts

    def _segment(self, tx: Transaction, docs: DataFrame, replaced: DataFrame, n: int, now: dict) -> dict:
        """Stages a segment of n documents, which `dealt` has dealt out; the manifest with it."""
        segments, made = now.get("segments", []), layout(n)
        seg = max((s["seg"] for s in segments), default=0) + 1
        held = tx.stage(docs.withColumn("rng", range_in(F.col("key"), made)).sortWithinPartitions("kb", "rng").drop("rng"), "docs", ["kb"], CODEC)
        live = held.where(F.col("mark").isNotNull())
        blocks = tx.stage(segment_blocks(live, made).sortWithinPartitions("term"), "blocks", codec=CODEC)
        more, corpus = lexical.summed(blocks)
        rng = F.coalesce(*[F.when(F.col("of") == s["seg"], range_in(F.col("key"), s)) for s in segments], F.lit(0).cast("long"))
        gone = tx.stage(replaced.select("of", rng.alias("rng"), "key"), "gone")
        df = more
        if segments:
            terms = among(self._read("docs", DOCS, segments).select(F.col("seg").alias("of"), "key", F.array_join("terms", " ").alias("terms")), gone)
            less = terms.join(gone, ["of", "key"], "left_semi").select(F.explode(F.split(F.nullif("terms", F.lit("")), " ")).alias("term"))
            df = more.unionByName(less.groupBy("term").agg((-F.count("*")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
        tx.stage(df.where("df <> 0"), "df")
        lost = replaced.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        won = corpus.first()
        return {
            "transactions": [*now.get("transactions", []), tx.tx],
            "segments": [*segments, {"tx": tx.tx, "seg": seg, **made, "tables": []}],
            "n_docs": now.get("n_docs", 0) + won["n_docs"] - lost[0],
            "total": now.get("total", 0) + won["total"] - lost[1],
        }

    def compact(self) -> None:
        """One segment of all that counts; what older versions alone need is removed."""
        now = self.store.manifest()
        if len(now.get("segments", [])) < 2:
            return
        tx = self.store.begin()
        # terms travel as one string, half the bytes of an array
        sent = dealt(self._read("docs", DOCS).withColumn("terms", F.array_join("terms", " ")), now["n_docs"])
        last = sent.groupBy("kb", "part", "key").agg(F.max_by(F.struct("mark", "size", "terms", "tfs"), "seg").alias("r")).select("key", "r.*", "kb").where(F.col("mark").isNotNull())
        live = last.withColumn("terms", F.when(F.col("terms") == "", F.array().cast("array<string>")).otherwise(F.split("terms", " ")))
        none = self.spark.createDataFrame([], "of int, key long, size int")
        names = sorted({t for s in now["segments"] for t in s["tables"]})
        for name in names:
            tx.stage(self.table(name), name)
        top = max(s["seg"] for s in now["segments"])
        made = self._segment(tx, live.select(*[x.split()[0] for x in DOCS.split(", ")]), none, now["n_docs"], {})
        made["segments"][0] |= {"seg": top + 1, "tables": names}
        tx.commit(made | {"batches": now.get("batches", {})})
        self.store.remove_unused()
