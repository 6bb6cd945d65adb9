"""Ranked lexical search by sort-based accumulation.

Texts are scanned once: each gives its length in terms and the counts of the terms
that some item has, which is a slim table of postings by document. From it come
the counts N, L and df. A block of documents then turns its postings into one
array of (item, document, impact): the packed keys are radix sorted, 16 bits a
pass, equal keys are summed with numpy's reduceat, and a heap an item keeps the
best. A document is whole inside its block, so scores never meet across tasks;
what each task's heaps hold is partitioned by ranges of (item, score), selected
again inside the ranges, and ranked.

Items are searched in blocks: a block's terms are sent to all tasks, and there are
as many blocks as keep it within BLOCK_TERMS terms on average. An item's text is
one row; its distinct terms are held by a task.

Defined results: null and empty texts have no term; an item without a known term,
or without a match, has no rows; equal rows of items count once, and texts of one
item_id are one item with the terms of all; a null item_id is an item; documents
with a repeated or null doc_id are ranked row by row, null first among equals;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import NULL_ID, pick, remove_path, shared_path, shuffle_width

TOP = 20
#: Entries of (item, term) that a block of items has on average.
BLOCK_TERMS = 200_000
#: Entries of (item, document, impact) that are sorted at once.
BLOCK_ENTRIES = 1_000_000
#: Term bytes: digits, letters and all above 0x7F; A-Z in lower case, others are blanks.
TERM = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM).split()


def radix_order(keys: np.ndarray, bound: int) -> np.ndarray:
    """The stable order of keys below bound; numpy sorts 16-bit digits by radix."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while bound - 1 >> shift:
        digit = (keys[order] >> shift & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
        shift += 16
    return order


def accumulated(item: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int, items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, score): impacts of equal (item, doc) summed, in order of both."""
    key = item.astype(np.int64) * docs + doc
    order = radix_order(key, docs * items)
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[head] // docs, key[head] % docs, np.add.reduceat(impact[order], head)


class Best:
    """The k best (score, smallest doc_id first among equals) of each item."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)  # the score that a new one has to reach

    def take(self, item: np.ndarray, doc_id: np.ndarray, score: np.ndarray) -> None:
        able = np.flatnonzero((score > 0) & (score >= self.least[item]))
        for i, d, s in zip(item[able].tolist(), doc_id[able].tolist(), score[able].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -d))
            elif (s, -d) > heap[0]:
                heapq.heapreplace(heap, (s, -d))
            if len(heap) == self.k:
                self.least[i] = heap[0][0]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [(i, -d, s) for i, heap in enumerate(self.heaps) for s, d in heap]
        return tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """key, n (terms of the text), terms and tfs (int32 arrays as bytes) of the vocabulary's terms in each row that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = terms(t)
                if found:
                    hits = [(known[x], c) for x, c in Counter(found).items() if x in known]
                    at = np.array(hits, np.int32).reshape(-1, 2)
                    rows.append((NULL_ID if k is None else k, len(found), at[:, 0].tobytes(), at[:, 1].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["key", "n", "terms", "tfs"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "key long, n long, terms binary, tfs binary")


def document_frequencies(held: DataFrame, size: int) -> DataFrame:
    """(term, df), counted in each task before they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    return held.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search_block(docs: DataFrame, items: list[tuple[int | None, Counter]], k: int, store) -> DataFrame:
    """(item, key, score) of the best rows that each task, and then each range, finds for the items; item is a place in the list."""
    vocabulary: dict[bytes, int] = {}
    entries = sorted((vocabulary.setdefault(t, len(vocabulary)), i, c) for i, (_, count) in enumerate(items) for t, c in count.items())
    term, item, times = (np.array(c, np.int64) for c in zip(*entries, strict=True)) if entries else (np.empty(0, np.int64),) * 3
    held = store(postings(docs, vocabulary), "postings")
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for t, df in document_frequencies(held, len(vocabulary)).collect():  # no more rows than the block has terms
        weights[t] = weight(n_docs, df)
    starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    shared = docs.sparkSession.sparkContext.broadcast((starts, item, times, weights))
    n_items = len(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, item, times, weights = shared.value
        degree = np.diff(starts)
        best = Best(n_items, k)

        def score(key: np.ndarray, m: np.ndarray, doc: np.ndarray, t: np.ndarray, tf: np.ndarray) -> None:
            impact = weights[t] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            of = np.repeat(np.arange(len(t)), degree[t])
            if not len(of):
                return
            first = np.cumsum(degree[t]) - degree[t]
            at = starts[t][of] + np.arange(len(of)) - first[of]
            i, d, s = accumulated(item[at], doc[of], impact[of] * times[at], len(key), n_items)
            best.take(i, key[d], s)

        for b in batches:
            key, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            m = 75 + 25 * n * n_docs // n_terms
            blobs, tfs = b.column(2).to_pylist(), b.column(3).to_pylist()
            t, tf = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (blobs, tfs))
            sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
            doc = np.repeat(np.arange(len(key)), sizes)
            edges, work = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(degree[t]))[np.append(0, np.cumsum(sizes))]
            lo = 0
            while lo < len(key):  # whole documents, of BLOCK_ENTRIES entries or a single one's
                hi = max(lo + 1, int(np.searchsorted(work, work[lo] + BLOCK_ENTRIES, "right")) - 1)
                x, y = edges[lo], edges[hi]
                score(key[lo:hi], m[lo:hi], doc[x:y] - lo, t[x:y], tf[x:y])
                lo = hi
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows()], names=["item", "key", "score"])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n_items, k)
        for b in batches:
            best.take(*(c.to_numpy() for c in b.columns))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows()], names=["item", "key", "score"])

    schema = "item long, key long, score long"
    # written, so that the ranges are drawn from the rows themselves and not from a second search
    found = store(held.mapInArrow(run, schema), "found")
    return found.repartitionByRange(shuffle_width(docs.sparkSession), "item", F.desc("score"), "key").mapInArrow(select, schema)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item."""
    spark = docs.sparkSession
    made = []

    def store(df: DataFrame, name: str) -> DataFrame:
        made.append(path := shared_path(spark, f"search-{name}"))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(set(terms(t))) for t in b.column(1).to_pylist()], pa.int64())], names=["item_id", "n"])

    asked = pick(items, "item_id", "text").where(F.col("text").isNotNull()).distinct()
    entries = asked.mapInArrow(distinct_terms, "item_id long, n long").agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-entries // BLOCK_TERMS))
    dealt = store(asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "items")
    out = []
    for block in range(blocks):
        counts: dict[int | None, Counter] = {}
        for row in dealt.where(F.col("block") == block).toLocalIterator():
            counts.setdefault(row["item_id"], Counter()).update(terms(row["text"]))
        listed = sorted(counts.items(), key=lambda x: (x[0] is not None, x[0] or 0))
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(listed)], "item long, item_id long")
        best = search_block(docs, listed, k, store)
        place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "key"))
        top = best.withColumn("rank", place).where(F.col("rank") <= k)
        out.append(store(top.join(names, "item").select("item_id", "rank", F.when(F.col("key") != NULL_ID, F.col("key")).alias("doc_id"), "score"), "ranked"))
    for path in made:
        if "search-ranked" not in path:
            remove_path(spark, path)
    found = out[0]
    for more in out[1:]:
        found = found.unionAll(more)
    return found
