"""BM25: an index of postings in blocks, stored or not, and set-oriented search on it.

Rows are numbered in ranges of RANGE; a block is what one range holds of one term:
keys, counts and lengths as bytes, with the largest count and the smallest length, which
bound any score from it whatever the corpus becomes. Ranges belong to the task
that read them, so a build shuffles nothing and a word that every row has is in as
many blocks as there are ranges. A search deals the blocks of its terms out by
range and scores each range's rows whole; with `prune`, ranges that cannot reach a
query's k-th best score are left out before that.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.queries import search_tokens

K1, B, FLOOR = 1.5, 0.75, 1e-4
#: Rows of a range, and ranges that a task scores together.
RANGE, TOGETHER = 512, 4
#: Rows of query terms that one pass over the index carries.
SMALL = 200_000
#: Ranges from which a search bounds them first, and those that it scores for its first guess, a query.
MANY_RANGES, PROBES = 512, 2
BLOCK = "rng long, term string, n int, total long, rows binary, max_tf int, min_len int"
#: What `rows` of a block holds, one after the other.
ROW = np.dtype([("key", "<i8"), ("tf", "<i4"), ("size", "<i4")])
#: The term of a range's own row: n rows and total tokens. No token is empty.
ABOUT = ""
_TOKEN = re.compile(r"[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*")
_PARTS = re.compile("[-_]+")


def token_list(text: str | None) -> list[str]:
    """What functions.text.tokens gives, in any order: identifiers in lower case, and the parts of those with - or _."""
    found = _TOKEN.findall(text or "")
    if not found:
        return found
    low = " ".join(found).lower().split(" ")
    if "-" in text or "_" in text:
        low += [p for x in low if "-" in x or "_" in x for p in _PARTS.split(x)]
    return low


class Counted:
    """Terms of some texts: their strings, the text that each is of, its count there, and the texts' lengths."""

    def __init__(self, texts: list[str | None]) -> None:
        terms: list[str] = []
        tf: list[int] = []
        kinds, sizes = [], []
        for t in texts:
            count = Counter(token_list(t))
            terms += count.keys()
            tf += count.values()
            kinds.append(len(count))
            sizes.append(count.total())
        self.terms, self.tf = pa.array(terms, pa.string()), np.array(tf, np.int32)
        self.kinds, self.lens = np.array(kinds, np.int64), np.array(sizes, np.int32)
        self.own = np.repeat(np.arange(len(texts)), self.kinds)


def postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, doc_len. Terms are counted inside each row, so nothing is shuffled; the JVM's patterns take five times as long."""
    field = chunks.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                c = Counted(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(c.own)), c.terms, pa.array(c.tf.astype(np.int64)), pa.array(c.lens[c.own].astype(np.int64))], names=[key, "term", "tf", "doc_len"])

    return chunks.select(key, text).mapInArrow(run, f"`{key}` {field.dataType.simpleString()}, term string, tf long, doc_len long")


def range_number(i: int) -> int:
    """The i-th range of this task: no other task has it."""
    return TaskContext.get().partitionId() << 32 | i


def block_rows(rng: int, keys: np.ndarray, terms: pa.StringArray, own: np.ndarray, tf: np.ndarray, lens: np.ndarray) -> pa.RecordBatch:
    """The blocks of one range, whose rows have these keys and lengths; a term of row own[i] occurs tf[i] times."""
    coded = terms.dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code, own, tf = code[order], own[order], tf[order]
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)
    size = lens[own]
    some = len(starts) > 0
    at = lambda f, x: f.reduceat(x, starts) if some else np.empty(0, np.int64)
    n = np.append(np.diff(np.append(starts, len(code))), len(keys))
    total = np.append(at(np.add, tf.astype(np.int64)), lens.sum(dtype=np.int64))
    held = np.empty(len(code), ROW)
    held["key"], held["tf"], held["size"] = keys[own], tf, size
    edges = (np.concatenate((starts, [len(code)] * 2)) * ROW.itemsize).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(n), rng)), pa.concat_arrays([coded.dictionary.take(pa.array(code[starts])), pa.array([ABOUT])]), pa.array(n.astype(np.int32)), pa.array(total.astype(np.int64)),
            pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(held.tobytes())]), pa.array(np.append(at(np.maximum, tf), 0).astype(np.int32)), pa.array(np.append(at(np.minimum, size), 0).astype(np.int32)),
        ],
        names=[x.split()[0] for x in BLOCK.split(", ")],
    )


def blocks(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """The blocks of each task's ranges, in one pass over the texts; key is a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            for lo in range(0, b.num_rows, RANGE):
                part = b.slice(lo, RANGE)
                c = Counted(part.column(1).to_pylist())
                yield block_rows(range_number(done), part.column(0).to_numpy(), c.terms, c.own, c.tf, c.lens)
                done += 1

    return chunks.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), text).mapInArrow(run, BLOCK)


@dataclass(frozen=True)
class Index:
    """blocks (seg and what BLOCK names), df (term, df), corpus (one row: n_docs, total), and gone (seg, rng, key): rows that no longer count."""

    blocks: DataFrame
    df: DataFrame
    corpus: DataFrame
    gone: DataFrame | None = None


def build(chunks: DataFrame, key: str, text: str, path: str, by_term: bool = True) -> Index:
    """Writes the index under path in one pass over the texts; by_term: each file is sorted, so that later searches read little more than their terms' blocks."""
    spark = chunks.sparkSession
    made = blocks(chunks, key, text)
    (made.sortWithinPartitions("term") if by_term else made).write.parquet(f"{path}/blocks")
    return load(spark, path)


def summed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df and corpus of some blocks."""
    df = rows.where(F.col("term") != ABOUT).groupBy("term").agg(F.sum("n").alias("df"))
    corpus = rows.where(F.col("term") == ABOUT).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    return df, corpus


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/blocks").withColumn("seg", F.lit(0))
    return Index(rows, *summed(rows))


@dataclass(frozen=True)
class Asked:
    """What a pass carries: by term, the places of the queries that have it and their weights; and the least score that still counts, by query."""

    n: int
    by_term: dict[str, tuple[np.ndarray, np.ndarray]]
    mean: float
    least: np.ndarray

    def part(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))


def _cut(q: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties by key."""
    order = np.lexsort((key, -score, q))
    q, key, score = q[order], key[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[keep], key[keep], score[keep]


def _bounds(asked: Asked, terms: list[str], max_tf: np.ndarray, min_len: np.ndarray) -> np.ndarray:
    """For each query, more than any row of the range can score."""
    out = np.zeros(asked.n)
    for t, part in zip(terms, asked.part(max_tf, min_len).tolist(), strict=True):
        q, w = asked.by_term[t]
        out[q] += w * part
    return out * (1 + 1e-9)


def _ranges(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """(seg, rng, rows) of each range in a table of blocks."""
    seg, rng = table["seg"].to_numpy(), table["rng"].to_numpy()
    order = np.lexsort((rng, seg))
    edge = np.flatnonzero(np.concatenate(([True], (seg[order][1:] != seg[order][:-1]) | (rng[order][1:] != rng[order][:-1]), [True]))) if len(seg) else np.empty(0, np.int64)
    for x, y in zip(edge, edge[1:], strict=False):
        yield int(seg[order[x]]), int(rng[order[x]]), order[x:y]


def _scores(asked: Asked, k: int, digits: int | None):
    def run(table: pa.Table, gone: pa.Table) -> pa.Table:
        least = asked.least.copy()
        dead: dict[tuple[int, int], set[int]] = defaultdict(set)
        for s, r, x in zip(*(gone[c].to_pylist() for c in ("seg", "rng", "key")), strict=True):
            dead[s, r].add(x)
        terms, max_tf, min_len = table["term"].to_pylist(), table["max_tf"].to_numpy(), table["min_len"].to_numpy()
        cells = table["rows"].to_pylist()
        held = []
        for seg, rng, rows in _ranges(table):
            mine = [terms[i] for i in rows]
            able = np.flatnonzero(_bounds(asked, mine, max_tf[rows], min_len[rows]) >= least)
            if not len(able):
                continue
            place = np.full(asked.n, -1)
            place[able] = np.arange(len(able))
            every = np.frombuffer(b"".join([cells[i] for i in rows]), ROW)
            keys, at = np.unique(every["key"], return_inverse=True)
            part = asked.part(every["tf"], every["size"])
            score, lo = np.zeros((len(able), len(keys))), 0
            for t, i in zip(mine, rows, strict=True):
                hi = lo + len(cells[i]) // ROW.itemsize
                q, w = asked.by_term[t]
                own = place[q] >= 0
                score[place[q[own]][:, None], at[lo:hi][None, :]] += w[own][:, None] * part[lo:hi][None, :]
                lo = hi
            met = score > 0
            if (seg, rng) in dead:
                met &= ~np.isin(keys, list(dead[seg, rng]))
            if digits is not None:
                score = np.round(score, digits)
            q, c = np.nonzero(met & (score >= least[able][:, None]))
            held.append((able[q], keys[c], score[q, c]))
            if sum(len(x[0]) for x in held) > 4 * k * asked.n + 10_000:
                held = [_cut(*map(np.concatenate, zip(*held, strict=True)), k)]
                full = np.flatnonzero(np.bincount(held[0][0], minlength=asked.n) >= k)
                last = np.searchsorted(held[0][0], full, "right") - 1
                least[full] = np.maximum(least[full], held[0][2][last])
        q, key, score = _cut(*map(np.concatenate, zip(*held, strict=True)), k) if held else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"q": q, "key": key, "score": score})

    return run


GROUP = ["seg", "grp"]


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("grp", F.floor(F.col("rng") / TOGETHER)).groupBy(*GROUP)


def _best(index: Index, held: DataFrame, asked: Asked, k: int, digits: int | None) -> DataFrame:
    """q, key, score, rank of the k best rows among these blocks."""
    run, schema = _scores(asked, k, digits), "q long, key long, score double"
    dealt = _grouped(held.select("seg", "rng", "term", "rows", "max_tf", "min_len"))
    none = pa.table({"seg": pa.array([], pa.int32()), "rng": pa.array([], pa.int64()), "key": pa.array([], pa.int64())})
    found = dealt.applyInArrow(lambda t: run(t, none), schema) if index.gone is None else dealt.cogroup(_grouped(index.gone.select("seg", "rng", "key"))).applyInArrow(run, schema)
    return top_k(found, "q", "score", "key", k)


def _alive(heads: DataFrame, asked: Asked, best_only: bool) -> DataFrame:
    """(seg, rng, q, bound): of each query the range with the largest bound in each group, or the ranges that some query may need."""

    def run(table: pa.Table) -> pa.Table:
        terms, max_tf, min_len = table["term"].to_pylist(), table["max_tf"].to_numpy(), table["min_len"].to_numpy()
        about = [(s, r, _bounds(asked, [terms[i] for i in rows], max_tf[rows], min_len[rows])) for s, r, rows in _ranges(table)]
        if best_only:
            bound = np.stack([b for *_, b in about])
            first = bound.argmax(0)
            out = [(*about[i][:2], q, bound[i, q]) for q, i in enumerate(first) if bound[i, q] > 0]
        else:
            out = [(s, r, 0, 0.0) for s, r, b in about if (b >= asked.least).any()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 4, (pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["seg", "rng", "q", "bound"])

    return _grouped(heads).applyInArrow(run, "seg int, rng long, q long, bound double")


def search_index(index: Index, queries: DataFrame, key: str, query_key: str, query_text: str, k: int = 10, digits: int | None = None, prune: bool | None = None) -> DataFrame:
    """query, key, score, rank (from 0) of the k best rows for each query; ties by key, on scores rounded to `digits` if given.

    A repeated query term adds as often as it occurs. Queries go out in blocks of
    SMALL terms on average, each a pass over the blocks of its terms. prune: first
    bound the ranges, and score those that may have one of the k best; by itself,
    from MANY_RANGES ranges on. The result is the same.
    """
    spark = queries.sparkSession
    field = queries.schema[query_key]
    asked = queries.select(F.col(query_key).alias("query"), F.explode(search_tokens(F.col(query_text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    n = asked.count()
    passes = max(1, -(-n // SMALL))
    told = asked.join(index.df, "term").where("df > 0")
    n_docs, total = index.corpus.select("n_docs", "total").first()
    ranges = index.blocks.where(F.col("term") == ABOUT).count() if prune is None and n_docs > MANY_RANGES * RANGE / 8 else 0
    out = None
    for i in range(passes):
        rows = (told.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == i) if passes > 1 else told).collect()  # about SMALL rows
        found = _pass(index, rows, n_docs, total, k, digits, prune if prune is not None else ranges > MANY_RANGES, spark, f"{query_key} {field.dataType.simpleString()}", key)
        out = found if out is None else out.unionByName(found)
    return out


def _asked(rows: list, n_docs: int, total: int) -> tuple[list, Asked]:
    names = sorted({r["query"] for r in rows}, key=lambda x: (x is not None, x))
    place = {x: i for i, x in enumerate(names)}
    by: dict[str, list] = defaultdict(list)
    for r in rows:
        by[r["term"]].append((place[r["query"]], r["times"] * max(math.log((n_docs - r["df"] + 0.5) / (r["df"] + 0.5) + 1), FLOOR)))
    return names, Asked(len(names), {t: (np.array([q for q, _ in x]), np.array([w for _, w in x])) for t, x in by.items()}, max(total, 1) / max(n_docs, 1), np.zeros(len(names)))


def _pass(index: Index, rows: list, n_docs: int, total: int, k: int, digits: int | None, prune: bool, spark: SparkSession, query: str, key: str) -> DataFrame:
    names, asked = _asked(rows, n_docs, total)
    terms = F.broadcast(spark.createDataFrame([(t,) for t in asked.by_term], "term string"))  # about SMALL at most
    held = index.blocks.join(terms, "term", "left_semi")
    if prune and names:
        asked, held = pruned(index, held, asked, k, digits)
    found = _best(index, held, asked, k, digits)
    of = spark.createDataFrame(list(enumerate(names)), f"_q long, {query}")
    rows = found.select(F.col("q").alias("_q"), F.col("key").alias("_key"), "score", "rank").join(F.broadcast(of), "_q")
    return rows.select(query.split()[0], F.col("_key").alias(key), "score", "rank")


def pruned(index: Index, held: DataFrame, asked: Asked, k: int, digits: int | None) -> tuple[Asked, DataFrame]:
    """The least score that each query's k-th best row has, from the ranges with the best bounds; and the blocks of the ranges that reach it for some query."""
    from ..sources.tables import stored

    heads = held.select("seg", "rng", "term", "max_tf", "min_len")
    probes = top_k(_alive(heads, asked, True), "q", "bound", "rng", PROBES).select("seg", "rng").distinct()
    guess = _best(index, held.join(F.broadcast(probes), ["seg", "rng"], "left_semi"), asked, k, digits)  # PROBES ranges a query
    least = asked.least.copy()
    for r in guess.where(F.col("rank") == k - 1).select("q", "score").collect():  # a number a query
        least[r["q"]] = r["score"]
    slack = 0.0 if digits is None else 10.0**-digits
    asked = replace(asked, least=np.maximum(least - slack, 0) * (1 - 1e-9))
    alive = stored(_alive(heads, asked, False).select("seg", "rng"), "alive")
    return asked, held.join(alive, ["seg", "rng"], "left_semi")


def blocks_read(index: Index, queries: DataFrame, query_key: str, query_text: str, k: int = 10) -> tuple[int, int]:
    """Blocks of the queries' terms, and those of them that a pruned search scores."""
    asked = queries.select(F.col(query_key).alias("query"), F.explode(search_tokens(F.col(query_text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    n_docs, total = index.corpus.select("n_docs", "total").first()
    _, told = _asked(asked.join(index.df, "term").where("df > 0").limit(SMALL).collect(), n_docs, total)
    held = index.blocks.join(F.broadcast(queries.sparkSession.createDataFrame([(t,) for t in told.by_term], "term string")), "term", "left_semi")
    return held.count(), pruned(index, held, told, k, None)[1].count()


def search(chunks: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, k: int = 10, digits: int | None = None) -> DataFrame:
    """search_index over rows that have no stored index: one for this search is built in the shared folder.

    The hits are stored too, so that what joins them knows their size, and few of them
    meet the rows without a shuffle of all texts.
    """
    from ..sources.tables import scratch, stored

    return stored(search_index(build(chunks, key, text, scratch(chunks.sparkSession, "bm25"), by_term=False), queries, key, query_key, query_text, k, digits), "found")


def top_k(scored: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group; the limit inside a group applies before the shuffle."""
    w = W.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
