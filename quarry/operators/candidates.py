"""Work on the ranked candidates of a query: expansion, near-duplicates, context."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip, tok_retrieval

NEIGHBOUR_SHARE, PREVIEW = 0.85, 120
SIMILAR, LENGTHS = 0.85, (0.8, 1.25)
HEADER = "### Context"


@F.pandas_udf(T.BinaryType())
def character_counts(texts: pd.Series) -> pd.Series:
    """The kinds of characters of a text in order, then how often it has each, as 32-bit numbers."""

    def one(t: str) -> bytes:
        kinds, n = np.unique(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)
        return kinds.tobytes() + n.astype("<u4").tobytes()

    return texts.map(one, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def counts_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """quick_ratio of two texts by their character_counts; null if either is."""

    def one(x: bytes, y: bytes) -> float:
        (kx, nx), (ky, ny) = (np.frombuffer(c, "<u4").reshape(2, -1) for c in (x, y))
        _, i, j = np.intersect1d(kx, ky, assume_unique=True, return_indices=True)
        total = int(nx.sum()) + int(ny.sum())
        return 2.0 * int(np.minimum(nx[i], ny[j]).sum()) / total if total else 1.0

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def quick_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in common, counted by kind, over all characters; in time that grows with the texts alone."""
    return counts_ratio(character_counts(a), character_counts(b))


def without_near_duplicates(hits: DataFrame, by: str, key: str, text: str, rank: str) -> DataFrame:
    """by, key, place of the hits kept in rank order: not empty, and unlike every one kept before.

    by and key are longs. A query has few candidates; its greedy walk is one small
    group, compared by counts of characters.
    """

    def walk(table: pa.Table) -> pa.Table:
        kept: list[tuple[int, str, Counter]] = []
        for k, t in zip(table["k"].to_pylist(), table["t"].to_pylist(), strict=True):
            if not t:
                continue
            count = Counter(t)
            if not any(k == k2 or t == t2 or LENGTHS[0] <= len(t) / len(t2) <= LENGTHS[1] and 2 * (count & c2).total() / (len(t) + len(t2)) >= SIMILAR for k2, t2, c2 in kept):
                kept.append((k, t, count))
        n = len(kept)
        return pa.table({by: pa.array([table["q"][0].as_py()] * n, pa.int64()), key: pa.array([k for k, _, _ in kept], pa.int64()), "place": pa.array(range(n), pa.int32())})

    rows = hits.select(F.col(by).alias("q"), F.col(key).alias("k"), F.trim(text).alias("t"), F.row_number().over(Window.partitionBy(by).orderBy(rank)).alias("r"))
    # the window has grouped the rows by query; a group arrives whole and is put in order once more
    return rows.groupBy("q").applyInArrow(lambda t: walk(t.sort_by("r")), f"{by} long, {key} long, place int")


def with_neighbours(hits: DataFrame, chunks: DataFrame, by: str, radius: int | Column = 1) -> DataFrame:
    """Hits (by, cid, document, index, score, rank) and, after them, the chunks within radius, which may differ by hit, that are not hits, at a share of the score."""
    r = F.lit(radius) if isinstance(radius, int) else radius
    steps = F.filter(F.sequence(-r, r), lambda i: i != 0)
    near = hits.select(by, "document", F.explode(steps).alias("step"), "index", "score", "rank").withColumn("index", F.col("index") + F.col("step"))
    best = near.groupBy(by, "document", "index").agg(F.max_by("score", F.struct(-F.col("rank"), -F.col("step"))).alias("score"), F.min("rank").alias("after"))
    found = best.join(chunks.select("document", "index", "cid"), ["document", "index"]).join(hits.select(by, "cid"), [by, "cid"], "left_anti")
    more = found.select(by, "cid", "document", "index", (F.col("score") * NEIGHBOUR_SHARE).alias("score"), (F.col("after") + 1000).alias("rank"))
    return hits.select(more.columns).unionByName(more)


def pack_context(hits: DataFrame, by: str, order: str, heading: Column, text: Column, budget: int | Column) -> DataFrame:
    """by, context, n_tokens, n_packed: blocks in order while they fit; the first prose block that does not, ends it.

    Of that block, leading sentences still enter if more than 100 tokens are left.
    """
    block = F.struct(F.col(order).alias("o"), heading.alias("h"), strip(text).alias("t"))
    limit = F.lit(budget) if isinstance(budget, int) else budget
    grouped = hits.groupBy(by).agg(F.array_sort(F.collect_list(block)).alias("b"), F.max(limit).alias("_budget"))
    budget = F.col("_budget")
    tok = lambda c: tok_retrieval(c).cast("int")
    start = F.struct(F.array(F.lit(HEADER)).alias("lines"), tok(F.lit(HEADER)).alias("n"), F.lit(0).alias("packed"), F.lit(False).alias("full"))

    def step(a: Column, x: Column) -> Column:
        head = F.concat(F.lit("\n--- "), x["h"], F.lit(" ---\n"))
        whole = F.concat(head, x["t"], F.lit("\n"))
        fits = a["n"] + tok(whole) <= budget
        room = budget - a["n"] - tok(head)
        parts = F.aggregate(F.split(x["t"], r"\. "), F.struct(F.array().cast("array<string>").alias("s"), F.lit(0).alias("n"), F.lit(False).alias("end")), lambda p, s: F.when(p["end"] | (p["n"] + tok(s) > room), F.struct(p["s"].alias("s"), p["n"].alias("n"), F.lit(True).alias("end"))).otherwise(F.struct(F.concat(p["s"], F.array(s)).alias("s"), (p["n"] + tok(s)).alias("n"), F.lit(False).alias("end"))))
        piece = F.concat(head, F.array_join(parts["s"], ". "), F.lit("\n"))
        some = (room > 100) & (F.size(parts["s"]) > 0)
        put = lambda line, full: F.struct(F.concat(a["lines"], F.array(line)).alias("lines"), (a["n"] + tok(line)).alias("n"), (a["packed"] + 1).alias("packed"), F.lit(full).alias("full"))
        stop = F.struct(a["lines"].alias("lines"), a["n"].alias("n"), a["packed"].alias("packed"), F.lit(True).alias("full"))
        return F.when(a["full"], a).when(fits, put(whole, False)).when(some, put(piece, True)).otherwise(stop)

    done = F.aggregate("b", start, step)
    return grouped.select(by, done.alias("d")).select(by, F.array_join("d.lines", "").alias("context"), F.col("d.n").alias("n_tokens"), F.col("d.packed").alias("n_packed"))


def violations(hits: DataFrame, by: str, key: str, score: str, rank: str) -> DataFrame:
    """by, duplicates, out_of_order of each result: repeated keys, and scores that rise along the ranks."""
    from pyspark.sql import Window as W

    w = W.partitionBy(by).orderBy(rank)
    rise = (F.col(score) > F.lag(score).over(w) + 1e-9).cast("int")
    return hits.withColumn("_up", rise).groupBy(by).agg((F.count(key) - F.countDistinct(key)).alias("duplicates"), F.coalesce(F.sum("_up"), F.lit(0)).alias("out_of_order"))
