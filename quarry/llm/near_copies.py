"""Near copies: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash proposes pairs: the fingerprints of all texts are linked by multi-index
hashing, as op10 links them, and the texts' own shingles verify the links. At its
radius it finds few of the pairs at 0.8 alone: such texts are apart by about ten
of 64 bits. So MinHash bands propose further pairs, which are verified alike. A
pair at 0.8 meets in some of BANDS bands of ROWS rows with a chance of
1 - (1 - 0.8 ** 4) ** 20, all but 3e-5. Equal fingerprints share a bucket, as
equal bands do.

All pairs of a bucket count, yet few are looked at. First each text is compared
with one centre of its bucket, the text whose buckets are the largest together;
in a group of edited copies that is one near the original, so most of the group
is one class after this. Then each bucket that still holds several classes is
dealt into blocks, and pairs of blocks are compared inside tasks, all texts of
different classes with each other; a task returns one link for two classes, and
blocks of one class are not sent. So rows follow the members of buckets, not
their pairs. A group is all that links reach.

Defined results: words are split at ASCII blanks, A-Z lowered; a text of fewer
than five words is one shingle; null and empty texts are alike; texts are told
apart by 64-bit hashes, so equal texts, in repeated rows or under other ids, are one
node; a text of any length is read whole; only the column text is looked at, and
further ones are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import pick, written
from .simhash import components

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4
#: Texts of a bucket that a task compares with as many others.
BLOCK = 256

_draw = np.random.default_rng(42)
_ODD, _ADD, _MIX = (_draw.integers(0, 2**64, n, np.uint64, endpoint=False) | np.uint64(1) for n in (BANDS * ROWS, BANDS * ROWS, ROWS))


def node(text: str) -> Column:
    """What tells texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = min(SHINGLE, len(words))
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def bands(own: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(own), 4096):
        least = np.minimum(least, ((own[i : i + 4096, None] ^ _ADD) * _ODD).min(0))
    least ^= least >> np.uint64(31)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64).view(np.int64)


def alike(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of a and b elements, `both` of them shared, are similar enough."""
    return 5 * both >= 4 * (a + b - both)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands, and after them as band number BANDS the fingerprint."""
    for b in batches:
        made = []
        for t in b.column(1).to_pylist():
            own = shingles(t)
            made.append(np.append(bands(own), simhash.voted(own)))
        flat = np.concatenate(made) if made else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), BANDS + 1)), pa.array(np.tile(np.arange(BANDS + 1, dtype=np.int32), len(made))), pa.array(flat)], names=["node", "band", "value"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "own"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        keep = []
        for a, b in zip(x.column(2), x.column(3), strict=True):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
            keep.append(bool(alike(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))))
        yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked(table: pa.Table) -> pa.Table:
    """Links a, b of alike texts of different classes in one pair of blocks, a spanning forest of them."""
    nodes, root, side = (table[c].to_numpy() for c in ("node", "root", "side"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["own"]]
    size = np.array([len(x) for x in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if size.sum() else np.empty(0, np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(len(sets)), size)
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    label = np.unique(root, return_inverse=True)[1]
    pair = side.max() > 0
    out = []
    for i in np.flatnonzero(side == 0):
        other = (label != label[i]) & (side > 0 if pair else np.arange(len(sets)) > i)
        if not other.any():
            continue
        mine = ids[begin[i] : begin[i + 1]]
        mark[mine] = True
        both = np.bincount(owner[mark[ids]], minlength=len(sets))
        mark[mine] = False
        for j in np.flatnonzero(other & alike(both, size[i], size)):
            if label[j] != label[i]:
                out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
                label[label == label[j]] = label[i]
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def by_simhash(every: DataFrame) -> DataFrame:
    """Columns a, b: pairs of nodes whose fingerprints, among these bands, are within SimHash's radius; one node stands for each fingerprint."""
    fps = written(every.where(F.col("band") == BANDS).groupBy(F.col("value").alias("fp")).agg(F.min("node").alias("node")), "near-fingerprints")
    left, right = (fps.select(F.col("fp").alias(c), F.col("node").alias(f"n{c}")) for c in "ab")
    return simhash.links(fps).join(left, "a").join(right, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))


def links(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Columns a, b: verified pairs of nodes (hashes of texts) that join the groups."""
    texts = docs.select("node", "text")
    every = written(texts.mapInArrow(_banded, "node long, band int, value long"), "near-bands")
    shared = every.groupBy("band", "value").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("band", "value")
    members = written(every.join(shared, ["band", "value"]).distinct(), "near-buckets")
    close = written(by_simhash(every), "near-simhash")
    meeting = members.select("node").unionByName(close.select(F.col("a").alias("node"))).unionByName(close.select(F.col("b").alias("node")))
    held = texts.join(meeting.distinct(), "node", "left_semi").dropDuplicates(["node"])
    sets = written(held.mapInArrow(_hashed, "node long, own binary"), "near-sets")

    sizes = members.groupBy("band", "value").agg(F.count("*").alias("n"))
    reach = members.join(sizes, ["band", "value"]).groupBy("node").agg(F.sum("n").alias("reach"))
    best = members.join(reach, "node").groupBy("band", "value").agg(F.max(F.struct("reach", "node")).alias("m"))
    centres = best.select("band", "value", F.col("m.node").alias("centre"))
    stars = members.join(centres, ["band", "value"]).where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).unionByName(close).distinct()
    left, right = (sets.select(F.col("node").alias(c), F.col("own").alias(f"t{c}")) for c in "ab")
    both = stars.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    found = written(both.mapInArrow(_verified, "a long, b long"), "near-links")

    roots = components(found).select(F.col("node").alias("_n"), "root")
    rooted = members.join(roots, members["node"] == roots["_n"], "left").select("band", "value", "node", F.coalesce("root", "node").alias("root"))
    classes = rooted.groupBy("band", "value", "root").agg(F.count("*").alias("c"))
    few = F.coalesce(F.sum(F.when(F.col("c") < block, F.col("c"))), F.lit(0))
    apart = classes.groupBy("band", "value").agg(F.count("*").alias("k"), few.alias("few")).where("k > 1").select("band", "value", "few")
    # a large class has blocks of its own; small ones share blocks
    alone = F.xxhash64("root", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / block)))
    shared_blk = F.pmod(F.xxhash64("root"), F.ceil(F.col("few") / block))
    parted = rooted.join(classes.join(apart, ["band", "value"]), ["band", "value", "root"])
    dealt = written(parted.select("band", "value", "node", "root", F.when(F.col("c") < block, shared_blk).otherwise(alone).alias("blk")), "near-blocks")
    blocks = dealt.groupBy("band", "value", "blk").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
    lists = blocks.groupBy("band", "value").agg(F.sort_array(F.collect_list(F.struct("blk", "r0", "r1"))).alias("m"))
    # pairs of blocks that do not hold one class alone
    first = lists.select("band", "value", "m", F.explode("m").alias("x"))
    duels = first.select("band", "value", "x", F.explode(F.filter("m", lambda y: y["blk"] >= F.col("x.blk"))).alias("y")).where("not (x.r0 = y.r1 and x.r1 = y.r0)")
    sides = duels.select("band", "value", F.col("x.blk").alias("i"), F.col("y.blk").alias("j"))
    at = sides.select("*", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("blk"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("i").alias("blk"), F.lit(0).alias("side")), F.struct(F.col("j").alias("blk"), F.lit(1).alias("side"))))).alias("p")).select("band", "value", "i", "j", F.col("p.blk").alias("blk"), F.col("p.side").alias("side"))
    sent = dealt.join(at, ["band", "value", "blk"]).join(sets, "node").select("band", "value", "i", "j", "side", "node", "root", "own")
    more = sent.groupBy("band", "value", "i", "j").applyInArrow(_linked, "a long, b long")
    return found.unionByName(more)


def near_copies(docs: DataFrame) -> DataFrame:
    """node, root of each text that is linked to others."""
    return components(links(pick(docs, "text").select(node("text").alias("node"), "text")))
