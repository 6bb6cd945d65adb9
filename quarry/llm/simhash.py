"""SimHash near-duplicates by multi-index hashing.

Every distinct 64-bit fingerprint is filed under each of its segments. A pair
within `radius` bits agrees in some segment up to radius // segments bits, so a
probe of the small Hamming ball around each segment meets it; complete distances
are then verified. The number of segments follows the number of fingerprints:
at radius 4, three of 21 bits with balls of one bit while that keeps groups
small, which it does for some 48 million, then two of 32 bits with balls of two;
both meet every pair. Only a spanning forest of each group's links leaves a task,
so a dense group of copies gives as many rows as it has members.

Defined results: a null or empty text has fingerprint zero and links like any
other; equal texts share a fingerprint and a component; a null doc_id counts as
the largest when a component is named (null only if no member has an id);
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, pick, shuffle_width, written

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints that may meet in one key on average, before longer segments with larger balls are taken.
GROUP = 512
#: Keys that one task takes, on average, when groups are dealt out.
KEYS_PER_TASK = 1_000_000
#: Groups up to this size are compared by lags over the whole task at once.
SMALL_GROUP = 24


def voted(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is set if over half of the hashes have it."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536]
        bits += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: a bit is set if over half of the shingles' XXH64 have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower is A-Z alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        spans = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)
    return voted(hashes)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def cuts(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment of 64 bits."""
    edges = [round(64 * i / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of at most radius bits out of width; the empty mask is first."""
    masks = level = [0]
    for _ in range(radius):
        level = sorted({m | 1 << i for m in level for i in range(width)} - set(masks))
        masks = masks + level
    return np.array(masks, np.uint64)


def forest(members: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of distinct fingerprints: a breadth-first walk over those not yet reached."""
    left, out = members, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found, left = left[near], left[~near]
                out.append((np.full(len(found), x), found))
                queue.extend(found)
    return out


def segments_for(n: int, radius: int) -> int:
    """Of the numbers of segments whose keys leave n even fingerprints in groups of GROUP, the one with the fewest keys; otherwise two, or one for a radius of one."""
    masks = {s: sum(math.comb(64 // s, i) for i in range(radius // s + 1)) for s in range(min(2, radius), radius + 1)}
    held = [s for s, m in masks.items() if n * m <= GROUP << (64 // s)]
    return min(held, key=lambda s: s * masks[s], default=min(masks, default=1))


def links(fps: DataFrame, radius: int = RADIUS, segments: int | None = None) -> DataFrame:
    """Columns a, b: enough of the pairs of distinct fp within radius to join every component.

    Each pair within radius is met in some group, and each group gives a spanning
    forest of its own links, so no two fingerprints that are linked come apart.
    """
    spark, n = fps.sparkSession, fps.count()
    segments = segments or segments_for(n, radius)
    layout = [(np.uint64(start), width, ball(width, radius // segments)) for start, width in cuts(segments)]
    parts = max(shuffle_width(spark), -(-n * sum(len(m) for _, _, m in layout) // KEYS_PER_TASK))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            keys, owner, home = [], [], []
            for s, (start, width, masks) in enumerate(layout):
                value = (fp >> start) & np.uint64((1 << width) - 1)
                keys.append((((value[:, None] ^ masks[None, :]) << np.uint64(3)) | np.uint64(s)).ravel())
                owner.append(np.repeat(fp, len(masks)))
                home.append(np.tile(masks == 0, len(fp)))
            key, who, at_home = map(np.concatenate, (keys, owner, home))
            part = (((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            key, who, at_home, part = key[order], who[order], at_home[order], part[order]
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for lo in range(0, len(edges) - 1, 4096):
                span = list(zip(edges[lo : lo + 4096], edges[lo + 1 : lo + 4097], strict=False))
                yield pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in span], pa.int32()), *[pa.array([x[a:z].tobytes() for a, z in span], pa.binary()) for x in (key, who, at_home)]], names=["part", "key", "who", "home"])

    def match(table: pa.Table) -> pa.Table:
        key, who = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint64) for c in ("key", "who"))
        home = np.frombuffer(b"".join(table["home"].to_pylist()), bool)
        order = np.argsort(key, kind="stable")
        key, who, home = key[order], who[order], home[order]
        first = np.flatnonzero(np.diff(key, prepend=key[0] ^ np.uint64(1)) != 0)
        size = np.diff(first, append=len(key))
        alive = (size > 1) & np.logical_or.reduceat(home, first)
        found = []
        small = np.repeat(alive & (size <= SMALL_GROUP), size)
        k, w, h = key[small], who[small], home[small]
        for lag in range(1, SMALL_GROUP):
            at = np.flatnonzero(k[:-lag] == k[lag:]) if lag < len(k) else np.empty(0, np.int64)
            if not len(at):
                break
            at = at[h[at] | h[at + lag]]
            near = at[np.bitwise_count(w[at] ^ w[at + lag]) <= radius]
            found.append((w[near], w[near + lag]))
        for g in np.flatnonzero(alive & (size > SMALL_GROUP)):
            found += forest(np.unique(who[first[g] : first[g] + size[g]]), radius)
        a = np.concatenate([x for x, _ in found]).view(np.int64) if found else np.empty(0, np.int64)
        b = np.concatenate([y for _, y in found]).view(np.int64) if found else np.empty(0, np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    dealt = fps.select("fp").mapInArrow(emit, "part int, key binary, who binary, home binary")
    return dealt.groupBy("part").applyInArrow(match, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node that has a link.

    Alternates large-star and small-star steps until no edge changes; each round
    is a written table, so neither lineage nor lost executors matter.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    star = edges.groupBy("u").agg(F.min("v").alias("root"))
    return star.select(F.col("u").alias("node"), "root").unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, segments: int | None = None, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links can reach) of each row."""
    marked = written(fingerprints(docs, shingle), "simhash")
    by_fp = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(by_fp, radius, segments))
    rooted = by_fp.join(roots, by_fp["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(named, "root").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(classes, marked["fp"] == classes["_fp"]).select("doc_id", "fp", "component_id")
