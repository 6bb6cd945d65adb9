"""Best-fit packing after Martello-Toth dominance reduction.

Documents become pieces of at most `capacity` ids. Only lengths matter to
packing, so it works on the count of pieces of each length, at most `capacity`
numbers whatever the corpus. Small sets of lengths that provably dominate every
other way to fill a sequence are fixed for good; best fit, longest first, packs
what is left, many equal sequences at a time. The plan says which ranks among
the pieces of one length go to which sequences, and each piece finds its place
by its length and rank.

Where documents come in an order that training is to keep, such as a mixture's,
pack_in_order does the same in windows of that order: a task packs the pieces of
one window, gives those of equal length out in order, and numbers sequences by
the first document they hold.

Defined results: a null or empty text is the single id 0; equal rows are packed
one by one; a null doc_id stays null; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pick, ranked, written
from .tokens import encode, vocabulary_path

CAPACITY = 2048
#: Texts that are encoded together.
TOGETHER = 256
#: Documents in a window of pack_in_order.
WINDOW = 8192

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"

Group = tuple[int, list[tuple[int, int]]]  # sequences, and (length, how many) in each


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, placed: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; a long text's first piece takes what does not fill one.

    placed: and file, row of its document, where docs has such columns.
    """
    path = path or vocabulary_path()
    end = (0).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TOGETHER):
                rows = []
                part = b.slice(lo, TOGETHER)
                for j, ids in enumerate(encode(part.column(1).to_pylist(), path)):
                    ids += end
                    n = len(ids) // 4
                    edges = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                    rows += [(j, i, a, z - a, zlib.crc32(ids[4 * a : 4 * z])) for i, (a, z) in enumerate(zip(edges, edges[1:], strict=False))]
                own, *told = zip(*rows, strict=True)
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                about = [part.column(c).take(pa.array(own)) for c in (0, *range(2, part.num_columns))]
                yield pa.RecordBatch.from_arrays([about[0], *[pa.array(c, t) for c, t in zip(told, types, strict=True)], *about[1:]], names=["doc_id", "piece", "start", "length", "ids_crc32", *["file", "row"][: len(about) - 1]])

    return pick(docs, "doc_id", "text", *["file", "row"] * placed).mapInArrow(run, PIECE + ", file string, row long" * placed)


def _others(count: list[int], j: int, room: int) -> list[int]:
    """Lengths that fit beside one j, ascending; a length twice if two are left."""
    out = []
    for s in range(1, room + 1):
        left = count[s] - (s == j)
        out += [s] * min(left, 3)
    return out


def dominate(count: list[int], capacity: int) -> list[Group]:
    """Fixes sets that dominate all others holding their longest piece, and takes them out of count.

    A set dominates another if each of the other's pieces can be dealt to one of
    its own that is at least as long as all it gets; then some best packing has it.
    """
    fixed: list[Group] = []
    again = True
    while again:
        again = False
        for j in range(capacity, 0, -1):
            while count[j]:
                chosen = _dominant(count, j, capacity - j)
                if chosen is None:
                    break
                need: dict[int, int] = {}
                for s in (j, *chosen):
                    need[s] = need.get(s, 0) + 1
                # a fix takes pieces away only, so the reason holds until one of its lengths runs out
                times = min(count[s] // k for s, k in need.items())
                for s, k in need.items():
                    count[s] -= times * k
                fixed.append((times, sorted(need.items(), reverse=True)))
                again = True
    return fixed


def _dominant(count: list[int], j: int, room: int) -> tuple[int, ...] | None:
    if room > 0 and count[room] - (room == j) > 0:
        return (room,)  # fills the sequence, and any other set's rest fits in its place
    fit = _others(count, j, room)
    if not fit:
        return ()
    a = fit[-1]
    if len(fit) == 1 or fit[0] + fit[1] > room:
        return (a,)  # one more fits at most, and this is the longest
    if len(fit) > 2 and fit[0] + fit[1] + fit[2] <= room:
        return None  # sets of four or more are not looked at
    pairs = []
    lo, hi = 0, len(fit) - 1
    while lo < hi:  # for each longer one, the longest partner that fits
        if fit[lo] + fit[hi] <= room:
            pairs.append((fit[hi], fit[lo]))
            lo += 1
        else:
            hi -= 1
    best = max(x + y for x, y in pairs)
    if best <= a:
        return (a,)  # any pair fits in its place
    partner = [s for s in fit[:-1] if a + s <= room]
    if not partner:
        return None
    b = partner[-1]
    above = [s for s in fit if s > b]
    for i, y in enumerate(above):  # a pair that neither {a, b} nor a alone can stand for
        for x in reversed(above[i + 1 :]):
            if x + y <= room:
                if x + y > a:
                    return None
                break
    return (a, b)


def best_fit(count: list[int], capacity: int) -> list[Group]:
    """Longest first, each piece into the fullest sequence that has room; equal sequences at once."""
    open_: list[list[Group]] = [[] for _ in range(capacity + 1)]
    for s in range(capacity, 0, -1):
        left, r = count[s], s
        while left:
            while r <= capacity and not open_[r]:
                r += 1
            if r > capacity:
                k = capacity // s
                if left // k:
                    open_[capacity - k * s].append((left // k, [(s, k)]))
                if left % k:
                    open_[capacity - left % k * s].append((1, [(s, left % k)]))
                break
            n, held = open_[r].pop()
            k = r // s
            whole = min(n, left // k)
            rest = min(left - whole * k, k - 1) if whole < n else 0
            if whole:
                open_[r - k * s].append((whole, [*held, (s, k)]))
            if rest:
                open_[r - rest * s].append((1, [*held, (s, rest)]))
            if n - whole - (rest > 0):
                open_[r].append((n - whole - (rest > 0), held))
            left -= whole * k + rest
    return [g for groups in open_ for g in groups]


def plan(count: list[int], capacity: int) -> tuple[np.ndarray, ...]:
    """Arrays, sorted by key = length << 40 | first rank: key, pieces a sequence, first sequence, first offset, length."""
    count = list(count)
    groups = dominate(count, capacity)
    groups += best_fit(count, capacity)
    used, sequence, rows = [0] * (capacity + 1), 0, []
    for n, held in groups:
        at = 0
        for s, k in held:
            rows.append((s << 40 | used[s], k, sequence, at, s))
            used[s] += n * k
            at += s * k
        sequence += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else tuple(np.empty(0, np.int64) for _ in range(5))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a column length."""
    names = cut.columns
    count = [0] * (capacity + 1)
    for length, n in cut.groupBy("length").count().collect():  # at most `capacity` rows
        count[length] = n
    key, k, first, base, size = plan(count, capacity)
    placed = ranked(cut, ["length"], names, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            own = length << 40 | rank
            at = np.searchsorted(key, own, "right") - 1
            inside = own - key[at]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(first[at] + inside // k[at]), pa.array(base[at] + inside % k[at] * size[at])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return placed.select(*names, "rank").mapInArrow(run, schema)


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece with its place."""
    return pack(written(pieces(docs, path, capacity), "pieces"), capacity)


def _window(table: pa.Table, capacity: int) -> pa.Table:
    """The pieces of one window with their sequence, numbered from 0 by the first place it holds, and offset."""
    length, place, piece = (table[c].to_numpy().astype(np.int64) for c in ("length", "place", "piece"))
    order = np.lexsort((piece, place))
    table, length = table.take(pa.array(order)), length[order]
    by_length = np.argsort(length, kind="stable")
    count = np.bincount(length, minlength=capacity + 1)
    rank = np.empty(len(length), np.int64)
    rank[by_length] = np.arange(len(length)) - np.repeat(np.cumsum(count) - count, count)
    key, k, first, base, size = plan(count.tolist(), capacity)
    at = np.searchsorted(key, length << 40 | rank, "right") - 1
    inside = (length << 40 | rank) - key[at]
    _, begins, sequence = np.unique(first[at] + inside // k[at], return_index=True, return_inverse=True)
    number = np.empty(len(begins), np.int64)
    number[np.argsort(begins, kind="stable")] = np.arange(len(begins))
    return table.append_column("sequence_id", pa.array(number[sequence])).append_column("offset", pa.array(base[at] + inside % k[at] * size[at]))


def pack_in_order(cut: DataFrame, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces with columns file and row, which it drops; sequences are numbered from 0 in the order of windows.

    Files follow each other by the number that Spark gives them, then by name; of
    a table that is not read from Parquet, there are no files to follow, and rows
    stand in the order in which Spark numbers them (common.with_place). A
    row for each file and one for each window is ordered in one task, as few as
    these are; the pieces of a window, and no more, meet in one.
    """
    number = lambda pattern: F.regexp_extract("file", pattern, 1).try_cast("long")
    before = W.orderBy(number("part-([0-9]+)"), number("-c([0-9]+)[^/]*$"), "file").rowsBetween(W.unboundedPreceding, -1)
    files = cut.groupBy("file").agg((F.max("row") + 1).alias("n")).select(F.col("file").alias("_file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_begin"))
    placed = cut.join(files, cut["file"] == files["_file"]).withColumn("place", F.col("_begin") + F.col("row"))
    names = [x.split()[0] for x in PIECE.split(", ")]
    placed = placed.select(*names, "place", F.floor(F.col("place") / window).alias("window"))
    packed = written(placed.groupBy("window").applyInArrow(lambda t: _window(t, capacity), f"{PIECE}, place long, window long, sequence_id long, offset long"), "windows")
    held = packed.groupBy("window").agg((F.max("sequence_id") + 1).alias("n"))
    earlier = W.orderBy("window").rowsBetween(W.unboundedPreceding, -1)
    begins = held.select(F.col("window").alias("_w"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_s"))
    return packed.join(begins, packed["window"] == begins["_w"]).select(*names, (F.col("_s") + F.col("sequence_id")).alias("sequence_id"), "offset")
