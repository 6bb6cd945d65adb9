"""Exact dedup: counting quotient filters of fingerprints, then the texts of the repeated ones byte by byte.

A fingerprint is the XXH64 of a text whose A-Z are lower-cased. Its top bits, the
quotient, say where it stands in a filter and need no room there; the rest, the
remainder, is kept in order, with a count. Each task fills a filter from its own
rows and cuts it by ranges of quotients; the cuts of a range merge by their sorted
remainders, without loss, and counts add up. Fingerprints with a count of one are
single texts. The others mark a bitmap of fixed size, which is sent to every task
and lets only their texts pass to be grouped by all their bytes, after a
partial grouping inside each task, so a text with any number of copies leaves a
task once. A digest whose texts are not all equal to the byte fails the job.

Defined results: a null text counts as empty; of rows equal in text and doc_id,
one stays; a null doc_id is the smallest, so such a row stays only in a group of
its like; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, pick, remove_path, shared_path, shuffle_width, with_place

#: Bits of a fingerprint and of the quotient; rows of a task's filter, and of a merged one on average.
BITS, QUOTIENT = 64, 20
BLOCK_ROWS, RANGE_ROWS = 4_000_000, 1_000_000
#: Slots of the bitmap that is sent to all tasks: 2**26 bits are 8 MB, however many rows there are; a piece of it has 2**15.
SLOT_BITS, PIECE_BITS = 26, 15
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class QuotientFilter:
    """Counts of fingerprints whose quotients lie in [first, first + 2**bits): sorted remainders in a run for each quotient that occurs.

    occupied has a bit for each quotient; ends has a bit for each remainder, 1 at
    the last of its run; counts above one are kept apart, by place.
    """

    def __init__(self, first: int, bits: int, occupied: bytes, ends: bytes, remainders: bytes, places: bytes, counts: bytes) -> None:
        self.first, self.bits = first, bits
        self.parts = occupied, ends, remainders, places, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, first: int, bits: int) -> QuotientFilter:
        """From distinct fingerprints in ascending order."""
        quotient = (fingerprints >> np.uint64(BITS - QUOTIENT)).astype(np.int64) - first
        occupied = np.zeros(1 << bits, np.uint8)
        occupied[quotient] = 1
        ends = np.append(quotient[1:] != quotient[:-1], True)[: len(quotient)]
        held = (BITS - QUOTIENT + 7) // 8
        remainders = (fingerprints & np.uint64((1 << (BITS - QUOTIENT)) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :held]
        more = np.flatnonzero(counts > 1)
        return cls(first, bits, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), remainders.tobytes(), more.astype("<i8").tobytes(), counts[more].astype("<i8").tobytes())

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in ascending order, and their counts."""
        occupied, ends, remainders, places, counts = self.parts
        held = (BITS - QUOTIENT + 7) // 8
        rest = np.zeros((len(remainders) // held, 8), np.uint8)
        rest[:, :held] = np.frombuffer(remainders, np.uint8).reshape(-1, held)
        end = np.unpackbits(np.frombuffer(ends, np.uint8), count=len(rest)).astype(np.int64)
        run = np.cumsum(end) - end
        quotient = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8)))[run] + self.first
        n = np.ones(len(rest), np.int64)
        n[np.frombuffer(places, "<i8")] = np.frombuffer(counts, "<i8")
        return (quotient.astype(np.uint64) << np.uint64(BITS - QUOTIENT)) | rest.view("<u8").ravel(), n

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """The filter of all their rows; they have one range."""
        found = [f.items() for f in filters]
        return cls.of(*totals(np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])), filters[0].first, filters[0].bits)


def totals(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in ascending order with the sums of their counts."""
    if not len(fingerprints):
        return fingerprints, counts
    order = np.argsort(fingerprints, kind="stable")
    fingerprints, counts = fingerprints[order], counts[order]
    head = np.flatnonzero(np.append(True, fingerprints[1:] != fingerprints[:-1]))
    return fingerprints[head], np.add.reduceat(counts, head)


def range_bits(rows: int, width: int) -> int:
    """How many bits of the quotient number the ranges: enough for RANGE_ROWS a range, and some for each task."""
    return min(QUOTIENT, max(-(-rows // RANGE_ROWS) - 1, 2 * width - 1).bit_length())


def normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, sha) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [normal(t) for t in b.column(1).to_pylist()]
            fp = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], names=["doc_id", "fp", "sha"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long, sha binary")


def repeated(rows: DataFrame, n_rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that more than one row has, by merged filters."""
    top = range_bits(n_rows, shuffle_width(rows.sparkSession))
    bits = QUOTIENT - top
    schema = "range int, occupied binary, ends binary, remainders binary, places binary, counts binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fp = np.concatenate(parts)
        fp, n = totals(fp, np.ones(len(fp), np.int64))
        where = (fp >> np.uint64(BITS - top)).astype(np.int64) if top else np.zeros(len(fp), np.int64)
        edge = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1], [True])))
        for x, y in zip(edge, edge[1:], strict=False):
            at = int(where[x])
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *[pa.array([p], pa.binary()) for p in QuotientFilter.of(fp[x:y], n[x:y], at << bits, bits).parts]], names=names)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            parts.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            held += b.num_rows
            if held >= BLOCK_ROWS:
                yield from cut(parts)
                parts, held = [], 0
        if held:
            yield from cut(parts)

    def merge(table: pa.Table) -> pa.Table:
        at = table["range"][0].as_py() << bits
        whole = QuotientFilter.merged([QuotientFilter(at, bits, *row) for row in zip(*(table[c].to_pylist() for c in names[1:]), strict=True)])
        fp, n = whole.items()
        return pa.table({"fp": fp[n > 1].view(np.int64), "n": n[n > 1]})

    return rows.select("fp").mapInArrow(fill, schema).groupBy("range").applyInArrow(merge, "fp long, n long")


def bitmap(fps: DataFrame) -> DataFrame:
    """(piece, bits) of a bitmap of 2**SLOT_BITS slots that these fingerprints mark: at most 2**(SLOT_BITS - PIECE_BITS) rows of 4 KB."""
    slot = F.shiftrightunsigned("fp", BITS - SLOT_BITS)
    return fps.groupBy(F.shiftright(slot, PIECE_BITS).alias("piece")).agg(F.bitmap_construct_agg(slot % 2**PIECE_BITS).alias("bits"))


def marked(fp: Column, bits: Column) -> Column:
    """Whether a fingerprint's slot is set in its piece."""
    place = F.shiftrightunsigned(fp, BITS - SLOT_BITS) % 2**PIECE_BITS
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row; the row with the largest doc_id stays of each group."""
    spark = docs.sparkSession
    made = []

    def store(df: DataFrame, name: str) -> DataFrame:
        made.append(path := shared_path(spark, f"exact-{name}"))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = store(digests(docs), "rows")
    fps = store(repeated(rows, rows.count()), "repeated")
    placed = with_place(rows, "file", "row")  # tells rows of one text and doc_id apart
    again = placed.join(fps.select("fp"), "fp", "left_semi")
    best = F.max(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), "file", "row")).alias("best")
    classes = again.groupBy("fp", "sha").agg(F.count("*").alias("rows"), best)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [normal(t) for t in b.column(0).to_pylist()]
            fp = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(found, pa.binary())], names=["fp", "bytes"])

    sent = F.broadcast(store(bitmap(fps), "bitmap"))  # at most 8 MB, by its construction
    piece = F.shiftrightunsigned("fp", BITS - SLOT_BITS + PIECE_BITS)
    suspects = pick(docs, "text").mapInArrow(texts, "fp long, bytes binary").join(sent, piece == F.col("piece")).where(marked(F.col("fp"), F.col("bits")))
    equal = suspects.groupBy("fp", "bytes").agg(F.count("*").alias("same")).select("fp", F.unhex(F.sha2("bytes", 256)).alias("sha"), "same")
    checked = classes.join(equal, ["fp", "sha"], "left").withColumn("sure", F.coalesce(F.col("rows") == F.col("same"), F.lit(False)))
    told = F.when(F.col("sure"), F.col("rows")).otherwise(F.raise_error(F.lit("texts of one digest differ")).cast("long"))
    groups = store(checked.select(F.col("fp").alias("_fp"), F.col("sha").alias("_sha"), told.alias("size"), "best"), "groups")

    met = placed.join(groups, (F.col("fp") == F.col("_fp")) & (F.col("sha") == F.col("_sha")), "left")
    key = F.col("best.key")
    keep = F.when(key.isNull(), F.col("doc_id")).when(key != NULL_ID, key)
    first = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    for path in made[1:3]:
        remove_path(spark, path)
    return met.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(first, F.lit(True)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
