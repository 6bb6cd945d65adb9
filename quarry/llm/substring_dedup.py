"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark's groups.

A word goes if a window that covers it has the words of a window that starts in
a document with a smaller doc_id. Hashes travel in packed blocks: a task hashes
its documents in numpy, keeps one entry a hash (its smallest doc_id), and deals
the entries into buckets by hash. A bucket's hashes are sorted and compared in
numpy, inside the group that Spark deals out, and it sends back, to each
document, those that a smaller doc_id has too; the document's windows are hashed again,
and the repeated ones merge into maximal removal intervals.

Hashes have 64 bits, of which 56 travel beside the bucket's number; the odds
that any two of n different windows meet are about n * n / 2**62.

Defined results: a null or empty text has no words; a null doc_id counts as the
smallest; rows with one doc_id never remove each other's words; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, pick, shuffle_width

WINDOW = 13
#: Windows that a task hashes before it sends them on, and those of a bucket on average.
BLOCK_WINDOWS, BUCKET_WINDOWS = 1_500_000, 2_000_000
BASE = np.uint64(0xD6E8FEB86659FD93)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
HELD = 7  # bytes of a hash that travel


def codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(code: np.ndarray, window: int) -> np.ndarray:
    """Polynomial hash of each run of `window` codes, then mixed so that all bits count."""
    m = len(code) - window + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = code[:m].copy()
    for j in range(1, window):
        h *= BASE
        h += code[j : j + m]
    for mix in MIX:
        h ^= h >> np.uint64(33)
        h *= mix
    return h ^ (h >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def merged(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal (first word, end) intervals that the windows at these starts, in order, cover."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.concatenate(([0], breaks + 1))].tolist(), (starts[np.concatenate((breaks, [len(starts) - 1]))] + window).tolist(), strict=True))


def _packed(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HELD]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    held = np.frombuffer(raw, np.uint8).reshape(-1, HELD)
    out = np.zeros((len(held), 8), np.uint8)
    out[:, :HELD] = held
    return out.view("<u8").ravel()


def _cut(h: np.ndarray) -> np.ndarray:
    return h & np.uint64((1 << 8 * HELD) - 1)


def _about(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Documents in order and how many hashes each has, small for neighbouring ids."""
    return zstandard.compress(np.concatenate((keys[:1], np.diff(keys), counts)).astype(np.int64).tobytes(), 1)


def _keys(about: bytes) -> np.ndarray:
    """The document of each hash that comes with this block."""
    a = np.frombuffer(zstandard.decompress(about), np.int64)
    return np.repeat(np.cumsum(a[: len(a) // 2]), a[len(a) // 2 :])


def _by_target(keys: np.ndarray, h: np.ndarray, targets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(target, about, hashes) blocks that tell documents which of their hashes a smaller doc_id has."""
    target = ((keys.astype(np.uint64) * BASE) >> np.uint64(33)).astype(np.int64) % targets
    order = np.lexsort((keys, target))
    keys, h, target = keys[order], h[order], target[order]
    edge = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1], [True])))
    for x, y in zip(edge, edge[1:], strict=False):
        here, count = np.unique(keys[x:y], return_counts=True)
        yield int(target[x]), _about(here, count), _packed(h[x:y])


def repeated_hashes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key (doc_id, null as NULL_ID) and the packed hashes of its windows that also start in a smaller one; a row for each key that has any."""
    source = pick(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), "text")
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(shuffle_width(docs.sparkSession), -(-chars // (6 * BUCKET_WINDOWS)))
    schema = "bucket int, kind int, target int, about binary, hashes binary"
    names = ["bucket", "kind", "target", "about", "hashes"]

    def block(ids: list[int], texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(ids)), key=ids.__getitem__)
        parts = [window_hashes(codes(words_of(texts[i])), window) for i in order]
        doc = np.repeat(np.arange(len(order)), [len(p) for p in parts])
        h = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        if not len(h):
            return
        key = np.array([ids[i] for i in order], np.int64)
        by_hash = np.argsort(h, kind="stable")  # within a hash, the smallest doc_id comes first
        sorted_h = h[by_hash]
        head = np.concatenate(([True], sorted_h[1:] != sorted_h[:-1]))
        least = key[doc[by_hash[np.flatnonzero(head)]]][np.cumsum(head) - 1]
        later = np.zeros(len(h), bool)
        later[by_hash] = key[doc[by_hash]] > least
        sent = np.zeros(len(h), bool)
        sent[by_hash[head]] = True
        rows = []
        if later.any():
            rows += [(t % buckets, 1, t, about, blob) for t, about, blob in _by_target(key[doc[later]], _cut(h[later]), buckets)]
        h, doc = h[sent], doc[sent]
        bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order_b = np.argsort(bucket, kind="stable")
        h, doc, bucket = h[order_b], doc[order_b], bucket[order_b]
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        for x, y in zip(edge, edge[1:], strict=False):
            here, count = np.unique(doc[x:y], return_counts=True)
            rows.append((int(bucket[x]), 0, 0, _about(key[here], count), _packed(h[x:y])))
        for lo in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 64], strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(k)
                texts.append(t)
                held += len(t or "")
                if held > 6 * BLOCK_WINDOWS:
                    yield from block(ids, texts)
                    ids, texts, held = [], [], 0
        yield from block(ids, texts)

    def compare(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        out = [(t.as_py(), a.as_py(), h.as_py()) for t, a, h, k in zip(table["target"], table["about"], table["hashes"], kind, strict=True) if k == 1]
        blocks = [(_keys(a.as_py()), h.as_py()) for a, h, k in zip(table["about"], table["hashes"], kind, strict=True) if k == 0]
        if blocks:
            h, key = np.concatenate([_unpacked(x) for _, x in blocks]), np.concatenate([k for k, _ in blocks])
            order = np.argsort(h, kind="stable")
            h, key = h[order], key[order]
            head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            later = key > np.repeat(np.minimum.reduceat(key, head), np.diff(head, append=len(h)))
            if later.any():
                out += _by_target(key[later], h[later], buckets)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 3, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["target", "about", "hashes"])

    def gather(table: pa.Table) -> pa.Table:
        key = np.concatenate([_keys(a.as_py()) for a in table["about"]])
        h = np.frombuffer(b"".join(table["hashes"].to_pylist()), np.uint8).reshape(-1, HELD)
        order = np.argsort(key, kind="stable")
        key, h = key[order], h[order]
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        return pa.table({"key": key[edge[:-1]], "hashes": pa.array([h[x:y].tobytes() for x, y in zip(edge, edge[1:], strict=False)], pa.binary())})

    met = source.mapInArrow(hashed, schema).groupBy("bucket").applyInArrow(compare, "target int, about binary, hashes binary")
    return met.groupBy("target").applyInArrow(gather, "key long, hashes binary")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space), intervals (maximal, in words)."""
    source = pick(docs, "doc_id", "text")
    gone = repeated_hashes(docs, window)
    joined = source.join(gone, F.coalesce(source["doc_id"], F.lit(NULL_ID)) == gone["key"], "left").select("doc_id", "text", "hashes")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words, spans = words_of(t), []
                if blob:
                    seen = _cut(window_hashes(codes(words), window))
                    spans = merged(np.flatnonzero(np.isin(seen, _unpacked(blob))), window)
                kept, at = [], 0
                for x, y in spans:
                    kept += words[at:x]
                    at = y
                kept += words[at:]
                rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"), [{"first": x, "end": y} for x, y in spans]))
            n, removed, text, spans = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(text, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_words", "n_removed", "kept_text", "intervals"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string, intervals array<struct<first: long, end: long>>")
