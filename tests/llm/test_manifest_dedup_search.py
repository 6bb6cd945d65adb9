"""Merkle manifests, exact dedup and ranked search against brute-force versions, on a given table and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, merkle, ranked_search

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
P1 = "The quick brown fox Jumps over the lazy dog"

AWKWARD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, None), (4, "one", "en", None), (5, P1, "en", "a"), (6, P1.upper(), "en", "a"), (6, P1, "en", "a"), (6, P1, "en", "a"),
    (7, "ÑANDÚ ñandú Ñandú 日本語 x_y-z 12", "es", "b"), (8, "ÑANDÚ ñandú Ñandú 日本語 X_Y-Z 12", "es", "b"), (None, P1, "en", "b"), (None, "alone", "en", "b"), (None, "Alone", "en", "b"), (9, "fox " * 3000, "en", "c"),
    (10, "another fox", "en", "c"), (10, "Another dog", "en", "c"), (-5, "negative", "", ""), (2**40, "large id", "en", "ä"), (25, "ABC def", "en", "z"),
] + [(100 + i, f"Fox number {i % 7}", "en", "many") for i in range(300)]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for name in ("kept", "fp", "sha", "grp", "idx", "node", "n", "key", "row", "file", "root"):
        df = df.withColumn(name, F.lit(1))
    return df.select("*", F.lit("no").alias("TEXT")).repartition(3)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


# ---- 11


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i - i % 16
        out.append((nodes[first:i], nodes[i + 1 : first + 16]))
        i //= 16
    return out


def slow_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H(*map(part, (*r[:4], t)))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for g in by.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {s: climb([leaf(r, r[4]) for r in g]) for s, g in by.items()}
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    top = climb([trees[s][-1][0] for s in names])
    root = top[-1][0]
    for j, s in enumerate(names):
        for i, r in enumerate(by[s]):
            path = siblings(trees[s], i) + siblings(top, j)
            odd = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = leaf(r, r[4].translate(LOW) if odd else r[4])
            for left, right in path:
                folded = H(*left, folded, *right)
            yield r[0], leaf(r, r[4]), trees[s][-1][0], root, H(*(x for a, b in path for x in a + b)), folded, folded == root


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("levels", [3, 1])
def test_manifest(spark, given, awkward, levels):
    """With one level a superblock, 307 leaves take several rounds."""
    rows = [(d, s, lang, None if t is None else len(t), t) for d, t, lang, s in AWKWARD]
    same(merkle.proofs(awkward, levels).select(*MANIFEST).collect(), slow_manifest(rows))
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in given.collect()]
    same(merkle.proofs(given, levels).select(*MANIFEST).collect(), slow_manifest(rows))


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([(1, "A", "en", None, 1)], [(1, "x", "en", "s", 1), (2, "y", "en", "s", 1)], [(i, "Long " * 50_000, "en", f"s{i % 40}", 250_000) for i in range(45)]):
        df = spark.createDataFrame(rows, schema)
        same(merkle.proofs(df).select(*MANIFEST).collect(), slow_manifest([(d, s, lang, n, t) for d, t, lang, s, n in rows]))
    none, root = merkle.manifest(spark.createDataFrame([], schema))
    assert none.count() == 0 and root is None


def test_paths_tell_of_a_change(spark, given):
    found, root = merkle.manifest(given)
    for r in found.limit(20).collect():
        assert merkle.fold(r.leaf, bytes(r.path)) == root
        assert merkle.fold(H(r.leaf), bytes(r.path)) != root


# ---- 12


def slow_exact(rows):
    groups, out = {}, []
    for d, t in rows:
        groups.setdefault((t or "").translate(LOW), []).append(d)
    for t, ids in groups.items():
        least = lambda d: (d is not None, d or 0)
        ids.sort(key=least)
        out += [(d, ids[-1], len(ids), i == len(ids) - 1, hashlib.sha256(t.encode()).hexdigest()) for i, d in enumerate(ids)]
    return out


def test_exact_dedup(spark, given, awkward):
    for df, rows in ((given, [(r.doc_id, r.text) for r in given.collect()]), (awkward, [r[:2] for r in AWKWARD])):
        same(exact_dedup.exact_dedup(df).collect(), slow_exact(rows))


def test_hot_text_and_long_text(spark):
    rng = random.Random(4)
    texts = ["Hot text"] * 700 + ["Long " * 100_000, "long " * 100_000] + [f"t{rng.randrange(900)}" for _ in range(600)]
    rows = list(enumerate(texts)) + list(enumerate(texts[:50]))
    same(exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect(), slow_exact(rows))


def test_fingerprints_that_meet_go_apart_by_bytes(spark, monkeypatch):
    """Texts of one fingerprint are told apart by their bytes; of one digest, the job fails."""
    rows = spark.createDataFrame([(1, 7, b"a"), (2, 7, b"b"), (3, 8, b"c")], "doc_id long, fp long, sha binary")
    assert [tuple(r) for r in exact_dedup.repeated(rows, 3).collect()] == [(7, 2)]
    monkeypatch.setattr(exact_dedup, "digests", lambda docs: docs.select("doc_id", F.xxhash64(F.lit(1)).alias("fp"), F.unhex(F.sha2("text", 256)).alias("sha")))
    with pytest.raises(Exception, match="texts of one digest differ"):
        exact_dedup.exact_dedup(spark.createDataFrame([(1, "x"), (2, "x")], "doc_id long, text string")).collect()


def test_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    bits, first = 12, 5 << 12
    parts, every = [], Counter()
    for n in (0, 1, 300, 5000):
        low = rng.integers(0, 2**30, n // 2 + n % 2).astype(np.uint64) << np.uint64(26)
        fp = (np.uint64(5) << np.uint64(56)) | np.concatenate((low, low[: n // 2]))
        every.update(fp.tolist())
        parts.append(exact_dedup.QuotientFilter.of(*exact_dedup.totals(fp, np.ones(len(fp), np.int64)), first, bits))
    got = exact_dedup.QuotientFilter.merged(parts).items()
    assert dict(zip(*(x.tolist() for x in got), strict=True)) == every and (np.diff(got[0]) > 0).all()


# ---- 13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_search(rows, items, k=20):
    cut = lambda t: TERM.findall((t or "").translate(LOW))
    docs = [(d, Counter(cut(t))) for d, t in rows]
    docs = [(d, c, c.total()) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for i, t in {(i, t) for i, t in items if t is not None}:
        asked.setdefault(i, Counter()).update(cut(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c, n in docs:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in terms.items() if t in c)
            if score:
                found.append((-score, d is not None, d or 0))
        out += [(i, r, d if some else None, -s) for r, (s, some, d) in enumerate(sorted(found)[:k], 1)]
    return out


ITEMS = [(1, "quick FOX fox"), (2, "nothing known here at all"), (3, ""), (4, None), (5, "ñandú 日本語 Ñandú"), (6, "another"), (6, "dog, dog"), (6, "dog, dog"), (None, "fox_number 3"), (7, "one; alone. large-id " * 2000)]


@pytest.mark.parametrize("terms", [200_000, 3])
def test_search(spark, given, awkward, monkeypatch, terms):
    """In one block of items and in several; entries sorted in many small blocks too."""
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", terms)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("item", F.lit(0)).repartition(2)
    same(ranked_search.ranked_search(awkward, items).collect(), slow_search([r[:2] for r in AWKWARD], ITEMS))
    if terms > 3:
        monkeypatch.setattr(ranked_search, "BLOCK_ENTRIES", 50)
        bench = spark.read.parquet(f"{SF}/benchmark.parquet")
        same(ranked_search.ranked_search(given, bench, 7).collect(), slow_search([(r.doc_id, r.text) for r in given.collect()], [(r.item_id, r.text) for r in bench.collect()], 7))


def test_accumulation():
    rng = np.random.default_rng(1)
    item, doc, impact = rng.integers(0, 900, 20_000), rng.integers(0, 500, 20_000), rng.integers(1, 2**40, 20_000)
    want = Counter()
    for i, d, x in zip(item.tolist(), doc.tolist(), impact.tolist(), strict=True):
        want[i, d] += x
    i, d, s = ranked_search.accumulated(item, doc, impact, 500, 900)
    assert dict(zip(zip(i.tolist(), d.tolist(), strict=True), s.tolist(), strict=True)) == want
    keys = rng.integers(0, 2**50, 5000)
    assert (keys[ranked_search.radix_order(keys, 2**50)] == np.sort(keys)).all()
