"""The stages of corpus_pipeline.py against brute force, each on its predecessor's rows."""

import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import mixing, near_copies, packing, secrets
from quarry.llm.common import by_place, one_case, with_place
from quarry.llm.queries import WEIGHTS

from .test_operators import AWKWARD, SF, real_ids, slow_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# names that stages use inside, or that differ in case alone
CLASHING = ["TEXT", "Doc_Id", "_id", "_node", "_c1", "mix_slot", "mix_place", "_added4", "file", "row", "rank", "_b", "root", "_stream"]


@pytest.fixture(scope="module", params=["given", "awkward"])
def docs(request, spark):
    if request.param == "given":
        return spark.read.parquet(f"{SF}/documents.parquet")
    long = "Some words that are all different come here: " + " ".join(f"w{i}" for i in range(80))
    more = [(20, long, "en", "a"), (20, long, "en", "a"), (21, long + ' token = "abcdefgh12345678"', "en", None), (None, long + " end", "en", "a"), (22, long.replace("w", "q"), None, "b"), *[(None, long.replace("w", "z"), "en", "c")] * 2]
    df = spark.createDataFrame(AWKWARD + more, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit("no").alias(c) for c in CLASHING]).repartition(3)


def picked(df):
    """The five columns by their exact names."""
    at = [df.columns.index(c) for c in COLUMNS]
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{i}").alias(c) for i, c in zip(at, COLUMNS, strict=True)])


def rows(df):
    return [tuple(r) for r in picked(df).collect()]


def told(df):
    return sorted(map(repr, rows(df)))


def five_words(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def slow_near_dedup(held):
    """One row of each group at Jaccard 0.8 or more: the smallest id; two texts of one id that are not linked stay."""
    texts = list(dict.fromkeys(r[1] or "" for r in held))
    sets, root = [five_words(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    groups = defaultdict(list)
    for r in held:
        groups[root[texts.index(r[1] or "")]].append(r)
    return list(groups.values())


def test_stages(spark, docs, tmp_path):
    made, kept = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, made, SF)
        made.write.parquet(f"{tmp_path}/{i}")
        made = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(made)
    extra = [c for c in docs.columns if c not in COLUMNS and c.lower() not in COLUMNS]
    assert all(x.columns == COLUMNS + extra for x in kept[:4])
    good = [r for r in rows(docs) if slow_quality(r[1])[6]]
    assert told(kept[0]) == sorted(map(repr, good))
    left = rows(kept[1])
    groups = slow_near_dedup(good)
    assert len(left) == len(groups)
    for g in groups:
        (one,) = [r for r in left if r in g]
        ids = [r[0] for r in g if r[0] is not None]
        assert one[0] == min(ids, default=None)
    clean = sorted(repr((r[0], secrets.redacted(r[1], secrets.spans(r[1])[1]), *r[2:4], len(secrets.redacted(r[1], secrets.spans(r[1])[1])))) for r in left)
    assert told(kept[2]) == clean
    assert not any(re.search(r"token = \"[A-Za-z0-9]{8,}", r[1]) for r in rows(kept[2]))
    assert told(kept[3]) == told(kept[2])
    want = []
    for r in rows(kept[3]):
        ids = [*real_ids(r[1]), 0]
        at, n = 0, len(ids) % 2048 or min(len(ids), 2048)
        while at < len(ids):
            want.append((r[0], at, n, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + n]))))
            at, n = at + n, 2048
    got = kept[4].collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.start, r.length, r.ids_crc32)) for r in got)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    assert sorted(held) == list(range(len(held)))
    for x in held.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(n for _, n in x) <= 2048


def test_mixture_order(spark, docs, tmp_path):
    """Rows in files by number hold the schedule's order, slot by slot."""
    mixed = corpus_pipeline.mix(spark, docs, SF)
    mixed.write.parquet(f"{tmp_path}/m")
    read = with_place(spark.read.parquet(f"{tmp_path}/m").select(*COLUMNS), "f", "i").orderBy("f", "i")
    order = [(r.doc_id, r.source) for r in read.collect()]
    own = one_case(docs)
    n = len(own.columns)
    plan = by_place(mixing.mix(own, WEIGHTS, carry=True)).orderBy(f"_c{n + 4}", f"_c{n + 5}").collect()
    assert order == [(r[own.columns.index("doc_id")], r[own.columns.index("source")]) for r in plan]


def first_place(rows):
    """Sequence of each document's first piece, for documents with ids of their own."""
    return {r.doc_id: r.sequence_id for r in rows if r.piece == 0}


def test_packing_keeps_the_mixture(spark, tmp_path):
    """Sequences follow the order of their first documents; without the mixing stage, or with other weights, they differ."""
    words = [" ".join(f"d{i}w{j}" for j in range(40 + i * 7 % 90)) for i in range(900)]
    df = spark.createDataFrame([(i, t, "en", "src0" if i < 300 else f"src{i % 3}", len(t)) for i, t in enumerate(words)], "doc_id long, text string, lang string, source string, n_chars long")
    packed = {}
    for name, made in (("mixed", corpus_pipeline.mix(spark, df, SF)), ("plain", df)):
        made.write.parquet(f"{tmp_path}/{name}")
        read = spark.read.parquet(f"{tmp_path}/{name}")
        packed[name] = corpus_pipeline.pack(spark, read, SF).collect()
        place = {r.doc_id: i for i, r in enumerate(with_place(read, "f", "i").orderBy("f", "i").collect())}
        least = defaultdict(list)
        for r in packed[name]:
            least[r.sequence_id].append(place[r.doc_id])
        firsts = [min(least[s]) for s in sorted(least)]
        assert firsts == sorted(firsts)
    assert first_place(packed["mixed"]) != first_place(packed["plain"])
    cut = packing.pieces(with_place(spark.read.parquet(f"{tmp_path}/mixed").select("doc_id", "text"), "file", "row"), placed=True)
    windows = packing.pack_in_order(cut, window=100).collect()
    order = [r.doc_id for r in with_place(spark.read.parquet(f"{tmp_path}/mixed"), "f", "i").orderBy("f", "i").collect()]
    window = {d: i // 100 for i, d in enumerate(order)}
    of = {s: {window[r.doc_id] for r in windows if r.sequence_id == s} for s in {r.sequence_id for r in windows}}
    assert all(len(x) == 1 for x in of.values()) and [min(of[s]) for s in sorted(of)] == sorted(min(x) for x in of.values())
    assert len(windows) == len(packed["mixed"])


def test_run_ends_in_sequences(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0


def test_near_dedup_by_five_words(spark, docs):
    """One document of each group at Jaccard 0.8 or more stays, without the quality rules before too."""
    got, groups = rows(corpus_pipeline.near_dedup(spark, docs, SF)), slow_near_dedup(rows(docs))
    assert len(got) == len(groups)
    for g in groups:
        (one,) = [r for r in got if r in g]
        assert one[0] == min((r[0] for r in g if r[0] is not None), default=None)


def test_near_dedup_keeps_unlinked_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(90)) for x in "abc")
    held = [(1, a), (5, a + " end"), (5, b), (5, b), (5, c), (7, c + " end")]
    df = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in held], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, SF).collect()]
    assert sorted(got) == [(1, a), (5, b), (5, c)]


def test_near_copies_in_large_groups(spark):
    """All links of a bucket count, whatever the size of blocks: edited copies of one text, of which only some are alike."""
    import random

    rng, base = random.Random(4), [f"w{i}" for i in range(120)]
    texts = [" ".join(f"z{rng.randrange(10**6)}" for _ in range(50)) for _ in range(20)] + ["", "a b", "A b"]
    for _ in range(220):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    groups = slow_near_dedup([(i, t) for i, t in enumerate(texts)])
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(near_copies.node("text").alias("node"), "text")
    node = {r.text: r.node for r in df.collect()}
    for block in (16, 256):
        root = {r.node: r.root for r in near_copies.components(near_copies.links(df, block)).collect()}
        got = defaultdict(set)
        for t in texts:
            got[root.get(node[t], node[t])].add(t)
        assert sorted(map(sorted, got.values())) == sorted(sorted({r[1] for r in g}) for g in groups)


def test_near_copies_of_awkward_rows(spark):
    """Repeated rows, nulls, further columns with clashing names, a text of 60,000 words and its copy, and no rows at all."""
    words = [f"w{i % 7919}x{i}" for i in range(60_000)]
    long, near = " ".join(words), " ".join(w if i % 100 else "other" for i, w in enumerate(words))
    rows = [(1, None), (2, ""), (3, long), (4, near), (4, near), (None, "alone here"), (5, " ".join(words[:600]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("node", "root", "band", "TEXT"):
        df = df.select("*", df["doc_id"].alias(name))
    root = {r.node: r.root for r in near_copies.near_copies(df).collect()}
    node = {t: n for t, n in spark.createDataFrame(rows, "doc_id long, text string").select("text", near_copies.node("text")).collect()}
    of = lambda t: root.get(node[t], node[t])
    assert of(long) == of(near) and of(None) == of("")
    assert len({of(long), of(None), of("alone here"), of(rows[-1][1])}) == 4
    assert near_copies.near_copies(df.where("doc_id > 99")).count() == 0


def test_simhash_proposes_near_copies(spark):
    """The fingerprints of a text and of its lightly edited copies are linked by SimHash, with no band's help."""
    words = [f"w{i * 7919 % 997}" for i in range(900)]
    texts = [" ".join(words), " ".join([*words[:450], "edited", *words[451:]]), " ".join(words[::-1]), "a few words", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(near_copies.node("text").alias("node"), "text")
    every = df.mapInArrow(near_copies._banded, "node long, band int, value long")
    node = {r.text: r.node for r in df.collect()}
    want = {(min(node[texts[0]], node[texts[1]]), max(node[texts[0]], node[texts[1]]))}
    assert {(r.a, r.b) for r in near_copies.by_simhash(every).collect()} == want
    assert {(r.a, r.b) for r in near_copies.links(df).distinct().collect()} == want
