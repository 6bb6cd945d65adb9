"""Operators that SQL does not express, against plain Python or by what must hold."""

import difflib
import hashlib
import math
import random
import re
import unicodedata
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import queries as qf
from quarry.functions import text as tx
from quarry.functions.protected import protected_spans
from quarry.operators import candidates, embedding, evaluation, grounding, parsing, python_text, structure, vectors
from quarry.plans import fixtures
from quarry.plans.registry import texts
from quarry.queries import QUERIES

SF = "/root/testdata/sf0.001"


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


def test_uuid5_and_sizes(spark):
    assert one(spark, lambda c: tx.uuid5(str(uuid.NAMESPACE_URL), c), "a/b.txt") == str(uuid.uuid5(uuid.NAMESPACE_URL, "a/b.txt"))
    df = spark.createDataFrame([(n,) for n in (5, 2048, 3 << 20, 5 << 30)], "n long").select(tx.byte_size(F.col("n")))
    assert [r[0] for r in df.collect()] == ["5 B", "2.00 KB", "3.00 MB", "5.00 GB"]


def test_paragraph_lines(spark):
    got = one(spark, tx.join_paragraph_lines, "First para\nsoft wrapped\nline.\nNew start\n\n\nSecond:\n- item a\n- item b\n# Head\ntext")
    assert got == "First para soft wrapped line.\nNew start\n\nSecond:\n- item a\n- item b\n# Head\ntext"


def test_clean_is_idempotent(spark):
    df = spark.createDataFrame(fixtures.RAW, "doc_id long, text string").select(tx.clean(F.col("text")).alias("a")).select("a", tx.clean(F.col("a")).alias("b"))
    assert all(r.a == r.b for r in df.collect())


def test_sentences(spark):
    text = "See fig. 3 for details. The pump (e.g. P-203) runs. It stops! Item 12. Then no. 5 came. end"
    assert one(spark, tx.sentences, text) == structure.sentences(text)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text", tx.sentences(F.col("text")).alias("s")).collect()
    assert all(r.s == structure.sentences(r.text) for r in rows)


def test_rewrite_and_expand(spark):
    assert one(spark, qf.rewrite, "the Pressue, of oisd 105 and api_650.") == "the pressure, of OISD-105 and API-650."
    assert one(spark, qf.expand_terms, "cdu pump leak")[:3] == ["crude distillation unit", "centrifugal pump", "impeller"]
    assert len(one(spark, qf.expand_terms, "pump valve compressor inspection pressure")) == 10


def test_entities(spark):
    e = one(spark, qf.entities, "P-203 and p203, V-12, OISD-105 at 12.5 bar in CDU-1 Rev 2 section 3.1 page 42")
    assert e.equipment_tags == ["CDU-1", "P-203"] or e.equipment_tags == ["P-203"]
    assert e.standards == ["OISD-105"] and e.pressure_values == ["12.5 bar"] and e.plant_units == ["CDU-1"] and e.page_references == ["42"] and e.section_references == ["3.1"]


def test_hash_vector(spark):
    import hashlib

    def slow(text, dim):
        out = []
        for step in range(-(-dim // 8)):
            d = hashlib.sha256(f"local_embedder:{text}:{step}".encode()).digest()
            out += [int.from_bytes(d[i : i + 4], "little", signed=True) / 2**31 for i in range(0, 32, 4)]
        v = np.array(out[:dim])
        return v / np.linalg.norm(v)

    assert np.allclose(one(spark, lambda c: embedding.hash_vector(c, 12), "some text"), slow("some text", 12))


def test_vector_problems(spark):
    rows = [([1.0, 0.0],), ([1.0],), ([float("nan"), 0.0],), ([],), (None,), ([float("inf"), 1.0],), ([0.5, 0.5],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(vectors.problems(F.col("v"), 2)).collect()]
    assert got[0] == [] and got[1] == ["dimension"] and "nan" in got[2] and got[3] == ["empty"] == got[4] and "infinite" in got[5] and got[6] == ["norm"]


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_nearest(spark, metric):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(i, m[i].tolist(), i % 3) for i in range(120)], "id long, v array<double>, g int").repartition(5)
    got = vectors.nearest(df, df.where("id < 7"), "id", "v", 4, metric).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = unit @ unit.T if metric == "cosine" else m @ m.T if metric == "dot" else -np.linalg.norm(m[:, None] - m[None], axis=2)
    for q in range(7):
        want = sorted(range(120), key=lambda i: (-s[q, i], i))[:4]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    same = vectors.nearest(df, df.where("id < 7"), "id", "v", 4, metric, same="g").collect()
    assert all(r.id % 3 == r.query_id % 3 for r in same) and len(same) == 28


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", ["x"], 5), (2, None, ["y"], None), (3, "b", None, 7)], "id int, s string, t array<string>, n int")
    ids = lambda **k: [r.id for r in df.where(vectors.compile_filter(**k)).orderBy("id").collect()]
    assert ids(must=[("s", "ne", "a")]) == [3] and ids(must=[("t", "eq", "x", "array")]) == [1]
    assert ids(should=[("n", "gt", 6), ("s", "eq", "a")]) == [1, 3] and ids(must_not=[("s", "eq", "a")]) == [2, 3] and ids(must=[("s", "not_in", ["a"])]) == [3]


def test_near_duplicates_in_order(spark):
    rows = [(1, 0, "the same text here", 0), (1, 1, "the same text here", 1), (1, 2, "the same text hare", 2), (1, 3, "something else entirely", 3), (1, 4, "", 4), (2, 5, "the same text here", 0)]
    df = spark.createDataFrame(rows, "q long, k long, t string, r int").repartition(3)
    got = sorted((r.q, r.place, r.k) for r in candidates.without_near_duplicates(df, "q", "k", "t", "r").collect())
    assert got == [(1, 0, 0), (1, 1, 3), (2, 0, 5)]
    a, b = "pump P-203", "P-302 pumps"
    want = difflib.SequenceMatcher(None, a, b).quick_ratio()
    assert math.isclose(one(spark, candidates.quick_ratio, a, b), want)


def test_context(spark):
    rows = [(1, i, f"h{i}", ("word " * n).strip() + ". " + ("tail " * n).strip()) for i, n in enumerate([20, 30, 400, 5])]
    df = spark.createDataFrame(rows, "q int, r int, h string, t string")
    r = candidates.pack_context(df, "q", "r", F.col("h"), F.col("t"), 400).first()
    assert r.n_tokens <= 400 and r.context.startswith(candidates.HEADER) and "h0" in r.context and "h1" in r.context and "h3" not in r.context
    assert candidates.pack_context(df, "q", "r", F.col("h"), F.col("t"), 5000).first().n_packed == 4


def test_neighbours(spark):
    chunks = spark.createDataFrame([(d * 10 + i, d, i) for d in (1, 2) for i in range(5)], "cid long, document long, index int")
    hits = spark.createDataFrame([(7, 12, 1, 2, 1.0, 0), (7, 13, 1, 3, 0.5, 1), (7, 20, 2, 0, 0.2, 2)], "q long, cid long, document long, index int, score double, rank int")
    got = {r.cid: r.score for r in candidates.with_neighbours(hits, chunks, "q").collect()}
    assert got == {12: 1.0, 13: 0.5, 20: 0.2, 11: 0.85, 14: 0.425, 21: pytest.approx(0.17)}


def test_grounding(spark):
    assert one(spark, grounding.grounding, "P-203 runs at 12.5 bar, not 99", "the p203 at 12.5 bar") == pytest.approx(2 / 3, abs=0.35)
    assert one(spark, grounding.grounding, "no facts", "anything") == 1.0
    assert one(spark, grounding.without_references, "Answer text.\n## References\n[1] x") == "Answer text."
    df = spark.createDataFrame([("a [1] b [3] [1]", ["[1]", "[2]"])], "a string, v array<string>")
    r = grounding.check_citations(df, "a", "v").first()
    assert (r.cited, r.phantom, r.precision) == (["[1]", "[3]"], ["[3]"], 0.5)


def test_nfkc_similarity_diff(spark):
    assert one(spark, lambda c: python_text.nfkc(c), "ﬁ ① ｘ") == unicodedata.normalize("NFKC", "ﬁ ① ｘ")
    assert one(spark, lambda a, b: python_text.similarity(a, b), " Pump ", "pumps") == pytest.approx(difflib.SequenceMatcher(None, "pump", "pumps").ratio())
    d = one(spark, lambda a, b: python_text.diff_stats(a, b), "a  b  c", "a b c")
    assert (d.removed, d.normalized) == (2, 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Pump P-203", "MOV-101", " at 12.5 bar", "API-610 ", "x", " ", "Rev 2", "Line 4", "kg/cm2", "\n"]), max_size=12))
def test_protected_spans_do_not_overlap(parts):
    text = "".join(parts)
    spans = protected_spans(text)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and all(0 <= a < z <= len(text) for a, z in spans)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["Alpha", "beta.", "Gamma", "12.", "e.g.", "delta!"]), min_size=1, max_size=40).map(" ".join), max_size=6))
def test_recursive_chunks_keep_all_words_in_order(paras):
    text = "\n\n".join(paras)
    got = structure.recursive(text, target=30, most=60, overlap=0)
    assert " ".join(got).split() == text.split()
    assert all(structure.size(c) <= 60 for c in got)


def test_tables_and_lists():
    rows = ["| a | b |", "|---|---|", *(f"| row {i} | value {i} |" for i in range(30))]
    parts = structure.table(rows, "T", target=60, most=100)
    assert len(parts) > 1 and all(p.split("\n")[1:3] == rows[:2] for p in parts) and parts[0].startswith("T (Part 1 of")
    assert [r for p in parts for r in p.split("\n")[3:]] == rows[2:]
    assert structure.list_blocks("intro\n- a\n  more\n- b\n" + "p" * 90) == [("prose", ["intro"]), ("list", ["- a\n  more", "- b"]), ("prose", ["p" * 90])]
    assert structure.section(["A", "B"], "text") == ["[A > B]\ntext"]


def test_messages_and_pages(spark):
    m = one(spark, parsing.email_headers, "From: a@b\nSubject: One\nSubject: Two\n\nBody: no")
    assert m == {"from": "a@b", "subject": "Two"}
    df = spark.createDataFrame([(1, "--- Page 1 ---\nfirst\n--- Page 3 ---\nthird\nmore")], "id long, t string")
    assert [(r.number, r.content) for r in parsing.marked_pages(df, "id", F.col("t")).orderBy("number").collect()] == [(1, "first"), (3, "third\nmore")]


def test_edges(spark):
    df = spark.createDataFrame([(1, "The pump P-203 feeds HX-01 and V-102 here. MOV-101 isolates P-203!")], "id long, t string")
    assert [(r.src, r.dst, r.relation) for r in parsing.entity_edges(df, "id", F.col("t")).orderBy("pos", "src").collect()] == [("HX-01", "V-102", "feeds"), ("P-203", "HX-01", "feeds"), ("MOV-101", "P-203", "isolates")]


def test_cells(spark):
    df = spark.sql("SELECT array('a|', 'b') AS h, array(array('x\n y', ' z ')) AS r")
    r = df.select(parsing.markdown_table(F.col("h"), parsing.clean_cells(F.col("r")))).first()[0]
    assert r == "| a| | b |\n|---|---|\n| x y | z |"


def test_injections(spark):
    rows = [r[0] for r in spark.createDataFrame(fixtures.SECRETS, "id int, text string").orderBy("id").select(evaluation.injection_flags(F.col("text"))).collect()]
    assert rows == [sum(bool(re.search(p, t)) for p in evaluation.INJECTIONS) for _, t in fixtures.SECRETS] and Counter(rows)[0] > 0


def test_violations(spark):
    df = spark.createDataFrame([(1, 5, 0.9, 0), (1, 6, 0.5, 1), (1, 5, 0.7, 2), (2, 7, 0.1, 0)], "q int, k int, s double, r int")
    got = {r.q: (r.duplicates, r.out_of_order) for r in candidates.violations(df, "q", "k", "s", "r").collect()}
    assert got == {1: (1, 1), 2: (0, 0)}


def test_histories_and_texts(spark):
    from quarry.operators import modality

    df = spark.createDataFrame([("a  b",)], "t string")
    r = modality.with_history(df, "t", {"squeeze": tx.squeeze_lines, "upper": F.upper}).first()
    assert r.t == "A B" and [tuple(h) for h in r.history] == [("squeeze", 4, 3), ("upper", 3, 3)]
    parts = spark.createDataFrame([("d", 2, 1, None, "c"), ("d", 1, 2, "T2", "b"), ("d", 1, 1, "", "a")], "doc string, page int, pos int, title string, content string")
    assert modality.canonical_text(parts, "doc").first().text == "a\n\nT2\nb\n\nc"


def test_matched_as_difflib():
    rng = random.Random(4)
    for letters, n in (("ab", 90), ("abcdefgh ", 400), ("aé日𝄞", 300)):
        for _ in range(25):
            x = "".join(rng.choices(letters, k=rng.randint(0, n)))
            y = x
            for _ in range(rng.randint(0, 9)):
                i = rng.randint(0, len(y))
                y = y[:i] + "".join(rng.choices(letters, k=rng.randint(0, 5))) + y[i + rng.randint(0, 9) :]
            for a, b in ((x, y), (y, x), (x, "".join(rng.choices(letters, k=n)))):
                assert python_text.matched(a, b) == sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_cleaning_statistics_measure_every_text(spark):
    """By brute force over all documents and the inline texts."""
    sf = "/root/testdata/sf0.001"
    rows = texts(spark, sf).select("doc_id", "text", tx.clean(F.col("text")).alias("c")).collect()
    want = []
    for d, x, y in rows:
        x, y = x or "", y or ""
        same = len(x) if x == y else sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        want.append((d, max(0, len(x) - len(y)), len(x) - same))
    got = [tuple(r) for r in QUERIES["cleaning_statistics"](spark, sf).collect()]
    assert len(got) > 200 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_differences_of_long_texts():
    """Beyond 20,000 characters, where lengths alone counted: against difflib, and where the blocks are known."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(4000)]
    x = " ".join(rng.choice(words) for _ in range(4000))
    y = x.replace("a ", "a  ", 40).replace("b", "", 30)
    assert len(x) > 20_000
    assert python_text.matched(x, y) == sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
    long = "".join(chr(0x4E00 + i % 20_000) if i % 7 else str(i) for i in range(100_000))
    cut = [i * 997 for i in range(1, 100)]
    less = "".join(c for i, c in enumerate(long) if i not in set(cut))
    assert python_text.matched(long, less) >= len(less) - 200


def test_signatures_and_delimiters_of_whole_texts(spark):
    from quarry.operators import classify
    from quarry.sources import files

    late = "word " * 2000 + "inspection report of the wall thickness"
    row = spark.createDataFrame([("x.txt", late)], "p string, t string").select(classify.classified(F.col("p"), F.col("t")).alias("c")).first().c
    assert row.category == "Inspection Report"
    text = "a line of text, with one comma\n" + "\n".join(f"{i};{i * 2};x" for i in range(3000))
    assert files.read_csv(text.encode()).split("\n")[2999] == "2998 | 5996 | x"
    assert files.read_csv(b"a|b\n1|2") == "a | b\n1 | 2" and files.read_csv(b"alone") == "alone" and files.read_csv(b'"x, y",z\n1,2') == "x, y | z\n1 | 2"


def test_a_cluster_has_to_name_its_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from quarry.sources import tables

    conf = {}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="app"))
    with pytest.raises(ValueError, match="checkpoint"):
        tables.scratch(session, "x")
    conf["spark.checkpoint.dir"] = "hdfs://shared/"
    assert tables.scratch(session, "x").startswith("hdfs://shared/app/x-")


def test_checksum_rounds_as_printf(spark):
    """1/128 is 0.0078125, a tie, which goes to the even digit; nulls are left out."""
    rng = np.random.default_rng(3)
    vectors = [[1 / 128, -1 / 128, 3 / 128, 0.0, -0.0, -1e-9], [None, 0.5], [], [float("nan"), float("inf"), float("-inf")], [1e9, 2.0**60, 123456.0078125], rng.normal(size=300).astype("float32").tolist(), (rng.integers(-999, 999, 300) / 128).tolist()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id int, v array<float>")
    got = {r.id: r.c for r in df.select("id", embedding.checksum(F.col("v")).alias("c")).collect()}
    for i, v in enumerate(vectors):
        assert got[i] == hashlib.sha256(",".join("%.6f" % np.float32(x) for x in v if x is not None).encode()).hexdigest(), i


def test_texts_are_cut_in_slices():
    """Chunks leave a task after some texts, not after a whole batch of them."""
    texts = [f"# Title {i}\n\nSome words of section {i}." for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], names=["id", "text"])
    split = structure.STRATEGIES["section"]
    out = list(structure._cut(iter([batch]), split, "id"))
    assert max(len(set(b["id"].to_pylist())) for b in out) <= structure.TOGETHER
    assert [(r["id"], r["chunk_index"], r["content"]) for b in out for r in b.to_pylist()] == [(k, i, c) for k, t in enumerate(texts) for i, c in enumerate(split(t))]
