"""The whole clean of documents against the same stages in Python, and paragraphs against a line-by-line fold."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.protected import protected_spans
from quarry.operators import cleaning, parsing

SECTIONS = [
    ("d1", 1, "ACME Works:\nThe  pump P-203 runs at 12.5 bar…\nand ﬁnely tuned oper-\nation.\n• one\n2) two\n|  a |b  |\n|---|---|\n| P-203 |  2   |\nPage 1 of 2"),
    ("d1", 2, "ACME Works:\n“Quoted” text\r\nmore text, see OISD-105\n\n\n\nLast.\nPage 2 of 2"),
    ("d2", 1, None),
    ("d3", 1, "alone ½ \x07bell​"),
]


def masked(t):
    out, own, at = [], [], 0
    for a, z in protected_spans(t):
        out += [t[at:a], f"__ENG_TOKEN_{len(own)}__"]
        own.append(t[a:z])
        at = z
    return "".join([*out, t[at:]]), own


def test_whole_clean(spark):
    df = spark.createDataFrame(SECTIONS, "doc string, pos int, content string")
    got = {(r.doc, r.pos): r for r in cleaning.clean_sections(df, "doc", "pos", "content").collect()}
    held = [masked(c or "") for _, _, c in SECTIONS]
    steps = spark.createDataFrame([(d, p, unicodedata.normalize("NFKC", m)) for (d, p, _), (m, _) in zip(SECTIONS, held, strict=True)], "doc string, pos int, t string")
    t = steps.select("doc", "pos", tx.join_hyphens(tx.join_paragraph_lines(tx.fix_line_ends(tx.squeeze_lines(tx.fix_encoding(F.col("t")))))).alias("t"))
    bare = {(r.doc, r.pos): r.cleaned for r in parsing.without_headers(t, "doc", "pos", "t").select("doc", "pos", tx.fix_lists(tx.fix_bullets(cleaning.table_lines(F.col("cleaned")))).alias("cleaned")).collect()}
    at = {}
    for (d, p, _), (_, own) in zip(SECTIONS, held, strict=True):
        want = re.sub(r"__ENG_TOKEN_(\d+)__", lambda m, own=own: own[int(m[1])], bare[d, p])
        r = got[d, p]
        assert r.cleaned == want and r.lost == [] and [h.stage for h in r.history] == list(cleaning.STAGES)
        assert all(a.after == b.before for a, b in zip(r.history, r.history[1:], strict=False)) and r.history[-1].after == len(want)
        assert (r.char_start, r.char_end) == (at.get(d, 0), at.get(d, 0) + len(want))
        at[d] = r.char_end + 2
    assert "| P-203 | 2 |" in got["d1", 1].cleaned and "- one" in got["d1", 1].cleaned and "2. two" in got["d1", 1].cleaned and "finely" in got["d1", 1].cleaned
    assert not any(x in got["d1", p].cleaned for p in (1, 2) for x in ("ACME", "of 2"))
    whole = {r.doc: r for r in cleaning.clean_documents(df, "doc", "pos", "content").collect()}
    for d, r in whole.items():
        parts = [got[k].cleaned for k in sorted(got) if k[0] == d]
        assert r.cleaned == "\n\n".join(parts) and [r.cleaned[m.char_start : m.char_end] for m in r.page_map] == parts


def slow_paragraph(para):
    block = lambda x: re.search(r"^#{1,6}\s", x) or re.search(r"^\d+(?:\.\d+)*\s+[A-Z]", x) and not x.endswith(".") and len(x) < 80 or re.search(r"^\|.*\|$", x)
    made = []
    for x in filter(None, map(str.strip, para.split("\n"))):
        last = made[-1] if made else ""
        if not made or block(last) or block(x) or re.search(r"^(?:[-*•]|\d{1,4}[.)])\s+", x) or re.search(r"[.?!:;-]$", last) or re.search(r'[.?!]"$', last):
            made.append(x)
        else:
            made[-1] += f" {x}"
    return "\n".join(made)


def test_paragraphs_like_a_fold(spark):
    """Runs are cut without following each line; those that could make a block of joined lines are followed."""
    rng = random.Random(6)
    bits = ["#", "##", "# Head", "7", "7.1", "7.1 Title", "Title", "lower", "|a", "b|", "| a | b |", "- item", "1. item", "ends.", 'said."', "colon:", "word word", "X" * 90]
    texts = ["\n".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.m for r in df.select("id", tx.join_paragraph_lines(F.col("t")).alias("m")).collect()}
    assert all(got[i] == slow_paragraph(t) for i, t in enumerate(texts))


def test_long_texts_are_cleaned_in_linear_time(spark):
    import time

    took = []
    for n in (4000, 16000):
        df = spark.createDataFrame([("\n".join(f"line {i} goes on" for i in range(n)) + " " + " ".join(f"Sentence {i} ends." for i in range(n)),)], "t string")
        df.select(tx.join_paragraph_lines(F.col("t")), tx.sentences(F.col("t"))).collect()
        start = time.time()
        df.select(F.length(tx.join_paragraph_lines(F.col("t"))), F.size(tx.sentences(F.col("t")))).collect()
        took.append(time.time() - start)
    assert took[1] < 10 * max(took[0], 0.2)


def test_sizes_round_as_printf(spark):
    """1152 / 1024 is 1.125, a tie, which goes to the even digit."""
    sizes = [0, 1023, 1024, 1152, 3712, 5760, 2**20, 2**20 * 9 // 8, 2**30 * 9 // 8, 5**7 * 2**20]
    unit = lambda n: (f"{n / 2**30:.2f} GB" if n >= 2**30 else f"{n / 2**20:.2f} MB" if n >= 2**20 else f"{n / 1024:.2f} KB") if n >= 1024 else f"{n} B"
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", tx.byte_size(F.col("n")).alias("s")).collect()
    assert [(r.n, r.s) for r in got] == [(n, unit(n)) for n in sizes]
