"""Tables, forms, headings and tags from recognised blocks; prompts."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.operators import ocr, prompts
from quarry.plans import drawing  # noqa: F401  adds its fixtures
from quarry.plans import fixtures


BLOCK = "page int, `left` double, top double, `right` double, bottom double, text string, confidence double"


def cells(spark, blocks):
    df = spark.createDataFrame([(1, *b, 0.9) if len(b) == 5 else (1, *b) for b in blocks], BLOCK)
    return {(r.row_no, r.column_no): r.value for r in ocr.table_cells(df).collect()}


def grid(rows, columns, slope=0.0):
    return [(20.0 + 200 * c, 20.0 + 40 * r + 200 * c * slope, 90.0 + 200 * c, 40.0 + 40 * r + 200 * c * slope, f"r{r}c{c}") for r in range(rows) for c in range(columns)]


def test_tilted_and_noisy_tables(spark):
    want = {(r, c): f"r{r}c{c}" for r in range(4) for c in range(4)}
    for degrees in (0.0, 1.5, -2.0):
        assert cells(spark, grid(4, 4, math.tan(math.radians(degrees)))) == want, degrees
    noise = [(300.0, 62.0, 310.0, 70.0, "~", 0.9), (500.0, 100.0, 512.0, 110.0, "口", 0.9), (100.0, 60.0, 108.0, 68.0, "ab", 0.5), (700.0, 21.0, 705.0, 30.0, "x", 0.2)]
    title = [(20.0, 300.0, 400.0, 320.0, "a line below the table", 0.9)]
    assert cells(spark, [*grid(4, 4), *noise, *title]) == want
    halfway = [(120.0, 100.0, 180.0, 120.0, "between", 0.9)]
    assert cells(spark, [*grid(4, 4), *halfway]) == want
    two = [(b[0] + 3, *b[1:]) if i == 5 else b for i, b in enumerate(grid(4, 4))] + [(75.0, 60.0, 90.0, 80.0, "more", 0.9)]
    assert cells(spark, two)[1, 0] == "r1c0 more"
    assert cells(spark, grid(1, 4)) == {} and cells(spark, grid(4, 1)) == {} and cells(spark, grid(1, 3)) == {}


def test_cells_and_fields(spark):
    blocks = fixtures.table(spark, "fx_blocks")
    cells = {(r.row_no, r.column_no): r.value for r in ocr.table_cells(blocks.where("page = 1")).collect()}
    assert cells == {(r, c): f"r{r}c{c}" for r in range(3) for c in range(3)}
    got = {r.label: (r.value, r.place) for r in ocr.form_fields(blocks.where("page = 2")).collect()}
    assert got == {"Name": ("Ann Example", "right"), "Date": ("2024-01-05", "below"), "Unit": ("CDU-1", "inline"), "Remarks": ("", "empty")}
    assert ocr.table_cells(blocks.where("page = 9")).count() == 0


def test_headings_and_tags(spark):
    rows = [("2.1 Scope of work", False), ("GENERAL NOTES", False), ("Isolated words here", True), ("Isolated words here", False), ("A sentence that ends.", True), ("12", True)]
    got = [r[0] and (r[0].level, r[0].confidence) for r in spark.createDataFrame(rows, "t string, i boolean").select(ocr.heading(F.col("t"), F.col("i"))).collect()]
    assert got == [(2, 0.95), (1, 0.9), (2, 0.8), None, None, None]
    tags = {r.id: r.i for r in fixtures.table(spark, "fx_labels").select("id", ocr.instrument(F.col("text")).alias("i")).collect()}
    assert (tags[6].description, tags[6].code, tags[6].loop) == ("Level Transmitter", "LT", "205")


def test_boxes(spark):
    blocks = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 20.0)], "page int, block_id int, `left` double, top double, `right` double, bottom double")
    truth = spark.createDataFrame([(1, 60.0, 2.0, 90.0, 18.0, "world"), (1, 5.0, 2.0, 40.0, 18.0, "hello"), (1, 5.0, 40.0, 40.0, 60.0, "below"), (1, 90.0, 1.0, 130.0, 19.0, "half")], "page int, `left` double, top double, `right` double, bottom double, text string")
    assert ocr.matched_boxes(blocks, truth, "page").first().text == "hello world"


def test_prompts(spark):
    df = spark.createDataFrame([("", "Limit is 5 bar.\nplain words only\n" * 40, "q [1]")], "s string, c string, q string")
    b = df.select(prompts.budget(F.col("s"), F.lit("memory text"), F.col("c"))).first()[0]
    assert b.system == 0 and b.memory == 2 and b.total == b.memory + b.context + 64 and b.fits
    assert df.select(prompts.compress(F.col("c"), 200)).first()[0] == "\n".join(["Limit is 5 bar."] * 40)
    assert df.select(prompts.problems(F.col("q"))).first()[0] == [] and "empty" in df.select(prompts.problems(F.col("s"))).first()[0]
    cited = spark.sql("SELECT array(named_struct('anchor', '[1]', 'document', 'a.pdf', 'page', 2, 'section', cast(null as string))) AS c")
    assert cited.select(prompts.citation_lines(F.col("c"))).first()[0] == "[1] a.pdf, p. 2"
    assert spark.range(1).select(prompts.artifact_name(F.lit("Make report_5.pdf now"), F.lit("s"))).first()[0] == "report_5.pdf"


def test_blocks_are_dealt_out_once(spark):
    """No step multiplies a page's blocks by turns before a shuffle, or joins a page with itself."""
    df = spark.createDataFrame([(1, *b, 0.9) for b in grid(4, 4)], BLOCK)
    plan = ocr.table_cells(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert cells(spark, [(1, *b, 0.9)[1:] for b in grid(2, 6)]) == {(r, c): f"r{r}c{c}" for r in range(2) for c in range(6)}


def test_pages_take_their_steps_together(spark):
    """Tilts and running means were lambdas, which Spark interprets for each block and turn."""
    df = spark.createDataFrame([(1, *b, 0.9) for b in grid(4, 4)], BLOCK)
    plan = ocr.table_cells(df)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("MapInArrow") == 1
    many = spark.range(300).select(F.col("id").cast("int").alias("page")).crossJoin(df.drop("page")).unionByName(df.where("left < 300").withColumn("page", F.lit(999))).repartition(3)
    got = Counter((r.row_no, r.column_no, r.value) for r in ocr.table_cells(many).collect())
    assert got == {(r, c, f"r{r}c{c}"): 300 + (c < 2) for r in range(4) for c in range(4)}


def test_steps_of_many_pages_equal_those_of_each(monkeypatch):
    rng = random.Random(3)
    sizes = [rng.choice([1, 2, 5, 17]) for _ in range(90)] + [400]
    own = np.repeat(np.arange(len(sizes)), sizes)
    pages = [sorted(rng.choice([rng.uniform(0, 90 * n), 8.0 * rng.randrange(9 * n)]) for _ in range(n)) for n in sizes]
    values = np.array([v for p in pages for v in p])
    want = []
    for p in pages:
        last, c = [], -1
        for v in p:
            last, c = (last + [v], c) if last and abs(v - sum(last) / len(last)) <= 12 else ([v], c + 1)
            want.append((c, sum(last)))
    for few in (1, 32, 1000):
        monkeypatch.setattr(ocr, "FEW_PAGES", few)
        assert list(zip(*(a.tolist() for a in ocr.clustered(own, values, 12.0)), strict=True)) == want
    x, turns = np.array([rng.uniform(0, 900) for _ in own]), [math.tan(math.radians(i * ocr.TILT_STEP)) for i in range(-30, 31)]
    told = ocr.tilts(own, x, values, len(sizes))
    for p, n in enumerate(sizes):
        score = [sum(k * k for k in Counter(round((y - t * e) / 8) for e, y in zip(x[own == p].tolist(), pages[p], strict=True)).values()) for t in turns]
        assert told[p] == (turns[score.index(max(score))] if n >= 6 and max(score) / score[30] >= 1.05 else 0), p
    assert ocr._squares(own, values * 1e30, len(sizes)).tolist() == [sum(k * k for k in Counter(p).values()) for p in pages]
    page = np.repeat(np.arange(0, 90, 2), 3)
    means = np.sort(np.array([rng.uniform(0, 200) for _ in page]).reshape(-1, 3)).ravel()
    for p, v, got in zip(own.tolist(), values.tolist(), ocr.nearest(own, values, page, means, len(sizes)).tolist(), strict=True):
        far = [abs(v - m) for m in means[page == p].tolist()]
        assert got == (far.index(min(far)) if far and sum(d - min(far) <= 8 for d in far) == 1 else -1)


def test_tables_of_blocks_end_with_a_page(monkeypatch):
    monkeypatch.setattr(ocr, "TOGETHER", 7)
    pages = [p for p, n in enumerate([1, 3, 30, 1, 1, 6, 8, 2]) for _ in range(n)]
    for step in (1, 4, 9, 60):
        parts = [pa.record_batch({"page": pages[i : i + step]}) for i in range(0, len(pages), step)]
        got = [t["page"].to_pylist() for t in ocr._whole_pages(iter(parts))]
        assert sum(got, []) == pages and all(a[-1] != b[0] for a, b in zip(got, got[1:], strict=False)) and len(got) > 2
