"""Structure from recognised text blocks: tables, form fields, headings, tags, connections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_words, strip

# Fixed values of form fields: least confidence, and reaches in pixels.
LEAST_CONFIDENCE = 0.3
RIGHT_REACH, LEAST_OVERLAP, BELOW_REACH = 450.0, 0.35, 80.0
# Letters of instrument tags.
FIRST_LETTERS = {"F": "Flow", "L": "Level", "P": "Pressure", "T": "Temperature", "A": "Analysis", "S": "Speed", "V": "Vibration", "W": "Weight", "H": "Hand", "Z": "Position"}
NEXT_LETTERS = {"A": "Alarm", "C": "Controller", "E": "Element", "G": "Gauge", "H": "High", "I": "Indicator", "L": "Low", "R": "Recorder", "S": "Switch", "T": "Transmitter", "V": "Valve", "Y": "Relay"}
# Phrases that say that one tag leads to another.
CONNECTION = r"(?i)\b([A-Z]{1,4}[-_]?\d{2,5}[A-Z]?)\s+(?:connects to|flows to|discharges to|feeds into|leads to|piped to|inlet of|outlet to)\s+([A-Z]{1,4}[-_]?\d{2,5}[A-Z]?)"
ARROW = r"(?i)([A-Z]{1,4}[-_]?\d{2,5})\s*->\s*([A-Z]{1,4}[-_]?\d{2,5})\b"
GUESSED = r"(?i)proximity|assumed connection|inferred connection|adjacent.*(?:connect|flow|lead|pipe)"

Block = tuple[float, float, float, float, str]  # left, top, right, bottom, text

# Fixed values of the recovery of tables: tolerances in pixels, bins and gain of the tilt, and what counts as noise.
ROW_GAP, COLUMN_GAP, AMBIGUOUS = 12.0, 35.0, 8.0
TILT_STEPS, TILT_STEP, TILT_BIN, TILT_GAIN, TILT_LEAST = 30, 0.1, 8.0, 1.05, 6
#: Blocks that a task looks at together, about, and pages below which each takes its steps alone.
TOGETHER, FEW_PAGES = 100_000, 32
SIGNS = r"^[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~…·√：！↓￥—°•\s]+$"


def valid(blocks: DataFrame) -> DataFrame:
    """Blocks that are no noise: specks of punctuation, small Han glyphs, low fragments of few letters, and small unsure ones go; single letters, signs and numbers of full height stay."""
    t, c = strip(F.col("text")), F.coalesce("confidence", F.lit(1.0))
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    large = F.greatest(w, h)
    number = F.regexp_replace(t, r"[.,+-]", "").rlike(r"^\d+$")
    sure = ((F.length(t) == 1) & t.rlike(r"^[\p{L}\p{N}]$") & (h >= 12) & (c >= 0.35)) | (t.isin("+", "-") & (h >= 12) & (w >= 8) & (c >= 0.5)) | (number & (h >= 12) & (c >= 0.3))
    noise = (t.rlike(SIGNS) & ((large <= 24) | (h <= 11.5) | (c < 0.6))) | (t.rlike(r"[\x{4e00}-\x{9fff}]") & ((large <= 24) | (c < 0.6))) | ((h <= 11.5) & (F.length(t) <= 4) & (c < 0.7)) | ((large <= 12) & (c < 0.4))
    return blocks.where((t != "") & (sure | ~noise)).withColumn("text", t)


def _edges(own: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where a new value of these ascending or grouped arrays begins."""
    new = np.zeros(len(own), bool)
    new[:1] = True
    for x in (own, *more):
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _squares(own: np.ndarray, bins: np.ndarray, n_pages: int) -> np.ndarray:
    """Of each page, the sum of the squares of the counts of its equal bins; own, the numbers of the pages, ascends."""
    bins = np.where(np.isnan(bins), np.inf, bins)  # what has no place is a bin of its own
    low = bins.min()
    span = bins.max() - low + 1
    if span * n_pages < 2**62:
        made = np.sort(own * np.int64(span) + (bins - low).astype(np.int64))
    else:
        made = bins[np.lexsort((bins, own))]
    starts = _edges(own, made)
    return np.bincount(own[starts], _sizes(starts, len(own)) ** 2.0, n_pages)


def tilts(own: np.ndarray, x: np.ndarray, y: np.ndarray, n_pages: int) -> np.ndarray:
    """Of each page, the turn at which the middles of its blocks fall into the fewest, fullest rows, if it gains TILT_GAIN over none; 0 for few blocks."""
    best, none, turn = np.zeros(n_pages), np.ones(n_pages), np.zeros(n_pages)
    for step in range(-TILT_STEPS, TILT_STEPS + 1):
        t = math.tan(math.radians(step * TILT_STEP))
        score = _squares(own, np.rint((y - t * x) / TILT_BIN), n_pages)
        more = score > best
        best, turn = np.where(more, score, best), np.where(more, t, turn)
        none = score if step == 0 else none
    return np.where((np.bincount(own, minlength=n_pages) >= TILT_LEAST) & (best / none >= TILT_GAIN), turn, 0.0)


def clustered(own: np.ndarray, values: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Of values that ascend in each page, the number of each one's cluster, and the sum of the cluster up to it: a value within `gap` of the mean of the last cluster joins it.

    Pages take their steps together; the few that are much longer than the rest end by themselves.
    """
    starts = _edges(own)
    order = np.argsort(-_sizes(starts, len(own)), kind="stable")
    first, less = starts[order], -_sizes(starts, len(own))[order]
    total, n, c = np.zeros(len(order)), np.zeros(len(order), np.int64), np.full(len(order), -1)
    made, sums, i = np.empty(len(own), np.int64), np.empty(len(own)), 0
    while (k := int(np.searchsorted(less, -i))) >= FEW_PAGES:
        at = first[:k] + i
        v = values[at]
        joins = (n[:k] > 0) & (np.abs(v - total[:k] / np.maximum(n[:k], 1)) <= gap)
        total[:k], n[:k] = np.where(joins, total[:k] + v, v), np.where(joins, n[:k] + 1, 1)
        c[:k] += ~joins
        made[at], sums[at], i = c[:k], total[:k], i + 1
    for p in range(k):
        lo, hi, t, m, d = int(first[p]) + i, int(first[p] - less[p]), float(total[p]), int(n[p]), int(c[p])
        for at, v in enumerate(values[lo:hi].tolist(), lo):
            if m and abs(v - t / m) <= gap:
                t, m = t + v, m + 1
            else:
                t, m, d = v, 1, d + 1
            made[at], sums[at] = d, t
    return made, sums


def anchors(own: np.ndarray, lefts: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pages and means of the clusters of lefts that ascend in each page, ascending; if two clusters of a page or more have its `least` values, only such."""
    c, sums = clustered(own, lefts, COLUMN_GAP)
    starts = _edges(own, c)
    n, page = _sizes(starts, len(own)), own[starts]
    often = n >= least[page]
    mean = sums[starts + n - 1] / n
    held = (often | (np.bincount(page, often, len(least)) < 2)[page]) & ~np.isnan(mean)
    return page[held], mean[held]


def nearest(own: np.ndarray, lefts: np.ndarray, page: np.ndarray, means: np.ndarray, n_pages: int) -> np.ndarray:
    """Of each left side, the place of the nearest anchor of its page; -1 where there is none, or another is as near but for AMBIGUOUS."""
    if not len(means):
        return np.full(len(own), -1)
    begin = np.searchsorted(page, np.arange(n_pages + 1))
    lo, hi = begin[own], begin[own + 1] - 1
    both = np.lexsort((np.repeat([0, 1], [len(page), len(own)]), np.append(means, lefts), np.append(page, own)))
    upto = np.empty(len(both), np.int64)
    upto[both] = np.cumsum(both < len(page))
    below = np.clip(upto[len(page) :] - 1, lo, np.maximum(hi, lo))  # the last anchor that is not right of it
    far = lambda j: np.where((j >= lo) & (j <= hi), np.abs(lefts - means[np.clip(j, 0, len(means) - 1)]), np.inf)
    best = np.where(far(below + 1) < far(below), below + 1, below)
    with np.errstate(invalid="ignore"):  # a page without anchors is endlessly far
        clear = (np.minimum(far(best - 1), far(best + 1)) - far(best) > AMBIGUOUS) & ~np.isnan(lefts) & (hi >= lo)
    return np.where(clear, best - lo, -1)


def _cells(pages: pa.Array, starts: np.ndarray, x: np.ndarray, y: np.ndarray, left: np.ndarray, text: pa.Array) -> tuple[pa.Array, ...]:
    """The cells of whole pages, whose blocks begin at `starts` and ascend by text in each."""
    n_pages, at = len(starts), np.arange(len(x))
    own = np.repeat(np.arange(n_pages), _sizes(starts, len(x)))
    y = y - tilts(own, x, y, n_pages)[own] * x
    order = np.lexsort((y, own))
    at, left = at[order], left[order]
    row, _ = clustered(own, y[order], ROW_GAP)
    begin = _edges(own, row)
    n, page = _sizes(begin, len(own)), own[begin]
    most = np.zeros(n_pages, np.int64)
    np.maximum.at(most, page, n)
    kept = (most[page] >= 2) & (n >= np.maximum(2, np.minimum(3, most[page] - 2)))
    count = np.bincount(page, kept, n_pages)
    row_no = np.cumsum(kept) - 1 - (np.cumsum(count) - count)[page].astype(np.int64)
    kept &= count[page] >= 2
    full = kept & (n >= np.maximum(3, most[page] - 1))
    used = kept & (full | (np.bincount(page, full, n_pages) == 0)[page])
    k = np.bincount(page, used, n_pages)
    group = np.repeat(np.arange(len(n)), n)
    some = used[group]
    u_own, u_left = own[some], left[some]
    column = np.lexsort((u_left, u_own))
    a_page, mean = anchors(u_own, u_left[column], np.minimum(2, k))
    some = kept[group]
    own, left, at, row = own[some], left[some], at[some], row_no[group[some]]
    column = nearest(own, left, a_page, mean, n_pages)
    some = np.flatnonzero(column >= 0)
    some = some[np.lexsort((at[some], left[some], column[some], row[some], own[some]))]
    own, row, column = own[some], row[some], column[some]
    begin = _edges(own, row, column)
    held = pa.ListArray.from_arrays(pa.array(np.append(begin, len(some)).astype(np.int32)), text.take(pa.array(at[some])))
    return pages.take(pa.array(starts[own[begin]])), pa.array(row[begin]), pa.array(column[begin]), pc.binary_join(held, " ")


def _page_starts(pages: pa.ChunkedArray) -> np.ndarray:
    return np.append(0, 1 + np.flatnonzero(pc.not_equal(pages[1:], pages[:-1]).to_numpy()))


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about TOGETHER rows that end where a page ends; rows ascend by page, their first column."""
    held, n = [], 0
    for b in batches:
        for part in (b.slice(i, TOGETHER) for i in range(0, b.num_rows, TOGETHER)):
            if n >= TOGETHER:
                t = pa.Table.from_batches([held[-1], part])
                cut = int(_page_starts(t[0])[-1]) - len(held[-1])  # where its last page begins, in the part
                if cut >= 0:
                    yield pa.Table.from_batches([*held, part.slice(0, cut)])
                    held, n, part = [], 0, part.slice(cut)
            held.append(part)
            n += len(part)
    if n:
        yield pa.Table.from_batches(held)


def table_cells(blocks: DataFrame, page: str = "page") -> DataFrame:
    """page, row_no, column_no, value of the table on each page that has one: two rows and columns at least.

    Rows are clusters of the middles, turned by the page's tilt; rows of too few
    blocks are no part of the table. Columns are clusters of left sides in its
    fuller rows; a block midway between two columns is left out. A header over two
    columns stays in the one nearest to its left side.

    Blocks are dealt out by page once, and a task works on about TOGETHER of them at
    a time, whole pages; running means and tilts have no primitive in Spark, whose
    lambdas are interpreted.
    """
    good = valid(blocks).where(F.col(page).isNotNull())
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    names = [page, "row_no", "column_no", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_pages(batches):
            starts = _page_starts(t[0])
            sizes = _sizes(starts, len(t))
            t = t.filter(pa.array(np.repeat(sizes >= 4, sizes))).combine_chunks()
            if len(t):
                sizes = sizes[sizes >= 4]
                p, x, y, left, text = (c.chunk(0) for c in t.columns)
                yield pa.RecordBatch.from_arrays([*_cells(p, np.cumsum(sizes) - sizes, *(c.to_numpy(zero_copy_only=False) for c in (x, y, left)), text)], names=names)

    sent = good.select(page, x.alias("x"), y.alias("y"), "left", "text").repartition(page).sortWithinPartitions(page, "text")
    kind = blocks.schema[page].dataType.simpleString()
    cells = sent.mapInArrow(run, f"`{page}` {kind}, row_no long, column_no long, value string")
    return cells.select(F.col(page).cast("long").alias(page), "row_no", "column_no", "value")


def fields(blocks: list[Block]) -> list[tuple[str, str, str]]:
    """(label, value, where) of labels: inline after a colon, else the nearest block to the right, else below, else empty.

    A value serves one label; labels are read from the top, then the left.
    """
    order = sorted(range(len(blocks)), key=lambda i: (round(blocks[i][1] / 10), blocks[i][0]))
    label = {i for i in order if _is_label(blocks[i][4])}
    used: set[int] = set()
    out = []
    for i in order:
        left, top, right, bottom, text = blocks[i]
        if i not in label:
            head, colon, rest = text.partition(":")
            if colon and rest.strip() and _is_label(head + ":"):
                out.append((head.strip(), rest.strip(), "inline"))
                used.add(i)
            continue
        best = None
        for j in order:
            if j == i or j in label or j in used:
                continue
            x, y, z, w, t = blocks[j]
            overlap = (min(bottom, w) - max(top, y)) / max(1e-9, min(bottom - top, w - y))
            if 0 <= x - right <= RIGHT_REACH and overlap >= LEAST_OVERLAP:
                best = min(best or (2, 0.0, j, t, ""), (0, x - right, j, t, "right"))
            elif 0 <= y - bottom <= BELOW_REACH and min(right, z) > max(left, x):
                best = min(best or (2, 0.0, j, t, ""), (1, y - bottom, j, t, "below"))
        if best and best[0] < 2:
            used.add(best[2])
            out.append((text.rstrip(": ").strip(), best[3].strip(), best[4]))
        else:
            out.append((text.rstrip(": ").strip(), "", "empty"))
    return out


def _is_label(text: str) -> bool:
    t = text.strip()
    return t.endswith(":") and len(t) <= 50 and len(t.split()) <= 6


def _by_page(blocks: DataFrame, page: str, f, schema: str, names: list[str]) -> DataFrame:
    """Applies f to the blocks of each page; a page has as many blocks as its image holds."""

    def run(table: pa.Table) -> pa.Table:
        order = sorted(zip(*(table[c].to_pylist() for c in ("left", "top", "right", "bottom", "text")), strict=True))
        made = f(order)
        p = pa.array([table[page][0].as_py()] * len(made), pa.int64())
        return pa.Table.from_arrays([p, *[pa.array(c) for c in (zip(*made, strict=True) if made else [[]] * (len(names) - 1))]], names=names) if made else pa.table({n: pa.array([], t) for n, t in zip(names, _types(schema), strict=True)})

    good = blocks.where(F.col("text").isNotNull() & (strip(F.col("text")) != "") & (F.coalesce("confidence", F.lit(1.0)) >= LEAST_CONFIDENCE))
    return good.select(F.col(page).cast("long").alias(page), "left", "top", "right", "bottom", "text").groupBy(page).applyInArrow(run, schema)


def _types(schema: str) -> Iterator[pa.DataType]:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return (kinds[x.split()[-1]] for x in schema.split(", "))


def form_fields(blocks: DataFrame, page: str = "page") -> DataFrame:
    """page, label, value, place of the labels on each page."""
    return _by_page(blocks, page, fields, f"{page} long, label string, value string, place string", [page, "label", "value", "place"])


def heading(text: Column, isolated: Column) -> Column:
    """Struct of level and confidence, null if the line is no heading: numbered, then upper case, then isolated and short."""
    t = strip(text)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)*)[.\s]\s*.+$", 1)
    made = lambda level, sure: F.struct(level.cast("int").alias("level"), F.lit(sure).alias("confidence"))
    n_words = count_words(t)
    return (
        F.when(letters < 3, None)
        .when((number != "") & (F.length(t) <= 120) & ~t.endswith("."), made(F.least(F.size(F.split(number, r"\.")), F.lit(6)), 0.95))
        .when((F.length(t) <= 80) & (upper / letters >= 0.75) & ~t.endswith("."), made(F.lit(1), 0.9))
        .when(isolated & (n_words <= 10) & ~t.rlike(r"[.,;\d]$"), made(F.lit(2), 0.8))
    )


def instrument(tag: Column) -> Column:
    """Struct of description, code and loop of an instrument tag."""
    up = F.upper(F.trim(tag))
    code, loop = (F.regexp_extract(up, r"\b([A-Z]{2,4})[-_ ]?(\d{2,5}[A-Z]?)\b", i) for i in (1, 2))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    letter = lambda d, c: F.coalesce(F.element_at(table(d), c), c)
    rest = F.transform(F.split(F.substring(code, 2, 9), ""), lambda c: letter(NEXT_LETTERS, c))
    named = F.concat_ws(" ", letter(FIRST_LETTERS, F.substring(code, 1, 1)), F.array_join(rest, " "))
    return F.struct(F.when(code == "", "Instrument").otherwise(named).alias("description"), F.when(code == "", up).otherwise(code).alias("code"), loop.alias("loop"))


def connections(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """from_tag, to_tag, first_key of stated connections, once a pair; guesses from nearness are left out."""
    stated = blocks.where(~F.col(text).rlike(GUESSED))
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 0) for p in (CONNECTION, ARROW)])
    m = F.col("m")
    end = lambda i: F.upper(F.coalesce(F.nullif(F.regexp_extract(m, CONNECTION, i), F.lit("")), F.regexp_extract(m, ARROW, i)))
    return stated.select(key, F.explode(found).alias("m")).select(key, end(1).alias("from_tag"), end(2).alias("to_tag")).groupBy("from_tag", "to_tag").agg(F.min(key).alias("first_key"))


def guesses(text: Column) -> Column:
    return text.rlike(GUESSED)


def merged_registry(read: DataFrame, seen: DataFrame) -> DataFrame:
    """tag, source (both, ocr, vlm) and the larger confidence of two equipment lists with tag and confidence."""
    a, b = (d.groupBy("tag").agg(F.max("confidence").alias(c)) for d, c in ((read, "a"), (seen, "b")))
    source = F.when(F.col("a").isNull(), "vlm").when(F.col("b").isNull(), "ocr").otherwise("both")
    return a.join(b, "tag", "full_outer").select("tag", source.alias("source"), F.greatest("a", "b").alias("confidence"))


def stable_id(prefix: str, *parts: Column, length: int = 8) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length))


def matched_boxes(blocks: DataFrame, truth: DataFrame, page: str) -> DataFrame:
    """page, block_id, text: the words of the truth boxes whose middle lies in a block, or 35 % of whose area it covers."""
    t = truth.select(page, *[F.col(c).alias(f"t_{c}") for c in ("left", "top", "right", "bottom", "text")])
    both = blocks.join(t, page)
    mid = (F.col("t_left") + F.col("t_right")) / 2, (F.col("t_top") + F.col("t_bottom")) / 2
    inside = mid[0].between(F.col("left"), F.col("right")) & mid[1].between(F.col("top"), F.col("bottom"))
    side = lambda a, z: F.greatest(F.lit(0.0), F.least(F.col(z), F.col(f"t_{z}")) - F.greatest(F.col(a), F.col(f"t_{a}")))
    area = (F.col("t_right") - F.col("t_left")) * (F.col("t_bottom") - F.col("t_top"))
    hit = both.where(inside | (side("left", "right") * side("top", "bottom") >= 0.35 * area))
    words = F.array_sort(F.collect_list(F.struct((F.round(F.col("t_top") / 10) * 10).alias("y"), F.col("t_left").alias("x"), F.col("t_text").alias("w"))))
    return hit.groupBy(page, "block_id").agg(F.array_join(F.transform(words, lambda s: s["w"]), " ").alias("text"))
