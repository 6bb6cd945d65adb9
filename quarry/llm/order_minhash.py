"""Document fingerprints by Order MinHash, in DataFrame functions alone.

A word k-mer together with its occurrence number is one element of a text, so
repeats count. One 33-bit hash of each element, its high bits naming one of
`BINS` bins, stands for as many hash functions (one-permutation hashing); in
each bin the `KEPT` smallest elements are selected, put back in text order, and
hashed as a tuple. Two texts agree in a bin only if they share its smallest
elements and have them in the same order, which follows edit distance.

A fingerprint is a string of six hex digits for each bin that has elements: the
bin and 16 bits of its tuple's hash. Likeness is the share of agreeing bins
among those that either text fills. Texts of fewer than K words are one k-mer;
each character of a script written without blanks is a word. An element's place
has 30 bits, more than the words that a string can hold.

Defined results: a null or empty text has the empty fingerprint, and two empty
fingerprints are alike (1.0); equal texts have equal fingerprints; rows with one
doc_id follow each other in the order of their texts' XXH64, and may be many; a
null doc_id comes first;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import NULL_ID, bind, pick, shuffle_width

K, BINS, KEPT = 3, 64, 2
PLACE = 30  # bits for a k-mer's position
#: Characters that are words by themselves.
UNSPACED = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]"
BIN_SHIFT = 63 - (BINS.bit_length() - 1)
NO_PLACE = (1 << PLACE) - 1


def _elements(words: Column) -> Column:
    """hash << PLACE | position of each k-mer."""

    def hashed(w: Column, i: Column) -> Column:
        h = F.xxhash64(w, *[F.get(words_, i + j) for j in range(1, K)])
        return F.shiftleft(F.shiftrightunsigned(h, 64 - (63 - PLACE)), PLACE).bitwiseOR(i.cast("long"))

    words_ = words
    return F.slice(F.transform(words, hashed), F.lit(1), F.greatest(F.size(words) - (K - 1), F.least(F.size(words), F.lit(1))))


def _numbered(raw: Column) -> Column:
    """The elements, sorted, each hash renewed with its occurrence number."""

    def renewed(s: Column) -> Column:
        top = lambda x: F.shiftright(x, PLACE)

        def one(x: Column, i: Column) -> Column:
            # the first of equal k-mers, which stand together in text order: steps of falling powers of two
            first = F.aggregate(F.array(*[F.lit(1 << p) for p in range(PLACE, -1, -1)]), i, lambda at, step: F.when(top(F.get(s, at - step)) == top(x), at - step).otherwise(at))
            again = F.shiftleft(F.shiftrightunsigned(F.xxhash64(top(x), i - first), 64 - (63 - PLACE)), PLACE).bitwiseOR(x.bitwiseAND(F.lit(NO_PLACE)))
            return F.when((i > 0) & (top(F.get(s, i - 1)) == top(x)), again).otherwise(x)

        return F.transform(s, one)

    return F.array_sort(bind(F.array_sort(raw), renewed))


def _tuples(elements: Column) -> Column:
    """bin << 16 | tuple hash of each bin in use."""

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, BIN_SHIFT)

    def smallest(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i < KEPT) | (bin_of(F.get(s, i - KEPT)) != bin_of(x)))

    def signed(s: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            y = F.get(s, i + 1)
            place = lambda v: v.bitwiseAND(F.lit(NO_PLACE))
            value = lambda v: F.shiftright(v, PLACE)
            pair = F.when(place(x) <= place(y), F.xxhash64(value(x), value(y))).otherwise(F.xxhash64(value(y), value(x)))
            h = F.when(y.isNotNull() & (bin_of(y) == bin_of(x)), pair).otherwise(F.xxhash64(value(x)))
            entry = F.shiftleft(bin_of(x), 16).bitwiseOR(h.bitwiseAND(F.lit(0xFFFF)))
            return F.when((i == 0) | (bin_of(F.get(s, i - 1)) != bin_of(x)), entry)

        return F.filter(F.transform(s, one), lambda e: e.isNotNull())

    return bind(bind(elements, smallest), signed)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column, as one expression that evaluates each step once a row."""
    text = F.coalesce(text, F.lit(""))
    apart = F.when((F.octet_length(text) > F.length(text)) & text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)
    words = F.filter(F.split(apart, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    tuples = bind(words, lambda w: _tuples(_numbered(_elements(w))))
    return F.array_join(F.transform(tuples, lambda e: F.lower(F.lpad(F.hex(e), 6, "0"))), "")


def _entries(fp: Column) -> Column:
    return F.regexp_extract_all(fp, F.lit("([0-9a-f]{6})"), 1)


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing bins, 0 to 1, of two fingerprints."""

    def compare(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        bins = lambda v: F.transform(v, lambda e: F.substring(e, 1, 2))
        either = F.size(F.array_union(bins(x), bins(y)))
        return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / either)

    return bind(F.struct(_entries(a).alias("x"), _entries(b).alias("y")), compare)


def with_next(docs: DataFrame, columns: list[str], key: str, text: str) -> DataFrame:
    """Adds next_<column> of the following row by key, a long, and then by the XXH64 of text; after the last comes the first.

    Rows are dealt into ranges whose bounds are (key, hash) pairs that rows have,
    so a key of many rows has ranges of its own. The rows at a bound also go, as
    marks, to the range before, so each range finds its last row's follower
    itself, and no range sees the whole.
    """
    ranges = 4 * shuffle_width(docs.sparkSession)
    h = F.xxhash64(text)
    found = docs.agg(F.min(key).alias("least"), F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("cuts")).first()
    cuts = [x for x in [found["least"], *(found["cuts"] or [])] if x is not None]
    times = Counter(cuts)
    bits = max(times.values(), default=1).bit_length() - 1  # a key that is several cuts is cut by its hashes too
    top = F.when(F.col(key).isin([k for k, n in times.items() if n > 1]), F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(2**63))), 63 - bits) if bits else F.lit(0)).otherwise(F.lit(0))
    least = docs.where(F.col(key).isin(list(times))).select(key, h.alias("_h"), top.alias("_top")).groupBy(key, "_top").agg(F.min("_h").alias("_h"))
    bounds = sorted((r[key], r["_h"]) for r in least.collect()) or [(0, 0)]  # at most two for each cut
    table = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(x).cast("long").alias("h")) for k, x in bounds])
    last = len(bounds) - 1
    reached = lambda x: (x["k"] < F.col(key)) | ((x["k"] == F.col(key)) & (x["h"] <= F.col("_h")))
    at = bind(F.filter(table, reached), lambda x: F.struct((F.size(x) - 1).alias("r"), F.element_at(x, -1).alias("bound")))
    own = docs.withColumn("_h", h).withColumn("_at", at)
    one = lambda r, m: F.struct(r.alias("r"), F.lit(m).alias("m"))
    r = F.col("_at.r")
    first = (F.col("_at.bound.k") == F.col(key)) & (F.col("_at.bound.h") == F.col("_h"))
    mark = F.when(first & (r == 0), F.array(one(r, 0), one(F.lit(last), 2))).when(first, F.array(one(r, 0), one(r - 1, 1))).otherwise(F.array(one(r, 0)))
    dealt = own.withColumn("_d", F.explode(mark)).withColumns({"_r": F.col("_d.r"), "_m": F.col("_d.m")}).drop("_d", "_at")
    w = W.partitionBy("_r").orderBy((F.col("_m") == 2).cast("int"), key, "_h", text)
    return dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("_m = 0").drop("_r", "_m", "_h")


def order_minhash(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The edited text has its last n_chars // 2 code points replaced by the first
    as many (or all) of the next document.
    """
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.withColumn("fp", fingerprint(F.col("t")))
    rows = with_next(rows, ["t", "fp"], "key", "t")
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("t").substr(F.lit(1), n - half), F.col("next_t").substr(F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("e"))
    rows = rows.select("doc_id", "n_chars", F.sha2("e", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), "next_fp", fingerprint(F.col("e")).alias("edited_fingerprint"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"))
