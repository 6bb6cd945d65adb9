"""Text steps that Spark has no primitive for, as Arrow functions over whole batches."""

from __future__ import annotations

import difflib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.protected import PROTECTED, protected_spans

#: Ranges of at most so many pairs of characters are left to difflib.
DIFF_SMALL = 1024
_BASE = 0x9E3779B97F4A7C15


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility normal form."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks' share of both texts, case and outer blanks apart; null if either is."""
    one = lambda x, y: difflib.SequenceMatcher(None, x.strip().lower(), y.strip().lower()).ratio()
    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def matched(x: str, y: str) -> int:
    """Characters in difflib's matching blocks (without junk) of x and y.

    The longest block of a range is found by halving its length over hashes of
    all windows, and compared: only unequal windows of one hash go to difflib. No
    block is longer than that of the range around it. Time goes with the length,
    its logarithm squared, and how deeply ranges nest.
    """
    if x == y:
        return len(x)
    top = max(len(x), len(y)) + 1
    power = np.full(top + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    sums = []
    for t in (x, y):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        sums.append(np.zeros(len(t) + 1, np.uint64))
        np.cumsum(codes * power[: len(t)], dtype=np.uint64, out=sums[-1][1:])

    def windows(side: int, lo: int, hi: int, n: int) -> np.ndarray:
        at = sums[side]
        return (at[lo + n : hi + 1] - at[lo : hi - n + 1]) * power[top - hi + n : top - lo + 1][::-1]

    def longest(alo: int, ahi: int, blo: int, bhi: int, most: int) -> tuple[int, int, int]:
        if (ahi - alo) * (bhi - blo) > DIFF_SMALL:
            n, over = 0, min(ahi - alo, bhi - blo, most) + 1
            while over - n > 1:
                mid = (n + over) // 2
                n, over = (mid, over) if np.isin(windows(0, alo, ahi, mid), windows(1, blo, bhi, mid)).any() else (n, mid)
            if not n:
                return alo, blo, 0
            a, b = windows(0, alo, ahi, n), windows(1, blo, bhi, n)
            i = int(np.isin(a, b).argmax())
            j = int((b == a[i]).argmax())
            i, j = i + alo, j + blo
            if x[i : i + n] == y[j : j + n]:
                return i, j, n
        i, j, n = difflib.SequenceMatcher(None, x[alo:ahi], y[blo:bhi], autojunk=False).find_longest_match()
        return i + alo, j + blo, n

    total, ranges = 0, [(0, len(x), 0, len(y), top)]
    while ranges:
        alo, ahi, blo, bhi, most = ranges.pop()
        if alo < ahi and blo < bhi:
            i, j, n = longest(alo, ahi, blo, bhi, most)
            if n:
                total += n
                ranges += [(alo, i, blo, j, n), (i + n, ahi, j + n, bhi, n)]
    return total


@F.pandas_udf(T.StructType([T.StructField("removed", T.LongType()), T.StructField("normalized", T.LongType())]))
def diff_stats(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Characters removed, and characters that no matching block covers, of texts of any length."""
    rows = [(max(0, len(x) - len(y)), len(x) - matched(x, y)) for x, y in zip(before.fillna(""), after.fillna(""), strict=True)]
    return pd.DataFrame(rows, columns=["removed", "normalized"])


@F.pandas_udf(T.StructType([T.StructField("masked", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))]))
def mask(texts: pd.Series) -> pd.DataFrame:
    """The text with its i-th protected token as __ENG_TOKEN_i__, and the tokens."""
    masked, tokens = [], []
    for t in texts.fillna(""):
        parts, at, own = [], 0, []
        for a, z in protected_spans(t):
            parts += [t[at:a], f"__ENG_TOKEN_{len(own)}__"]
            own.append(t[a:z])
            at = z
        masked.append("".join([*parts, t[at:]]))
        tokens.append(own)
    return pd.DataFrame({"masked": masked, "tokens": tokens})


def unmask(masked: Column, tokens: Column) -> Column:
    """Puts token i back for its mark, in one pass; a mark that has no token stays."""
    mark = r"__ENG_TOKEN_(\d+)__"
    found = F.regexp_extract_all(masked, F.lit(mark), 1)
    put = lambda n: F.coalesce(F.get(tokens, n.try_cast("int")), F.concat(F.lit("__ENG_TOKEN_"), n, F.lit("__")))
    joined = lambda gaps: F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(put(F.get(found, i)), F.lit(""))))), "")
    return F.transform(F.array(F.split(masked, mark)), joined)[0]


def protected_tokens(text: Column) -> Column:
    """Sorted distinct matches of all patterns, of more than one character."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 0) for _, p in PROTECTED])
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, F.trim), lambda x: F.length(x) > 1)))


def lost_tokens(before: Column, after: Column) -> Column:
    """Protected tokens that the cleaned text lacks."""
    return F.filter(protected_tokens(before), lambda x: ~F.contains(after, x))
