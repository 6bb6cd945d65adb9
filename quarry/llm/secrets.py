"""Secret scans: fixed patterns, and novelty under a dictionary-primed zstandard.

Three kinds come from patterns: assign, access, hex. The fourth, novel, covers
strings that no pattern names: a candidate in a sensitive context is compressed
after its surroundings, with a dictionary of common identifiers. It is reported
if it adds NOVELTY bytes for each of its characters, or SHARE of what random
strings of its length and alphabet add in the same place; names and prose
compress against the dictionary and context, keys do not.

Defined results: a null or empty text has no spans; a text is scanned whole and
by itself, so repeated rows and ties give equal rows; further columns are
ignored; an empty table gives an empty result. Spans are in code points.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
import string
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import pick

# The patterns of the three base kinds and their least lengths.
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "novel")

#: A sign = ends a name, which is context of the value after it; only one that pads belongs to a value.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.~-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=.~-]))?")
SENSITIVE = re.compile(r"(?i:pass|pwd|secret|token|key|auth|bearer|credential|private|signature|session|cookie)", re.ASCII)
#: Characters before a candidate that must name something sensitive; those on both sides that prime the compressor.
NEAR, AROUND = 48, 256
#: Least compressed bytes that a candidate adds for each of its characters; or least share of what random strings of
#: its length and alphabet add in its place, DRAWS of them on average.
NOVELTY, SHARE, DRAWS = 0.9, 0.82, 4
#: Bytes a character below which no string comes near SHARE: even hexadecimal digits hold half a byte each.
FLOOR = 0.35
ALPHABETS = (string.digits, string.ascii_lowercase, string.ascii_uppercase)
IDENTIFIERS = (
    "access account action address admin algorithm application argument array async authorization await backend base64 bearer boolean bucket buffer byte cache callback certificate "
    "character class client cloud cluster code column command config configuration connection console const container content context control cookie counter create credentials "
    "current custom data database debug default delete description development directory document domain driver dynamic element email enabled encoding endpoint engine environment "
    "error event example exception export extends extension factory false field file filter float folder format from function gateway generate global group handler hash header "
    "history host http https identifier image implements import index information input instance integer interface internal iterator java javascript json kernel language length "
    "library license listener local location logger login manager master match message metadata method model module monitor name namespace network node null number object offset "
    "operation option output package page parameter parent parse password path pattern payload permission pipeline platform plugin policy port prefix private process production "
    "profile project property protected protocol provider proxy public python query queue random read record reference refresh register release remote repository request resource "
    "response result return role root route runtime sample scheduler schema scope script secret section secure security select sequence server service session setting signature size "
    "source spark stack staging state static status storage store stream string structure style subject suffix switch system table target task template temporary test text thread "
    "time timeout timestamp title token tracker transaction transform true type unique update upload user username utility validate value variable vector version view void webhook "
    "width window worker workflow write www. .com .org .net /usr/local/bin/ /home/user/ 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 2020-01-01T00:00:00Z"
)

_pair: list[zstandard.ZstdCompressor] = []


def _compressor() -> zstandard.ZstdCompressor:
    if not _pair:
        raw = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _pair.append(zstandard.ZstdCompressor(level=19, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False))
    return _pair[0]


def surroundings(text: str, start: int, end: int) -> bytes:
    """What primes the compressor for text[start:end]: AROUND characters on both sides, where copies of it are blanked."""
    own = text[start:end].rstrip("=")
    blank, reach = "\n" * len(own), AROUND + len(own)
    before = text[max(0, start - reach) : start].replace(own, blank)[-AROUND:]
    after = text[end : end + reach].replace(own, blank)[:AROUND]
    return (before + "\n" + after + "\n").encode("utf-8", "surrogatepass")


def alphabet(s: str) -> str:
    """Hexadecimal digits of one case, or the classes of letters and digits that s has, and its signs."""
    held = set(s)
    for letters in ("abcdef", "ABCDEF"):
        if held <= set(string.digits + letters):
            return string.digits + letters
    return "".join(x for x in ALPHABETS if held & set(x)) + "".join(sorted(held - set(string.digits + string.ascii_letters)))


@functools.lru_cache(4096)
def drawn(letters: str, n: int) -> list[bytes]:
    """DRAWS random strings of n letters, the same at every call."""
    rng = random.Random(f"{letters} {n}")
    return ["".join(rng.choices(letters, k=n)).encode() for _ in range(DRAWS)]


def novel(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] adds about as many compressed bytes after its surroundings as a random string does."""
    around = surroundings(text, start, end)
    size = lambda raw: len(_compressor().compress(raw))
    n, before = end - start, size(around)
    added = size(around + text[start:end].encode()) - before
    if added >= NOVELTY * n or added < FLOOR * n:
        return added >= NOVELTY * n
    return DRAWS * added >= SHARE * sum(size(around + x) - before for x in drawn(alphabet(text[start:end]), n))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the fixed patterns, by start, then kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def merged(spans: list[tuple[int, int, str]]) -> list[int]:
    """Where the union of spans, sorted by start, begins and ends, by turns."""
    out: list[int] = []
    for a, b, _ in spans:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def places(text: str, found: dict[str, None]) -> Iterator[tuple[int, int]]:
    """All places of the strings found, in one pass over the text."""
    if not found:
        return
    search = ahocorasick.Automaton()
    for s in found:
        search.add_word(s, len(s))
    search.make_automaton()
    for last, n in search.iter(text):
        yield last + 1 - n, last + 1


def novel_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates that mix letters with digits or are all letters, follow a sensitive word, touch no base span, and do not compress; all places of each.

    Letters with signs but no digit are names and paths, which random strings seldom look like; digits without a letter are numbers.
    """
    edges = merged(base)
    free = lambda a, b: bisect.bisect_right(edges, a) % 2 == 0 and bisect.bisect_right(edges, a) == bisect.bisect_left(edges, b)
    out, known = {}, {}
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        s = m[0]
        if not (s.isalpha() or any(c.isdigit() for c in s) and any(c.isalpha() for c in s)) or not free(a, b):
            continue
        if SENSITIVE.search(text, max(0, a - NEAR), a) and (s.rstrip("=") in known or novel(text, a, b)):
            out[a] = b
            known[s.rstrip("=")] = None
    starts = list(out)
    for a, b in places(text, known):
        i = bisect.bisect_right(starts, a) - 1
        if free(a, b) and (i < 0 or out[starts[i]] < b):
            out[a] = max(b, out.get(a, b))
    return [(a, b, "novel") for a, b in sorted(out.items())]


def spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, of one text."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2])))


def told(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def redacted(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """The text with each merged span put as [SECRET]; unchanged if there is none."""
    if not found:
        return text
    out, at, reach = [], 0, -1
    for a, b, _ in found:
        if a >= reach:
            out += [text[at:a], "[SECRET]"]
        reach = at = max(reach, b)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, redacted string"


def secret_scan(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """A row for each document with its spans; redacted is null unless with_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64()] * 4 + [pa.string()] * 3
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                base, every = spans(t)
                kinds = [k for _, _, k in every]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(told(base).encode()).hexdigest(), told(every), redacted(t, every) if with_text else None))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=names)

    return pick(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def redact(texts: pd.Series) -> pd.Series:
    """The texts with their secrets put as [SECRET]."""
    return texts.map(lambda t: redacted(t, spans(t)[1]) if isinstance(t, str) else None)
