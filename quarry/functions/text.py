"""Cleaning, splitting and counting of text, as JVM-side column expressions.

Patterns keep to what both Java and RE2 read alike, so an oracle can use the
same strings. WS is the set that Python's str.strip and str.split take as blank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STRIP = f"^[{WS}]+|[{WS}]+$"
#: The characters of WS.
BLANKS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# for Java alone: letters of ASCII pass by one comparison, before the class is asked
WORD = f"[!-~[^{WS}]]+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# horizontal: blank but not \n, \r
HWS = r"[\t\x0b\x0c\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
ZERO_WIDTH = r"[\x{200b}\x{200c}\x{200d}\x{feff}\x{ad}\x{2060}]"
CURLY, STRAIGHT = "‘’‚‛“”„‟", "''''\"\"\"\""
BULLET = r"(?m)^([ \t]*)(?:[•▪▫►▻⁃◦○*]|–|—)(?:\s+|\t+)"
NUMBERED = r"(?m)^([ \t]*)(?:\((\d{1,4})\)|(\d{1,4})\)|(\d{1,4})\s*-\s+)"
NUMBER_GAP = r"(?m)^([ \t]*\d{1,4}\.)[ \t]{2,}"
HYPHEN = r"-\s*(?:\r?\n|[ \t]+)\s*([a-z]{2,})\b"
HELD = "\ue000"  # stands for a kept hyphen meanwhile
KEPT_PREFIX = r"(?i:self|cross|quasi|semi|ex|all|half)"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + WS + "]"
SENTENCE_BREAK = r"(?<=[.?!])\s+(?=[A-Z0-9\"'(\[])"
# Words after which a sentence goes on.
ABBREVIATIONS = ("e.g.", "i.e.", "fig.", "figs.", "ref.", "no.", "rev.", "approx.", "min.", "max.", "temp.", "press.", "vol.", "dr.", "dept.", "equip.", "p&id.")


def strip(t: Column) -> Column:
    """What replacing STRIP gives, without a pattern, which tries each character of the text."""
    return F.btrim(t, F.lit(BLANKS))


def fix_encoding(t: Column) -> Column:
    """Control and zero-width characters go; curly quotes and the ellipsis become ASCII."""
    plain = F.regexp_replace(F.regexp_replace(t, CONTROL, ""), ZERO_WIDTH, "")
    return F.replace(F.translate(plain, CURLY, STRAIGHT), F.lit("…"), F.lit("..."))


def fix_line_ends(t: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), "\n{3,}", "\n\n"))


def lines(t: Column) -> Column:
    """Lines without their ends; no line after a final end."""
    whole = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)
    return F.transform(F.array(F.split(t, LINE_BREAK)), whole)[0]


def squeeze_lines(t: Column) -> Column:
    return F.array_join(F.transform(lines(t), lambda x: strip(F.regexp_replace(x, HWS, " "))), "\n")


def join_hyphens(t: Column) -> Column:
    """Words split by a hyphen and a blank are joined; some prefixes keep the hyphen."""
    held = F.regexp_replace(t, rf"\b({KEPT_PREFIX}){HYPHEN}", f"$1{HELD}$2")
    return F.replace(F.regexp_replace(held, rf"\b([A-Za-z]{{2,}}){HYPHEN}", "$1$2"), F.lit(HELD), F.lit("-"))


def fix_bullets(t: Column) -> Column:
    return F.regexp_replace(t, BULLET, "$1- ")


def fix_lists(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, NUMBERED, "$1$2$3$4. "), NUMBER_GAP, "$1 ")


def runs(items: Column, begins) -> Column:
    """The array cut into runs: an item begins one if begins(item before, item); each item is copied once."""

    def cut(x: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | begins(F.get(x, i - 1), F.get(x, i)))
        return F.transform(F.array(at), lambda s: F.transform(s, lambda i, j: F.slice(x, i + 1, F.coalesce(F.get(s, j + 1), F.size(x)) - i)))[0]

    return F.transform(F.array(items), lambda x: F.when(F.size(x) == 0, F.array().cast("array<array<string>>")).otherwise(cut(x)))[0]


def join_paragraph_lines(t: Column) -> Column:
    """Within a paragraph, a line joins the one before unless either is a block or that one ends a sentence.

    Most lines show by themselves whether they join. Only a line of "#" or
    number signs, or one that begins with "|", may make a block of those that
    join it, so only runs that hold one are followed line by line.
    """
    block = lambda x: x.rlike(r"^#{1,6}\s") | x.rlike(r"^\d+(?:\.\d+)*\s+[A-Z]") & ~x.endswith(".") & (F.length(x) < 80) | x.rlike(r"^\|.*\|$")
    item = lambda x: x.rlike(r"^(?:[-*•]|\d{1,4}[.)])\s+")
    apart = lambda last, x: block(last) | block(x) | item(x) | last.rlike(r"[.?!:;-]$") | last.rlike(r'[.?!]"$')
    opens = lambda x: x.rlike(r"^(?:#{1,6}|\d+(?:\.\d+)*)$|^\|")

    def fold(made: Column, x: Column) -> Column:
        last = F.element_at(made, -1)
        return F.when(F.size(made) == 0, F.array(x)).when(block(last), F.concat(made, F.array(x))).otherwise(F.concat(F.slice(made, F.lit(1), F.size(made) - 1), F.array(F.concat_ws(" ", last, x))))

    def one(para: Column) -> Column:
        rows = F.filter(F.transform(F.split(para, "\n"), strip), lambda x: x != "")
        joined = lambda r: F.when(F.exists(r, opens), F.array_join(F.aggregate(r, F.array().cast("array<string>"), fold), "\n")).otherwise(F.array_join(r, " "))
        return F.array_join(F.transform(runs(rows, apart), joined), "\n")

    return F.array_join(F.filter(F.transform(F.split(t, "\n\n"), one), lambda x: x != ""), "\n\n")


def clean(t: Column) -> Column:
    """The text stages in document order."""
    for step in (fix_encoding, squeeze_lines, fix_line_ends, join_paragraph_lines, join_hyphens, fix_bullets, fix_lists):
        t = step(t)
    return t


def ascii_share(t: Column) -> Column:
    return F.when(F.length(t) == 0, 1.0).otherwise(F.length(F.regexp_replace(t, r"[^\x00-\x7F]", "")) / F.length(t))


def words(t: Column) -> Column:
    return F.filter(F.split(t, f"[{WS}]+"), lambda w: w != "")


def count_words(t: Column) -> Column:
    return F.regexp_count(t, F.lit(WORD))


def tok_regex(t: Column) -> Column:
    return F.regexp_count(t, F.lit(TOKEN))


def tok_retrieval(t: Column) -> Column:
    return F.greatest(count_words(t).cast("long"), F.ceil(F.length(strip(t)) / 4))


def tok_prompt(t: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(t) / 4))


def tok_loader(t: Column) -> Column:
    n = count_words(t)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.bround((F.length(t) / 4 + n * 1.33) / 2).cast("long")))


def tokens(t: Column) -> Column:
    """Search tokens: identifiers in lower case, and the parts of those with - or _."""
    found = F.regexp_extract_all(t, F.lit(r"([A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*)"), 1)
    return F.flatten(F.transform(found, lambda x: F.when(x.rlike("[-_]"), F.concat(F.array(F.lower(x)), F.split(F.lower(x), "[-_]+"))).otherwise(F.array(F.lower(x)))))


def paragraphs(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, r"\n\s*\n"), strip), lambda p: p != "")


def list_items(t: Column) -> Column:
    return F.filter(F.transform(lines(t), strip), lambda p: p != "")


def sentences(t: Column) -> Column:
    """Sentences; one that ends in an abbreviation or a number with a dot takes the next.

    An abbreviation shows in the last few characters. Patterns that end in $ are tried
    from every character of a text, so they see no more than those, or only parts that end in a digit and a dot.
    """
    tail = lambda s: F.right(s, F.lit(max(map(len, ABBREVIATIONS)) + 1))
    abbreviated = lambda s: F.lower(F.regexp_extract(tail(s), f"([^{WS}]+)$", 1)).isin(*ABBREVIATIONS)
    open_end = lambda s: s.endswith(".") & (abbreviated(s) | tail(s).rlike(r"\d\.$") & s.rlike(r"\b\d+\.$"))
    parts = F.filter(F.transform(F.split(t, SENTENCE_BREAK), strip), lambda x: x != "")
    return F.transform(runs(parts, lambda last, _: ~open_end(last)), lambda r: F.array_join(r, " "))


def content_hash(t: Column) -> Column:
    return F.sha2(strip(t), 256)


def chunk_id(document_id: Column, page: Column, index: Column, content: Column) -> Column:
    return F.format_string("chk_%s_p%d_%04d_%s", F.substring(F.sha2(document_id, 256), 1, 8), F.coalesce(page, F.lit(0)), index, F.substring(content_hash(content), 1, 8))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based identifier of version 5 in a namespace given as a UUID string."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.instr(F.lit("0123456789abcdef"), F.substring(h, 17, 1)), 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def fixed(x: Column, places: int) -> Column:
    """x with so many decimals, as C's printf has it: a tie of the binary value goes to the even digit, where the JVM's formatter rounds the shortest decimal up.

    Exact while x * 10**places is, as it is for all 32-bit floats at up to six
    places and for counts over powers of two, up to 2**63; null stays null.
    """
    x, scale = x.cast("double"), float(10**places)
    big = F.abs(x) >= 2.0**53
    digits = F.format_string(f"%.{places}f", F.rint(x * scale) / scale)
    return (
        F.when(x.isNull(), None)
        .when(F.isnan(x), "nan")
        .when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when(big & (F.abs(x) < 2.0**63), F.concat(x.cast("long").cast("string"), F.lit("." + "0" * places)))
        .otherwise(digits)
    )


def byte_size(n: Column) -> Column:
    kb, mb, gb = 1024, 1024**2, 1024**3
    told = lambda unit, name: F.concat(fixed(n / unit, 2), F.lit(f" {name}"))
    return F.when(n < kb, F.format_string("%d B", n)).when(n < mb, told(kb, "KB")).when(n < gb, told(mb, "MB")).otherwise(told(gb, "GB"))
