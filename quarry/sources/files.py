"""Files as rows: scanning, validation, and loaders for the formats that the standard library can read.

Everything reads through Spark's binaryFile source, so any store that Spark can
open will do, and a broken file gives a row with a reason instead of a failure.
That source passes over files of no bytes at all, so they never become rows.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections import Counter
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import uuid5

# What is read, what is passed over, first bytes by format.
SUPPORTED = ("pdf", "docx", "xlsx", "pptx", "txt", "md", "csv", "json", "xml", "png", "jpg", "jpeg", "eml")
IGNORED_DIRS = (".git", "__pycache__", ".venv", "node_modules", ".idea", ".vscode")
IGNORED_EXTENSIONS = ("pyc", "tmp", "log", "ds_store")
MAGIC = {"pdf": b"%PDF-", "png": b"\x89PNG", "jpg": b"\xff\xd8\xff", "jpeg": b"\xff\xd8\xff", "docx": b"PK", "xlsx": b"PK", "pptx": b"PK"}
MIME = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json", "xml": "application/xml", "eml": "message/rfc822"}
NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
LARGEST = 500 << 20


def scan(spark: SparkSession, directory: str, content: bool = False) -> DataFrame:
    """relative_path, category, subcategory, file_name, extension, size_bytes, modified, is_supported (and content) of every file below a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    root = directory.rstrip("/").split("://")[-1]
    relative = F.regexp_replace("path", f"^.*?{re.escape(root)}/", "")
    parts = F.split(relative, "/")
    name = F.element_at(parts, -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    folders = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), F.lower)
    rows = files.select(
        relative.alias("relative_path"),
        F.when(F.size(parts) > 1, parts[0]).otherwise("root").alias("category"),
        F.when(F.size(parts) > 2, parts[1]).alias("subcategory"),
        name.alias("file_name"),
        extension.alias("extension"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
        extension.isin(*SUPPORTED).alias("is_supported"),
        folders.alias("_folders"),
        *(["content"] if content else []),
    )
    return rows.where(~F.arrays_overlap("_folders", F.array(*map(F.lit, IGNORED_DIRS))) & ~F.col("extension").isin(*IGNORED_EXTENSIONS)).drop("_folders")


def mime_type(extension: Column, content: Column) -> Column:
    """From the first bytes; formats in zip containers, and those without a mark, by extension."""
    head = lambda raw: F.startswith(F.hex(F.substring(content, 1, 8)), F.lit(raw.hex().upper()))
    by_name = F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), extension)
    return F.when(head(b"%PDF-"), MIME["pdf"]).when(head(b"\x89PNG"), MIME["png"]).when(head(b"\xff\xd8\xff"), MIME["jpg"]).otherwise(F.coalesce(by_name, F.lit("application/octet-stream")))


def intact(extension: str, raw: bytes) -> bool:
    """Whether the content is what the extension says."""
    mark = MAGIC.get(extension)
    if mark and not raw.startswith(mark):
        return False
    try:
        if extension in ("docx", "xlsx", "pptx"):
            return zipfile.ZipFile(io.BytesIO(raw)).testzip() is None
        if extension == "json":
            json.loads(raw)
        if extension == "xml":
            ElementTree.fromstring(raw)
    except (ValueError, zipfile.BadZipFile, ElementTree.ParseError, zlib.error):
        return False
    return True


def validate(files: DataFrame, least: int = 1, most: int = LARGEST) -> DataFrame:
    """Adds status (VALID, EMPTY, CORRUPTED, UNSUPPORTED; the first rule that fails decides) and sha256."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ext, raw = (b.column(b.schema.get_field_index(c)) for c in ("extension", "content"))
            ok = [r is not None and intact(e or "", r) for e, r in zip(ext.to_pylist(), raw.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], names=[*b.schema.names, "intact"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", intact boolean"
    probed = files.mapInArrow(probe, schema)
    status = F.when(~F.col("is_supported"), "UNSUPPORTED").when(F.col("size_bytes") < least, "EMPTY").when(F.col("size_bytes") > most, "CORRUPTED").when(~F.col("intact"), "CORRUPTED").otherwise("VALID")
    return probed.withColumns({"status": status, "sha256": F.sha2("content", 256)}).drop("intact")


def decoded(raw: bytes) -> str:
    for name in ("utf-8", "latin-1"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("ascii", "replace")


def csv_rows(text: str) -> list[list[str]]:
    """The rows under the delimiter that gives most rows, of the whole text, the same number of fields above one; a comma if none does."""
    best: tuple[int, list[list[str]]] | None = None
    for delimiter in ",;\t|":
        rows = list(csv.reader(io.StringIO(text), delimiter=delimiter, skipinitialspace=True))
        widths = Counter(len(r) for r in rows if len(r) > 1)
        alike = max(widths.values(), default=0)
        if best is None or alike > best[0]:
            best = alike, rows
    return best[1]


def read_csv(raw: bytes) -> str:
    return "\n".join(" | ".join(c.strip() for c in row if c.strip()) for row in csv_rows(decoded(raw)))


def _texts(raw: bytes, tag: str) -> list[str]:
    return [e.text or "" for e in ElementTree.fromstring(raw).iter() if e.tag.endswith("}" + tag)]


def read_docx(raw: bytes) -> str:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    line = lambda e: "".join(t.text or "" for t in e.iter() if t.tag.endswith("}t"))
    out = []
    for block in next(e for e in body.iter() if e.tag.endswith("}body")):
        if block.tag.endswith("}p"):
            out.append(line(block))
        elif block.tag.endswith("}tbl"):
            out += [" | ".join(line(c) for c in row if c.tag.endswith("}tc")) for row in block if row.tag.endswith("}tr")]
    return "\n\n".join(x for x in out if x.strip())


def read_pptx(raw: bytes) -> str:
    z = zipfile.ZipFile(io.BytesIO(raw))
    slides = sorted((int(m[1]), m[0]) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for number, name in slides:
        parts = [t for t in _texts(z.read(name), "t") if t.strip()]
        if parts:
            out.append(f"--- Slide {number} ---\n" + "\n".join(parts))
    return "\n\n".join(out)


def read_xlsx(raw: bytes) -> str:
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if si.tag.endswith("}si")]
    names = [e.get("name", "") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if e.tag.endswith("}sheet")]
    files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    out = []
    for name, f in zip(names, files, strict=False):
        rows = []
        for row in (e for e in ElementTree.fromstring(z.read(f)).iter() if e.tag.endswith("}row")):
            cells = []
            for c in row:
                v = next((x.text or "" for x in c.iter() if x.tag.endswith("}v") or x.tag.endswith("}t")), "")
                cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
            if any(x.strip() for x in cells):
                rows.append(" | ".join(x for x in cells if x.strip()))
        out.append("\n".join([f"=== Sheet: {name} ===", *rows]))
    return "\n\n".join(out)


def read_pdf(raw: bytes) -> str:
    """Literal strings of the text operators in deflated streams; pieces that are mostly letters stay."""
    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", raw, re.S):
        try:
            data = zlib.decompress(m[1])
        except zlib.error:
            data = m[1]
        found = []
        for block in re.findall(rb"BT(.*?)ET", data, re.S):
            found += [p.decode("latin-1") for p in re.findall(rb"\(((?:\\.|[^\\()])*)\)", block)]
        text = " ".join(p for p in found if p and sum(c.isalnum() or c.isspace() for c in p) >= 0.65 * len(p))
        if text.strip():
            pages.append(text)
    return "\n\n".join(f"--- Page {i} ---\n{p}" for i, p in enumerate(pages, 1))


def read_image(raw: bytes) -> str:
    if raw.startswith(b"\x89PNG"):
        return f"[image PNG {int.from_bytes(raw[16:20], 'big')}x{int.from_bytes(raw[20:24], 'big')}]"
    return "[image]"


LOADERS: dict[str, Callable[[bytes], str]] = {"txt": decoded, "md": decoded, "json": decoded, "xml": decoded, "eml": decoded, "csv": read_csv, "docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx, "pdf": read_pdf, "png": read_image, "jpg": read_image, "jpeg": read_image}


def register_loader(extension: str) -> Callable:
    """Decorator that adds a loader of bytes for an extension."""

    def keep(f: Callable[[bytes], str]) -> Callable[[bytes], str]:
        LOADERS[extension.lower()] = f
        return f

    return keep


def load_documents(spark: SparkSession, directory: str) -> DataFrame:
    """doc_id, relative_path, category, extension, content, error of every supported file; a failure fills error."""
    loaders = dict(LOADERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            texts, errors = [], []
            for ext, raw in zip(at["extension"].to_pylist(), at["content"].to_pylist(), strict=True):
                try:
                    texts.append(loaders[ext](raw))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  whatever a broken file does becomes its row's reason
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([at["doc_id"], at["relative_path"], at["category"], at["extension"], pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["doc_id", "relative_path", "category", "extension", "content", "error"])

    files = scan(spark, directory, content=True).where(F.col("is_supported") & F.col("extension").isin(*loaders))
    keyed = files.select(uuid5(NAMESPACE_URL, F.col("relative_path")).alias("doc_id"), "relative_path", "category", "extension", "content")
    return keyed.mapInArrow(run, "doc_id string, relative_path string, category string, extension string, content string, error string")


def manifest(validated: DataFrame) -> DataFrame:
    """A record for each file: id, state, and whether another file with its content comes first."""
    first = validated.groupBy("sha256").agg(F.min("relative_path").alias("_first"), F.count("*").alias("_n")).where("_n > 1").withColumnRenamed("sha256", "_sha")
    rows = validated.join(first, F.col("sha256") == F.col("_sha"), "left")
    late = F.coalesce(F.col("relative_path") > F.col("_first"), F.lit(False))
    return rows.select(uuid5(NAMESPACE_URL, F.col("relative_path")).alias("document_id"), "relative_path", "category", "subcategory", "file_name", "extension", "size_bytes", "sha256", "status", "modified", late.alias("is_duplicate"), F.when(late, F.col("_first")).alias("duplicate_of"), F.when(F.col("status") == "VALID", "INDEXED").otherwise("FAILED_VALIDATION").alias("state"))


def health(files: DataFrame) -> DataFrame:
    """status, category, extension, n, bytes for each single grouping and the total, and the share of valid files."""
    valid = F.round(100 * F.count(F.when(F.col("status") == "VALID", 1)) / F.count("*"), 2)
    keys = [F.col(c) for c in ("status", "category", "extension")]
    return files.groupingSets([[keys[0]], [keys[1]], [keys[2]], []], *keys).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), valid.alias("health"))
