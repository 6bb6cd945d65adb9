"""Files, tables and streams on small folders."""

import io
import uuid
import zipfile
import zlib

from pyspark.sql import functions as F

from quarry.operators import chunking
from quarry.operators.incremental import LexicalIndex
from quarry.sources import files, tables
from quarry.streaming import ingest


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def folder(tmp_path):
    w = 'xmlns:w="u"'
    rows = {
        "manuals/a.txt": b"plain \xe9 text",
        "manuals/deep/b.md": b"# Title\nbody",
        "c.csv": b"name;value\nx;1\ny;\n",
        "d.docx": zipped(word__document_xml=f"<w:document {w}><w:body><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"),
        "e.pptx": zipped(ppt__slides__slide1_xml='<a:s xmlns:a="u"><a:t>Hello</a:t></a:s>', ppt__slides__slide2_xml='<a:s xmlns:a="u"></a:s>'),
        "f.xlsx": zipped(xl__workbook_xml='<w:w xmlns:w="u"><w:sheet name="S1"/></w:w>', xl__sharedStrings_xml='<s:s xmlns:s="u"><s:si><s:t>Tag</s:t></s:si></s:s>', xl__worksheets__sheet1_xml='<s:s xmlns:s="u"><s:row><s:c t="s"><s:v>0</s:v></s:c><s:c><s:v>5</s:v></s:c></s:row></s:s>'),
        "g.pdf": b"%PDF-1.4\nstream\n" + zlib.compress(b"BT (Hello page) Tj ET") + b"\nendstream",
        "bad.docx": b"not a zip",
        "empty.txt": b"\n",
        "copy.txt": b"plain \xe9 text",
        "x.exe": b"MZ",
        "skip.log": b"no",
        ".git/h.txt": b"no",
    }
    for name, raw in rows.items():
        p = tmp_path / "data" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(raw)
    return f"{tmp_path}/data"


def test_files(spark, tmp_path):
    root = folder(tmp_path)
    seen = {r.relative_path: r for r in files.scan(spark, root).collect()}
    assert "skip.log" not in seen and ".git/h.txt" not in seen and not seen["x.exe"].is_supported
    assert (seen["manuals/deep/b.md"].category, seen["manuals/deep/b.md"].subcategory, seen["c.csv"].category) == ("manuals", "deep", "root")
    checked = files.validate(files.scan(spark, root, content=True), least=2).drop("content")
    status = {r.relative_path: r.status for r in checked.collect()}
    assert status["bad.docx"] == "CORRUPTED" and status["empty.txt"] == "EMPTY" and status["x.exe"] == "UNSUPPORTED" and status["d.docx"] == "VALID"
    listed = {r.relative_path: r for r in files.manifest(checked).collect()}
    assert listed["manuals/a.txt"].duplicate_of == "copy.txt" and not listed["copy.txt"].is_duplicate
    assert listed["c.csv"].document_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "c.csv"))
    total = files.health(checked).where("status is null and category is null and extension is null").first()
    assert total.n == len(status) and total.health == round(100 * sum(s == "VALID" for s in status.values()) / len(status), 2)


def test_loaders(spark, tmp_path):
    got = {r.relative_path: r for r in files.load_documents(spark, folder(tmp_path)).collect()}
    assert got["manuals/a.txt"].content == "plain é text"
    assert got["c.csv"].content == "name | value\nx | 1\ny"
    assert got["d.docx"].content == "Para\n\nA | B"
    assert got["e.pptx"].content == "--- Slide 1 ---\nHello"
    assert got["f.xlsx"].content == "=== Sheet: S1 ===\nTag | 5"
    assert got["g.pdf"].content == "--- Page 1 ---\nHello page"
    assert got["bad.docx"].content is None and got["bad.docx"].error.startswith("BadZipFile")


def test_tables(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    first.write.parquet(f"{path}/v1")
    merged = spark.read.parquet(tables.merge(spark, path, 1, spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), "id"))
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert tables.checksum(merged) == tables.checksum(merged.repartition(3)) != tables.checksum(first)
    journal = spark.createDataFrame([("t1", "START", 1), ("t1", "COMMIT", 2), ("t2", "START", 3), ("t3", "START", 4), ("t3", "ROLLBACK", 5)], "tx_id string, action string, at int")
    assert [r.tx_id for r in tables.unfinished(journal).collect()] == ["t2"]
    cache = spark.createDataFrame([(1, "x", 10), (2, "y", 1)], "k int, value string, expires_at int")
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    assert {r.k: r.value for r in tables.lookup(keys, cache, "k", F.lit(5)).collect()} == {1: "x", 2: None}


def test_stream(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = ingest.stream_documents(spark, f"{tmp_path}/in", "doc_id long, text string, lang string, source string, n_chars long", 2)
    ingest.ingest(stream, "doc_id", "text", f"file://{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    index = LexicalIndex(spark, f"file://{tmp_path}/out")
    assert index.table("chunks").count() == chunking.word_windows(docs, "doc_id", "text").count()
    assert len(index.segments()) == 2 and index.store.manifest()["n_docs"] == docs.count()
