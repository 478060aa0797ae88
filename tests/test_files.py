import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import files
from tessera.streaming.ingest import stream_ingest
from tessera.operators import services, store


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
CELL = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
DOCX = archive(word__document_xml=f"<w:document {W}><w:body><w:p><w:r><w:t>ELEKTRİK PİYASASI YÖNETMELİĞİ</w:t></w:r></w:p><w:p><w:r><w:t>MADDE 1 – Önlisans süresi otuz aydır.</w:t></w:r></w:p><w:tbl><w:tr>{CELL.format('a')}{CELL.format('a')}{CELL.format('b')}</w:tr></w:tbl></w:body></w:document>")
OLE = b"\xd0\xcf\x11\xe0" + b"\0" * 600
BLOBS = {
    "a.docx": (DOCX, "docx"),
    "copy.docx": (DOCX, "docx"),
    "b.bin": (b"%PDF-1.7", "pdf"),
    "c.doc": (b"{\\rtf1", "rtf"),
    "d.doc": (OLE + "WordDocument".encode("utf-16-le"), "doc"),
    "e.doc": (OLE + "Workbook".encode("utf-16-le"), "xls"),
    "f.doc": (OLE + "PowerPoint".encode("utf-16-le"), "ppt"),
    "g.doc": (OLE, "doc"),
    "h.x": (archive(xl__a="1"), "xlsx"),
    "i.x": (archive(ppt__a="1"), "pptx"),
    "j.x": (archive(other="1"), "zip"),
    "k.x": (b"PK\x03\x04broken", "zip"),
    "l.pdf": (b"<HTML><body>", "html"),
    "m.pdf": (b"<!DOCTYPE html>", "html"),
    "o.pdf": (b" <html>", "unknown:203c6874"),
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "raw/sub").mkdir(parents=True)
    for name, (blob, _) in BLOBS.items():
        (tmp_path / "raw/sub" / name).write_bytes(blob)
    return str(tmp_path / "raw")


def test_types_and_extraction(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.extract(files.scan(spark, folder)).collect()}
    assert {k: r.detected_type for k, r in rows.items()} == {k: t for k, (_, t) in BLOBS.items()}
    assert rows["a.docx"].status == "ok" and rows["copy.docx"].status == "duplicate"
    assert rows["a.docx"].text == "ELEKTRİK PİYASASI YÖNETMELİĞİ\nMADDE 1 – Önlisans süresi otuz aydır.\na\tb"
    assert rows["b.bin"].status == "failed" and "no converter" in rows["b.bin"].reason
    assert rows["h.x"].status == "skipped" and rows["a.docx"].doc_id.endswith("-a")


def test_empty_content(spark):
    assert spark.createDataFrame([(bytearray(b""),)], "c binary").select(files.detect_type(F.col("c")).alias("k")).first()["k"] == "empty"


def test_converter_and_bad_files(spark, folder):
    def convert(blob, kind):
        if kind == "doc":
            raise OSError("bad")
        return [(1, "uzun bir sayfa metni burada duruyor, evet"), (2, "kısa")]

    rows = {r.path.rsplit("/", 1)[1]: r for r in files.extract(files.scan(spark, folder), convert).collect()}
    assert [(p.number, p.needs_ocr) for p in rows["b.bin"].pages] == [(1, False), (2, True)]
    assert rows["d.doc"].status == "failed" and "bad" in rows["d.doc"].reason


def test_questions_and_manifest(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# yorum\n\nSoru bir?\n  Soru iki?  \n")
    assert [r.text for r in files.read_questions(spark, str(tmp_path / "q.txt")).collect()] == ["Soru bir?", "Soru iki?"]
    (tmp_path / "m.json").write_text('[{"source_url": "u1", "title": "t"}]')
    have = files.read_manifest(spark, str(tmp_path / "m.json"))
    found = spark.createDataFrame([("u1",), ("u2",)], "source_url string")
    assert [r.source_url for r in files.new_entries(found, have).collect()] == ["u2"]
    kept = str(tmp_path / "kept")
    for part in (have, files.new_entries(found, have).withColumn("extra", F.lit(1))):
        files.write_manifest(part, kept)
    assert {(r.source_url, r.title) for r in files.read_manifest(spark, kept, lines=True).collect()} == {("u1", "t"), ("u2", None)}


def test_scan_of_some(spark, folder):
    every = sorted(r.path for r in files.scan(spark, folder).collect())
    assert sorted(r.path for r in files.scan(spark, folder, limit=2).collect()) == every[:2] and files.scan(spark, folder, limit=0).count() == 0
    assert [r.path for r in files.scan(spark, folder, paths=every[1:2]).collect()] == every[1:2] and files.scan(spark, folder, paths=[]).count() == 0


def test_stream(spark, folder, tmp_path):
    root = str(tmp_path / "store")
    for _ in range(2):
        stream_ingest(spark, folder, root, str(tmp_path / "cp"), services.hashing_embedder()).awaitTermination()
    assert store.read_snapshot(spark, root).where("active").select("article_ref").distinct().count() >= 1


def test_doc_ids(spark):
    row = spark.createDataFrame([("file:/x/Çok%20Uzun%20Ad.v2.pdf", "0123456789abcdef")], "p string, s string")
    assert row.select(files.make_doc_id(F.col("p"), F.col("s")).alias("i")).first()["i"] == "0123456789ab-cok-uzun-ad-v2"
