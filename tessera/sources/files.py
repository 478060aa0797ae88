"""Files of any kind to documents: scan, sniff, hash, extract, flag.

Word documents are read here; types that need an outside converter (old Word, PDF) go to a
``Converter`` if one is given and fail with a reason otherwise.  Nothing raises for a single bad file.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import ascii_only, normalize_text, strip, tr_lower
from tessera.operators.chunking import document_text
from tessera.operators.quality import mark_duplicates, quality_flags, strip_repeating_lines
from tessera.params import DEFAULTS, Params

PROBE = 8 * 1024 * 1024
EXTRACTABLE = ("doc", "docx", "pdf")
PAGES = "array<struct<number:int,text:string,needs_ocr:boolean>>"
# bytes and detected type to pages (number or None, text); raises if it can't.
Converter = Callable[[bytes, str], list[tuple[int | None, str]]]


def scan(spark: SparkSession, root: str, *, paths: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """path, length, content of every file below root, or of the given paths alone; with a limit the first ones by path.

    Spark's file listing passes over empty files."""

    def listed(at: str | list[str]) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at).select("path", "length", "content")

    rows = listed(root if paths is None else paths) if paths is None or paths else listed(root).limit(0)
    if limit is not None:
        first = [r.path for r in rows.select("path").orderBy("path").limit(limit).collect()]
        rows = listed(first) if first else rows.limit(0)
    return rows


def _wide(name: str) -> Column:
    """A stream name as it stands in an OLE2 directory: UTF-16 without a last zero byte."""
    return F.unhex(F.lit(name.encode("utf-16-le")[:-1].hex()))


def zip_kind(content: Column) -> Column:
    """docx, xlsx, pptx or zip by member names; an unreadable archive is zip."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for blob in column.to_pylist():
            kind = "zip"
            if blob is not None:
                try:
                    names = zipfile.ZipFile(io.BytesIO(blob)).namelist()
                    kind = next((k for prefix, k in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx")) if any(n.startswith(prefix) for n in names)), "zip")
                except (zipfile.BadZipFile, OSError, ValueError):
                    pass
            out.append(kind)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(content)


def sniff(content: Column) -> Column:
    """The type by leading bytes, whatever the name says; zip archives are still just ``zip``."""
    head = F.substring(content, 1, 8)
    probe = F.substring(content, 1, PROBE)

    def opens(hexed: str) -> Column:
        return F.startswith(head, F.unhex(F.lit(hexed)))

    ole = F.when(F.contains(probe, _wide("WordDocument")), "doc").when(F.contains(probe, _wide("Workbook")) | F.contains(probe, _wide("Book")), "xls").when(F.contains(probe, _wide("PowerPoint")), "ppt").otherwise("doc")
    low = tr_lower(F.decode(head, "ISO-8859-1"))
    return (
        F.when(F.octet_length(content) == 0, "empty")
        .when(opens("25504446"), "pdf")
        .when(opens("7B5C727466"), "rtf")
        .when(opens("D0CF11E0"), ole)
        .when(opens("504B0304"), "zip")
        .when(low.startswith("<html") | low.startswith("<!doc"), "html")
        .otherwise(F.concat(F.lit("unknown:"), F.lower(F.hex(F.substring(content, 1, 4)))))
    )


def detect_type(content: Column) -> Column:
    """``sniff``, with archives looked into; only they go through Python."""
    kind = sniff(content)
    return F.when(kind == "zip", zip_kind(F.when(kind == "zip", content))).otherwise(kind)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.substring_index(path, "/", -1)), r"(?<=.)\.[^.]*$", "")


def make_doc_id(path: Column, sha: Column) -> Column:
    """Twelve digits of the hash and a readable name of at most 48 characters."""
    slug = F.regexp_replace(tr_lower(ascii_only(file_stem(path))), r"[^\p{L}\p{N}]+", "-")
    slug = F.regexp_replace(F.substring(F.regexp_replace(slug, "^-+|-+$", ""), 1, 48), "^-+|-+$", "")
    return F.concat_ws("-", F.substring(sha, 1, 12), F.nullif(slug, F.lit("")))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(blob: bytes) -> str:
    """Paragraphs and tables in body order; cells of a row a tab apart, neighbouring equal cells once."""

    def paragraph(node) -> str:
        out = []
        for x in node.iter():
            out.append(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else "")
        return "".join(out)

    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(blob)).read("word/document.xml")).find(f"{_W}body")
    lines = []
    for node in body:
        if node.tag == f"{_W}p":
            lines.append(paragraph(node))
        elif node.tag == f"{_W}tbl":
            for row in node.iter(f"{_W}tr"):
                cells: list[str] = []
                for cell in row.findall(f"{_W}tc"):
                    text = "\n".join(paragraph(p) for p in cell.iter(f"{_W}p")).strip()
                    if text and (not cells or cells[-1] != text):
                        cells.append(text)
                if cells:
                    lines.append("\t".join(cells))
    return "\n".join(lines)


def raw_pages(content: Column, kind: Column, convert: Converter | None = None, params: Params = DEFAULTS) -> Column:
    """(pages, error) of extractable files."""
    least = params.least_page_chars

    def run(blobs: pa.Array, kinds: pa.Array) -> pa.Array:
        pages, errors = [], []
        for blob, k in zip(blobs.to_pylist(), kinds.to_pylist()):
            found = error = None
            if blob is not None and k in EXTRACTABLE:
                try:
                    if k == "docx":
                        found = [(None, docx_text(blob))]
                    elif convert is not None:
                        found = convert(blob, k)
                    else:
                        error = f"no converter for {k}"
                except Exception as e:  # one bad file is a row's reason, not the job's end
                    error = f"{type(e).__name__}: {e}"
            pages.append(None if found is None else [{"number": n, "text": t, "needs_ocr": n is not None and len(t.strip()) < least} for n, t in found])
            errors.append(error)
        kind_of = pa.list_(pa.struct([("number", pa.int32()), ("text", pa.string()), ("needs_ocr", pa.bool_())]))
        return pa.StructArray.from_arrays([pa.array(pages, kind_of), pa.array(errors, pa.string())], names=["pages", "error"])

    return F.arrow_udf(run, f"struct<pages:{PAGES},error:string>")(content, kind)


def extract(files: DataFrame, convert: Converter | None = None, params: Params = DEFAULTS) -> DataFrame:
    """One row a file: doc_id, path, file_sha256, detected_type, status (ok, skipped, failed, duplicate), reason, pages, text, page_note, flags."""
    rows = files.select("path", F.sha2("content", 256).alias("file_sha256"), detect_type(F.col("content")).alias("detected_type"), "content")
    rows = rows.withColumn("doc_id", make_doc_id(F.col("path"), F.col("file_sha256")))
    wanted = F.col("detected_type").isin(*EXTRACTABLE)
    rows = rows.withColumn("got", raw_pages(F.when(wanted, F.col("content")), F.col("detected_type"), convert, params)).drop("content")
    good = rows.where("got.pages IS NOT NULL")
    pages = good.select(F.col("path").alias("doc_id"), F.posexplode("got.pages").alias("_n", "p")).select("doc_id", F.col("_n").alias("number"), F.col("p.number").alias("page"), "p.text", "p.needs_ocr")
    clean = strip_repeating_lines(pages).withColumn("text", normalize_text(F.col("text")))
    joined = clean.groupBy(F.col("doc_id").alias("path")).agg(F.transform(F.sort_array(F.collect_list(F.struct("number", F.struct(F.col("page").alias("number"), "text", "needs_ocr").alias("p")))), lambda x: x["p"]).alias("pages"))
    rows = rows.join(joined, "path", "left").withColumn("text", document_text(F.col("pages")))
    seen = mark_duplicates(rows.where("pages IS NOT NULL").select("path", "file_sha256")).select("path", "duplicate")
    rows = rows.join(seen, "path", "left")
    status = F.when(~F.col("detected_type").isin(*EXTRACTABLE), "skipped").when(F.col("pages").isNull(), "failed").when(F.col("duplicate"), "duplicate").otherwise("ok")
    reason = F.when(~F.col("detected_type").isin(*EXTRACTABLE), F.concat(F.lit("not a text document: "), F.col("detected_type"))).otherwise(F.col("got.error"))
    note = F.when(F.exists("pages", lambda p: p["number"].isNotNull()), F.lit(None).cast("string")).otherwise(F.lit("no page model for this format"))
    flags = F.when(F.col("pages").isNotNull(), quality_flags(F.col("text"), F.col("pages"), params)).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", "path", "file_sha256", "detected_type", status.alias("status"), reason.alias("reason"), "pages", "text", note.alias("page_note"), flags.alias("flags"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text: the lines of a text file but blank ones and comments."""
    rows = spark.read.text(path).select(strip(F.col("value")).alias("text")).where("text <> '' AND NOT startswith(text, '#')")
    return rows.select(F.monotonically_increasing_id().alias("query_id"), "text")


MANIFEST = "title string, document_group string, category string, version_label string, version_kind string, rg_date string, rg_number string, is_mulga boolean, is_current boolean, source_url string, local_path string"


def read_manifest(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Entries of one JSON array, or, with ``lines``, of what ``write_manifest`` wrote."""
    return spark.read.schema(MANIFEST).option("multiLine", not lines).json(path)


def write_manifest(entries: DataFrame, path: str) -> None:
    """Adds entries, one JSON object a line; columns beyond the manifest's stay out, missing ones are null."""
    fields = [f.strip().split(" ") for f in MANIFEST.split(",")]
    entries.select(*((F.col(n) if n in entries.columns else F.lit(None)).cast(t).alias(n) for n, t in fields)).write.mode("append").json(path)


def new_entries(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Entries whose source_url the manifest doesn't have yet."""
    return found.join(manifest.select("source_url"), "source_url", "left_anti")
