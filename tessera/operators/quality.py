"""Page furniture, quality flags and duplicate files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.text import longest_run, looks_like_page_number, occurrences, strip
from tessera.operators.identity import LINE_END
from tessera.params import DEFAULTS, Params


def kept_lines(pages: DataFrame, least_repeats: int | None = None) -> DataFrame:
    """doc_id, number, n, line of the lines that aren't running headers, footers or page numbers.

    A line counts as furniture if it stands among the first or last two of its page, has at most 90
    characters and does so on three fifths of the document's pages (two at least); documents under three
    pages only lose page numbers.  Lines go wherever they stand."""
    lines = pages.select("doc_id", "number", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_END)).alias("n", "line")).withColumn("bare", strip(F.col("line")))
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    full = lines.where("bare <> ''")
    page = Window.partitionBy("doc_id", "number")
    edge = full.withColumns({"up": F.row_number().over(page.orderBy("n")), "down": F.row_number().over(page.orderBy(F.desc("n")))}).where("(up <= 2 OR down <= 2) AND length(bare) <= 90")
    needed = F.lit(least_repeats) if least_repeats is not None else F.greatest(F.lit(2), F.floor(F.col("pages") * 0.6))
    repeated = edge.groupBy("doc_id", "bare").agg(F.count_distinct("number").alias("n")).join(counts, "doc_id").where((F.col("pages") >= 3) & (F.col("n") >= needed)).select("doc_id", "bare")
    return lines.join(repeated, ["doc_id", "bare"], "left_anti").where(~looks_like_page_number(F.col("line")))


def strip_repeating_lines(pages: DataFrame, least_repeats: int | None = None) -> DataFrame:
    """The pages with the kept lines of their text."""
    kept = kept_lines(pages, least_repeats)
    texts = kept.groupBy("doc_id", "number").agg(strip(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")).alias("text"))
    return pages.drop("text").join(texts, ["doc_id", "number"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def text_flags(text: Column, params: Params = DEFAULTS) -> Column:
    """Flags of a text that isn't blank."""
    n = F.length(text)
    bad = occurrences(text, "�")
    marks = F.array_compact(F.array(*(F.when(F.contains(text, F.lit(m)), m) for m in fixed.MOJIBAKE)))
    own = F.regexp_count(text, F.lit(f"[{fixed.TURKISH_LETTERS}]"))
    shown = F.concat(F.lit("['"), F.array_join(F.slice(marks, 1, 3), "', '"), F.lit("']"))
    return F.array_compact(F.array(
        F.when(n < params.least_document_chars, F.concat(F.lit("near-empty: only "), n, F.lit(" chars extracted"))),
        F.when((bad > 0) & (bad / n > params.most_replacement_ratio), F.concat(F.lit("replacement-chars: "), bad, F.lit(" U+FFFD present (bad decode)"))),
        F.when(F.size(marks) > 0, F.concat(F.lit("mojibake: found "), shown, F.lit(" (UTF-8 text decoded as cp1252?)"))),
        F.when(own < params.least_turkish_chars, "no-turkish-chars: 0 of ıİşğüöç in a Turkish document (mis-decoded?)"),
        F.when(longest_run(text) > params.longest_run, F.concat(F.lit("gibberish-run: "), longest_run(text), F.lit(" chars with no whitespace"))),
    ))


def quality_flags(text: Column, pages: Column, params: Params = DEFAULTS) -> Column:
    """All flags of a document; a blank one only tells so, and whether it needs character recognition.

    pages: array<struct<number,text,needs_ocr>>."""
    scans = F.filter(pages, lambda p: p["needs_ocr"])
    blank = F.filter(pages, lambda p: (F.coalesce(p["number"], F.lit(0)) != 0) & (strip(p["text"]) == "") & ~p["needs_ocr"])
    numbers = F.array_join(F.transform(F.slice(scans, 1, 8), lambda p: F.coalesce(p["number"].cast("string"), F.lit("None"))), ", ")
    more = F.when(F.size(scans) > 8, F.concat(F.lit(" (+"), F.size(scans) - 8, F.lit(" more)"))).otherwise("")
    of_pages = F.array_compact(F.array(
        F.when(F.size(scans) > 0, F.concat(F.lit("needs-ocr: "), F.size(scans), F.lit(" page(s) with no text layer: "), numbers, more)),
        F.when(F.size(blank) > 0, F.concat(F.lit("empty-pages: "), F.size(blank), F.lit(" page(s) extracted blank"))),
    ))
    empty = F.array_compact(F.array(
        F.when((F.size(scans) > 0) & (F.size(scans) == F.size(pages)), F.concat(F.lit("needs-ocr: no text layer on any of "), F.size(pages), F.lit(" page(s) - likely a scanned document"))),
        F.lit("empty: no text extracted"),
    ))
    return F.when(strip(text) == "", empty).otherwise(F.concat(text_flags(text, params), of_pages))


def mark_duplicates(files: DataFrame) -> DataFrame:
    """Adds duplicate: among files of equal content that were extracted, all but the first path."""
    order = Window.partitionBy("file_sha256").orderBy("path")
    return files.withColumn("duplicate", F.row_number().over(order) > 1)


def extraction_report(docs: DataFrame) -> DataFrame:
    """kind, value, n: counts by detected type, status, reason and kind of flag.  docs: detected_type, status, reason, flags."""
    flags = docs.select(F.explode("flags").alias("f")).select(F.lit("flag").alias("kind"), F.substring_index("f", ":", 1).alias("value"))
    rows = docs.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("type", "detected_type"), ("status", "status"), ("reason", "reason"))))).alias("r")).select("r.*").where("value IS NOT NULL")
    return rows.unionByName(flags).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
