"""Identity of a document from its text: title, type, number, gazette reference, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.text import WS, U, let, strip, tr_lower, tr_upper

HEAD_CHARS = 4000
HEAD_LINES = 40
TITLE_LINES = 20
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"


def head_lines(text: Column) -> Column:
    """The first lines with text, stripped."""
    lines = F.transform(F.split(F.substring(text, 1, HEAD_CHARS), LINE_END), strip)
    return F.slice(F.filter(lines, lambda x: x != ""), 1, HEAD_LINES)


def is_title_like(line: Column, least: int = 12) -> Column:
    """Long enough, not a preamble, mostly capital letters."""
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    capitals = letters - F.regexp_count(line, F.lit(r"\p{Ll}")) + F.when(tr_upper(line) == line, F.regexp_count(line, F.lit(r"\p{Ll}"))).otherwise(0)
    return F.length(line).between(least, 300) & ~line.rlike(fixed.PREAMBLE) & (letters >= max(3, min(8, least))) & (capitals / letters >= 0.75)


def marker_type(line: Column) -> Column:
    """The type that a line names by itself, or null."""
    table = F.create_map(*(F.lit(x) for pair in fixed.TYPE_MARKERS.items() for x in pair))
    return F.try_element_at(table, F.regexp_replace(tr_lower(line), r"\A[ :.\-–—]+|[ :.\-–—]+\z", ""))


def clean_title_line(line: Column) -> Column:
    """Without an issuer before the title and fields after it."""
    body = strip(F.regexp_replace(line, fixed.ISSUER, ""))
    body = strip(F.get(F.split(body, fixed.TRAILING_FIELD, 2), 0))
    return F.regexp_replace(F.regexp_replace(body, rf"{U}{WS}+", " "), r"\A[ .;:,]+|[ .;:,]+\z", "")


def title(lines: Column) -> Column:
    """(title, how): the first title-like line and up to three that continue it.

    Lines are judged once; a fold then joins continuations until one ends the heading."""
    judged = F.transform(lines, lambda x: let(clean_title_line(x), lambda c: F.struct(
        c.alias("clean"), (c != x).alias("cut"), (marker_type(x).isNotNull() | x.rlike(fixed.GAZETTE_LINE)).alias("skip"),
        ((c != "") & is_title_like(c, 12)).alias("opens"), ((c != "") & is_title_like(c, 4)).alias("goes_on"),
    )))

    def joined(rows: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.least(F.size(rows), F.lit(TITLE_LINES))), lambda i: ~F.element_at(rows, i)["skip"] & F.element_at(rows, i)["opens"])
        first = F.when(F.size(rows) > 0, F.get(starts, 0))

        def from_first(i: Column) -> Column:
            head = F.element_at(rows, i)

            def step(state: Column, row: Column) -> Column:
                takes = ~state["over"] & ~row["skip"] & row["goes_on"]
                text = F.when(takes, F.concat(state["text"], F.lit(" "), row["clean"])).otherwise(state["text"])
                return F.struct(text.alias("text"), (state["over"] | ~takes | row["cut"] | (F.length(text) > 260)).alias("over"))

            whole = F.aggregate(F.slice(rows, i + 1, 3), F.struct(head["clean"].alias("text"), head["cut"].alias("over")), step, lambda s: s["text"])
            neat = F.regexp_replace(F.regexp_replace(whole, rf"{U}{WS}+", " "), r"\A[ .;:]+|[ .;:]+\z", "")
            return F.struct(neat.alias("title"), F.when(head["cut"], "heading recovered from mixed line").otherwise("uppercase heading").alias("how"))

        none = F.struct(F.lit(None).cast("string").alias("title"), F.lit("no uppercase heading found").alias("how"))
        return F.when(first.isNotNull(), let(F.coalesce(first, F.lit(1)), from_first)).otherwise(none)

    return let(judged, joined)


def document_type(name: Column, lines: Column) -> Column:
    """From the last type word near the title's end, else a marker line, else any type word in the title."""
    low = tr_lower(name)
    cases = []
    for pattern, kind in fixed.TITLE_TYPES:
        found = F.regexp_extract_all(low, F.lit(pattern), 0)
        last = F.try_element_at(found, F.lit(-1))
        # What a greedy run leaves before the last match is as long as that match's place.
        before = F.regexp_extract(low, rf"(?sU)\A(.*){pattern.removeprefix('(?U)')}", 1)
        cases.append(F.when(last.isNotNull() & (F.length(before) >= F.length(low) - 60), kind))
    marked = F.get(F.filter(F.transform(F.slice(lines, 1, 12), marker_type), lambda m: m.isNotNull()), 0)
    held = [F.when(F.contains(low, F.lit(word)), kind) for word, kind in fixed.CONTAINED_TYPES]
    return F.coalesce(*cases, marked, *held)


def iso_date(raw: Column) -> Column:
    parts = F.split(raw, "[./]")
    day, month, year = (F.get(parts, i).try_cast("int") for i in range(3))
    good = (F.size(parts) == 3) & month.between(1, 12) & day.between(1, 31) & year.between(1900, 2100)
    return F.when(good, F.format_string("%04d-%02d-%02d", year, month, day))


def gazette(text: Column) -> Column:
    """(date, number) of the gazette reference in the head: field, inline or banner form."""
    head = F.substring(text, 1, HEAD_CHARS)
    by_field, inline = (F.struct(iso_date(F.regexp_extract(head, p, 1)).alias("date"), F.regexp_extract(head, p, 2).alias("number")) for p in (fixed.GAZETTE_FIELD, fixed.GAZETTE_INLINE))
    day, month, year, number = (F.regexp_extract(head, fixed.GAZETTE_BANNER, i) for i in range(1, 5))
    months = F.create_map(*(F.lit(x) for i, m in enumerate(fixed.MONTHS, 1) for x in (m, i)))
    at = F.try_element_at(months, tr_lower(month))
    banner = F.struct(F.when(at.isNotNull(), F.format_string("%04d-%02d-%02d", year.try_cast("int"), at, day.try_cast("int"))).alias("date"), number.alias("number"))
    none = F.struct(F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("number"))
    return F.when(head.rlike(fixed.GAZETTE_FIELD), by_field).when(head.rlike(fixed.GAZETTE_INLINE), inline).when(head.rlike(fixed.GAZETTE_BANNER), banner).otherwise(none)


def number(text: Column) -> Column:
    head = F.substring(text, 1, HEAD_CHARS)
    found = [F.when(head.rlike(p), F.regexp_replace(F.regexp_extract(head, p, 1), r"\A[ .:\-]+|[ .:\-]+\z", "")) for p in fixed.NUMBERS]
    return F.coalesce(*found)


def identify(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Adds title, mevzuat_type, number, rg_date (ISO text), rg_number, confidence and identity_flags."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank = strip(text) == ""
    rows = docs.withColumn("_lines", head_lines(text)).withColumn("_title", title(F.col("_lines"))).withColumn("_rg", gazette(text))
    rows = rows.withColumns({
        "title": F.when(~blank, F.col("_title.title")), "mevzuat_type": F.when(~blank, document_type(F.col("_title.title"), F.col("_lines"))),
        "number": F.when(~blank, number(text)), "rg_date": F.when(~blank, F.col("_rg.date")), "rg_number": F.when(~blank, F.col("_rg.number")),
    })
    have = {c: F.coalesce(F.col(c) != "", F.lit(False)) for c in ("title", "mevzuat_type", "number", "rg_number")}
    signals = sum((h.cast("int") for h in have.values()), F.lit(0))
    sure = F.when(~have["title"], "none").when(signals >= 3, "high").when(signals >= 2, "medium").otherwise("low")
    flags = F.array_compact(F.array(
        F.when(~have["title"], F.concat(F.lit("title-missing: "), F.col("_title.how"))),
        F.when(~have["mevzuat_type"], "mevzuat-type-unknown: no type word in title or marker line"),
        F.when(~have["number"], "number-missing: no 'Kanun No'/'Karar No' field found"),
        F.when(~have["rg_number"], "rg-missing: no Resmî Gazete reference found"),
        F.when(sure == "low", "title-low-confidence: title found but no corroborating metadata"),
    ))
    none = F.array(F.lit("title: document has no text to derive identity from"))
    return rows.withColumns({"confidence": sure, "identity_flags": F.when(blank, none).otherwise(flags)}).drop("_lines", "_title", "_rg")
