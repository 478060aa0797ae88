"""Documents to chunks: articles, their items, or overlapping word windows.

Everything is built-in expressions over one row a document; chunk_index comes from
the chunk array itself, so no shuffle is needed to number chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.text import WS, U, estimate_tokens, let, strip, tr_lower, words
from tessera.params import DEFAULTS, Params

MARK = "\ue000"  # private use; taken out of texts first
PIECE = "array<struct<strategy:string,text:string,kind:string,number:string,start:int,end:int>>"


def document_text(pages: Column) -> Column:
    """Pages that aren't blank, a blank line apart."""
    return F.array_join(F.transform(F.filter(pages, lambda p: strip(p["text"]) != ""), lambda p: p["text"]), "\n\n")


def canonical_kind(raw: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in fixed.ARTICLE_KINDS.items() for x in pair))
    return F.coalesce(F.try_element_at(kinds, strip(F.regexp_replace(tr_lower(raw), rf"{U}{WS}+", " "))), F.lit("MADDE"))


def find_articles(text: Column) -> Column:
    """Array of (text, kind, number, start, end): the text before the first heading, with a null kind, then every article."""
    parts = F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit("")), f"({fixed.ARTICLE})", f"{MARK}$1"), MARK)

    def with_bounds(p: Column) -> Column:
        ends = F.aggregate(p, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
        return let(ends, lambda e: F.transform(p, lambda x, i: article(x, i, e)))

    def article(x: Column, i: Column, e: Column) -> Column:
        number = F.regexp_replace(strip(F.regexp_extract(x, fixed.ARTICLE, 2)), rf"{U}{WS}*/{WS}*", "/")
        return F.struct(
            x.alias("text"),
            F.when(i > 0, canonical_kind(F.regexp_extract(x, fixed.ARTICLE, 1))).alias("kind"),
            F.when(i > 0, number).alias("number"),
            F.get(e, i).alias("start"),
            F.get(e, i + 1).alias("end"),
        )

    return let(parts, with_bounds)


def split_items(text: Column) -> Column:
    """An article cut at its numbered or lettered items; whole if it has fewer than two."""
    parts = F.split(F.regexp_replace(text, f"({fixed.ITEM})", f"{MARK}$1"), MARK)
    return let(parts, lambda p: F.when(F.size(p) < 3, F.array(text)).otherwise(F.filter(F.transform(p, strip), lambda x: x != "")))


def token_windows(text: Column, params: Params = DEFAULTS) -> Column:
    """Overlapping runs of words; the last one ends with the text, no words give none."""
    width = max(1, int(params.chunk_tokens / params.tokens_per_word))
    step = max(1, width - int(params.chunk_overlap / params.tokens_per_word))

    def windows(w: Column) -> Column:
        last = F.ceil(F.greatest(F.size(w) - width, F.lit(0)) / step).cast("int") * step
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: F.array_join(F.slice(w, s + 1, F.lit(width)), " "))).otherwise(F.array().cast("array<string>"))

    return let(words(text), windows)


def pack(parts: Column, params: Params = DEFAULTS) -> Column:
    """Neighbouring parts joined by line feeds while their estimate stays within a chunk."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, part: Column) -> Column:
        joined = F.when(state["open"] != "", F.concat(state["open"], F.lit("\n"), part)).otherwise(part)
        full = (state["open"] != "") & (estimate_tokens(joined, params) > params.chunk_tokens)
        return F.struct(F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"), F.when(full, part).otherwise(joined).alias("open"))

    return F.aggregate(parts, start, add, lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def page_span(pages: Column, start: Column, end: Column) -> Column:
    """First and last page number that characters start..end of the document text touch."""
    full = F.filter(pages, lambda p: strip(p["text"]) != "")

    def spans(f: Column) -> Column:
        ends = F.aggregate(f, F.array(F.lit(-2)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + 2 + F.length(p["text"]))))
        places = let(ends, lambda e: F.transform(f, lambda p, i: F.struct(p["number"].alias("number"), (F.get(e, i) + 2).alias("a"), F.get(e, i + 1).alias("b"))))
        return F.filter(places, lambda s: (s["a"] < end) & (s["b"] > start))

    return let(let(full, spans), lambda s: F.struct(F.get(s, 0)["number"].alias("first"), F.try_element_at(s, F.lit(-1))["number"].alias("last")))


def _pieces(texts: Column, strategy: str, kind: Column, number: Column, start: Column, end: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(F.lit(strategy).alias("strategy"), t.alias("text"), kind.alias("kind"), number.alias("number"), start.alias("start"), end.alias("end"))).cast(PIECE)


def pieces(text: Column, params: Params = DEFAULTS) -> Column:
    """The chunks of a document, in order, by the cascade of strategies."""
    none = F.lit(None).cast("string")
    size = params.chunk_tokens

    def lead(a: Column) -> Column:
        body = strip(a["text"])
        return F.when(estimate_tokens(body, params) > params.least_lead_tokens, _pieces(token_windows(body, params), "preamble", none, none, F.lit(0), a["end"])).otherwise(F.array().cast(PIECE))

    def article(a: Column) -> Column:
        def of_body(body: Column) -> Column:
            def made(texts: Column, strategy: str) -> Column:
                return _pieces(texts, strategy, a["kind"], a["number"], a["start"], a["end"])

            def of_parts(parts: Column) -> Column:
                each = F.transform(parts, lambda p: F.when(estimate_tokens(p, params) <= size, made(F.array(p), "article-sub")).otherwise(made(token_windows(p, params), "article-window")))
                return F.when(F.size(parts) > 1, F.flatten(each)).otherwise(made(token_windows(body, params), "article-window"))

            return (
                F.when(body == "", F.array().cast(PIECE))
                .when(estimate_tokens(body, params) <= size, made(F.array(body), "article"))
                .otherwise(let(pack(split_items(body), params), of_parts))
            )

        return let(strip(a["text"]), of_body)

    def cascade(found: Column) -> Column:
        plain = _pieces(token_windows(text, params), "token-window", none, none, F.lit(0), F.length(text))
        listed = F.flatten(F.transform(found, lambda a: F.when(a["kind"].isNull(), lead(a)).otherwise(article(a))))
        return F.when(F.size(found) == 1, plain).otherwise(listed)

    return let(find_articles(text), cascade)


def chunk_documents(docs: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One row a chunk.  docs: doc_id, title, page_note, pages array<struct<number,text,...>>.

    chunk_index counts before blank chunks are dropped.  page_note tells why pages are missing, where they are."""
    base = docs.withColumn("document", document_text(F.col("pages"))).where(strip(F.col("document")) != "")
    has_pages = F.exists("pages", lambda p: p["number"].isNotNull())
    rows = base.select("doc_id", "title", "page_note", "pages", has_pages.alias("paged"), F.posexplode(pieces(F.col("document"), params)).alias("chunk_index", "c"))
    rows = rows.withColumn("span", F.when(F.col("paged"), page_span(F.col("pages"), F.col("c.start"), F.col("c.end"))))
    note = F.when(F.col("span.first").isNull() & ~F.col("paged"), F.coalesce("page_note", F.lit("no page model for this format")))
    out = rows.select(
        "doc_id", "chunk_index", strip(F.col("c.text")).alias("text"), F.col("c.strategy").alias("strategy"),
        F.when(F.col("c.kind").isNotNull(), F.concat_ws(" ", "c.kind", "c.number")).alias("article_ref"),
        F.col("title").alias("document_title"), F.col("span.first").alias("page_start"), F.col("span.last").alias("page_end"),
        note.alias("page_note"), estimate_tokens(F.col("c.text"), params).alias("token_estimate"),
    )
    return out.where(F.col("text") != "")


def _pages(start: Column, end: Column, open_end: bool) -> Column:
    same = (end == start) | (end.isNull() if open_end else F.lit(False))
    shown = F.coalesce(end.cast("string"), F.lit("None"))
    return F.when(same, F.concat(F.lit("s. "), start)).otherwise(F.concat(F.lit("s. "), start, F.lit("-"), shown))


def chunk_citation(title: Column, doc_id: Column, article: Column, start: Column, end: Column) -> Column:
    """Title - article (pages), as a chunk names itself."""
    return F.concat(F.coalesce(F.nullif(title, F.lit("")), doc_id), F.when(article.isNotNull(), F.concat(F.lit(" - "), article)).otherwise(""), F.when(F.coalesce(start, F.lit(0)) != 0, F.concat(F.lit(" ("), _pages(start, end, False), F.lit(")"))).otherwise(""))


