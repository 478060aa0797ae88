"""Scope of documents and chunks by auditable lexical rules.

Lexicons are parameters; the defaults are fixed values.  All rules are built-in
expressions; a literal containment test runs before each term's pattern.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.text import let, tr_lower

OPENING = 1500


@dataclass(frozen=True)
class Lexicon:
    domain_terms: tuple[str, ...] = fixed.DOMAIN_TERMS
    other_terms: tuple[str, ...] = fixed.OTHER_TERMS
    domain_codes: tuple[str, ...] = tuple(fixed.DOMAIN_CODES)
    other_codes: tuple[str, ...] = tuple(fixed.OTHER_CODES)
    exclusions: tuple[tuple[str, str, str], ...] = fixed.EXCLUSIONS
    omnibus_title: str = fixed.OMNIBUS_TITLE
    omnibus_body: str = fixed.OMNIBUS_BODY
    code: str = fixed.LAW_CODE


DEFAULT = Lexicon()


def manual_exclusion(title: Column, text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """(name, reason) of the first exclusion that fits title or opening, or null."""
    hay = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, OPENING))
    found = [F.when(hay.rlike(p), F.struct(F.lit(n).alias("name"), F.lit(r).alias("reason"))) for n, r, p in lexicon.exclusions]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<name:string,reason:string>")


def is_omnibus(title: Column, text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    return F.coalesce(title.rlike(lexicon.omnibus_title), F.lit(False)) | F.coalesce(F.substring(text, 1, OPENING).rlike(lexicon.omnibus_body), F.lit(False))


def document_scope(title: Column, text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """(disposition, reason): EXCLUDED before OMNIBUS before IN_SCOPE."""

    def judged(e: Column) -> Column:
        out = F.when(e.isNotNull(), F.struct(F.lit("EXCLUDED").alias("disposition"), F.concat(F.lit("manual exclusion: "), e["name"], F.lit(" -- "), e["reason"]).alias("reason")))
        out = out.when(is_omnibus(title, text, lexicon), F.struct(F.lit("OMNIBUS").alias("disposition"), F.lit("omnibus act: articles filtered individually").alias("reason")))
        return out.otherwise(F.struct(F.lit("IN_SCOPE").alias("disposition"), F.lit("single-subject electricity document: indexed whole").alias("reason")))

    return let(manual_exclusion(title, text, lexicon), judged)


def cited_codes(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """(domain, other): distinct codes the text cites, in order of appearance."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(lexicon.code), 1))
    own, other = (F.array(*map(F.lit, c)) for c in (lexicon.domain_codes, lexicon.other_codes))
    return let(found, lambda f: F.struct(F.filter(f, lambda c: F.array_contains(own, c)).alias("domain"), F.filter(f, lambda c: F.array_contains(other, c)).alias("other")))


def hits(lowered: Column, terms: tuple[str, ...]) -> Column:
    """The terms that begin some word of the text, in the lexicon's order."""
    return F.array_compact(F.array(*(F.when(F.contains(lowered, F.lit(t)) & lowered.rlike(r"(?U)\b" + re.sub(r"([^\w\s])", r"\\\1", t)), t) for t in terms)))


def label(n_domain: Column, n_other: Column, domain_codes: Column, other_codes: Column) -> Column:
    """Codes decide first, then which vocabulary is at least twice the other."""
    return (
        F.when((domain_codes > 0) & (other_codes == 0), "ELECTRICITY")
        .when((other_codes > 0) & (domain_codes == 0) & (n_domain == 0), "OFF_DOMAIN")
        .when((n_domain == 0) & (n_other == 0), "OFF_DOMAIN")
        .when(n_other == 0, "ELECTRICITY")
        .when(n_domain == 0, "OFF_DOMAIN")
        .when(n_domain >= 2 * n_other, "ELECTRICITY")
        .when(n_other >= 2 * n_domain, "OFF_DOMAIN")
        .otherwise("AMBIGUOUS")
    )


def classify(rows: DataFrame, lexicon: Lexicon = DEFAULT, *, text_col: str = "text") -> DataFrame:
    """Adds domain_hits, other_hits, domain_codes, other_codes, scope_label, indexable and scope_reason."""
    low = tr_lower(F.col(text_col))
    rows = rows.withColumn("_codes", cited_codes(F.col(text_col), lexicon)).withColumns({"domain_hits": hits(low, lexicon.domain_terms), "other_hits": hits(low, lexicon.other_terms), "domain_codes": F.col("_codes.domain"), "other_codes": F.col("_codes.other")}).drop("_codes")
    rows = rows.withColumn("scope_label", label(F.size("domain_hits"), F.size("other_hits"), F.size("domain_codes"), F.size("other_codes")))
    return rows.withColumns({"indexable": F.col("scope_label") != "OFF_DOMAIN", "scope_reason": reason()})


def reason() -> Column:
    def listed(c: str) -> Column:
        return F.coalesce(F.nullif(F.array_join(F.slice(c, 1, 5), ", "), F.lit("")), F.lit("-"))

    return F.concat_ws(
        " | ", F.col("scope_label"),
        F.when(F.size("domain_codes") > 0, F.concat(F.lit("amends "), F.array_join("domain_codes", "/"), F.lit(" (electricity)"))),
        F.when(F.size("other_codes") > 0, F.concat(F.lit("amends "), F.array_join("other_codes", "/"), F.lit(" (off-domain)"))),
        F.concat(F.lit("elec terms: "), listed("domain_hits")), F.concat(F.lit("off terms: "), listed("other_hits")),
    )


def article_groups(chunks: DataFrame) -> DataFrame:
    """Adds grp: a chunk goes on with the group before it iff that chunk has a reference and this one has none or the same."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    before = F.lag("article_ref").over(order)
    fresh = ~F.coalesce(before.isNotNull() & (F.col("article_ref").isNull() | (F.col("article_ref") == before)), F.lit(False))
    return chunks.withColumn("_fresh", fresh.cast("int")).withColumn("grp", F.sum("_fresh").over(order)).drop("_fresh")


def classify_chunks(chunks: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Verdicts of whole articles, on each of their chunks.  chunks: doc_id, chunk_index, article_ref, text."""
    grouped = article_groups(chunks)
    texts = grouped.groupBy("doc_id", "grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("article"))
    verdicts = classify(texts, lexicon, text_col="article").drop("article")
    return grouped.join(verdicts, ["doc_id", "grp"]).drop("grp")


def scope_chunks(chunks: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Adds disposition, scope_label (null: never judged) and indexable.  chunks: doc_id, document_title, chunk_index, article_ref, text.

    A document is judged by its title and its first two chunks; only omnibus documents are judged by article."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    opening = chunks.withColumn("_n", F.row_number().over(order)).where("_n <= 2").groupBy("doc_id").agg(F.max("document_title").alias("document_title"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("opening"))
    scopes = opening.select("doc_id", document_scope(F.col("document_title"), F.col("opening"), lexicon).alias("s")).select("doc_id", "s.disposition", F.col("s.reason").alias("disposition_reason"))
    placed = chunks.join(scopes, "doc_id")
    omnibus = classify_chunks(placed.where("disposition = 'OMNIBUS'"), lexicon)
    others = placed.where("disposition <> 'OMNIBUS'").withColumns({"scope_label": F.when(F.col("disposition") == "EXCLUDED", "OFF_DOMAIN"), "indexable": F.col("disposition") != "EXCLUDED"})
    return omnibus.unionByName(others, allowMissingColumns=True)


def scoped_out(scopes: DataFrame) -> DataFrame:
    """Documents that aren't indexed whole: what a dry run would touch."""
    return scopes.where("disposition <> 'IN_SCOPE'")
