"""From ranked results to prompts, answers and citations.

Prompt texts and messages are parameters of ``Prompts``.  Identifiers are taken out of source texts,
a prefix of sources that fits the budget becomes the prompt, labels in the answer are joined back to metadata.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.text import count_tokens, let, strip, strip_leading_heading, strip_thinking
from tessera.operators import services
from tessera.params import DEFAULTS, Params
from tessera.sources import tables


@dataclass(frozen=True)
class Prompts:
    system: str = (
        "Yalnızca verilen KAYNAK metinlerine dayanarak Türkçe cevap ver. Belge adı, madde numarası, tarih yazma. "
        "Her bilginin ardından kaynağını (KAYNAK 1) biçiminde belirt. […] işareti çıkarılmış bilgidir. Kaynaklar yetmiyorsa söyle."
    )
    example_user: str = "KAYNAK 1:\n[…] (1) Başvuru süresi otuz gündür.\n\nSORU: Başvuru süresi kaç gündür?"
    example_answer: str = "Başvuru süresi otuz gündür (KAYNAK 1)."
    instruction: str = "Kaynaklara dayanarak en fazla 4 cümlelik tek bir düz paragraf yaz ve kaynakları (KAYNAK 1) biçiminde belirt."
    not_found: str = "Sorunuzla ilgili bir hüküm bulunamadı. Soruyu daha belirgin terimlerle yeniden yazın."
    context_exhausted: str = "Bulunan metinler modelin işleyebileceği uzunluğu aşıyor. Soruyu daraltıp yeniden sorun."
    generation_failed: str = "Dil modeline erişilemedi. Soruyu biraz sonra yeniden sorun."
    empty_answer: str = "Model okunabilir bir cevap üretmedi. Soruyu daha kısa biçimde yeniden sorun."


DEFAULT = Prompts()


# What a match of the pattern that holds the first string begins with, in any case that it matches: signs passed over quickly.
_HEADS = {"(?:MADDE|Madde|madde)": "GEMm", "(?:No|Numaras": "KkYyTtSs\u212a\u017f", r"Söz\s+konusu": "BAİIS"}


def _scrubbed(text: Column, pattern: str) -> Column:
    head = next((h for sign, h in _HEADS.items() if sign in pattern), None)
    if head is not None:
        flags, rest = pattern.split(")", 1)
        pattern = f"{flags})(?-i:(?=[{head}]))(?:{rest})"

    def done(t: Column) -> Column:
        return F.regexp_replace(t, pattern, fixed.REDACTED)

    if pattern.endswith(r"\s+madde\w*"):
        return let(text, lambda t: F.when(F.contains(F.lower(t), F.lit("madde")), done(t)).otherwise(t))
    return done(text)


def scrub_context(text: Column, terms: Column | None = None) -> Column:
    """The text without citable identifiers: literal terms (over 3 characters, longest first), then the fixed patterns in order."""
    if terms is not None:
        some = F.filter(F.array_distinct(terms), lambda t: t.isNotNull() & (F.length(t) > 3))
        longest = F.transform(F.array_sort(F.transform(some, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])
        quoted = F.transform(longest, lambda t: F.regexp_replace(t, r"([\\^$.|?*+()\[\]{}])", r"\\$1"))
        text = F.aggregate(quoted, text, lambda a, t: F.regexp_replace(a, F.concat(F.lit("(?iu)"), t), F.lit(fixed.REDACTED)))
    for pattern in fixed.SCRUB:
        text = _scrubbed(text, pattern)
    text = F.regexp_replace(F.regexp_replace(text, fixed.SCRUB_RUN, f"{fixed.REDACTED} "), fixed.SCRUB_SPACE, " ")
    return strip(text)


def render_block(label: Column, text: Column) -> Column:
    return F.concat(F.lit(f"{fixed.LABEL_WORD} "), label, F.lit(":\n"), text)


def question_block(question: Column, prompts: Prompts = DEFAULT) -> Column:
    return F.concat(F.lit("SORU: "), question, F.lit(f"\n\n{prompts.instruction}"))


def preamble_cost(prompts: Prompts = DEFAULT, params: Params = DEFAULTS) -> int:
    parts = (prompts.system, prompts.example_user, prompts.example_answer)
    return sum(int(len(p.split()) * params.measured_tokens_per_word) + 1 + params.tokens_per_message for p in parts)


def available_tokens(question: Column, history: Column | None = None, prompts: Prompts = DEFAULT, params: Params = DEFAULTS) -> Column:
    """What sources may cost: the budget less preamble, question and history (which has no framing of its own)."""
    rest = F.lit(params.context_budget - preamble_cost(prompts, params)) - count_tokens(question_block(question, prompts), params) - params.tokens_per_message
    return rest if history is None else rest - F.when(F.coalesce(history, F.lit("")) != "", count_tokens(history, params)).otherwise(0)


def source_blocks(results: DataFrame, budget: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """query_id, id, label, text, tokens of the sources that fit: the longest run of best ranks within the budget, each whole.

    results: query_id, id, rank, text, document_title, article_ref; budget: query_id, available."""
    cleaned = results.withColumn("text", scrub_context(F.col("text"), F.array("document_title", "article_ref")))
    return fit(cleaned.select("query_id", "id", F.col("rank").alias("label"), "text"), budget, params)


def fit(sources: DataFrame, budget: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The longest run of labels whose summed cost stays within each query's budget.  sources: query_id, id, label, text."""
    cost = count_tokens(render_block(F.col("label"), F.col("text")), params) + params.tokens_per_message
    running = Window.partitionBy("query_id").orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
    rows = sources.withColumn("tokens", cost).withColumn("used", F.sum("tokens").over(running)).join(budget, "query_id")
    return rows.where("used <= available").select("query_id", "id", "label", "text", "tokens")


def build_prompts(blocks: DataFrame, queries: DataFrame, prompts: Prompts = DEFAULT) -> DataFrame:
    """query_id, prompt: system text, example, then sources, history and question as one user turn.  queries: query_id, text, history (optional)."""
    sources = blocks.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", "text"))), lambda b: render_block(b["label"], b["text"])), "\n\n").alias("sources"))
    history = F.nullif(F.col("history"), F.lit("")) if "history" in queries.columns else F.lit(None).cast("string")
    user = F.concat_ws("\n\n", "sources", history, question_block(F.col("text"), prompts))
    head = F.lit("\n\n".join((prompts.system, prompts.example_user, prompts.example_answer)))
    return sources.join(queries, "query_id").select("query_id", F.concat_ws("\n\n", head, user).alias("prompt"))


def parse_labels(answer: Column) -> Column:
    """Distinct label numbers in order of appearance."""
    runs = F.regexp_extract_all(answer, F.lit(fixed.LABEL_RUN), 1)
    return F.array_distinct(F.transform(F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(r"\d+"), 0))), lambda n: n.cast("int")))


def cite(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """query_id, pos, label, id, hallucinated: every label of an answer in order of use; those never supplied have no id.

    answers: query_id, answer; blocks: query_id, label, id."""
    used = answers.select("query_id", F.posexplode(parse_labels(F.col("answer"))).alias("pos", "label"))
    return used.join(blocks.select("query_id", "label", "id"), ["query_id", "label"], "left").withColumn("hallucinated", F.col("id").isNull())


def citation_line(title: Column, path: Column, article: Column, start: Column, end: Column, label: Column | None = None) -> Column:
    """Title / article / pages, with the label before it if given."""
    pages = F.when(end.isNull() | (end == start), F.concat(F.lit("s. "), start)).otherwise(F.concat(F.lit("s. "), start, F.lit("-"), end))
    line = F.concat_ws(" / ", F.coalesce(F.nullif(title, F.lit("")), path), F.nullif(article, F.lit("")), F.when(start.isNotNull(), pages))
    return line if label is None else F.concat(F.lit(f"[{fixed.LABEL_WORD} "), label, F.lit("] "), line)


def answer_all(queries: DataFrame, judged: DataFrame, results: DataFrame, generate: services.Generate, prompts: Prompts = DEFAULT, params: Params = DEFAULTS) -> DataFrame:
    """One row a query: decision, confidence, status, text, labels, citations and counts.

    queries: query_id, text, history (optional); judged: query_id, confidence, decision; results: query_id, id, rank,
    text and metadata.  The model sees only prompts of queries that pass the gate and have a source that fits."""
    results = tables.settle(results)  # a few rows a query, which several plans start from
    asked = queries.join(judged.select("query_id", "confidence", "decision"), "query_id")
    history = F.col("history") if "history" in queries.columns else None
    budget = asked.where("decision <> 'NOT_FOUND'").select("query_id", available_tokens(F.col("text"), history, prompts, params).alias("available"))
    blocks = source_blocks(results, budget, params)
    made = build_prompts(blocks, queries, prompts).withColumn("made", services.generate(F.col("prompt"), generate))
    made = made.select("query_id", count_tokens(F.col("prompt"), params).alias("prompt_tokens"), F.col("made.text").alias("raw"), F.col("made.error").alias("error"))
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved")).join(blocks.groupBy("query_id").agg(F.count(F.lit(1)).alias("used"), F.array_sort(F.collect_list(F.struct("label", "id"))).alias("supplied")), "query_id", "left")
    rows = asked.join(made, "query_id", "left").join(counts, "query_id", "left").withColumn("clean", strip_thinking(F.col("raw")))
    status = (
        F.when(F.col("decision") == "NOT_FOUND", "not_found")
        .when(F.col("prompt_tokens").isNull(), "context_exhausted")
        .when(services.is_context_error(F.coalesce("error", F.lit(""))), "context_exhausted")
        .when(F.col("error").isNotNull(), "generation_failed")
        .when(strip(F.coalesce("clean", F.lit(""))) == "", "empty")
        .otherwise("generated")
    )
    rows = rows.withColumn("status", status)
    text = F.when(F.col("status") == "generated", strip_leading_heading(F.col("clean")))
    for name, message in (("not_found", prompts.not_found), ("context_exhausted", prompts.context_exhausted), ("generation_failed", prompts.generation_failed), ("empty", prompts.empty_answer)):
        text = F.coalesce(text, F.when(F.col("status") == name, message))
    labels = F.when(F.col("status") == "generated", parse_labels(F.col("clean"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("labels", labels)
    cited = F.filter(F.transform("labels", lambda x: F.get(F.filter("supplied", lambda s: s["label"] == x), 0)), lambda s: s.isNotNull())
    return rows.select(
        "query_id", "decision", "confidence", "status", text.alias("text"), (F.col("decision") == "ANSWER_WEAK").alias("low_confidence"), "labels",
        F.coalesce(F.transform(cited, lambda s: s["id"]), F.array()).alias("citations"),
        F.filter("labels", lambda x: ~F.exists(F.coalesce("supplied", F.array()), lambda s: s["label"] == x)).alias("hallucinated_labels"),
        F.coalesce("retrieved", F.lit(0)).alias("chunks_retrieved"), (F.coalesce("retrieved", F.lit(0)) - F.coalesce("used", F.lit(0))).alias("chunks_dropped"), "prompt_tokens",
    )
