"""Bounded conversations: follow-ups, rewrites, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.text import WS, U, clean_rewrite, count_tokens, folded_words, let, strip_labels, tokenize
from tessera.params import DEFAULTS, Params


def looks_like_follow_up(question: Column) -> Column:
    """Any word that points back, or too few content words to have a topic; without words no."""
    markers = F.array(*map(F.lit, fixed.FOLLOW_UP))
    return let(folded_words(question), lambda w: (F.size(w) > 0) & (F.arrays_overlap(w, markers) | (F.size(tokenize(question)) <= fixed.FEW_CONTENT_WORDS)))


def rewrite_accepted(question: Column, candidate: Column) -> Column:
    """Whether a cleaned candidate is one standalone question, not a fresh-topic sign, an answer or a comment."""
    folded = F.regexp_replace(F.upper(F.replace(candidate, F.lit("I"), F.lit("İ"))), r"[.!? ]+\z", "")
    fresh = folded.startswith(fixed.FRESH) | folded.startswith("YENI")
    long = F.length(candidate) > F.greatest(F.lit(240), F.length(question) * 6)
    return (candidate != "") & ~fresh & F.contains(candidate, F.lit("?")) & ~candidate.rlike(fixed.ANSWER_SHAPED) & ~long


REWRITE_TASK = (
    "Bir sohbetin son sorusunu, sohbeti görmeyen biri de anlasın diye tek satırlık bağımsız bir soruya çevir; soruya cevap verme. "
    "Eksik konuyu yalnızca verilen konuşmadan al. Soru zaten bağımsızsa yalnızca YENİ yaz."
)
REWRITE_EXAMPLES = (
    ("Kullanıcı: Sayaç kontrolü kaç yılda bir yapılır?\nAsistan: Sayaç kontrolü on yılda bir yapılır.", "peki kim yapar?", "Sayaç kontrolünü kim yapar?"),
    ("Kullanıcı: Bağlantı başvurusu nereye yapılır?\nAsistan: Bağlantı başvurusu dağıtım şirketine yapılır.", "bunun için ücret alınır mı?", "Bağlantı başvurusu için ücret alınır mı?"),
)


def rewrite_prompt(history: Column, question: Column) -> Column:
    """The task, two worked examples, then the conversation (as ``history`` gives it), the last question and the task again."""
    shown = "".join(f"[Önceki tur]\n{said}\n\nSON SORU: {asked}\n\n{wanted}\n\n" for said, asked, wanted in REWRITE_EXAMPLES)
    return F.concat(F.lit(f"{REWRITE_TASK}\n\n{shown}"), history, F.lit("\n\nSON SORU: "), question, F.lit(f"\n\n{REWRITE_TASK}"))


def rewrite(question: Column, has_turns: Column, raw: Column) -> Column:
    """(query, was_follow_up): what to search for.  raw: the model's text, null if it wasn't asked or failed."""

    def judged(candidate: Column) -> Column:
        used = has_turns & looks_like_follow_up(question) & raw.isNotNull() & rewrite_accepted(question, candidate)
        return F.struct(F.when(used, candidate).otherwise(question).alias("query"), used.alias("was_follow_up"))

    return let(clean_rewrite(F.coalesce(raw, F.lit(""))), judged)


def condense(answer: Column, params: Params = DEFAULTS) -> Column:
    """An answer for the recap: whole if short, else whole sentences while they fit, else its first 400 characters."""

    def shortened(text: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("over"))

        def add(s: Column, sentence: Column) -> Column:
            used = s["used"] + count_tokens(sentence, params)
            over = s["over"] | (used > params.history_answer_tokens)
            return F.struct(F.when(over, s["kept"]).otherwise(F.concat(s["kept"], F.array(sentence))).alias("kept"), F.when(over, s["used"]).otherwise(used).alias("used"), over.alias("over"))

        kept = F.aggregate(F.split(text, rf"{U}(?<=[.!?]){WS}+"), start, add, lambda s: s["kept"])
        cut = F.concat(F.regexp_replace(F.substring(text, 1, 400), rf"{U}{WS}+\z", ""), F.lit(" …"))
        return F.when(count_tokens(text, params) <= params.history_answer_tokens, text).otherwise(let(kept, lambda k: F.when(F.size(k) > 0, F.array_join(k, " ")).otherwise(cut)))

    return let(strip_labels(answer), shortened)


def exchanges(messages: DataFrame) -> DataFrame:
    """conv_id, exchange, question, answer: each user message with the assistant's next one.  messages: conv_id, turn, role, text."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.where("role IN ('user', 'assistant')").withColumns({"_next": F.lead("role").over(order), "_answer": F.lead("text").over(order)})
    asked = rows.where("role = 'user'").withColumn("exchange", F.row_number().over(order))
    return asked.select("conv_id", "exchange", "turn", F.col("text").alias("question"), F.when(F.col("_next") == "assistant", F.col("_answer")).alias("answer"))


def history(turns: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds history: the recap of the exchanges before, at most params.history_turns; null for the first.

    turns: conv_id, exchange, question, answer and, where a rewrite was used, rewritten."""
    before = Window.partitionBy("conv_id").orderBy("exchange").rowsBetween(-params.history_turns, -1)
    asked = F.coalesce(F.col("rewritten"), F.col("question")) if "rewritten" in turns.columns else F.col("question")
    line = F.concat(F.lit("Kullanıcı: "), asked, F.lit("\nAsistan: "), condense(F.coalesce("answer", F.lit("")), params))
    rows = turns.withColumn("_line", F.struct("exchange", line.alias("line")))
    recap = F.array_join(F.transform(F.sort_array(F.collect_list("_line").over(before)), lambda x: x["line"]), "\n")
    return rows.withColumn("history", F.when(F.coalesce(F.size(F.collect_list("_line").over(before)), F.lit(0)) > 0, F.concat(F.lit("[Önceki tur]\n"), recap))).drop("_line")
