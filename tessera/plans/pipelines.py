"""The engine's three journeys as plans: ingest, retrieve and answer."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold_diacritics
from tessera.operators import answer, conversation, dense, fusion, lexical, scope, services, store
from tessera.operators.chunking import chunk_documents
from tessera.operators.identity import identify
from tessera.params import DEFAULTS, Params
from tessera.sources import tables


def ingest(current: DataFrame, extracted: DataFrame, embed: services.Embed, params: Params = DEFAULTS) -> DataFrame:
    """The next snapshot of the store.  Only chunks that it lacks are embedded."""
    docs = identify(extracted.where("status = 'ok'"))
    chunks = chunk_documents(docs, params)
    meta = docs.select("doc_id", F.col("path").alias("source_path"), "file_sha256", F.array_join("flags", "; ").alias("quality_flag"))
    rows = scope.scope_chunks(chunks).join(meta, "doc_id")
    new = store.pending(current, rows).select(*store.KEY).withColumn("_new", F.lit(True))
    marked = rows.join(new, store.KEY, "left")
    vector = services.embed(F.when(F.col("indexable") & F.col("_new").isNotNull(), F.col("text")), embed, params)
    return store.upsert(current, marked.withColumn("embedding", vector).drop("_new"))


def reprocess_scope(current: DataFrame, extracted: DataFrame, embed: services.Embed, params: Params = DEFAULTS) -> DataFrame:
    """The next snapshot after documents that aren't indexed whole were deleted and rebuilt."""
    docs = identify(extracted.where("status = 'ok'"))
    scopes = scope.scope_chunks(chunk_documents(docs, params)).select("doc_id", "disposition").distinct()
    touched = docs.join(scope.scoped_out(scopes), "doc_id").select(F.col("path").alias("source_path"))
    return reprocess(current, extracted, touched, embed, params)


def reprocess(current: DataFrame, extracted: DataFrame, paths: DataFrame, embed: services.Embed, params: Params = DEFAULTS) -> DataFrame:
    """The next snapshot after the documents of the given paths (source_path) alone were deleted and rebuilt."""
    rebuilt = extracted.join(paths.select(F.col("source_path").alias("path")), "path", "left_semi")
    return ingest(store.delete(current, paths), rebuilt, embed, params)


Ready = tuple[DataFrame, lexical.Index]
T = TypeVar("T")


def prepare(current: DataFrame, params: Params = DEFAULTS) -> Ready:
    """Searchable rows and their index, for several retrievals over one snapshot."""
    rows = store.searchable(current, params)
    return rows, lexical.build_index(rows, keep=True)


def retrieve(current: DataFrame, queries: DataFrame, embed: services.Embed | None, params: Params = DEFAULTS, ready: Ready | None = None) -> tuple[DataFrame, DataFrame]:
    """(fused results with metadata, judged queries).  queries: query_id, text; embed None: vectors come in an embedding column."""
    rows, index = ready or prepare(current, params)
    asked = queries if embed is None else queries.withColumn("embedding", services.embed(F.col("text"), embed, params))
    fused, judged = fusion.answerable(index, rows, rows.select("id", "embedding"), asked, params)
    return dense.hydrate(fused, store.metadata(current)), judged


def ask(current: DataFrame, queries: DataFrame, embed: services.Embed, generate: services.Generate, params: Params = DEFAULTS, ready: Ready | None = None) -> DataFrame:
    """Answers with citations for every query."""
    results, judged = retrieve(current, queries, embed, params, ready)
    return answer.answer_all(queries, judged, results, generate, params=params)


def ask_timed(current: DataFrame, queries: DataFrame, embed: services.Embed, generate: services.Generate, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(answers as ``ask`` gives them, timings: stage, seconds).  Plans are lazy, so each stage is written before the next starts:
    embed (queries), index, retrieve (both rankers, fusion, gate), generate (prompts, model, citations), and total.  One row a stage of the whole batch."""
    began = time.perf_counter()
    took: list[tuple[str, float]] = []

    def timed(stage: str, make: Callable[[], T]) -> T:
        start = time.perf_counter()
        out = make()
        took.append((stage, time.perf_counter() - start))
        return out

    asked = timed("embed", lambda: tables.settle(queries.withColumn("embedding", services.embed(F.col("text"), embed, params))))
    ready = timed("index", lambda: prepare(current, params))
    results, judged = timed("retrieve", lambda: tuple(tables.settle(part) for part in retrieve(current, asked, None, params, ready)))
    answers = timed("generate", lambda: tables.settle(answer.answer_all(asked.drop("embedding"), judged, results, generate, params=params)))
    took.append(("total", time.perf_counter() - began))
    return answers, current.sparkSession.createDataFrame(took, "stage string, seconds double")


def probe(current: DataFrame, questions: DataFrame, embed: services.Embed, params: Params = DEFAULTS) -> DataFrame:
    """query_id, answerable, fused, fused_folded, dense, dense_folded, coverage, top: every question scored on both paths, as typed and folded.

    questions: query_id, text, answerable.  top: the id of the first fused result as typed; coverage: as typed."""
    ways = F.array(F.struct(F.lit("typed").alias("way"), F.col("text")), F.struct(F.lit("folded").alias("way"), fold_diacritics(F.col("text")).alias("text")))
    spelled = questions.select(F.col("query_id").alias("asked"), "answerable", F.explode(ways).alias("w"))
    spelled = spelled.select(F.concat_ws(":", "w.way", "asked").alias("query_id"), "asked", "answerable", "w.way", "w.text")
    spelled = spelled.withColumn("embedding", services.embed(F.col("text"), embed, params))
    rows, _ = ready = prepare(current, params)
    fused, judged = retrieve(current, spelled, None, params, ready)
    alone = dense.cosine_topk(rows.select("id", "embedding"), spelled, 1, params).select("query_id", F.col("score").alias("alone"))
    first = fused.where("rank = 1").select("query_id", F.col("id").alias("first"))
    scored = spelled.drop("embedding", "text").join(judged.select("query_id", "confidence", "coverage"), "query_id").join(alone, "query_id", "left").join(first, "query_id", "left")

    def of(way: str, c: str) -> Column:
        return F.max(F.when(F.col("way") == way, F.col(c)))

    return scored.groupBy(F.col("asked").alias("query_id"), "answerable").agg(
        of("typed", "confidence").alias("fused"), of("folded", "confidence").alias("fused_folded"), F.coalesce(of("typed", "alone"), F.lit(0.0)).alias("dense"),
        F.coalesce(of("folded", "alone"), F.lit(0.0)).alias("dense_folded"), of("typed", "coverage").alias("coverage"), of("typed", "first").alias("top"),
    )


def _standalone(rows: DataFrame, generate: services.Generate) -> DataFrame:
    """Adds w (query, was_follow_up).  rows: question, history.  Only questions that depend on what came before reach the rewriter."""
    depends = F.col("history").isNotNull() & conversation.looks_like_follow_up(F.col("question"))
    prompt = F.when(depends, conversation.rewrite_prompt(F.col("history"), F.col("question")))
    said = rows.withColumn("said", services.generate(prompt, generate)).withColumn("said", F.col("said.text"))
    return said.withColumn("w", conversation.rewrite(F.col("question"), F.col("history").isNotNull(), F.col("said"))).drop("said")


def _replies(current: DataFrame, rows: DataFrame, embed: services.Embed, generate: services.Generate, params: Params, ready: Ready | None = None) -> DataFrame:
    """Answers to rewritten questions, one a conversation.  rows: conv_id, question, history, w."""
    queries = rows.select(F.col("conv_id").alias("query_id"), F.col("w.query").alias("text"), "history")
    asked = rows.select(F.col("conv_id").alias("query_id"), "question", F.col("w.query").alias("rewritten_query"), F.col("w.was_follow_up").alias("was_follow_up"))
    return ask(current, queries, embed, generate, params, ready).join(asked, "query_id")


def converse(current: DataFrame, turns: DataFrame, embed: services.Embed, generate: services.Generate, params: Params = DEFAULTS) -> DataFrame:
    """Answers the last question of each conversation, given the exchanges before it (conv_id, exchange, question, answer)."""
    rows = conversation.history(turns, params)
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("question", "history"), "exchange").alias("t")).select("conv_id", "t.*")
    return _replies(current, tables.settle(_standalone(last, generate)), embed, generate, params)


def converse_all(current: DataFrame, turns: DataFrame, embed: services.Embed, generate: services.Generate, params: Params = DEFAULTS) -> DataFrame:
    """Answers every question of each conversation (conv_id, exchange from 1 without gaps, question), one row each.

    A round answers one question of all conversations at once; it sees the answers and rewritten questions of the rounds
    before, refusals included, at most params.history_turns of them.  There are as many rounds as the longest conversation has
    questions, and each is written before the next starts."""
    ready = prepare(current, params)
    asked = tables.settle(turns.select("conv_id", "exchange", "question"))
    rounds = asked.agg(F.max("exchange")).first()[0] or 0
    out: DataFrame | None = None
    for n in range(1, max(rounds, 1) + 1):
        now = asked.where(F.col("exchange") == n).withColumns({"answer": F.lit(None).cast("string"), "rewritten": F.lit(None).cast("string")})
        if out is not None:
            past = out.where(F.col("exchange") >= n - params.history_turns)
            now = now.unionByName(past.select(F.col("query_id").alias("conv_id"), "exchange", "question", F.col("text").alias("answer"), F.col("rewritten_query").alias("rewritten")))
        rows = conversation.history(now, params).where(F.col("exchange") == n).drop("answer", "rewritten")
        written = tables.settle(_standalone(rows, generate))
        done = tables.settle(_replies(current, written, embed, generate, params, ready).withColumn("exchange", F.lit(n)))
        out = done if out is None else out.unionByName(done)
    return out
