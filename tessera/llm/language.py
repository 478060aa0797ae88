"""Operator 8: language identification.

Sparse multinomial logistic regression over TF-IDF weighted hashed character
1- to 3-grams of the lower-cased text, trained by follow-the-regularised-leader with an
elastic net and calibrated by a temperature.

A document whose crc32(doc_id as text) mod 4 is 2 is held out.  Of the others with a lang,
document frequencies cover all; the model is fitted on a bounded sample: about
``SAMPLE_A_LANG`` documents a language by hash of doc_id, and every fifth of them
only sets the temperature.  A prediction reads the text alone.

Cases: null text, or text without a letter, is ``und`` with score 0; null doc_id isn't held out nor learned
from; repeated rows are judged alike; without any document to learn from all are ``und``; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow
from tessera.llm.linear import ftrl_multinomial, softmax, temperature

FEATURES = 1 << 15
GRAMS = (1, 2, 3)
SAMPLE_A_LANG = 700
MOST_LANGS = 256
SCALE = 30.0
CHARS_AT_ONCE = 1 << 19
_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


def batches_of(texts: list[str]):
    """Runs of texts of bounded length: first, end, code points with a gap of zeros after each text, starts."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < CHARS_AT_ONCE):
            size += len(texts[end]) + 2
            end += 1
        lowered = [t.lower() for t in texts[at:end]]
        points = np.frombuffer(("\0\0".join(lowered) + "\0\0").encode("utf-32-le", "surrogatepass"), "<u4")
        starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in lowered])])
        yield at, end, points, starts
        at = end


def gram_buckets(points: np.ndarray):
    """For each gram size the bucket at every place; FEATURES where no gram starts."""
    mixed = points * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    dead = points == 0
    total = np.zeros(len(points), np.uint32)
    blocked = np.zeros(len(points), bool)
    for k in GRAMS:
        shift = k - 1
        total = total * np.uint32(0x85EBCA77)
        total[: len(points) - shift] += mixed[shift:] if shift else mixed
        blocked[: len(points) - shift] |= dead[shift:] if shift else dead
        blocked[len(points) - shift :] = True
        final = (total ^ (total >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + np.uint32(k)
        yield np.where(blocked, FEATURES, final >> np.uint32(17))


def counts(texts: list[str]):
    """Gram counts (dense, FEATURES) of each text."""
    for at, end, points, starts in batches_of(texts):
        grams = list(gram_buckets(points))
        for k in range(end - at):
            yield np.bincount(np.concatenate([g[starts[k] : starts[k + 1]] for g in grams]), minlength=FEATURES + 1)[:FEATURES]


def _labelled(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))


def document_frequency(learned: DataFrame) -> np.ndarray:
    """Documents that hold each bucket, over all of ``learned``; summed where they lie before they travel."""

    def run(batches):
        df = np.zeros(FEATURES, np.int64)
        for batch in batches:
            for at, end, points, starts in batches_of([t or "" for t in batch.column(0).to_pylist()]):
                seen, grams = np.zeros(FEATURES + 1, bool), list(gram_buckets(points))
                for k in range(end - at):
                    for g in grams:
                        seen[g[starts[k] : starts[k + 1]]] = True
                    df += seen[:FEATURES]
                    seen[:] = False
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["f", "n"])

    out = np.zeros(FEATURES)
    for f, n in learned.select("text").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n")).collect():  # at most FEATURES rows
        out[f] = n
    return out


class LanguageModel:
    def __init__(self, names: list[str], table: np.ndarray, bias: np.ndarray, t: float) -> None:
        self.names, self.table, self.bias, self.t = names, table, bias, t

    def logits(self, texts: list[str]) -> np.ndarray:
        """Mean over a text's grams of their weights; the table is the weights times IDF and scale."""
        out = np.zeros((len(texts), len(self.names)))
        for at, end, points, starts in batches_of(texts):
            sums, places = np.zeros((end - at, len(self.names))), np.zeros(end - at)
            for g in gram_buckets(points):
                sums += np.add.reduceat(self.table[g], starts[:-1], axis=0)
                places += np.add.reduceat((g < FEATURES).astype(np.int64), starts[:-1])
            out[at:end] = sums / np.maximum(places, 1)[:, None]
        return out + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        p = softmax(self.logits(texts) / self.t)
        best = p.argmax(axis=1)
        return [self.names[b] for b in best], p[np.arange(len(texts)), best].tolist()


def train(docs: DataFrame, *, sample_a_lang: int = SAMPLE_A_LANG, most_langs: int = MOST_LANGS) -> LanguageModel | None:
    """Learns the ``most_langs`` languages with the most rows, from a sample by hash of row; equal rows count once."""
    learned = _labelled(docs).where("NOT held_out AND doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    most = learned.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    langs = {r["lang"]: r["n"] for r in most.collect()}
    if not langs:
        return None
    names = sorted(langs)
    df = document_frequency(learned)
    idf = np.log((1 + sum(langs.values())) / (1 + df)) + 1
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30))
    bound = F.create_map(*(F.lit(x) for k, n in langs.items() for x in (k, int(min(1.0, sample_a_lang / n) * (1 << 30)))))
    sampled = learned.withColumn("place", place).where(F.col("place") < F.element_at(bound, F.col("lang"))).dropDuplicates(["doc_id", "lang", "text"])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, n = [], []
            for c in counts(batch.column("text").to_pylist()):
                some = np.flatnonzero(c)
                at.append(some.astype(np.int32))
                n.append(c[some].astype(np.int32))
            return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], names=["lang", "place", "at", "n"])

        return step

    got = map_arrow(sampled.select("text", "lang", "place"), make, "lang string, place long, at array<int>, n array<int>").toPandas().sort_values(["place", "lang"], kind="stable")
    rows = [(np.asarray(a, np.int64), np.asarray(n) / max(1, sum(n)) * idf[np.asarray(a, np.int64)] * SCALE) for a, n in zip(got["at"], got["n"])]
    labels = np.array([names.index(x) for x in got["lang"]])
    check = np.arange(len(rows)) % 5 == 4
    w, bias = ftrl_multinomial([r for r, c in zip(rows, check) if not c], labels[~check], FEATURES, len(names))
    t = 1.0
    if check.any():
        logits = np.array([x @ w[at] for (at, x), c in zip(rows, check) if c]) + bias
        t = temperature(logits, labels[check])
    table = np.vstack([w * idf[:, None] * SCALE, np.zeros((1, len(names)))]).astype(np.float32)
    return LanguageModel(names, table, bias, t)


def identify(docs: DataFrame, *, sample_a_lang: int = SAMPLE_A_LANG) -> DataFrame:
    model = train(docs, sample_a_lang=sample_a_lang)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            some = [k for k, t in enumerate(texts) if model is not None and has_letter(t)]
            for k, name, score in zip(some, *(model.predict([texts[k] for k in some]) if some else ((), ()))):
                names[k], scores[k] = name, score
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

        return step

    return map_arrow(_labelled(docs).select("doc_id", "held_out", "text"), make, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
