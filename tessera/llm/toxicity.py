"""Operator 9: toxicity severity by cumulative-link ordinal regression.

Features are presences of hashed words and of hashed five-byte word beginnings of the lower-cased
text.  The model is fitted on a bounded sample of labelled documents (``SAMPLE_TOXIC`` and
``SAMPLE_CLEAN`` rows by hash of doc_id).  Labels tell toxic or not, so only these two grades are observed; grades 1 to 3 of toxic
documents are the thirds of their weight of evidence: the number of distinct features that the sample
shows to go with toxicity.  One weight vector serves all ordered thresholds,
P(grade > k) = sigmoid(w.x - t_k); the output is the expected grade.

``toxic`` is P(grade > 0) at or over a cut chosen on every fifth sampled document (the greatest
Youden's J, midway between the neighbouring scores, kept within 0.3 and 0.9).

Cases: null or empty text has no features and the model's base severity; null doc_id passes through;
repeated rows are judged alike; without labels of both kinds all get severity 0 and toxic false; labels of
unknown or null documents are ignored, of several labels of a document the highest counts, of several rows of a doc_id one is fitted; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow
from tessera.llm.linear import cumulative_link, sigmoid
from tessera.llm.words import _U, groups, hash_words, mix

BITS = 18
FEATURES = 1 << BITS
LEVELS = 4
SAMPLE_TOXIC = 3000
SAMPLE_CLEAN = 5000
CHOSEN = 4000  # features kept by screening
BEGINNING = 5

# ASCII signs and digits end a word; letters and all bytes of other characters belong to it.
_CLEAN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def features(texts: list[str]):
    """For each run of texts: first, end, bucket of every feature, its text in the run."""
    parts = [t.lower().encode("utf-8", "surrogatepass").translate(_CLEAN) for t in texts]
    for at, end, data, starts in groups(parts):
        words, where = hash_words(data)
        home = np.searchsorted(starts, where, "right") - 1
        raw = np.frombuffer(data + b" " * BEGINNING, np.uint8)
        head = np.zeros(len(where), _U)
        full = np.ones(len(where), bool)
        for k in range(BEGINNING):
            byte = raw[where + k]
            full &= byte != 32
            head = (head << _U(8)) | byte.astype(_U)
        full &= raw[np.minimum(where + BEGINNING, len(raw) - 1)] != 32
        buckets = np.concatenate([words >> _U(64 - BITS), mix(head[full] + _U(0x5851F42D4C957F2D)) >> _U(64 - BITS)]).astype(np.int64)
        yield at, end, buckets, np.concatenate([home, home[full]])


def sample(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> DataFrame:
    """doc_id, y, at (distinct buckets): a bounded number of labelled documents."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    order = [F.xxhash64("doc_id", F.lit("toxicity")), "doc_id"]
    few = known.where("y > 0").orderBy(*order).limit(toxic).union(known.where("y <= 0").orderBy(*order).limit(clean))
    # At most toxic + clean rows of two numbers.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    # Of rows that repeat a doc_id one is taken, so that rows are as bounded as ids.
    found = found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select("doc_id", "y", F.col("first.text").alias("text"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at: list = [None] * batch.num_rows
            for first, end, buckets, home in features([t or "" for t in batch.column("text").to_pylist()]):
                for k in range(end - first):
                    at[first + k] = np.unique(buckets[home == k]).astype(np.int32)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(at, pa.list_(pa.int32()))], names=["doc_id", "y", "at"])

        return step

    return map_arrow(found.select("doc_id", "y", "text"), make, "doc_id long, y int, at array<int>")


class SeverityModel:
    def __init__(self, weights: np.ndarray, cuts: np.ndarray, cut: float) -> None:
        self.weights, self.cuts, self.cut = weights.astype(np.float64), cuts, cut
        self.used = self.weights != 0

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for at, end, buckets, home in features(texts):
            some = self.used[buckets]
            pairs = np.unique(home[some] * FEATURES + buckets[some])
            out[at:end] = np.bincount(pairs >> BITS, self.weights[pairs & (FEATURES - 1)], minlength=end - at)
        return out

    def tails(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.scores(texts)[:, None] - self.cuts)


def fit(rows: list[np.ndarray], y: np.ndarray, *, chosen: int = CHOSEN) -> SeverityModel:
    """rows: distinct buckets of each document, in random order; y: toxic or not."""
    check = np.arange(len(rows)) % 5 == 4
    own = [r for r, c in zip(rows, check) if not c]
    positive = y[~check] > 0
    a, b = (np.bincount(np.concatenate([np.zeros(0, np.int64), *(r for r, p in zip(own, positive) if p == side)]), minlength=FEATURES) for side in (True, False))
    n, m = max(1, positive.sum()), max(1, (~positive).sum())
    odds = np.log((a + 0.5) / (n - a + 0.5)) - np.log((b + 0.5) / (m - b + 0.5))
    z = odds / np.sqrt(1 / (a + 0.5) + 1 / (n - a + 0.5) + 1 / (b + 0.5) + 1 / (m - b + 0.5))
    z[a + b < 3] = 0
    names = np.sort(np.argsort(-np.abs(z), kind="stable")[:chosen])
    names = names[z[names] != 0]
    place = np.full(FEATURES, -1)
    place[names] = np.arange(len(names))
    telling = (z > 4) & (odds > 2)
    evidence = np.array([telling[r].sum() for r in own])
    ends = np.quantile(evidence[positive & (evidence > 0)], [1 / 3, 2 / 3]) if (positive & (evidence > 0)).any() else np.zeros(2)
    grades = np.where(positive, 1 + (evidence > ends[0]) + (evidence > ends[1]), 0).astype(np.int64)
    sparse = [(p := place[r])[p >= 0] for r in own]
    w, cuts = cumulative_link([(r, np.ones(len(r))) for r in sparse], grades, max(1, len(names)), LEVELS)
    weights = np.zeros(FEATURES)
    weights[names] = w[: len(names)]
    judged = np.array([weights[r].sum() for r in rows])
    p, truth = sigmoid(judged - cuts[0])[check], y[check] > 0
    cut = 0.5
    if truth.any() and not truth.all():
        values = np.unique(p)
        youden = [(p[truth] >= v).mean() - (p[~truth] >= v).mean() for v in values]
        best = int(np.argmax(youden))
        cut = float(np.clip((values[best] + (values[best - 1] if best else 0)) / 2, 0.3, 0.9))  # a small fold says little
    return SeverityModel(weights, cuts, cut)


def severity(docs: DataFrame, labels: DataFrame, *, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    got = sample(docs, labels, toxic, clean).toPandas()
    got = got.assign(order=[(int(d) * 0x9E3779B97F4A7C15) % (1 << 64) for d in got["doc_id"]]).sort_values("order", kind="stable")
    y = got["y"].to_numpy()
    model = fit([np.asarray(a, np.int64) for a in got["at"]], y) if (y > 0).any() and (y <= 0).any() else None

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            tails = np.zeros((n, LEVELS - 1)) if model is None else model.tails([t or "" for t in batch.column("text").to_pylist()])
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array((tails >= 0.5).sum(axis=1).astype(np.int32)), pa.array(tails[:, 0].copy()), pa.array(tails[:, 0] >= model.cut if model else np.zeros(n, bool))],
                names=["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
