"""Operator 1: a ledger of rule bits, and versioned policies over it.

``ledger`` evaluates every rule once a document and stores its measurements
and one long of failure bits.  ``apply_policy`` judges documents by the bits of a policy's
mask; ``ablations`` tells, for each policy and rule, what would pass without
that rule, from counts over distinct bit patterns (at most two to the number of
rules, whatever the corpus).

Cases: null or empty text has no words (it fails ``few_words``); null doc_id
passes through; repeated rows are judged alike; further columns stay out of the ledger.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, map_arrow, strings
from tessera.llm.words import SPACE, _U, groups, hash_words, mix, window_hashes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaim", "n_upper", "n_letters")
WINDOW = 5

# Name, and the condition of failure over the measurements.  A rule's bit is its place.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 5 * word_chars"),
    ("exclamations", "100 * n_exclaim > 5 * word_chars"),
    ("upper_case", "n_letters >= 40 AND 100 * n_upper > 40 * n_letters"),
    ("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


BASE = mask("few_words", "repeated_windows")
POLICIES: dict[str, int] = {
    "v1": BASE,
    "v2": BASE | mask("symbols", "exclamations", "upper_case"),
    "v3": BASE | mask("symbols", "exclamations", "upper_case", "repeated_lines", "short_words", "long_words"),
}
CURRENT = "v3"

_SYMBOL, _EXCLAIM, _UPPER, _LETTER, _LEAD = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_EXCLAIM[ord("!")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LEAD[:128] = _LEAD[192:] = True
_IN_WORD = _LEAD & ~SPACE
_CLASS = np.zeros((256, 5), np.int64)
for _k, _table in enumerate((_IN_WORD, _SYMBOL, _EXCLAIM, _UPPER, _LETTER)):
    _CLASS[:, _k] = _table


def _lines(part: bytes) -> tuple[int, int]:
    """Lines that have a word, and how many of them equal an earlier one."""
    lines = [x for x in part.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: list[str]) -> np.ndarray:
    """A row of MEASURES for each text."""
    parts = [t.encode() for t in texts]
    out = np.zeros((len(parts), len(MEASURES)), np.int64)
    for at, end, data, starts in groups(parts):
        n = end - at
        words, where = hash_words(data)
        doc = np.searchsorted(starts, where, "right") - 1
        out[at:end, 0] = np.bincount(doc, minlength=n)
        raw = np.frombuffer(data, np.uint8)
        for k in range(n):  # byte counts give every class at once
            counts = np.bincount(raw[starts[k] : starts[k] + len(parts[at + k])], minlength=256) @ _CLASS
            out[at + k, [1, 2, 6, 7, 8]] = counts
            out[at + k, 5], out[at + k, 3] = _lines(parts[at + k])
        windows = window_hashes(words, WINDOW)
        if len(windows):
            home = doc[: len(windows)]
            valid = np.flatnonzero(home == doc[WINDOW - 1 :])
            keys = mix(windows[valid] + home[valid].astype(_U) * _U(0x9E3779B97F4A7C15))
            order = np.argsort(keys)
            same = keys[order][1:] == keys[order][:-1]
            again = np.zeros(len(valid), bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, valid[again], 1)
            np.add.at(change, valid[again] + WINDOW, -1)
            out[at:end, 4] = np.bincount(doc[np.cumsum(change)[:-1] > 0], minlength=n)
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits, one row a document."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = measure(strings(batch.column(1)).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(len(MEASURES)))], names=["doc_id", *MEASURES])

        return step

    measured = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    return measured.withColumn("fail_bits", rule_bits())


def rule_bits(measures: str = "") -> Column:
    """The failure bits from measurements, which are columns or (``measures``) fields of a struct."""
    values = [(k, re.sub("|".join(rf"\b{m}\b" for m in MEASURES), lambda m: f"{measures}.{m[0]}" if measures else m[0], rule)) for k, (_, rule) in enumerate(RULES)]
    return sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in values), F.lit(0).cast("long"))


def failed(policy_mask: int) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy_mask)) != 0


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds base_failed, kept and the policy's version."""
    return rows.withColumns({"base_failed": failed(BASE), "kept": ~(failed(BASE) | failed(POLICIES[version])), "policy": F.lit(version)})


def ablations(rows: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """For each policy and rule of its mask: documents rejected, those by that
    rule alone (kept without it), words of these, and the other bits they ever fail."""
    policies = policies or POLICIES
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"))
    cases = F.array(*(F.struct(F.lit(v).alias("policy"), F.lit(name).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(BIT[name]).cast("long").alias("bit")) for v, m in policies.items() for name, _ in RULES if m & BIT[name]))
    each = patterns.select("*", F.explode(cases).alias("c")).select("fail_bits", "n", "words", "c.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    alone = hit == F.col("bit")
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("kept_without"),
        F.sum(F.when(alone, F.col("words")).otherwise(0)).alias("words_without"),
        F.bit_or(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("fail_bits")).otherwise(F.lit(0).cast("long"))).alias("fails_with"),
    )


def kept_documents(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of docs that the policy keeps, all columns as they were; texts don't move."""

    def run(column: pa.Array) -> pa.Array:
        found = measure(strings(column).to_pylist())
        return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(MEASURES))], names=list(MEASURES))

    measured = F.arrow_udf(run, "struct<" + ",".join(f"{m}: bigint" for m in MEASURES) + ">")(F.col("text").cast("string"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), measured.alias("m")).select("row", rule_bits("m").alias("fail_bits"))
    return rows.where(~failed(BASE | POLICIES[version])).select("row.*")


def op1_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored once; the policy reads it."""
    return apply_policy(cut(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy rejects, and would keep without each of its rules, from the stored bits of all documents."""
    return ablations(cut(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


_BITS_SQL = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(RULES))
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, ws[i:i + {WINDOW - 1}] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d)
), twice AS (
  SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT win.doc_id, i, unnest(range({WINDOW})) AS k FROM win JOIN twice USING (doc_id, g)) GROUP BY doc_id
), l AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), m AS (
  SELECT d.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '!')) AS n_exclaim,
    len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters
  FROM d JOIN l USING (doc_id) LEFT JOIN covered USING (doc_id)
), b AS (SELECT *, ({_BITS_SQL})::BIGINT AS fail_bits FROM m)
"""
ABLATIONS_ORACLE = ORACLE + "".join(
    f"{'UNION ALL ' if k else ''}SELECT '{v}' AS policy, '{name}' AS rule, count(*) FILTER (fail_bits & {m} <> 0) AS rejected, "
    f"count(*) FILTER (fail_bits & {m} = {BIT[name]}) AS kept_without, (coalesce(sum(n_words) FILTER (fail_bits & {m} = {BIT[name]}), 0))::BIGINT AS words_without, "
    f"coalesce(bit_or(CASE WHEN fail_bits & {BIT[name]} <> 0 THEN fail_bits ELSE 0 END), 0) AS fails_with FROM b\n"
    for k, (v, m, name) in enumerate((v, m, name) for v, m in POLICIES.items() for name, _ in RULES if m & BIT[name])
)
ORACLE += rf"""SELECT *, (fail_bits & {BASE}) <> 0 AS base_failed, (fail_bits & {POLICIES[CURRENT] | BASE}) = 0 AS kept, '{CURRENT}' AS policy FROM b
"""
