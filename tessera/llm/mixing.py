"""Operator 3: temperature mixing of sources, realised as budgeted block permutations.

1. Tokens (words, see ``TOKENS``) are summed by source; shares p give weights
   w = p**a / sum(p**a).
2. The exponent a in [0, 1] is bisected on a grid of 2**-20.  With a target entropy it is the
   greatest whose weights reach it; with a repetition limit it is raised to the least under
   which no source is read more often than the limit.  With a limit alone, sources are flattened as
   far as the limit allows.  Each step of the search is an aggregate over sources, which are never collected.
3. A source's quota is its weight times the budget.  Its documents lie in hashed blocks; an epoch goes
   through the blocks in an order of its own.  Whole epochs repeat every document, the last takes blocks in
   order while they fit and, of the next block, documents in order while they fit, leaving out those longer than all
   that is left; never over the quota.  A quota within a thousandth of whole epochs is rounded up to them.

Cases: null or empty text has no tokens and rides along with its block; null source is a source;
null doc_id passes through; rows that repeat a doc_id are documents of their own; sources without tokens
get nothing; an empty table gives no rows; further columns are ignored (``mixed_documents`` keeps all columns).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import HASH32_SQL, cut, hash32

TOKENS = r"[^\x20\x09-\x0D]+"
STEPS = 20
AT_ONCE = 4  # bisection steps settled by one aggregate
SALTS = 64
SPREAD = 0.92  # default target: this part of the greatest entropy


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, its key, and tokens of each document."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("key"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(TOKENS)), F.lit(0)).cast("long").alias("tokens"),
    )


def _search(shares: DataFrame, good, greatest: bool) -> int:
    """The greatest (or least) i of 0..2**STEPS whose exponent is good, good ones lying at one end.

    ``good`` judges a row of n, s (sum of p**a), l (sum of p**a ln p), r (greatest p**(a-1)), a."""

    def verdicts(points: list[int]) -> dict[int, bool]:
        each = shares.select("p", F.explode(F.array(*(F.lit(i) for i in points))).alias("i")).withColumn("a", F.col("i") / (1 << STEPS))
        w = F.pow("p", "a")
        found = each.groupBy("i", "a").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("s"), F.sum(w * F.log("p")).alias("l"), F.max(F.pow(F.col("p"), F.col("a") - 1)).alias("r"))
        return {row["i"]: good(row) for row in found.collect()}

    low, high = 0, 1 << STEPS
    ends = verdicts([low, high])
    if ends[high if greatest else low]:
        return high if greatest else low
    if not ends[low if greatest else high]:
        return low if greatest else high
    while high - low > 1:
        width = max(1, (high - low) >> AT_ONCE)
        inner = list(range(low + width, high, width))
        judged = verdicts(inner)
        for i in inner:
            if judged[i] == greatest:
                low = i
            else:
                high = i
                break
    return low if greatest else high


def exponent(shares: DataFrame, *, target_entropy: float | None, spread: float | None, repetition_limit: float | None, budget_ratio: float) -> float:
    """The exponent for shares (column p); budget_ratio: budget by tokens of the corpus."""
    if target_entropy is None and spread is None and repetition_limit is None:
        return 1.0
    at = 0
    if target_entropy is not None or spread is not None:

        def reached(row) -> bool:
            goal = target_entropy if target_entropy is not None else spread * math.log(row["n"])
            return math.log(row["s"]) - row["a"] * row["l"] / row["s"] >= goal

        at = _search(shares, reached, greatest=True)
    if repetition_limit is not None:
        at = max(at, _search(shares, lambda row: row["r"] / row["s"] * budget_ratio <= repetition_limit * (1 + 1e-12), greatest=False))
    return at / (1 << STEPS)


def temperature_mix(docs: DataFrame, *, target_entropy: float | None = None, spread: float | None = SPREAD, repetition_limit: float | None = 4.0, budget_ratio: float = 1.0, budget_tokens: int | None = None, least_block: int = 1 << 14, most_blocks: int = 1 << 16) -> DataFrame:
    """One row for each time a document is read: doc_id, source, tokens, epoch, block, block_rank.

    Blocks hold about least_block tokens, or more where that keeps them to most_blocks."""
    rows = cut(measured(docs))
    sources = cut(rows.groupBy("key").agg(F.sum("tokens").alias("held")).where("held > 0"))
    total = sources.agg(F.sum("held")).first()[0] or 0
    if not total:
        return rows.select("doc_id", "source", "tokens", F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("block"), F.lit(0).alias("block_rank")).limit(0)
    budget = budget_tokens if budget_tokens is not None else int(budget_ratio * total)
    a = exponent(sources.select((F.col("held") / total).alias("p")), target_entropy=target_entropy, spread=spread, repetition_limit=repetition_limit, budget_ratio=budget / total)
    raised = F.pow(F.col("held") / total, F.lit(a))
    whole = sources.agg(F.sum(raised)).first()[0]
    size = max(least_block, -(-total // most_blocks))
    quota = F.floor(F.round(raised / F.lit(whole) * F.lit(float(budget)), 3)).cast("long")
    plan = sources.select("key", "held", quota.alias("quota"), F.ceil(F.col("held") / size).cast("long").alias("blocks"))
    nearly = F.expr("1000 * (held - quota % held) <= held")
    plan = cut(plan.withColumns({"full": F.expr("quota div held") + nearly.cast("long"), "rest": F.when(nearly, 0).otherwise(F.expr("quota % held"))}))
    # A source may hold most rows: its plan is dealt to every salt, so that its rows spread over tasks.
    dealt = plan.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    placed = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(SALTS))).join(dealt, ["key", "salt"]).drop("salt").withColumn("block", hash32(F.lit("block"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % F.col("blocks"))
    blocks = placed.groupBy("key", "block", "full", "rest").agg(F.sum("tokens").alias("held"))
    passes = cut(blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full")))))
    order = Window.partitionBy("key", "epoch").orderBy(hash32(F.lit("order"), F.col("key"), F.col("epoch"), F.col("block")), "block")
    ranked = passes.withColumns({"block_rank": F.row_number().over(order) - 1, "before": F.sum("held").over(order) - F.col("held")})
    left = F.when(F.col("epoch") < F.col("full"), F.col("held")).otherwise(F.col("rest") - F.col("before"))
    ranked = cut(ranked.select("key", "block", "epoch", "block_rank", left.alias("left"), (left >= F.col("held")).alias("fits")).where("left > 0"))
    read = placed.select("doc_id", "source", "tokens", "key", "block").join(ranked, ["key", "block"])
    inside = Window.partitionBy("key", "block", "epoch").orderBy(hash32(F.lit("doc"), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    partly = read.where("NOT fits AND tokens <= left").withColumn("upto", F.sum("tokens").over(inside)).where("upto <= left").drop("upto")
    names = ["doc_id", "source", "tokens", F.col("epoch").cast("int").alias("epoch"), "block", F.col("block_rank").cast("int").alias("block_rank")]
    return read.where("fits").select(*names).union(partly.select(*names))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs in as many copies as the mix reads them, all columns as they were.

    Rows that share a doc_id share the count of its reads, rounded up for each."""
    reads = temperature_mix(docs, **options)
    held = reads.groupBy("doc_id").agg(F.count(F.lit(1)).alias("reads")).select("doc_id", "reads", F.lit(0).cast("long").alias("rows"))
    had = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("rows")).select("doc_id", F.lit(0).cast("long").alias("reads"), "rows")
    copies = held.union(had).groupBy("doc_id").agg(F.ceil(F.sum("reads") / F.sum("rows")).cast("int").alias("copies"))
    copies = cut(copies.where("copies > 0").withColumnRenamed("doc_id", "id"))
    whole = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return whole.join(copies, F.col("own_id").eqNullSafe(F.col("id"))).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temperature_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS key, len(regexp_extract_all(coalesce(text, ''), '{TOKENS}')) AS tokens FROM documents
), s AS (SELECT key, sum(tokens)::BIGINT AS held FROM d GROUP BY key HAVING sum(tokens) > 0),
t AS (SELECT sum(held)::BIGINT AS total, list(held) AS helds FROM s),
p AS (SELECT total, list_transform(helds, lambda x: x / total) AS ps FROM t),
b AS (
  SELECT 0 AS step, 0 AS low, {1 << STEPS} AS high, ps FROM p
  UNION ALL
  SELECT step + 1, CASE WHEN good THEN mid ELSE low END, CASE WHEN good THEN high ELSE mid END, ps FROM (
    SELECT *, ln(list_sum(list_transform(ps, lambda x: pow(x, mid / {1 << STEPS}))))
      - mid / {1 << STEPS} * list_sum(list_transform(ps, lambda x: pow(x, mid / {1 << STEPS}) * ln(x))) / list_sum(list_transform(ps, lambda x: pow(x, mid / {1 << STEPS})))
      >= {SPREAD} * ln(len(ps)) AS good
    FROM (SELECT *, (low + high) // 2 AS mid FROM b WHERE step < {STEPS})
  )
), a AS (
  SELECT CASE WHEN -list_sum(list_transform(ps, lambda x: x * ln(x))) >= {SPREAD} * ln(len(ps)) THEN 1.0::DOUBLE ELSE low / {1 << STEPS} END AS a FROM b WHERE step = {STEPS}
),
w AS (SELECT key, held, pow(held / total, a) AS raised, total FROM s, t, a),
q AS (SELECT key, held, floor(round(raised / (SELECT sum(raised) FROM w) * total, 3))::BIGINT AS quota, ceil(held / greatest(16384, ceil(total / 65536)))::BIGINT AS blocks FROM w),
n AS (SELECT *, 1000 * (held - quota % held) <= held AS nearly FROM q),
c AS (SELECT d.*, quota // q.held + nearly::BIGINT AS whole_passes, CASE WHEN nearly THEN 0 ELSE quota % q.held END AS rest, {HASH32_SQL.format("'block|' || d.doc_id")} % blocks AS block FROM d JOIN n q USING (key)),
k AS (SELECT key, block, whole_passes, rest, sum(tokens)::BIGINT AS held FROM c GROUP BY ALL),
e AS (SELECT *, unnest(range(0, whole_passes + 1)) AS epoch FROM k),
r AS (
  SELECT *, row_number() OVER o - 1 AS block_rank, sum(held) OVER o - held AS before FROM e
  WINDOW o AS (PARTITION BY key, epoch ORDER BY {HASH32_SQL.format("'order|' || key || '|' || epoch || '|' || block")}, block)
), u AS (SELECT *, CASE WHEN epoch < whole_passes THEN held ELSE rest - before END AS room FROM r),
z AS (
  SELECT c.doc_id, c.source, c.tokens, u.epoch, u.block, u.block_rank, u.held, u.room,
    sum(c.tokens) OVER (PARTITION BY c.key, u.block, u.epoch ORDER BY {HASH32_SQL.format("'doc|' || u.epoch || '|' || c.doc_id")}, c.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM c JOIN u ON c.key = u.key AND c.block = u.block WHERE room > 0 AND (room >= held OR c.tokens <= room)
)
SELECT doc_id, source, tokens, epoch::INTEGER AS epoch, block, block_rank::INTEGER AS block_rank FROM z WHERE room >= held OR upto <= room
"""
