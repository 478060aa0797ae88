"""Calibration, recall, audits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.dense import hydrate
from tessera.operators.fusion import classify
from tessera.operators.lexical import DIGITS

BUCKETS = 1024


def half_up(c: Column) -> Column:
    """Rounded to DIGITS by the product, as the mean of two rounded numbers often lies halfway between two others."""
    return F.round(c * 10**DIGITS) / 10**DIGITS


def separation(scores: DataFrame) -> DataFrame:
    """cutoff, tpr, fpr, j of every observed score.  scores: score, positive.

    Distinct scores are counted first.  They lie in BUCKETS equal ranges: running sums go over the ranges, a bounded
    table, and within each range, so that no task sees all scores."""
    counts = scores.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    ends = scores.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    low, high = ends.select("low").scalar(), ends.select("high").scalar()
    place = F.floor((F.col("score") - low) / F.nullif(high - low, F.lit(0)) * BUCKETS)
    counts = counts.withColumn("_b", F.least(F.coalesce(place, F.lit(0)), F.lit(BUCKETS - 1)))
    above, whole = Window.orderBy(F.desc("_b")), Window.partitionBy(F.lit(1))
    ranges = counts.groupBy("_b").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    ranges = ranges.select("_b", *((F.sum(c).over(above) - F.col(c)).alias(f"{c}_above") for c in "pn"), *(F.sum(c).over(whole).alias(f"{c}_all") for c in "pn"))
    up = Window.partitionBy("_b").orderBy(F.desc("score"))
    rows = counts.join(F.broadcast(ranges), "_b").select(F.col("score").alias("cutoff"), *(((F.col(f"{c}_above") + F.sum(c).over(up)) / F.col(f"{c}_all")).alias(r) for c, r in (("p", "tpr"), ("n", "fpr"))))
    return rows.withColumn("j", F.round(F.col("tpr") - F.col("fpr"), DIGITS))


def best_separation(scores: DataFrame) -> DataFrame:
    """The cutoff of the greatest Youden's J; of equal ones the smallest."""
    return separation(scores).orderBy(F.desc("j"), "cutoff").limit(1).select("j", "cutoff", "tpr", "fpr")


def recommend(scores: DataFrame) -> DataFrame:
    """threshold, floor, clean: both inside the gap between the classes if there is one, else the best cutoff and the least positive; down to 5 decimals."""
    ends = scores.agg(F.min(F.when(F.col("positive"), F.col("score"))).alias("low"), F.max(F.when(~F.col("positive"), F.col("score"))).alias("high"))
    gap = F.col("low") - F.col("high")
    rows = ends.withColumn("cutoff", best_separation(scores).select("cutoff").scalar())

    def down(c: Column) -> Column:
        return F.floor(c * 100000) / 100000

    clean = F.col("low") > F.col("high")
    return rows.select(
        F.when(clean, down(F.col("high") + 0.75 * gap)).otherwise(down(F.col("cutoff"))).alias("threshold"),
        F.when(clean, down(F.col("high") + 0.25 * gap)).otherwise(down(F.col("low"))).alias("floor"), clean.alias("clean"),
    )


def gate_signals(fused: DataFrame, weights: DataFrame, coverage: DataFrame) -> DataFrame:
    """Six candidate signals a query.  fused: query_id, rank, dense_score, lexical_score; weights: query_id, total (sum of idf of its terms)."""
    first = F.max(F.when(F.col("rank") == 1, F.col("dense_score")))
    tops = fused.groupBy("query_id").agg(F.coalesce(first, F.max(F.coalesce("dense_score", F.lit(0.0)))).alias("d"), F.max(F.coalesce("lexical_score", F.lit(0.0))).alias("x"))
    rows = weights.join(tops, "query_id", "left").join(coverage, "query_id", "left").withColumns({"d": F.coalesce("d", F.lit(0.0)), "c": F.coalesce("coverage", F.lit(0.0)), "l": F.when((F.col("total") > 0) & F.col("x").isNotNull(), F.col("x") / F.col("total")).otherwise(0.0)})
    c = F.when(F.col("x").isNull(), 0.0).otherwise(F.col("c"))
    return rows.select("query_id", F.col("d").alias("dense_top1"), F.round("l", DIGITS).alias("lexical_norm"), F.round(c, DIGITS).alias("coverage_topk"), F.round(F.col("d") * c, DIGITS).alias("dense_x_coverage"), F.round(F.col("d") * F.col("l"), DIGITS).alias("dense_x_lexnorm"), half_up((F.col("d") + c) / 2).alias("mean_dense_cov"))


def gate_report(probes: DataFrame, threshold: float, floor: float) -> DataFrame:
    """right, total, flips: decisions that fit the label, as typed and folded, and decisions that folding turns.

    probes: answerable, typed, folded (scores)."""
    typed, folded = (classify(F.col(c), threshold, floor) for c in ("typed", "folded"))
    right = [F.count_if((d != "NOT_FOUND") == F.col("answerable")).alias(n) for n, d in (("right_typed", typed), ("right_folded", folded))]
    return probes.agg(*right, F.count(F.lit(1)).alias("total"), F.count_if(typed != folded).alias("flips"))


def path_accuracy(probes: DataFrame, dense: tuple[float, float], fused: tuple[float, float]) -> DataFrame:
    """path, right_typed, right_folded, total, flips: ``gate_report`` of the dense and of the fused scores, each with its (threshold, floor).

    probes: answerable, dense, dense_folded, fused, fused_folded."""

    def judged(path: str, cutoffs: tuple[float, float]) -> DataFrame:
        scores = probes.select("answerable", F.col(path).alias("typed"), F.col(f"{path}_folded").alias("folded"))
        return gate_report(scores, *cutoffs).withColumn("path", F.lit(path))

    return judged("dense", dense).unionByName(judged("fused", fused))


def leaks(probes: DataFrame, threshold: float, floor: float) -> DataFrame:
    """Off-domain probes that the gate doesn't refuse, with their decision.  probes: off_domain, fused."""
    return probes.where("off_domain").withColumn("decision", classify(F.col("fused"), threshold, floor)).where("decision <> 'NOT_FOUND'")


def off_domain_sweep(probes: DataFrame, threshold: float, floor: float) -> DataFrame:
    """refused, total: off-domain probes that the gate turns away, of all."""
    refused = F.count_if(classify(F.col("fused"), threshold, floor) == "NOT_FOUND")
    return probes.where("off_domain").agg(refused.alias("refused"), F.count(F.lit(1)).alias("total"))


def answer_report(answers: DataFrame) -> DataFrame:
    """By status: answers, weak ones, mean confidence, sources retrieved and dropped for space, citations, labels never supplied."""
    return answers.groupBy("status").agg(
        F.count(F.lit(1)).alias("answers"), F.count_if("low_confidence").alias("weak"), F.round(F.avg("confidence"), DIGITS).alias("mean_confidence"), F.sum("chunks_retrieved").alias("retrieved"),
        F.sum("chunks_dropped").alias("dropped"), F.sum(F.size("citations")).alias("cited"), F.sum(F.size("hallucinated_labels")).alias("hallucinated"),
    )


def retrieval_report(results: DataFrame, judged: DataFrame) -> DataFrame:
    """By decision: queries, mean confidence and coverage, results that both rankers, only the dense or only the lexical one found."""
    d, x = F.col("dense_rank").isNotNull(), F.col("lexical_rank").isNotNull()
    found = results.groupBy("query_id").agg(F.count_if(d & x).alias("both"), F.count_if(d & ~x).alias("dense_only"), F.count_if(x & ~d).alias("lexical_only"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("both", "dense_only", "lexical_only")]
    means = [F.round(F.avg(c), DIGITS).alias(f"mean_{c}") for c in ("confidence", "coverage")]
    return judged.join(found, "query_id", "left").groupBy("decision").agg(F.count(F.lit(1)).alias("queries"), *means, *sums)


def score_distribution(scores: DataFrame) -> DataFrame:
    """least, median, mean and greatest score of each class."""
    return scores.groupBy("positive").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.median("score").alias("median"), F.round(F.avg("score"), DIGITS).alias("mean"), F.max("score").alias("most"))


def recall_at(hits: DataFrame, labels: DataFrame, titles: DataFrame, depths: tuple[int, ...] = (10, 25, 50)) -> DataFrame:
    """depth, found, total: queries with a hit of that depth whose title contains what was expected.

    hits: query_id, id, rank; labels: query_id, expected; titles: id, title."""
    good = hydrate(hits.join(labels, "query_id"), titles).where(F.contains("title", "expected")).groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = labels.join(good, "query_id", "left").select(F.explode(F.array(*map(F.lit, depths))).alias("depth"), "first")
    return rows.groupBy("depth").agg(F.count_if(F.col("first") <= F.col("depth")).alias("found"), F.count(F.lit(1)).alias("total"))


def scope_audit(chunks: DataFrame) -> DataFrame:
    """Label counts by document and, with a null source_path, in total.  chunks: source_path, scope_label."""
    kinds = {"electricity": "ELECTRICITY", "off_domain": "OFF_DOMAIN", "ambiguous": "AMBIGUOUS"}
    rows = chunks.rollup("source_path").agg(*(F.count_if(F.col("scope_label") == v).alias(k) for k, v in kinds.items()), F.count(F.lit(1)).alias("chunks"))
    return rows.withColumn("off_share", F.round(F.col("off_domain") / F.col("chunks"), DIGITS))


def audit_samples(chunks: DataFrame, n: int = 3, label: str = "OFF_DOMAIN") -> DataFrame:
    """The first n chunks of a label in each document, their text on one line of at most 300 characters."""
    order = Window.partitionBy("source_path").orderBy("chunk_index")
    rows = chunks.where(F.col("scope_label") == label).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    return rows.withColumn("excerpt", F.substring(F.regexp_replace(F.trim("text"), r"(?U)\s+", " "), 1, 300)).drop("_n")


def document_titles(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_path").agg(F.max("document_title").alias("title"))


def opening_texts(chunks: DataFrame, n: int = 2) -> DataFrame:
    """source_path, opening: the first n chunks of each document, a line feed apart."""
    order = Window.partitionBy("source_path").orderBy("chunk_index")
    first = chunks.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    return first.groupBy("source_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("opening"))


def tokenizer_report(counts: DataFrame, target: int, context: int) -> DataFrame:
    """Tokens by word and shares over the target.  counts: words, tokens."""
    return counts.agg(
        F.count(F.lit(1)).alias("chunks"), F.round(F.avg(F.when(F.col("words") > 0, F.col("tokens") / F.col("words"))), DIGITS).alias("mean_ratio"),
        F.round(F.median(F.when(F.col("words") > 0, F.col("tokens") / F.col("words"))), DIGITS).alias("median_ratio"), F.max("tokens").alias("most"),
        F.count_if(F.col("tokens") > target).alias("over_target"), F.count_if(F.col("tokens") > target * 1.5).alias("over_by_half"), F.count_if(F.col("tokens") > context).alias("over_context"),
    )


def stratified_sample(rows: DataFrame, target: int, *, stratum: str = "strategy", size: str = "tokens", tie: str = "id") -> DataFrame:
    """Every n-th row by size within each stratum, an equal number of each at most."""
    strata = rows.select(stratum).distinct().agg(F.count(F.lit(1)).alias("k"))
    share = F.greatest(F.lit(1), F.floor(F.lit(target) / F.greatest(F.lit(1), strata.select("k").scalar())))
    order = Window.partitionBy(stratum)
    ranked = rows.withColumns({"_share": share, "_i": F.row_number().over(order.orderBy(size, tie)) - 1, "_n": F.count(F.lit(1)).over(order)})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / F.col("_share")))
    return ranked.where((F.col("_i") % step == 0) & (F.floor(F.col("_i") / step) < F.col("_share"))).drop("_share", "_i", "_n")
