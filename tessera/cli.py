"""Command line: extract, ingest, search, answer, audit.  Exit codes: 2 bad input, 3 something needed isn't there."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluate, quality, scope, services, store
from tessera.plans import pipelines
from tessera.sources import files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera")
    sub = out.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract")
    e.add_argument("--root", required=True)
    e.add_argument("--show-flagged", action="store_true")
    e.add_argument("--limit", type=int)
    i = sub.add_parser("ingest")
    i.add_argument("--root", required=True)
    i.add_argument("--store", required=True)
    which = i.add_mutually_exclusive_group()
    which.add_argument("--reprocess-scope", action="store_true")
    which.add_argument("--only", nargs="+", metavar="PATH")
    i.add_argument("--dry-run", action="store_true")
    for name in ("search", "answer"):
        s = sub.add_parser(name)
        s.add_argument("query", nargs="+")
        s.add_argument("--store", required=True)
        s.add_argument("--top-k", type=int, default=5)
    a = sub.add_parser("audit")
    a.add_argument("--store", required=True)
    a.add_argument("--samples", type=int, default=3)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    embed = services.hashing_embedder()
    if args.command in ("search", "answer", "audit"):
        current = store.read_snapshot(spark, args.store)
        if current.isEmpty():
            print("the store is empty", file=sys.stderr)
            return 3
    if args.command == "extract":
        docs = files.extract(files.scan(spark, args.root, limit=args.limit))
        quality.extraction_report(docs).orderBy("kind", F.desc("n")).show(100, truncate=False)
        if args.show_flagged:
            docs.where(F.size("flags") > 0).select("path", "flags").show(100, truncate=False)
    elif args.command == "ingest":
        try:
            scanned = files.scan(spark, args.root, paths=args.only)
        except AnalysisException as e:  # a path that isn't there
            print(e, file=sys.stderr)
            return 2
        extracted = files.extract(scanned)
        current = store.read_snapshot(spark, args.store)
        if args.only:
            after = pipelines.reprocess(current, extracted, scanned.select(F.col("path").alias("source_path")), embed)
        else:
            after = (pipelines.reprocess_scope if args.reprocess_scope else pipelines.ingest)(current, extracted, embed)
        if args.dry_run:
            after.groupBy("active", "indexable", "scope_label").count().show()
        else:
            print("snapshot", store.write_snapshot(after, args.store))
    elif args.command in ("search", "answer"):
        if not " ".join(args.query).strip():
            return 2
        queries = spark.createDataFrame([(0, " ".join(args.query))], "query_id long, text string")
        if args.command == "search":
            results, judged = pipelines.retrieve(current, queries, embed)
            judged.show(truncate=False)
            evaluate.retrieval_report(results, judged).show(truncate=False)
            results.where(F.col("rank") <= args.top_k).orderBy("rank").select("rank", "score", "source_path", "article_ref", "text").show(truncate=80)
        else:
            answers = pipelines.ask(current, queries, embed, services.echo_generator)
            answers.show(truncate=False)
            evaluate.answer_report(answers).show(truncate=False)
    else:
        active = current.where("active")
        opening = evaluate.opening_texts(active).join(evaluate.document_titles(active), "source_path")
        opening.select("source_path", scope.document_scope(F.col("title"), F.col("opening")).alias("s")).groupBy("s.disposition").count().show()
        evaluate.scope_audit(active).orderBy(F.desc("off_domain")).show(100, truncate=False)
        evaluate.audit_samples(active, args.samples).select("source_path", "chunk_index", "excerpt").show(100, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
