"""Command line.

python -m pointweave.cli query NAME --source DIR [--json FILE] [--report FILE] [--output DIR] [--profile MANIFEST]
python -m pointweave.cli report NAME --source DIR [--json FILE] [--report FILE] [--snapshot ID] [--render-existing]
python -m pointweave.cli points --points GLOB [--expected N] [--output DIR]
python -m pointweave.cli matches --matches GLOB [--output DIR]
python -m pointweave.cli context --context-source DIR [--output DIR]
python -m pointweave.cli review --automated FILE --human FILE
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions import text
from pointweave.operators import integrity
from pointweave.plans import registry
from pointweave.sources import readers, reports

REVIEW_FIELDS = ("review_status", "review_notes")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pointweave.cli", description="Run queries and reports, or read point files.")
    sub = p.add_subparsers(dest="command", required=True)
    for command, names in (("query", sorted(registry.queries())), ("report", sorted(reports.REPORTS))):
        c = sub.add_parser(command)
        c.add_argument("name", choices=names)
        c.add_argument("--source", help="folder of the Parquet tables")
        c.add_argument("--json", help="file for a small result")
        c.add_argument("--report", help="file for a Markdown report of a small result")
        c.add_argument("--profile", help="JSON file of file names and SHA-256 that the source must have")
        c.add_argument("--snapshot", help="name of the snapshot, kept in the JSON and checked when it is rendered again")
        c.add_argument("--render-existing", action="store_true", help="render the report from the saved --json, without Spark")
        c.add_argument("--output", help="folder for a query's whole result as Parquet")
    files = {"points": ["--points"], "matches": ["--matches"], "context": ["--context-source"], "review": ["--automated", "--human"]}
    for command, options in files.items():
        c = sub.add_parser(command)
        for o in options:
            c.add_argument(o, required=True)
        c.add_argument("--expected", type=int, help="number of files that the pattern must name")
        c.add_argument("--output", help="folder for the rows as Parquet")
    return p


def table(df: DataFrame) -> dict:
    return {"columns": df.columns, "rows": reports.collected(df)}


def run_query(spark: SparkSession, args: argparse.Namespace) -> dict:
    df = registry.queries()[args.name](spark, args.source)
    if args.output:
        df.write.mode("errorifexists").parquet(args.output)
        df = spark.read.parquet(args.output)
    small = args.json or args.report or not args.output
    return {"title": args.name, "source": args.source, "snapshot": args.snapshot, **(table(df) if small else {"columns": df.columns, "rows": []})}


def run_report(spark: SparkSession, args: argparse.Namespace) -> dict:
    sections = reports.REPORTS[args.name][2]
    tables = {h: table(registry.queries()[q](spark, args.source)) for h, q in sections.items()}
    return {"title": args.name, "source": args.source, "snapshot": args.snapshot, "tables": tables}


def rendered(args: argparse.Namespace, result: dict) -> str:
    return reports.markdown(result) if args.command == "query" else reports.report(args.name, result["source"], result["tables"])


def review(spark: SparkSession, automated: str, human: str) -> DataFrame:
    """Decisions by status; fails where ids differ or evidence was changed."""
    sides = []
    for path in (automated, human):
        raw = readers.read_csv(spark, path, ["mcp_match_id", "status"], readers.sniffed(spark, path)).drop("source_file")
        dates, flags = ([c for c in raw.columns if c.endswith(e)] for e in ("_date", "_agrees"))
        sides.append(raw.withColumns({c: text.iso_date(F.col(c)) for c in dates} | {c: text.plain_boolean(F.col(c)) for c in flags}))
    fields = [c for c in sides[0].columns if c not in (*REVIEW_FIELDS, "mcp_match_id")]
    changed = reports.collected(integrity.evidence_changes(sides[0], sides[1], "mcp_match_id", fields))
    if changed:
        raise ValueError(f"the review changed evidence of {len(changed)} rows: {changed[:3]}")
    return sides[1].groupBy("status", F.lower(F.trim("review_status")).alias("decision")).agg(F.count(F.lit(1)).alias("rows"))


def read_files(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.command == "review":
        return review(spark, args.automated, args.human)
    if args.command == "points":
        rows = readers.read_points(spark, readers.discover(spark, args.points, args.expected))
        summary = rows.groupBy(F.coalesce("error", F.lit("ok")).alias("error"))
    elif args.command == "matches":
        rows = readers.read_matches(spark, readers.discover(spark, args.matches, args.expected)).select("match_id", "copies", "conflicting", "invalid_date", "invalid_surface", "invalid_best_of", "safe", "row.*")
        summary = rows.groupBy("safe")
    else:
        rows = readers.read_context(spark, args.context_source)
        summary = rows.groupBy("tour", "family", "valid")
    if args.output:
        rows.write.mode("errorifexists").parquet(args.output)
    return summary.agg(F.count(F.lit(1)).alias("rows"))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if getattr(args, "render_existing", False):
        if not (args.json and args.report):
            p.error("--render-existing needs --json and --report")
        saved = reports.load_json(args.json)
        if args.snapshot:
            reports.require_snapshot(saved, args.snapshot)
        Path(args.report).write_text(rendered(args, saved), encoding="utf-8")
        return 0
    if args.command in ("query", "report") and not args.source:
        p.error("--source is needed")
    spark = spark or SparkSession.builder.appName("pointweave").getOrCreate()
    if args.command not in ("query", "report"):
        sys.stdout.write(reports.markdown({"title": args.command, "source": "files", **table(read_files(spark, args))}))
        return 0
    if args.profile:
        reports.pinned(spark, f"{args.source}/*.parquet", reports.load_json(args.profile))
    result = run_query(spark, args) if args.command == "query" else run_report(spark, args)
    if args.json:
        reports.save_json(result, args.json)
    if args.report:
        Path(args.report).write_text(rendered(args, result), encoding="utf-8")
    elif not args.json and not args.output:
        sys.stdout.write(rendered(args, result))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
