"""Command line.

    run --data DIR --out DIR QUERY...         write the results of queries
    load --csv FILE --out DIR                 articles of a CSV file as DIR/articles.parquet
    eda --data DIR --out DIR --section N|all  tables of an exploration section, with a summary on the screen
    prepare --data DIR --out DIR              the corpus of each rollup, with a manifest of digests
    embed --corpus FILE --out DIR             vectors of the corpus
    experiment --corpus FILE --out DIR ...    a whole classification scenario
    drift --corpus FILE --vectors FILE ...    a drift run (statistical or semantic)
    report --runs DIR --out DIR               the report on the statistical drift runs
    digest --file FILE --register FILE        check a file against its registered digest, and extract it if asked to
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .operators import encoders
from .operators.corpus import numbered
from .plans import reports, scenario
from .plans.base import LAST_MONTH, articles
from .plans.corpus import THRESHOLD
from .plans.queries import QUERIES
from .schemas import ANCHORS, FIVE
from .session import build_session, scratch
from .sources import artifacts, tables


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="vazante", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, **needed: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name)
        for option, text in needed.items():
            own.add_argument(f"--{option}", required=True, help=text)
        return own

    run = command("run", data="folder of tables", out="folder of results")
    run.add_argument("--csv", action="store_true", help="write one CSV file a query instead of Parquet")
    run.add_argument("query", nargs="+", help="names of queries, or all")
    command("load", csv="file", out="folder of tables")
    command("eda", data="folder of tables", out="folder of results", section="1 to 8, or all")
    prepare = command("prepare", data="folder of tables", out="folder of results")
    prepare.add_argument("--threshold", type=int, default=THRESHOLD, help="rows of a frequent class")
    prepare.add_argument("--rollups", nargs="+", choices=scenario.ROLLUPS, default=list(scenario.ROLLUPS))
    embed = command("embed", corpus="prepared corpus", out="root folder")
    embed.add_argument("--width", type=int, default=64)
    embed.add_argument("--limit", type=int, help="articles of a smoke run")
    experiment = command("experiment", corpus="prepared corpus", out="root folder", family=f"one of {sorted(scenario.FAMILIES)}")
    experiment.add_argument("--rollup", choices=scenario.ROLLUPS, default=scenario.PRIMARY[0])
    experiment.add_argument("--protocol", choices=scenario.PROTOCOLS, default=scenario.PRIMARY[1])
    experiment.add_argument("--regime", choices=scenario.REGIMES, default=scenario.PRIMARY[2])
    experiment.add_argument("--hp-from", help="folder of the primary run")
    experiment.add_argument("--pairs", help="CSV file of near-duplicate pairs, left out if it is not there")
    experiment.add_argument("--limit", type=int, help="articles of a smoke run")
    drift = command("drift", corpus="prepared corpus", vectors="vectors of it", out="root folder")
    drift.add_argument("--block", choices=("statistical", "semantic"), default="statistical")
    drift.add_argument("--granularity", choices=sorted(reports.GRANULARITIES), default="mensal")
    drift.add_argument("--scope", choices=artifacts.SCOPES, default="global")
    drift.add_argument("--period", nargs=2, default=["2015-01-01", LAST_MONTH], metavar=("FROM", "TO"))
    drift.add_argument("--repetitions", type=int, default=5)
    drift.add_argument("--permutations", type=int, default=100)
    drift.add_argument("--limit-pairs", type=int, help="pairs of windows of a smoke run")
    command("report", runs="folder of run folders", out="folder of reports")
    digest = command("digest", file="file", register="file of its digest")
    digest.add_argument("--extract", help="folder to extract a checked archive to")
    return parser


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if args.command == "digest":
        if not tables.check_digest(args.file, args.register):
            return 2
        if args.extract:
            tables.unzip(args.file, args.extract)
        return 0
    spark = build_session()
    with scratch(spark):
        return _COMMANDS[args.command](spark, args, parser)


def _run(spark, args, parser) -> int:
    names = list(QUERIES) if args.query == ["all"] else args.query
    if unknown := [n for n in names if n not in QUERIES]:
        parser.error(f"unknown queries: {', '.join(unknown)}")
    for name in names:
        with scratch(spark):
            (artifacts.write_csv if args.csv else artifacts.write_table)(QUERIES[name](spark, args.data), f"{args.out}/{name}")
    return 0


def _load(spark, args, parser) -> int:
    rows = tables.read_articles_csv(spark, args.csv).select("title", "text", "date", "category", "subcategory", "link")
    # ids in order of the file: rows of a split follow each other, and splits are numbered in order
    rows = rows.withColumn("__line", F.monotonically_increasing_id())
    ids = numbered(rows.select("__line"), [F.col("__line").asc()], "article_id")
    artifacts.write_table(rows.join(ids, "__line").drop("__line"), f"{args.out}/articles.parquet")
    return 0


def _eda(spark, args, parser) -> int:
    if args.section != "all" and (not args.section.isdigit() or int(args.section) not in reports.EDA):
        parser.error(f"section is one of {sorted(reports.EDA)} or all")
    for number in sorted(reports.EDA) if args.section == "all" else [int(args.section)]:
        with scratch(spark):
            reports.eda_section(spark, args.data, number, args.out)
    return 0


def _prepare(spark, args, parser) -> int:
    print(scenario.prepare(articles(spark, args.data), args.out, args.threshold, ANCHORS, FIVE, args.rollups))
    return 0


def _embed(spark, args, parser) -> int:
    corpus = scenario.limited(spark.read.parquet(args.corpus), args.limit)
    folder = artifacts.drift_folder(args.out, "embeddings", "hashed_words")
    width, make = args.width, encoders.HashedWords
    artifacts.write_table(encoders.embed(corpus, lambda: make(width)), str(folder / "embeddings.parquet"))
    artifacts.write_json(folder / "metadata.json", artifacts.metadata(2026, bloco="embeddings", largura=width, limite_artigos=args.limit))
    print(folder)
    return 0


def _experiment(spark, args, parser) -> int:
    pairs = tables.read_pairs_if_there(spark, args.pairs)
    corpus = spark.read.parquet(args.corpus)
    print(scenario.run_scenario(corpus, args.family, args.rollup, args.protocol, args.regime, args.out, args.hp_from, pairs, args.limit))
    return 0


def _drift(spark, args, parser) -> int:
    corpus = spark.read.parquet(args.corpus).select("link", F.col("y_original").alias("category"))
    one = corpus.groupBy("link").agg(F.min("category").alias("category"))
    vectors = spark.read.parquet(args.vectors).filter("embedding is not null and day is not null")
    vectors = vectors.groupBy("link").agg(F.min_by("embedding", F.struct("day", F.to_json("embedding"))).alias("embedding"), F.min("day").alias("day"))
    print(reports.run_drift(vectors, one, args.out, args.block, args.granularity, args.scope, tuple(args.period), args.repetitions, args.permutations, args.limit_pairs))
    return 0


def _report(spark, args, parser) -> int:
    print(reports.drift_report(spark, args.runs, args.out))
    return 0


_COMMANDS = {"run": _run, "load": _load, "eda": _eda, "prepare": _prepare, "embed": _embed, "experiment": _experiment, "drift": _drift, "report": _report}


if __name__ == "__main__":
    sys.exit(main())
