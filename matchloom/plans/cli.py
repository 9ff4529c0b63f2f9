"""Command line: ``spark-submit -m`` style entry of every job, paths as arguments.

    python -m matchloom.plans.cli raw LANDING OUT
    python -m matchloom.plans.cli base-a RAW OUT --code 27408
    python -m matchloom.plans.cli base-b BASE_A OUT
    python -m matchloom.plans.cli matrix BASE_A BASE_B PAIRS MATRIX --min-score 0.9
    python -m matchloom.plans.cli all LANDING OUT
    python -m matchloom.plans.cli podcast SHOW_PAGES EPISODE_PAGES OUT --name N --phrase P
    python -m matchloom.plans.cli extracts TABLE PATH [PATH ...] --format csv
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from matchloom.operators.noise import NoiseShares
from matchloom.plans import extracts, linkage, podcast
from matchloom.session import SETTINGS

NOISE_KINDS = ("missing", "one_word", "two_words")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="matchloom")
    jobs = top.add_subparsers(dest="job", required=True)

    def linkage_job(name: str, *paths: str) -> None:
        job = jobs.add_parser(name)
        for p in paths:
            job.add_argument(p)
        base = linkage.LinkageConfig()
        job.add_argument("--encoding")
        job.add_argument("--csv-compat", action="store_true")
        job.add_argument("--code", default=base.code)
        job.add_argument("--id-keys", nargs="*", default=list(base.id_keys))
        job.add_argument("--line-ids", action="store_true", default=base.line_ids)
        job.add_argument("--lost-score", type=float, default=base.lost_score)
        job.add_argument("--fraction", type=float, default=base.fraction)
        job.add_argument("--limit", type=int, default=base.limit)
        job.add_argument("--sample-seed", default=base.sample_seed)
        job.add_argument("--extraction-time", action="store_true")
        for kind in NOISE_KINDS:
            job.add_argument(f"--{kind.replace('_', '-')}", type=float, default=getattr(base.shares, kind))
        job.add_argument("--within", nargs="*", default=list(base.within))
        job.add_argument("--min-score", type=float, default=base.min_score)
        job.add_argument("--strict", action="store_true")
        job.add_argument("--partition-by", nargs="*", default=list(base.partition_by))

    linkage_job("raw", "landing", "out")
    linkage_job("base-a", "raw", "out")
    linkage_job("base-b", "base_a", "out")
    linkage_job("matrix", "base_a", "base_b", "pairs", "matrix")
    linkage_job("all", "landing", "out")

    pages = jobs.add_parser("podcast")
    for p in ("show_pages", "episode_pages", "out"):
        pages.add_argument(p)
    pages.add_argument("--name", required=True)
    pages.add_argument("--phrase", required=True)

    files = jobs.add_parser("extracts")
    files.add_argument("table")
    files.add_argument("paths", nargs="+")
    files.add_argument("--format", default="csv")
    files.add_argument("--sales-names", action="store_true")
    files.add_argument("--table-path")
    files.add_argument("--jdbc-url")
    return top


def config(args: argparse.Namespace) -> linkage.LinkageConfig:
    return linkage.LinkageConfig(
        encoding=args.encoding,
        csv_compat=args.csv_compat,
        code=args.code,
        id_keys=tuple(args.id_keys),
        line_ids=args.line_ids,
        lost_score=args.lost_score,
        fraction=args.fraction,
        limit=args.limit,
        sample_seed=args.sample_seed,
        extraction_time=args.extraction_time,
        shares=NoiseShares(**{kind: getattr(args, kind) for kind in NOISE_KINDS}),
        within=tuple(args.within),
        min_score=args.min_score,
        strict=args.strict,
        partition_by=tuple(args.partition_by),
    )


def run(spark: SparkSession, args: argparse.Namespace) -> object:
    if args.job == "podcast":
        return podcast.pages_to_csv(
            spark, args.show_pages, args.episode_pages, args.out, args.name, args.phrase
        )
    if args.job == "extracts":
        names = extracts.SALES_NAMES if args.sales_names else None
        return extracts.files_to_table(
            spark,
            args.paths,
            args.table,
            args.format,
            names,
            table_path=args.table_path,
            jdbc_url=args.jdbc_url,
        )
    cfg = config(args)
    if args.job == "raw":
        return linkage.landing_to_raw(spark, args.landing, args.out, cfg)
    if args.job == "base-a":
        return linkage.raw_to_base_a(spark, args.raw, args.out, cfg)
    if args.job == "base-b":
        return linkage.base_a_to_base_b(spark, args.base_a, args.out, cfg)
    if args.job == "matrix":
        return linkage.bases_to_matrix(
            spark, args.base_a, args.base_b, args.pairs, args.matrix, cfg
        )
    return linkage.run_linkage(spark, args.landing, args.out, cfg)


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName(f"matchloom-{args.job}")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    print(json.dumps(run(builder.getOrCreate(), args)))


if __name__ == "__main__":
    main()
