"""`python -m pagelode.jobs.cli <job> ...`: one sub-command per tool (CLI-01..04).

Every job reads and writes folders, takes its limits as options and runs on the session that `spark-submit` gives it.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagelode.functions import text
from pagelode.operators import cleaning, eda, sampling
from pagelode.operators.leakage import LeakageConfig, leakage
from pagelode.session import build_session, ship_package
from pagelode.sources import readers, sinks


def _clean(spark: SparkSession, a) -> None:
    pages = spark.read.parquet(a.input)
    flagged = cleaning.mark_duplicate_urls(cleaning.mark_bad_titles(cleaning.mark_empty_html(pages)), a.order.split(","))
    sinks.write_pages(cleaning.drop_bad_rows(flagged, not a.keep_duplicates), a.output, a.by.split(","))


def _leakage(spark: SparkSession, a) -> None:
    leakage(spark.read.parquet(a.train), spark.read.parquet(a.test), LeakageConfig(url_limit=a.url_limit, html_limit=a.html_limit)).write.parquet(a.output)


def _difficulty(spark: SparkSession, a) -> None:
    scores = sampling.ensemble([spark.read.parquet(p) for p in a.scores])
    if a.filters:
        scores = sampling.apply_filters(scores, [readers.filter_table(spark, p) for p in a.filters])
    kept = sampling.difficulty_filter(scores, a.positive, delta=a.delta, drop=a.drop)
    scores.join(kept.select("sha256"), "sha256", "left_anti").select("sha256").write.parquet(a.output)


def _filters(spark: SparkSession, a) -> None:
    rows = spark.read.parquet(a.input)
    sampling.apply_filters(rows, [readers.filter_table(spark, p) for p in a.filters]).write.parquet(a.output)


def _targets(spark: SparkSession, a) -> None:
    eda.target_counts(spark.read.parquet(a.input), text.clean_target(F.col("target")), a.min_count, tuple(a.exclude)).write.json(a.output)


def _names(spark: SparkSession, a) -> None:
    """CLI-01: name candidates of urls, probable ones only."""
    each = spark.read.parquet(a.input).select("sha256", "url", F.explode(text.pii_candidates(F.col("url"))).alias("name"))
    sinks.append_json(each.where(text.is_probable_name(F.col("name"))).dropDuplicates(["sha256", "name"]), a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagelode")
    jobs = p.add_subparsers(dest="job", required=True)

    def job(name: str, run: Callable, *options: tuple) -> None:
        j = jobs.add_parser(name)
        for flag, kw in options:
            j.add_argument(flag, **kw)
        j.add_argument("--output", required=True)
        j.set_defaults(run=run)

    needed, many = {"required": True}, {"nargs": "*", "default": []}
    job("clean", _clean, ("--input", needed), ("--order", {"default": "date,sha256"}), ("--by", {"default": "split,label"}), ("--keep-duplicates", {"action": "store_true"}))
    job("leakage", _leakage, ("--train", needed), ("--test", needed), ("--url-limit", {"type": float, "default": 0.1}), ("--html-limit", {"type": float, "default": 0.2}))
    job("difficulty", _difficulty, ("--scores", {"nargs": "+", "required": True}), ("--filters", many), ("--positive", {"action": "store_true"}), ("--delta", {"type": float, "default": 0.15}), ("--drop", {"type": float, "default": 0.1}))
    job("apply-filters", _filters, ("--input", needed), ("--filters", many))
    job("targets", _targets, ("--input", needed), ("--min-count", {"type": int, "default": 1}), ("--exclude", many))
    job("names", _names, ("--input", needed))
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session(f"pagelode-{args.job}")
    ship_package(spark)
    args.run(spark, args)


if __name__ == "__main__":
    main()
