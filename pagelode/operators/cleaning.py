"""Heuristic flags and the review of look-alike groups (FLT-01..04, FLT-09, WIN-01, AGG-10..14, CLN-*)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.session import broadcast_if_small, stored

# What titles of error pages contain.
BAD_TITLES = (
    "400",
    "404",
    "410",
    "403",
    "found",
    "encontrada",
    "forbidden",
    "error",
    "suspended",
    "bad request",
    "cloudflare",
    "just a moment...",
    "warning! | there might be a problem with the requested link",
    "url shortener, branded short links & analytics | tinyurl",
    "denied",
)
# Spellings of the two classes.
PHISH, BENIGN = ("phish", "phishing", "phishes", "1"), ("benign", "benigns", "0", "-1")


def canonical_label(label: Column) -> Column:
    """`phish` or `benign` for any known spelling, else null."""
    key = F.lower(F.trim(label.cast("string")))
    return F.when(key.isin(*PHISH), "phish").when(key.isin(*BENIGN), "benign")


def mark_empty_html(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """FLT-01: `empty_html` where html is null or '', without trimming."""
    return pages.withColumn("empty_html", F.col(html_col).isNull() | (F.col(html_col) == ""))


def mark_bad_titles(pages: DataFrame, title_col: str = "title", words: tuple[str, ...] = BAD_TITLES) -> DataFrame:
    """FLT-02: `bad_title` where the title contains one of `words`, in any case; null titles are not bad."""
    pattern = "(?iu)" + "|".join(re.escape(w) for w in words)
    return pages.withColumn("bad_title", F.coalesce(F.col(title_col).rlike(pattern), F.lit(False)))


def mark_duplicate_urls(pages: DataFrame, order_by: list[str], url_col: str = "url") -> DataFrame:
    """WIN-01: `duplicate_url` for all but the first row of each url in the given order; null urls are one group.

    The first row's order key is aggregated per url and joined back, so a url with very many rows is never sorted in
    one task. Rows that are equal in the whole order key all count as first.
    """
    key = F.struct(*order_by)
    first = pages.groupBy(F.col(url_col).alias("__u")).agg(F.min(key).alias("__first"))
    marked = pages.join(first, F.col(url_col).eqNullSafe(F.col("__u")), "left")
    return marked.withColumn("duplicate_url", key != F.col("__first")).drop("__u", "__first")


def drop_bad_rows(pages: DataFrame, drop_duplicates: bool = True) -> DataFrame:
    """FLT-03, FLT-04: rows without a flag; without `drop_duplicates` the duplicate flag stays as a column."""
    kept = pages.where(~F.col("bad_title") & ~F.col("empty_html"))
    if drop_duplicates:
        return kept.where(~F.col("duplicate_url")).drop("duplicate_url", "bad_title", "empty_html")
    return kept.drop("bad_title", "empty_html")


def update_keep(pages: DataFrame, ids: DataFrame, value: bool, id_col: str = "id") -> DataFrame:
    """FLT-09: set `keep` of the rows in `ids`, leave the others."""
    hit = ids.select(F.col(id_col)).distinct().withColumn("__hit", F.lit(True))
    out = pages.join(broadcast_if_small(hit), id_col, "left")
    return out.withColumn("keep", F.when(F.col("__hit"), F.lit(value)).otherwise(F.col("keep"))).drop("__hit")


def reject_stats(pages: DataFrame, label_col: str = "label") -> DataFrame:
    """AGG-10: rejected and reviewed rows per label."""
    return pages.where("keep is not null").groupBy(label_col).agg(F.count_if(~F.col("keep")).alias("rejected"), F.count(F.lit(1)).alias("reviewed"))


def progress(pages: DataFrame) -> DataFrame:
    """AGG-11: one row of counts and percentages; zeros for an empty table."""
    counts = pages.agg(F.count(F.lit(1)).alias("total"), F.count("keep").alias("processed"), F.count_if(F.col("keep")).alias("kept"), F.count_if(~F.col("keep")).alias("rejected"))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c) * 100, F.col("total")), F.lit(0.0)), 6).alias(f"{c}_pct")
    return counts.select("total", "processed", "kept", "rejected", share("processed"), share("kept"), share("rejected"))


def group_coverage(pages: DataFrame, group_col: str, threshold: float = 0.8) -> DataFrame:
    """AGG-13: size, reviewed rows and coverage of each group."""
    out = pages.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"), F.count("keep").alias("reviewed"))
    out = out.withColumn("coverage", F.round(F.col("reviewed") / F.col("n"), 6))
    return out.withColumn("covered", F.col("coverage") >= threshold)


def neighbour_profile(neighbours: DataFrame, column: str, k: int = 10) -> DataFrame:
    """AGG-12: the k most frequent values among neighbours, ties by value."""
    return neighbours.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_first()).limit(k)


def within_cutoff(edges: DataFrame, groups: DataFrame, cutoff: float, id_col: str = "id", group_col: str = "group") -> DataFrame:
    """JON-02, AGG-14: per group, the share of its neighbour pairs within the cutoff."""
    a = groups.select(F.col(id_col).alias("query_id"), F.col(group_col).alias("g"))
    b = groups.select(F.col(id_col).alias("cand_id"), F.col(group_col).alias("h"))
    same = edges.join(a, "query_id").join(b, "cand_id").where("g = h")
    return same.groupBy(F.col("g").alias(group_col)).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.when(F.col("distance") <= cutoff, 1.0).otherwise(0.0)), 6).alias("share"))


def remove_outliers(rows: DataFrame, value: str, groups: list[str], q: float = 0.99) -> DataFrame:
    """WIN-02: rows with `value` at or below the nearest `q` quantile of their group; null values are dropped."""
    from pagelode.operators.eda import nearest_quantiles

    limits = nearest_quantiles(rows.where(F.col(value).isNotNull()), groups, value, {"__limit": q}).select(*groups, "__limit")
    on = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
    joined = rows.where(F.col(value).isNotNull()).alias("a").join(broadcast_if_small(limits).alias("b"), on, "left")
    return joined.where(F.col(f"a.{value}") <= F.col("b.__limit")).select("a.*")


def review(pages: DataFrame, edges: DataFrame, decide: Callable[[DataFrame], str], group_col: str, budget: int = 25, cutoff: float = 0.2, coverage: float = 0.8, exclude: tuple = (), per_group: int = 3, id_col: str = "id", include_self: bool = True) -> DataFrame:
    """CLN-01, CLN-02: review look-alikes group by group, the largest first, and set `keep` for whole neighbourhoods.

    `decide` sees a sampled page with its neighbours and answers k (keep), r (reject), s (skip) or anything else to
    stop. A group ends when enough of it is reviewed or after `per_group` samples; skips and pages without neighbours
    do not use the budget. Only group sizes and one id at a time come to the driver; groups of null are never reviewed.
    """
    table = pages if "keep" in pages.columns else pages.withColumn("keep", F.lit(None).cast("boolean"))
    sizes = table.where(F.col(group_col).isNotNull()).groupBy(group_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group_col)
    for row in sizes.toLocalIterator():
        group = row[group_col]
        if group in exclude:
            continue
        for _ in range(per_group):
            if budget <= 0:
                return table
            mine = table.where(F.col(group_col) == F.lit(group))
            seen = mine.agg(F.count("keep").alias("k"), F.count(F.lit(1)).alias("n")).first()
            if seen["k"] >= coverage * seen["n"]:
                break
            picked = mine.where("keep is null").orderBy(F.md5(F.col(id_col).cast("string"))).select(id_col).first()
            if picked is None:
                break
            near = edges.where((F.col("query_id") == F.lit(picked[0])) & (F.col("distance") <= cutoff)).select(F.col("cand_id").alias(id_col)).distinct()
            answer = decide(table.join(near, id_col, "left_semi").unionByName(table.where(F.col(id_col) == F.lit(picked[0]))))
            if answer == "s":
                continue
            if answer not in ("k", "r"):
                return table
            ids = near.unionByName(near.sparkSession.createDataFrame([(picked[0],)], near.schema)) if answer == "k" or include_self else near
            table = stored(update_keep(table, ids, answer == "k", id_col), "review")
            budget -= 1
    return table


def add_index(pages: DataFrame, order_by: list[str], name: str = "index") -> DataFrame:
    """PRJ-02: 0-based position in the given order, by sums over order ranges rather than one global window."""
    # Written once, so that every use sees the same partitions, also after lost executors.
    ordered = stored(pages.orderBy(*order_by).withColumn("__part", F.spark_partition_id()), "ordered")
    counted = ordered.withColumn("__pos", F.row_number().over(Window.partitionBy("__part").orderBy(*order_by)))
    sizes = counted.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    total = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("__part", F.coalesce(F.sum("__n").over(total), F.lit(0)).alias("__off"))
    placed = counted.join(F.broadcast(offset), "__part")  # one row a partition
    return placed.withColumn("__pos", F.col("__pos") - 1 + F.col("__off")).drop("__part", "__off").withColumnRenamed("__pos", name)
