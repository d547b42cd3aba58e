"""Exploratory aggregates (AGG-01..09, 17, 27, FLT-05..08, PRJ-01, 10, 11, 14, WIN-03, 04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.session import broadcast_if_small


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """PRJ-01, SET-01: all splits with their name in `split`; missing columns become null."""
    out: DataFrame | None = None
    for name, part in parts.items():
        named = part.withColumn("split", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("at least one split is needed")
    return out


def count_by_label(rows: DataFrame, label_col: str = "label") -> DataFrame:
    """AGG-01: non-null labels per label; the null group counts 0."""
    return rows.groupBy(label_col).agg(F.count(label_col).alias("n"))


def class_balance(rows: DataFrame, by: str = "split", label_col: str = "label") -> DataFrame:
    """AGG-02, WIN-03: rows per group and label and their share of the group; sums are joined, not windowed over rows."""
    counts = rows.groupBy(by, label_col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("frac", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 6))


def top_k(rows: DataFrame, column: str, k: int = 10, by: str | None = None) -> DataFrame:
    """AGG-03..06: the k most frequent values (with `by`: pairs), ties by value."""
    keys = [column] if by is None else [column, by]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *[F.col(c).asc_nulls_first() for c in keys]).limit(k)


def daily_collection(rows: DataFrame, date_col: str = "date", split_col: str = "split", label_col: str = "label") -> DataFrame:
    """AGG-07: rows per day, split and label."""
    return rows.groupBy(date_col, split_col, label_col).agg(F.count(F.lit(1)).alias("n"))


def daily_pivot(rows: DataFrame, columns: list[str], date_col: str = "date", split_col: str = "split", label_col: str = "label") -> DataFrame:
    """AGG-07: one column `<split>_<label>` per pair in `columns`, 0 where a day has none."""
    named = rows.withColumn("__c", F.concat_ws("_", split_col, label_col))
    out = named.groupBy(date_col).pivot("__c", columns).agg(F.count(F.lit(1)))
    return out.na.fill(0, columns)


def first_test_day(rows: DataFrame, date_col: str = "date", split_col: str = "split", label_col: str = "label", test: str = "test") -> DataFrame:
    """AGG-07: the first day of the test split per label."""
    return rows.where(F.col(split_col) == test).groupBy(label_col).agg(F.min(date_col).alias("first_day"))


def snapshot(rows: DataFrame, label: str, first: str, last: str, label_col: str = "label", date_col: str = "date") -> DataFrame:
    """FLT-05: rows of a label between two days, both included."""
    return rows.where((F.col(label_col) == label) & F.col(date_col).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def known_targets(rows: DataFrame, label_col: str = "label", target_col: str = "target") -> DataFrame:
    """FLT-06: phish rows whose target is named; unknown, other and null targets are dropped."""
    return rows.where((F.col(label_col) == "phish") & ~F.col(target_col).isin("unknown", "other"))


def bucket_top(rows: DataFrame, column: str, n: int = 9) -> DataFrame:
    """PRJ-10: `column` with all but its n most frequent values as `other`; null counts as a value, ties by value."""
    top = top_k(rows, column, n).select(F.col(column).alias("__v"), F.lit(True).alias("__top"))
    out = rows.join(F.broadcast(top), F.col(column).eqNullSafe(F.col("__v")), "left")  # n rows
    return out.withColumn(column, F.when(F.col("__top"), F.col(column)).otherwise("other")).drop("__v", "__top")


def daily_targets(rows: DataFrame, n: int = 9, target_col: str = "target", date_col: str = "date") -> DataFrame:
    """AGG-08: rows per day and target, all but the n most frequent targets as `other`."""
    return bucket_top(known_targets(rows), target_col, n).groupBy(date_col, target_col).agg(F.count(F.lit(1)).alias("n"))


def nearest_quantiles(rows: DataFrame, groups: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """AGG-09: nearest quantiles of the non-null values of each group: the value at place `round((n - 1) q)`.

    Values are counted first; running counts over distinct values of a group are split into ranges of values, so a
    group is never collected or sorted in one task. Ranks that lie between are rounded half up.
    """
    held = rows.where(F.col(value).isNotNull())
    distinct = held.groupBy(*groups, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    edges = distinct.groupBy(*groups).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"))
    on = lambda a, b: [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in groups]
    names = [F.col(f"a.{g}").alias(g) for g in groups]
    ranged = distinct.alias("a").join(edges.alias("b"), on("a", "b")) if groups else distinct.alias("a").crossJoin(F.broadcast(edges.alias("b")))  # one row
    width = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255)).otherwise(0).cast("int")
    ranged = ranged.select(*names, "v", "c", "n", width.alias("r"))
    sums = ranged.groupBy(*groups, "r").agg(F.sum("c").alias("s"))
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy(*groups).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy(*groups, "r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumn("upto", F.sum("c").over(inner))
    placed = ranged.alias("a").join(sums.alias("b"), [*on("a", "b"), F.col("a.r") == F.col("b.r")]).select(*names, "v", "c", "n", (F.col("upto") + F.col("before")).alias("last"))
    picks = [F.max(F.when((F.floor((F.col("n") - 1) * F.lit(q) + 0.5) < F.col("last")) & (F.floor((F.col("n") - 1) * F.lit(q) + 0.5) >= F.col("last") - F.col("c")), F.col("v"))).alias(name) for name, q in wanted.items()]
    return placed.groupBy(*groups).agg(*picks, F.max("n").alias("count"))


def unpivot_features(rows: DataFrame, features: list[str], label_col: str = "label") -> DataFrame:
    """PRJ-11: long form `(label, feature, value)`."""
    return rows.select(label_col, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([label_col], features, "feature", "value")


def feature_statistics(rows: DataFrame, features: list[str], label_col: str = "label") -> DataFrame:
    """AGG-09: min, nearest quartiles, max and count of non-nulls per label and feature; nulls and 0 if all are null."""
    long = unpivot_features(rows, features, label_col)
    stats = nearest_quantiles(long, [label_col, "feature"], "value", {"min": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "max": 1.0})
    every = long.select(label_col, "feature").distinct()
    on = F.col(f"a.{label_col}").eqNullSafe(F.col(f"b.{label_col}")) & (F.col("a.feature") == F.col("b.feature"))
    return every.alias("a").join(stats.alias("b"), on, "left").select(f"a.{label_col}", "a.feature", "min", "p25", "p50", "p75", "max", F.coalesce("count", F.lit(0)).alias("count"))


def target_counts(rows: DataFrame, target: Column, min_count: int = 1, exclude: tuple[str, ...] = ()) -> DataFrame:
    """AGG-17, FLT-07: targets with at least `min_count` rows, blacklisted ones left out."""
    named = rows.select(target.alias("target"))
    if exclude:
        named = named.where(~F.col("target").isin(*exclude))
    return named.groupBy("target").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)


def histogram(rows: DataFrame, value: Column, width: float) -> DataFrame:
    """AGG-27: counts per bin of a width; null values have no bin."""
    return rows.select(F.floor(value / F.lit(width)).cast("bigint").alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def split_ratios(rows: DataFrame, split_col: str = "split", label_col: str = "label") -> DataFrame:
    """PRJ-14: share of test rows of all, and of phish in each split."""
    counts = rows.agg(*[F.count_if(F.col(split_col) == s).alias(f"n_{s}") for s in ("train", "test")], *[F.count_if((F.col(split_col) == s) & (F.col(label_col) == "phish")).alias(f"p_{s}") for s in ("train", "test")])
    ratio = lambda a, b, name: F.round(F.try_divide(a, b), 6).alias(name)
    c = F.col
    return counts.select(ratio(c("n_test"), c("n_test") + c("n_train"), "test_ratio"), ratio(c("p_train"), c("n_train"), "phish_train"), ratio(c("p_test"), c("n_test"), "phish_test"))


def rolling_mean(rows: DataFrame, value: str, order_by: str, window: int = 5, group: str | None = None) -> DataFrame:
    """WIN-04: mean of the last `window` rows in order, null until there are that many.

    Rows of a group are ordered in one task, as for a training log; give `group` where there are several logs.
    """
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(order_by).rowsBetween(-(window - 1), 0)
    return rows.withColumn("rolling", F.when(F.count(value).over(w) == window, F.round(F.avg(value).over(w), 6)))
