"""Samples, splits, difficulty and benchmark sets (SMP-*, WIN-06..08, SRT-*, SET-02..04, JON-03, 05, 06, 13..15, FLT-10..15).

All randomness is a hash of a seed and an id, the same in every run, partitioning and engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions.text import base_rate_size
from pagelode.operators.prefix import hash_running_sum
from pagelode.session import broadcast_if_small


def hash_order(seed: int | str, *ids: str) -> Column:
    """The place of a row in the order of a seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def sample_rows(rows: DataFrame, n: int, id_col: str, seed: int | str = 42) -> DataFrame:
    """SMP-01: exactly n rows (all, if fewer) without replacement."""
    return rows.orderBy(hash_order(seed, id_col), id_col).limit(n)


def sample_fraction(rows: DataFrame, fraction: float, id_col: str, seed: int | str = 42) -> DataFrame:
    """SMP-01: `int(fraction * n)` rows without replacement; raises unless 0 < fraction <= 1."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be in (0, 1]")
    return sample_rows(rows, int(fraction * rows.count()), id_col, seed)


def ranked(rows: DataFrame, groups: list[str], id_col: str, seed: int | str) -> DataFrame:
    """`rn`: 1-based place of each row in the hash order of its group."""
    out = hash_running_sum(rows.withColumn("__one", F.lit(1)), groups, id_col, "__one", "rn", str(seed), rows.count())
    return out.withColumn("rn", (F.col("rn") + 1).cast("bigint")).drop("__one")


def stratified_sample(rows: DataFrame, sizes: dict[str, int], class_col: str, id_col: str, seed: int | str = 42) -> DataFrame:
    """SMP-02: the given number of rows of each class."""
    keep = F.lit(False)
    for name, n in sizes.items():
        keep = keep | ((F.col(class_col) == name) & (F.col("rn") <= n))
    return ranked(rows, [class_col], id_col, seed).where(keep).drop("rn")


def stratified_split(rows: DataFrame, class_col: str, id_col: str, test_share: float = 0.1, seed: int | str = 42) -> DataFrame:
    """SMP-03: `part` test for `int(n * share)` rows of each class, else train."""
    sizes = rows.groupBy(class_col).agg(F.count(F.lit(1)).alias("__n"))
    out = ranked(rows, [class_col], id_col, seed).alias("a").join(broadcast_if_small(sizes).alias("b"), F.col(f"a.{class_col}").eqNullSafe(F.col(f"b.{class_col}")))
    part = F.when(F.col("rn") <= F.floor(F.col("__n") * F.lit(test_share)), "test").otherwise("train")
    return out.withColumn("part", part).select("a.*", "part").drop("rn")


def time_split(rows: DataFrame, order_by: list[str], train_share: float = 0.8) -> DataFrame:
    """SMP-04, WIN-06: `part` train for the first `int(n * share)` rows in order, else test."""
    from pagelode.operators.cleaning import add_index

    n = rows.count()
    return add_index(rows, order_by, "__i").withColumn("part", F.when(F.col("__i") < int(n * train_share), "train").otherwise("test")).drop("__i")


def difficulty_filter(rows: DataFrame, positive: bool, score: str = "score", id_col: str = "sha256", delta: float = 0.15, drop: float = 0.1, seed: int | str = 42) -> DataFrame:
    """SMP-05, SMP-06: without a share of the easy rows of a class.

    Easy are scores at or above the `1 - delta` quantile of the positive class, at or below the `delta` quantile of the
    negative one (linear); `int(drop * n)` of them are dropped in hash order. `delta` must exceed `drop`. Null scores
    are never easy.
    """
    if delta <= drop:
        raise AssertionError("delta must exceed the share to drop")
    limit = rows.agg(F.percentile(score, F.lit(1 - delta if positive else delta)).alias("q"), F.count(F.lit(1)).alias("n")).first()
    if limit["q"] is None:
        return rows
    easy = rows.where(F.col(score) >= limit["q"] if positive else F.col(score) <= limit["q"])
    gone = sample_rows(easy.select(id_col), int(drop * limit["n"]), id_col, seed)
    return rows.join(gone, id_col, "left_anti").select(*rows.columns)


def ensemble(scores: list[DataFrame], id_col: str = "sha256", score: str = "score") -> DataFrame:
    """JON-03, PRJ-09: ids that all score tables have, with the mean of their scores."""
    out = scores[0].select(id_col, F.col(score).alias("s0"))
    for k, s in enumerate(scores[1:], 1):
        out = out.join(s.select(id_col, F.col(score).alias(f"s{k}")), id_col)
    total = sum((F.col(f"s{k}") for k in range(1, len(scores))), F.col("s0"))
    return out.select(id_col, F.round(total / len(scores), 6).alias("score"))


def union_filters(filters: list[DataFrame], id_col: str = "sha256") -> DataFrame:
    """SET-02: ids that any filter names."""
    out = filters[0].select(id_col)
    for f in filters[1:]:
        out = out.unionByName(f.select(id_col))
    return out.where(F.col(id_col).isNotNull()).distinct()


def both_filters(a: DataFrame, b: DataFrame, id_col: str = "sha256") -> DataFrame:
    """SET-03: ids that both filters name."""
    return a.select(id_col).intersect(b.select(id_col))


def apply_filters(rows: DataFrame, filters: list[DataFrame], id_col: str = "sha256") -> DataFrame:
    """SMP-13, JON-05, SET-04: rows that no filter names; rows with null ids stay."""
    return rows.join(union_filters(filters, id_col), id_col, "left_anti").select(*rows.columns) if filters else rows


def keep_only(rows: DataFrame, ids: DataFrame, id_col: str = "sha256") -> DataFrame:
    """JON-06: rows whose id is listed."""
    return rows.join(ids.select(id_col), id_col, "left_semi").select(*rows.columns)


def benchmark_sets(positives: DataFrame, n_negatives: int, rate: float, id_col: str = "sha256", seed: int | str = 42) -> DataFrame:
    """SMP-08, WIN-08: disjoint sets of positives at a base rate (per cent), as many full ones as there are: `(set_id, id)`."""
    size = max(1, positives.sparkSession.range(1).select(base_rate_size(rate, F.lit(n_negatives)).alias("n")).first()["n"])
    full = positives.count() // size
    placed = ranked(positives.select(id_col), [], id_col, seed).withColumn("k", F.floor((F.col("rn") - 1) / size).cast("bigint"))
    return placed.where(F.col("k") < full).select(F.concat(F.lit(f"{rate:.2f}-"), F.col("k").cast("string")).alias("set_id"), id_col)


def sequential_sets(positives: DataFrame, n_negatives: int, rates: list[float], id_col: str = "sha256", seed: int | str = 42) -> DataFrame:
    """SMP-09: one set per rate, cut one after another from the same order: `(set_id, id)`."""
    sizes = [positives.sparkSession.range(1).select(base_rate_size(r, F.lit(n_negatives)).alias("n")).first()["n"] for r in rates]
    placed, choice, start = ranked(positives.select(id_col), [], id_col, seed), F.lit(None).cast("string"), 0
    for r, n in zip(rates, sizes):
        choice = F.when(F.col("rn").between(start + 1, start + n), f"{r:.2f}").otherwise(choice)
        start += n
    return placed.withColumn("set_id", choice).where("set_id is not null").select("set_id", id_col)


def resampled_sets(positives: DataFrame, n_negatives: int, rate: float, sets: int, id_col: str = "sha256", seed: int | str = 42) -> DataFrame:
    """SMP-10: sets of positives drawn with replacement: `(set_id, draw, id)`."""
    spark = positives.sparkSession
    size = spark.range(1).select(base_rate_size(rate, F.lit(n_negatives)).alias("n")).first()["n"]
    placed = ranked(positives.select(id_col), [], id_col, seed)
    n = placed.count()
    if not n:
        return placed.select(F.lit("").alias("set_id"), F.lit(0).cast("bigint").alias("draw"), id_col).limit(0)
    draws = spark.range(sets * size).select((F.col("id") / size).cast("bigint").alias("k"), (F.col("id") % size).alias("draw"))
    draws = draws.withColumn("rn", F.pmod(F.xxhash64(F.lit(str(seed)), "k", "draw"), F.lit(n)) + 1)
    return draws.join(placed, "rn").select(F.concat(F.lit(f"{rate:.2f}-"), F.col("k").cast("string")).alias("set_id"), "draw", id_col)


def with_negatives(sets: DataFrame, negatives: DataFrame, id_col: str = "sha256") -> DataFrame:
    """SMP-11, JON-15: each set with every negative: `(set_id, id, gt)`; as many rows as sets times negatives by definition."""
    names = sets.select("set_id").distinct()
    return sets.select("set_id", id_col, F.lit(1).alias("gt")).unionByName(negatives.select(id_col).crossJoin(F.broadcast(names)).select("set_id", id_col, F.lit(0).alias("gt")))


def feed_filter(lines: DataFrame, column: str = "value", low: int = 5, high: int = 100, keep_commas: bool = True) -> DataFrame:
    """FLT-11: urls of feed lines `url[,more],connects,blocks` with no blocks and `low` to `high` connects."""
    parts = F.split(F.col(column), ",")
    n = F.size(parts)
    url = F.array_join(F.slice(parts, 1, F.greatest(n - 2, F.lit(0))), "," if keep_commas else "")
    picked = lines.select(url.alias("url"), F.try_element_at(parts, n - 1).try_cast("int").alias("nconnects"), F.try_element_at(parts, n).try_cast("int").alias("nblocks"), n.alias("n"))
    return picked.where((F.col("n") >= 3) & (F.col("nblocks") == 0) & F.col("nconnects").between(low, high)).select("url", "nconnects")


def accept(rows: DataFrame, id_col: str, share: float = 0.75, seed: int | str = 1) -> DataFrame:
    """SMP-14: each row with a fixed chance, by hash."""
    return rows.where(F.conv(F.substring(hash_order(seed, id_col), 1, 8), 16, 10).cast("double") / F.lit(float(16**8)) < share)


def new_ids(rows: DataFrame, id_col: str, last: int) -> DataFrame:
    """FLT-12, STM-03: rows whose id as a number lies beyond the last one seen."""
    return rows.where(F.col(id_col).try_cast("bigint") > last)


def size_gate(rows: DataFrame, html_col: str = "html_content", min_col: str | None = None, least: int = 5000) -> DataFrame:
    """FLT-13: pages of at least the wanted length; null pages are dropped."""
    limit = F.coalesce(F.col(min_col), F.lit(least)) if min_col else F.lit(least)
    return rows.where(F.length(html_col) >= limit)


def skip_done(rows: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """JON-13: rows that an output does not have yet."""
    return rows.join(done.select(id_col).distinct(), id_col, "left_anti").select(*rows.columns)


def drop_nulls(rows: DataFrame, subset: list[str]) -> DataFrame:
    """FLT-15: rows without a null in the given columns."""
    return rows.na.drop(subset=subset)


def dedup_urls(first: Column, more: Column) -> Column:
    """PRJ-13: one url, then others, each once, in order; null and '' left out."""
    every = F.concat(F.array(first), F.coalesce(more, F.expr("cast(array() as array<string>)")))
    return F.array_distinct(F.filter(every, lambda u: u.isNotNull() & (u != "")))
