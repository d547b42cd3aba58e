"""Evaluation metrics (MET-*, WIN-05): exact, by sums over distinct scores rather than over rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelode.session import stored

#: Distinct scores whose counts one task of the bootstrap holds.
RANGE_SCORES = 100_000


def _curve(rows: DataFrame, gt: str, score: str, group: list[str]) -> DataFrame:
    """WIN-05: cumulative true and false positives per distinct score, from the highest down; null scores are left out.

    Scores are counted first. Running sums go over ranges of scores, so that no task holds all distinct scores.
    """
    counted = rows.where(F.col(score).isNotNull() & F.col(gt).isNotNull()).groupBy(*group, F.col(score).alias("__s")).agg(F.count_if(F.col(gt) == 1).alias("__p"), F.count_if(F.col(gt) == 0).alias("__q"))
    ranged = counted.withColumn("__r", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__s"))) * 1024).cast("int"))
    sums = ranged.groupBy(*group, "__r").agg(F.sum("__p").alias("__sp"), F.sum("__q").alias("__sq"))
    above = Window.partitionBy(*group).orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    sums = sums.select(*group, "__r", F.coalesce(F.sum("__sp").over(above), F.lit(0)).alias("__bp"), F.coalesce(F.sum("__sq").over(above), F.lit(0)).alias("__bq"), F.sum("__sp").over(whole).alias("__pos"), F.sum("__sq").over(whole).alias("__neg"))
    inner = Window.partitionBy(*group, "__r").orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumn("__ip", F.sum("__p").over(inner)).withColumn("__iq", F.sum("__q").over(inner))
    on = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group] + [F.col("a.__r") == F.col("b.__r")]
    return ranged.alias("a").join(sums.alias("b"), on).select(*[F.col(f"a.{g}").alias(g) for g in group], "__s", "__p", "__q", (F.col("__ip") + F.col("__bp")).alias("__tp"), (F.col("__iq") + F.col("__bq")).alias("__fp"), "__pos", "__neg")


def pr_curve(rows: DataFrame, gt: str = "gt", score: str = "score", group: list[str] = ()) -> DataFrame:
    """MET-01: `(threshold, precision, recall)` at each distinct score."""
    c = _curve(rows, gt, score, [*group])
    return c.select(*group, F.col("__s").alias("threshold"), (F.col("__tp") / (F.col("__tp") + F.col("__fp"))).alias("precision"), F.try_divide("__tp", "__pos").alias("recall"))


def average_precision(rows: DataFrame, gt: str = "gt", score: str = "score", group: list[str] = ()) -> DataFrame:
    """MET-01: sum of precision times the step in recall over distinct scores; 0 without positives."""
    c = _curve(rows, gt, score, [*group])
    part = F.col("__p") / F.greatest("__pos", F.lit(1)) * F.col("__tp") / (F.col("__tp") + F.col("__fp"))
    return c.groupBy(*group).agg(F.round(F.coalesce(F.sum(part), F.lit(0.0)), 6).alias("average_precision"))


def precision_at_recall(rows: DataFrame, recall: float = 0.9, gt: str = "gt", score: str = "score", group: list[str] = ()) -> DataFrame:
    """MET-02: the best precision where the recall is reached; 0 where it never is."""
    c = _curve(rows, gt, score, [*group])
    hit = F.when((F.col("__pos") > 0) & (F.col("__tp") >= F.lit(recall) * F.col("__pos")), F.col("__tp") / (F.col("__tp") + F.col("__fp")))
    return c.groupBy(*group).agg(F.round(F.coalesce(F.max(hit), F.lit(0.0)), 6).alias("precision"))


def roc_curve(rows: DataFrame, gt: str = "gt", score: str = "score", group: list[str] = ()) -> DataFrame:
    """MET-04: `(threshold, fpr, tpr)` at each distinct score."""
    c = _curve(rows, gt, score, [*group])
    return c.select(*group, F.col("__s").alias("threshold"), F.try_divide("__fp", "__neg").alias("fpr"), F.try_divide("__tp", "__pos").alias("tpr"))


def roc_auc(rows: DataFrame, gt: str = "gt", score: str = "score", group: list[str] = ()) -> DataFrame:
    """MET-04: area under the ROC curve, ties averaged; null with one class only."""
    c = _curve(rows, gt, score, [*group])
    area = F.sum(F.col("__q") * (F.col("__tp") - F.col("__p") / 2.0))
    return c.groupBy(*group).agg(F.round(F.try_divide(area, F.max("__pos") * F.max("__neg")), 6).alias("auc"))


def best_threshold(rows: DataFrame, gt: str = "gt", score: str = "score") -> DataFrame:
    """MET-05: the threshold of the largest geometric mean of sensitivity and specificity, the highest of ties."""
    r = roc_curve(rows, gt, score).withColumn("g", F.round(F.sqrt(F.col("tpr") * (1 - F.col("fpr"))), 9))
    best = r.agg(F.max(F.struct("g", "threshold", "fpr", "tpr")).alias("m"))
    return best.select(F.col("m.threshold").alias("threshold"), F.round("m.fpr", 6).alias("fpr"), F.round("m.tpr", 6).alias("tpr"), F.round("m.g", 6).alias("g_mean"))


def evaluation(rows: DataFrame, gt: str = "gt", score: str = "score", recall: float = 0.9) -> DataFrame:
    """MET-11: one row with average precision, precision at a recall, area under the ROC curve and the best threshold."""
    parts = [average_precision(rows, gt, score), precision_at_recall(rows, recall, gt, score).withColumnRenamed("precision", "precision_at_recall"), roc_auc(rows, gt, score), best_threshold(rows, gt, score)]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


def confusion(rows: DataFrame, thresholds: list[float], gt: str = "gt", score: str = "score", strict: bool = True) -> DataFrame:
    """MET-06..08: counts and macro F1, accuracy, precision, recall and F1 per threshold; positive is `score > t` (or `>=`)."""
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    each = rows.where(F.col(score).isNotNull()).select(F.col(gt).alias("y"), F.col(score).alias("s"), levels.alias("threshold"))
    yes = F.col("s") > F.col("threshold") if strict else F.col("s") >= F.col("threshold")
    c = each.groupBy("threshold").agg(*[F.count_if((F.col("y") == y) & (yes if p else ~yes)).alias(n) for n, y, p in (("tp", 1, True), ("fp", 0, True), ("tn", 0, False), ("fn", 1, False))])
    z = lambda x: F.coalesce(x, F.lit(0.0))
    f1 = z(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    f0 = z(F.try_divide(2.0 * F.col("tn"), 2 * F.col("tn") + F.col("fp") + F.col("fn")))
    r6 = lambda x, n: F.round(x, 6).alias(n)
    return c.select("threshold", "tp", "fp", "tn", "fn", r6((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")), "accuracy"), r6(z(F.try_divide("tp", F.col("tp") + F.col("fp"))), "precision"), r6(z(F.try_divide("tp", F.col("tp") + F.col("fn"))), "recall"), r6(f1, "f1"), r6((f1 + f0) / 2, "macro_f1"))


def classification_report(rows: DataFrame, gt: str = "gt", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """MET-07: precision, recall, F1 and support of both classes."""
    c = confusion(rows, [threshold], gt, score, strict=False)
    z = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)

    def line(name: str, t: str, wrong: str, missed: str):
        return F.struct(F.lit(name).alias("class"), z(F.try_divide(t, F.col(t) + F.col(wrong))).alias("precision"), z(F.try_divide(t, F.col(t) + F.col(missed))).alias("recall"), z(F.try_divide(2.0 * F.col(t), 2 * F.col(t) + F.col(wrong) + F.col(missed))).alias("f1"), (F.col(t) + F.col(missed)).alias("support"))

    return c.select(F.inline(F.array(line("benign", "tn", "fn", "fp"), line("phish", "tp", "fp", "fn"))))


def bootstrap_mean(rows: DataFrame, value: str, group: str, replicates: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """MET-09: mean and percentile interval of the mean of each group's values (one value per benchmark set)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        import zlib

        import numpy as np

        v, name = frame[value].dropna().to_numpy(float), frame[group].iloc[0]
        if not len(v):
            return pd.DataFrame([(name, None, None, None)], columns=[group, "mean", "low", "high"])
        rng = np.random.default_rng([seed, zlib.crc32(str(name).encode())])
        means = np.concatenate([v[rng.integers(0, len(v), (min(500, replicates - k), len(v)))].mean(axis=1) for k in range(0, replicates, 500)])
        lo, hi = np.percentile(means, [50 * (1 - level), 50 * (1 + level)])
        return pd.DataFrame([(name, round(v.mean(), 6), round(lo, 6), round(hi, 6))], columns=[group, "mean", "low", "high"])

    return rows.groupBy(group).applyInPandas(run, f"{group} string, mean double, low double, high double")


def confidence_intervals(rows: DataFrame, gt: str = "gt", score: str = "score", replicates: int = 1000, level: float = 0.95, seed: int = 42, recall: float = 0.9, range_scores: int = RANGE_SCORES) -> DataFrame:
    """MET-10, SMP-12: stratified bootstrap intervals of average precision and precision at recall.

    A resample only changes how often each distinct score of each class occurs. Scores lie in ranges; how many resampled
    rows fall into each range is one multinomial draw a replicate, small enough to be drawn alike by every task, and the
    counts inside a range are another. Tasks are ranges times blocks of replicates, so no task sees all scores.
    """
    import numpy as np

    bad = rows.where(~F.col(gt).isin(0, 1) | F.col(gt).isNull()).limit(1).count()
    if bad:
        raise ValueError(f"{gt} must be 0 or 1")
    from pagelode.operators.cleaning import add_index

    table = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("__score")).agg(F.count_if(F.col(gt) == 1).alias("p"), F.count_if(F.col(gt) == 0).alias("q"))
    placed = add_index(table.withColumn("__down", -F.col("__score")), ["__down"], "i").withColumn("r", F.floor(F.col("i") / range_scores).cast("long"))
    held = stored(placed.select("r", "i", "p", "q"), "score-counts")
    ranges = held.groupBy("r").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).orderBy("r").toPandas()  # one row a range
    totals = ranges["p"].to_numpy(np.int64), ranges["q"].to_numpy(np.int64)
    blocks = max(1, min(replicates, rows.sparkSession.sparkContext.defaultParallelism * 4))

    def draw(rng, n: int, sizes):
        return rng.multinomial(n, sizes / sizes.sum()) if n and sizes.sum() else np.zeros(len(sizes), np.int64)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r, block = int(key[0]), int(key[1])
        frame = frame.sort_values("i")
        p, q, (all_p, all_q) = frame["p"].to_numpy(), frame["q"].to_numpy(), totals
        pos, out = max(1, int(all_p.sum())), []
        for k in range(block, replicates, blocks):
            first = np.random.default_rng([seed, k])
            of_p, of_q = draw(first, int(all_p.sum()), all_p), draw(first, int(all_q.sum()), all_q)
            rng = np.random.default_rng([seed, k, r + 1])
            a, b = draw(rng, int(of_p[r]), p), draw(rng, int(of_q[r]), q)
            tp, fp = a.cumsum() + of_p[:r].sum(), b.cumsum() + of_q[:r].sum()
            precision = tp / np.maximum(1, tp + fp)
            reached = (tp >= recall * pos) & (a + b > 0)
            out.append((k, float((a / pos * precision).sum()), float(precision[reached].max()) if all_p.sum() and reached.any() else 0.0))
        return pd.DataFrame(out, columns=["k", "average_precision", "precision"])

    spread = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = spread.groupBy("r", "block").applyInPandas(run, "k long, average_precision double, precision double")
    draws = parts.groupBy("k").agg(F.sum("average_precision").alias("average_precision"), F.max("precision").alias("precision")).drop("k")
    long = draws.unpivot([], ["average_precision", "precision"], "metric", "value")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit((1 - level) / 2)), 6).alias("low"), F.round(F.percentile("value", F.lit((1 + level) / 2)), 6).alias("high"))


def mean_curve(rows: DataFrame, group: str, kind: str = "pr", gt: str = "gt", score: str = "score", points: int = 1000) -> DataFrame:
    """MET-03, MET-12: curves of several sets interpolated on one grid and averaged: `(x, y, n)`."""
    from pagelode.functions.text import interpolate

    curve = pr_curve(rows, gt, score, [group]) if kind == "pr" else roc_curve(rows, gt, score, [group])
    x, y = ("recall", "precision") if kind == "pr" else ("fpr", "tpr")
    sets = curve.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("c"))  # one benchmark set's distinct scores
    on_grid = interpolate(points)(F.transform("c", lambda p: p["x"]), F.transform("c", lambda p: p["y"]))
    each = sets.select(F.posexplode(on_grid).alias("i", "v"))
    return each.groupBy("i").agg(F.round(F.avg("v"), 6).alias("y"), F.count(F.lit(1)).alias("n")).select(F.round(F.col("i") / (points - 1), 6).alias("x"), "y", "n")
