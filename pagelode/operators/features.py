"""Feature files, dictionaries and linear models (SRC-14..16, SRC-29, AGG-20..23, JON-11, MDL-01..04, SNK-09, SNK-10, LNG-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelode.operators.vectors import most_frequent
from pagelode.session import broadcast_if_small, stored


def parse_feature_lines(lines: DataFrame, column: str = "value", strict: bool = False) -> DataFrame:
    """SRC-14, SRC-15: `label sha256 name:value ...` lines as `(label, sha256, features map<string,double>)`.

    Tolerant: blank and short lines and bad labels are skipped, bad values left out, the last of a repeated feature
    wins. Strict: a bad value makes the row's map null.
    """
    parts = F.split(F.trim(F.split_part(F.col(column), F.lit("\t"), F.lit(1))), r"\s+")
    pairs = F.transform(F.filter(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), lambda x: x.contains(":")), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("k"), F.regexp_extract(x, r"^[^:]*:(.*)$", 1).try_cast("double").alias("v")))
    good = F.filter(pairs, lambda p: p["v"].isNotNull() & (p["k"] != ""))
    later = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda o: o["k"] == p["k"]))
    features = F.map_from_entries(later)
    if strict:
        features = F.when(F.size(good) == F.size(pairs), features)
    rows = lines.select(F.try_element_at(parts, F.lit(1)).try_cast("int").alias("label"), F.try_element_at(parts, F.lit(2)).alias("sha256"), features.alias("features"))
    return rows.where("label is not null and sha256 is not null")


def parse_index_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC-16: `label\\ti:1\\tj:1` lines as `(label, indices array<int>)`, 0-based; label 1 iff it equals 1."""
    parts = F.split(F.col(column), "\t")
    idx = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda x: F.split_part(x, F.lit(":"), F.lit(1)).try_cast("int"))
    return lines.where(F.length(column) > 0).select((F.get(parts, 0).try_cast("int") == 1).cast("int").alias("label"), F.filter(idx, lambda i: i.isNotNull()).alias("indices"))


def feature_dictionary(features: DataFrame, feature_col: str = "feature", min_count: int = 10, max_features: int | None = None, count_col: str | None = None) -> DataFrame:
    """AGG-20, AGG-21, SRC-29: a stored table `(feature, n, idx)` of features that occur more than `min_count` times, by count and name.

    Each row is one occurrence, or as many as `count_col` says.
    """
    times = F.sum(count_col) if count_col else F.count(F.lit(1))
    counted = features.groupBy(F.col(feature_col).alias("feature")).agg(times.alias("n")).where(F.col("n") > min_count)
    if max_features:
        counted = most_frequent(stored(counted, "features"), max_features, "n", "feature")
    from pagelode.operators.cleaning import add_index

    return stored(add_index(counted.withColumn("__k", -F.col("n")), ["__k", "feature"], "idx").drop("__k"), "dictionary")


def reduce_rows(rows: DataFrame, dictionary: DataFrame, id_cols: list[str], feature_col: str = "feature", compat_drop_zero: bool = False) -> DataFrame:
    """AGG-21, JON-11: `(ids, indices)` of known features, sorted and distinct; rows without any are left out.

    With `compat_drop_zero` the feature of index 0 is left out of the rows.
    """
    known = dictionary.select(F.col("feature").alias(feature_col), "idx")
    if compat_drop_zero:
        known = known.where("idx > 0")
    return rows.join(broadcast_if_small(known), feature_col).groupBy(*id_cols).agg(F.sort_array(F.collect_set("idx")).alias("indices"))


def index_lines(rows: DataFrame, label_col: str = "label", indices_col: str = "indices") -> DataFrame:
    """SNK-10: rows as `label\\ti:1\\t...` lines."""
    return rows.select(F.concat_ws("\t", F.col(label_col).cast("string"), F.array_join(F.transform(indices_col, lambda i: F.concat(i.cast("string"), F.lit(":1"))), "\t")).alias("value"))


def vectorizer_stats(features: DataFrame, feature_col: str = "feature", value_col: str = "value", position_col: str = "pos", cap: int = 100_000, replace: str = "avg") -> DataFrame:
    """AGG-22, AGG-23: per feature sum, count, maximum and the value for missing ones; the first `cap` features seen."""
    stats = features.groupBy(F.col(feature_col).alias("feature")).agg(F.min(position_col).alias("first_pos"), F.sum(value_col).alias("total"), F.count(value_col).alias("n"), F.max(value_col).alias("most"))
    filler = F.coalesce(F.try_divide("total", "n") if replace == "avg" else F.col("most"), F.lit(0.0))
    return stats.withColumn("missing_value", F.round(filler, 6)).orderBy("first_pos", "feature").limit(cap)


def balance_weights(rows: DataFrame, label_col: str = "label") -> DataFrame:
    """MDL-01: `weight` = rows / (classes x rows of the class)."""
    sizes = rows.groupBy(label_col).agg(F.count(F.lit(1)).alias("__n"))
    both = sizes.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    table = sizes.crossJoin(F.broadcast(both)).select(label_col, (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("weight"))  # one row a class
    return rows.join(broadcast_if_small(table), label_col)


def long_features(rows: DataFrame, id_col: str, label_col: str, features_col: str) -> DataFrame:
    """MDL-03: `(id, y, weight, feature, value)` of a map of values or an array of indices; y is 1 or -1."""
    keep = [F.col(id_col).alias("id"), F.when(F.col(label_col) == 1, 1.0).otherwise(-1.0).alias("y"), "weight"]
    if dict(rows.dtypes)[features_col].startswith("map"):
        return rows.select(*keep, F.explode(features_col).alias("feature", "value")).where("value is not null")
    return rows.select(*keep, F.explode(features_col).alias("feature")).select("*", F.lit(1.0).alias("value"))


def train_linear(rows: DataFrame, id_col: str = "sha256", label_col: str = "label", features_col: str = "features", c: float = 1.0, iterations: int = 20, rate: float = 0.5) -> tuple[DataFrame, float]:
    """MDL-01, MDL-04: weights `(feature, weight)` and bias of a linear classifier with squared hinge loss and balanced classes.

    Full-batch descent with a step size per feature: margins and gradients are sums per row and per feature, so neither
    the matrix nor the weights ever have to fit in one place.
    """
    sized = balance_weights(rows.select(id_col, label_col, features_col), label_col)
    long = stored(long_features(sized, id_col, label_col, features_col), "features-long")
    every = stored(sized.select(F.col(id_col).alias("id"), F.when(F.col(label_col) == 1, 1.0).otherwise(-1.0).alias("y"), "weight"), "features-rows")
    n = max(1, every.count())
    w = long.select("feature").distinct().select("feature", F.lit(0.0).alias("w"), F.lit(1e-8).alias("g2"))
    bias, bias2 = 0.0, 1e-8
    for _ in range(iterations):
        w = stored(w, "weights")
        margins = long.join(w, "feature").groupBy("id").agg(F.sum(F.col("w") * F.col("value")).alias("m"))
        slack = every.join(margins, "id", "left").select("id", "y", "weight", F.greatest(F.lit(0.0), 1 - F.col("y") * (F.coalesce("m", F.lit(0.0)) + F.lit(bias))).alias("s")).where("s > 0")
        push = stored(slack.select("id", (-2 * c * F.col("weight") * F.col("y") * F.col("s") / n).alias("p")), "push")
        grad = long.join(push, "id").groupBy("feature").agg(F.sum(F.col("p") * F.col("value")).alias("g"))
        full = w.join(grad, "feature", "left").withColumn("g", F.coalesce("g", F.lit(0.0)) + F.col("w") / n)
        w = full.select("feature", (F.col("w") - rate * F.col("g") / F.sqrt(F.col("g2") + F.col("g") * F.col("g"))).alias("w"), (F.col("g2") + F.col("g") * F.col("g")).alias("g2"))
        g = push.agg(F.sum("p")).first()[0] or 0.0
        bias2 += g * g
        bias -= rate * g / bias2**0.5
    return stored(w.select("feature", F.col("w").alias("weight")), "weights"), bias


def decision_scores(weights: DataFrame, bias: float, rows: DataFrame, id_col: str = "sha256", features_col: str = "features") -> DataFrame:
    """MDL-02: `(id, decision, predicted)`; features without a weight count nothing."""
    kind = dict(rows.dtypes)[features_col]
    each = rows.select(F.col(id_col).alias("id"), F.explode(features_col).alias("feature", "value")) if kind.startswith("map") else rows.select(F.col(id_col).alias("id"), F.explode(features_col).alias("feature"), ).withColumn("value", F.lit(1.0))
    sums = each.join(weights, "feature").groupBy("id").agg(F.sum(F.col("weight") * F.col("value")).alias("m"))
    out = rows.select(F.col(id_col).alias("id")).join(sums, "id", "left").select("id", (F.coalesce("m", F.lit(0.0)) + F.lit(bias)).alias("decision"))
    return out.withColumn("predicted", (F.col("decision") > 0).cast("int"))


def weight_lines(weights: DataFrame, bias: float, feature_col: str = "feature", weight_col: str = "weight") -> DataFrame:
    """SNK-09: header, bias and one `name\\t%.6f` line per weight, in order of the column `line`."""
    body = weights.select(F.lit(2).alias("line"), F.format_string("%s\t%.6f", feature_col, weight_col).alias("value"))
    head = weights.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(F.struct(F.lit(0).alias("line"), F.format_string("No of features %d", "n").alias("value")), F.struct(F.lit(1).alias("line"), F.lit(f"weightvectorbias\t{bias}").alias("value")))).alias("x")).select("x.line", "x.value")
    return head.unionByName(body)


def packed_requests(rows: DataFrame, size_col: str, order_by: list[str], most_rows: int = 10_000, most_bytes: int = 190_000_000) -> DataFrame:
    """MDL-11: `file_no` of each request so that no file exceeds a number of rows, nor of bytes by more than one request.

    Requests are packed in order: a file ends where their number or the bytes before it pass the next multiple of a
    limit. Running sums go over order ranges, so no task sees all requests.
    """
    ordered = rows.orderBy(*order_by).withColumn("__p", F.spark_partition_id())
    inner = Window.partitionBy("__p").orderBy(*order_by)
    ordered = ordered.withColumn("__i", F.row_number().over(inner) - 1).withColumn("__b", F.coalesce(F.sum(size_col).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = ordered.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.sum(size_col).alias("__s"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"))
    keyed = ordered.join(F.broadcast(parts), "__p")  # one row a partition
    keyed = keyed.withColumn("__k", F.struct(F.floor((F.col("__i") + F.col("__n0")) / most_rows).alias("a"), F.floor((F.col("__b") + F.col("__s0")) / most_bytes).alias("b")))
    numbers = keyed.select("__k").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("__k")) - 1)
    return keyed.join(F.broadcast(numbers), "__k").drop("__p", "__i", "__b", "__n0", "__s0", "__k")  # one row a file
