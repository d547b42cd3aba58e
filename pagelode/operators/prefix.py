"""Running sums over any number of rows without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hash ranges a running sum is split into at least; a group's rows spread evenly over them.
RANGES = 512
#: Rows of a range that a task sorts, on average.
RANGE_ROWS = 100_000


def ranges_for(rows: int) -> int:
    """Ranges for a table of so many rows, should one group hold them all."""
    return max(RANGES, -(-rows // RANGE_ROWS))


def hash_running_sum(df: DataFrame, groups: list[str], key: str, value: str, out: str, seed: str = "0", rows: int = 0) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same group that come before the row in hash order of `key`.

    The order is `md5(seed|key)`, cut into hash ranges whose number follows from `rows`, the size of the table. Sums
    of whole ranges are aggregated first (at most groups x ranges rows), so the window that needs an order only ever
    sees the rows of one group and one range. Nulls in `value` count as 0; rows with equal keys get an order by chance of their
    hash only, so keys should be unique.
    """
    hashed = df.withColumn("__h", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))))
    hashed = hashed.withColumn("__r", F.expr(f"cast(conv(substr(__h, 1, 8), 16, 10) as bigint) * {ranges_for(rows)} div 4294967296"))
    sums = hashed.groupBy(*groups, "__r").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("__s"))
    whole = Window.partitionBy(*groups).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__s").over(whole), F.lit(0))).drop("__s")
    inner = Window.partitionBy(*groups, "__r").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, -1)
    within = hashed.withColumn("__in", F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(inner), F.lit(0)))
    on = None
    left, right = within.alias("a"), sums.alias("b")
    for c in [*groups, "__r"]:
        cond = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        on = cond if on is None else on & cond
    names = [c for c in within.columns if c not in ("__h", "__r", "__in")]
    return left.join(right, on, "left").select(*[F.col(f"a.`{c}`") for c in names], (F.col("a.__in") + F.coalesce(F.col("b.__before"), F.lit(0))).alias(out))
