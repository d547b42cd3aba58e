"""Choosing a varied subset (problem 1).

Each page is hashed repeatedly into locality-sensitive buckets, in three views: fine buckets of word shingles hold
look-alike pages, coarse buckets of single words and tags hold kinds of pages, and the target is a bucket of its own.
The mean number of rows that share a page's buckets estimates how crowded its surroundings are in that view. A subset
of exact size is drawn without replacement with probability inverse to that density.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.functions.html import visible_text
from pagelode.llm.cross_split import shingle_hashes
from pagelode.llm.group_split import target_key
from pagelode.session import stored

#: Repetitions in the fine and in the coarse view, and minwise hashes per fine bucket.
FINE, COARSE, ROWS = 8, 12, 3
#: Exponents of the densities of the three views in the weight.
POWERS = (1.0, 0.5, 0.5)
#: A bucket with at least this share of all rows is hot; there are at most repetitions / HOT of them.
HOT = 0.001
TAG_NAME = re.compile(r"<([A-Za-z][A-Za-z0-9]*)")


def page_features(page: str | None) -> tuple[list[str], list[str]]:
    """Words of the visible text in order, and the distinct tags with how often they occur, on a log scale."""
    if not page or page.isspace():
        return [], []
    counts: dict[str, int] = {}
    for t in TAG_NAME.findall(page):
        t = t.lower()
        counts[t] = counts.get(t, 0) + 1
    return visible_text(page).lower().split(), [f"<{t}:{n.bit_length()}>" for t, n in counts.items()]


#: Steps that a unit of a race key's logarithm is counted in; rows that may be sorted in one task.
STEPS, SORTED = 64, 200_000


def _minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[part : part + 4096, None] * a + b >> np.uint64(8)).min(axis=0))
    return least


def bucket_keys(pages: DataFrame, id_col: str, html_col: str, target_col: str) -> DataFrame:
    """`(id, fine array<bigint>, coarse array<bigint>, target)`; pages without content share one bucket each time."""
    draw = np.random.default_rng(11)
    n = FINE * ROWS
    a = draw.integers(1, 2**63, n + COARSE, dtype=np.uint64) | np.uint64(1)
    b = draw.integers(0, 2**63, n + COARSE, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pandas.util import hash_array

        order = np.arange(1, FINE + COARSE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            fine, coarse = [], []
            for page in batch.column(1).to_pylist():
                words, tags = page_features(page)
                h = hash_array(np.array(words or [""], dtype=object), categorize=False)
                mins = _minima(shingle_hashes(h), a[:n], b[:n])
                keys = np.zeros(FINE, np.uint64)
                for k in range(ROWS):
                    keys = (keys ^ mins[k::ROWS]) * np.uint64(0xBF58476D1CE4E5B9)
                    keys ^= keys >> np.uint64(31)
                both = np.unique(np.concatenate([h, hash_array(np.array(tags or [""], dtype=object), categorize=False)]))
                fine.append((keys ^ order[:FINE]).view(np.int64))
                coarse.append((_minima(both, a[n:], b[n:]) ^ order[FINE:]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.list_(pa.int64())), pa.array(coarse, pa.list_(pa.int64())), batch.column(2)], names=["id", "fine", "coarse", "target"])

    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(html_col).alias("html"), F.coalesce(target_key(F.col(target_col)), F.lit("")).alias("target"))
    return rows.mapInArrow(sign, "id bigint, fine array<bigint>, coarse array<bigint>, target string")


def _mean_counts(rows: DataFrame, total: int) -> DataFrame:
    """`(id, density)`: mean size of the buckets `key` of each row.

    Sizes are summed before any join. Hot buckets, whose number is bounded, are broadcast; the rows of all others meet
    their sizes in a join whose groups are small; buckets of one row need neither.
    """
    sizes = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    bound = max(2, int(total * HOT))
    hot = F.broadcast(sizes.where(F.col("n") >= bound).withColumnRenamed("n", "hot"))
    marked = rows.join(hot, "key", "left")
    cold = marked.where("hot is null").join(sizes.where(F.col("n") < bound), "key", "left").select("id", F.coalesce("n", F.lit(1)).alias("n"))
    return marked.where("hot is not null").select("id", F.col("hot").alias("n")).unionByName(cold).groupBy("id").agg(F.avg("n").alias("density"))


def densities(pages: DataFrame, id_col: str, html_col: str, target_col: str) -> DataFrame:
    """`(id, target, fine, coarse, by_target, density)` of every row with an id."""
    keys = stored(bucket_keys(pages, id_col, html_col, target_col), "bucket-keys")
    total = keys.count()
    fine = _mean_counts(keys.select("id", F.explode("fine").alias("key")), total).withColumnRenamed("density", "fine")
    coarse = _mean_counts(keys.select("id", F.explode("coarse").alias("key")), total).withColumnRenamed("density", "coarse")
    named = _mean_counts(keys.select("id", F.xxhash64("target").alias("key")), total).withColumnRenamed("density", "by_target")
    out = keys.select("id", "target").join(fine, "id").join(coarse, "id").join(named, "id")
    return out.withColumn("density", F.pow("fine", F.lit(POWERS[0])) * F.pow("coarse", F.lit(POWERS[1])) * F.pow("by_target", F.lit(POWERS[2])))


def varied_subset(weighted: DataFrame, size: int, seed: str) -> DataFrame:
    """Exactly `size` rows (all, if there are fewer), drawn one after another with probability inverse to `density`.

    Exponential races: the row with the smallest `-ln(u) * density` wins, `u` from a hash of seed and id; equal keys
    are decided by id. The last winner is found by counting rows per step of the key's logarithm, finer inside the
    step that it lies in, so that only the rows of one small step are ever sorted.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))
    raced = weighted.withColumn("race", -F.log(u) * F.col("density"))
    pool, won, scale = raced, None, STEPS
    while True:
        step = F.floor(F.log("race") * scale)
        counts = sorted((r["b"], r["n"]) for r in pool.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())  # the key's logarithm lies between -40 and 60
        last, before = None, 0
        for b, n in counts:
            if before + n >= size:
                last = b
                break
            before += n
        if last is None:
            return pool if won is None else won.unionByName(pool)
        below = pool.where(step < last)
        won = below if won is None else won.unionByName(below)
        pool, size, held = pool.where(step == last), size - before, dict(counts)[last]
        if held <= SORTED or scale >= 2**40:
            return won.unionByName(pool.orderBy("race", "id").limit(size))
        scale *= STEPS


def choose_subsets(tables: dict[str, tuple[DataFrame, str, str, str]], plan: DataFrame, seed: str = "subset") -> DataFrame:
    """`(plan_id, table_name, row_id)`: for each row of `plan` the ids of exactly `subset_size` rows of its table.

    `tables` gives for each name the table and its id, html and target columns. Null and blank html and targets that
    name nothing are kinds of their own; repeated rows share their chances. Plans of unknown tables or of size 0 or
    less choose nothing, empty tables likewise.
    """
    rows = plan.where("plan_id is not null and table_name is not null and subset_size > 0").orderBy("plan_id").collect()
    ready: dict[str, DataFrame] = {}
    out: DataFrame | None = None
    for r in rows:
        name = r["table_name"]
        if name not in tables:
            continue
        if name not in ready:
            table, id_col, html_col, target_col = tables[name]
            ready[name] = stored(densities(table, id_col, html_col, target_col).select("id", "density"), "densities")
        part = varied_subset(ready[name], r["subset_size"], f"{seed}/{r['plan_id']}").select(F.lit(r["plan_id"]).cast("bigint").alias("plan_id"), F.lit(name).alias("table_name"), F.col("id").alias("row_id"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return plan.selectExpr("cast(null as bigint) as plan_id", "table_name", "cast(null as bigint) as row_id").limit(0)
    return out
