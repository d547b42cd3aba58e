"""Mixing sources to target weights (problem 9).

Token counts give every source an exact quota. A splitting tree of multivariate hypergeometric draws divides the
blocks of all sources among the output shards; each shard gets a random number of blocks of each source, the numbers
add up exactly, and the blocks of a source, in the random order of a hash, go to the shards in disjoint runs. Inside a
shard the order is a hash order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm.tokens import encoder, vocabulary_path
from pagelode.operators.prefix import hash_running_sum
from pagelode.session import broadcast_if_small, stored

#: Tokens meant for one output shard, whose number follows from the size of the mix, and blocks a shard is made of.
SHARD_TOKENS, SHARD_BLOCKS = 20_000_000, 64
#: Nodes of the splitting tree that the driver grows, about; the rest grows on the executors.
TOP_NODES = 1024


def token_counts(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str | None = None) -> DataFrame:
    """`(doc_id, source, n_tokens)`: sources without case and outer blanks; null and empty texts have 0 tokens."""
    path = vocabulary_path(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    rows = docs.select(F.col(doc_col).cast("bigint").alias("doc_id"), F.lower(F.trim(F.regexp_replace(source_col, r"\s+", " "))).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")


def split_node(first: int, last: int, have: np.ndarray, seed: int) -> tuple[int, np.ndarray]:
    """The middle of the shards `first` to `last` and how many blocks of each source the left half gets.

    A multivariate hypergeometric draw in proportion to the numbers of shards, seeded by the node's place in the tree.
    """
    middle = (first + last) // 2
    total = int(have.sum())
    give = int(total * (middle - first) // (last - first))
    return middle, np.random.default_rng([seed, first, last]).multivariate_hypergeometric(have, give, method="marginals") if total else have


def grow(first: int, last: int, have: np.ndarray, seen: np.ndarray, seed: int, leaves: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Nodes `(first, last, blocks, blocks before)` of at most `leaves` shards below a node, from left to right."""
    todo = [(first, last, have, seen)]
    while todo:
        first, last, have, seen = todo.pop()
        if last - first <= leaves:
            yield first, last, have, seen
            continue
        middle, draw = split_node(first, last, have, seed)
        todo += [(middle, last, have - draw, seen + draw), (first, middle, draw, seen)]


def splitting_tree(spark: SparkSession, blocks: list[int], shards: int, seed: int) -> DataFrame:
    """`(source_no, block, shard)`: every block of every source goes to one shard.

    The driver grows the top of the tree, at most some thousand nodes; the executors grow the rest. The blocks of a
    source are in hash order, which is a random one, and each shard takes a run of them.
    """
    have = np.asarray(blocks, dtype=np.int64)
    top = [(f, t, h.tolist(), s.tolist()) for f, t, h, s in grow(0, shards, have, np.zeros_like(have), seed, max(1, shards // TOP_NODES))]
    nodes = spark.createDataFrame(top, "first bigint, last bigint, have array<bigint>, seen array<bigint>").repartition(min(len(top), spark.sparkContext.defaultParallelism))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, held, before in zip(*(c.to_pylist() for c in batch.columns)):
                for shard, _, n, seen in grow(first, last, np.array(held, dtype=np.int64), np.array(before, dtype=np.int64), seed):
                    of = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(np.full(len(of), shard), pa.int64()), pa.array(seen[of]), pa.array(seen[of] + n[of] - 1)], names=["source_no", "shard", "from", "to"])

    dealt = nodes.mapInArrow(expand, "source_no int, shard bigint, from bigint, to bigint")
    return dealt.select("source_no", F.explode(F.sequence("from", "to")).alias("block"), "shard")


def mix_quotas(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """Token quota of every source of `targets`: one dict a source, as many as `targets` has rows.

    Shares of sources that have no tokens are spread over the others in proportion. Without `total_tokens` the mix
    is as large as the scarcest source allows at `max_repeats`; a larger wish is cut to that size, as shares come first.
    """
    have = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.when(F.col("n_tokens") > 0, 1)).alias("docs"))
    key = F.lower(F.trim(F.regexp_replace("source", r"\s+", " ")))
    plan = targets.select(key.alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = [r.asDict() for r in plan.join(have, "source", "left").orderBy("source").collect()]
    for r in rows:
        r["tokens"], r["docs"], r["target_share"] = r["tokens"] or 0, r["docs"] or 0, max(0.0, r["target_share"] or 0.0)
        r["room"] = r["tokens"] * max(0, r["max_repeats"] or 0)
    whole = sum(r["target_share"] for r in rows if r["room"])
    for r in rows:
        r["share"] = r["target_share"] / whole if r["room"] and whole else 0.0
    most = min((r["room"] / r["share"] for r in rows if r["share"] > 0), default=0)
    size = min(most, total_tokens) if total_tokens else most
    for r in rows:
        r["quota"] = min(r["room"], int(round(size * r["share"])))
        r["full"], r["rest"] = divmod(r["quota"], r["tokens"]) if r["tokens"] else (0, 0)
    return rows


def _selected(counts: DataFrame, quotas: list[dict], seed: str) -> DataFrame:
    spark = counts.sparkSession
    plan = F.broadcast(spark.createDataFrame([(r["source"], r["full"], r["rest"]) for r in quotas], "source string, full bigint, rest bigint"))  # one row a source of the plan
    usable = counts.where("n_tokens > 0 and doc_id is not null").join(plan, "source")
    summed = hash_running_sum(usable, ["source"], "doc_id", "n_tokens", "before", seed, sum(r["docs"] for r in quotas))
    # In hash order, whole documents as long as they fit in the rest of the quota; then the one that fits the gap best.
    picked = stored(summed.withColumn("fits", F.col("before") + F.col("n_tokens") <= F.col("rest")), "picked")
    gaps = picked.groupBy("source").agg((F.max("rest") - F.sum(F.when(F.col("fits"), F.col("n_tokens")).otherwise(0))).alias("gap"))
    missed = F.abs(F.col("n_tokens") - F.col("gap"))
    best = picked.where("not fits").join(broadcast_if_small(gaps), "source").where(missed < F.col("gap")).groupBy("source").agg(F.min_by("doc_id", F.struct(missed, "doc_id")).alias("extra"))
    picked = picked.join(broadcast_if_small(best), "source", "left")
    copies = F.col("full") + F.when(F.col("fits") | F.coalesce(F.col("doc_id") == F.col("extra"), F.lit(False)), 1).otherwise(0)
    return picked.withColumn("copies", copies.cast("bigint")).where("copies > 0")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, shard_tokens: int = SHARD_TOKENS, doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str | None = None) -> DataFrame:
    """`(doc_id, source, copy_no, n_tokens, shard, place)`: one row per occurrence of a document in the mix.

    `copy_no` counts from 1 and never exceeds the source's `max_repeats`; `place` is the row's position in its shard.
    Documents with a null id, no tokens, or a source that is null or not in `targets` are left out; so is every
    source without tokens. Empty input or an empty plan gives no rows. Repeated texts count as separate documents.
    """
    spark = docs.sparkSession
    counts = stored(token_counts(docs, doc_col, text_col, source_col, tokenizer), "token-counts")
    quotas = mix_quotas(counts, targets, total_tokens)
    chosen = _selected(counts, quotas, str(seed))
    copies = chosen.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("doc_id", "source", "copy_no", "n_tokens", F.concat_ws("/", "doc_id", "copy_no").alias("key"))
    copies = stored(copies, "mix-copies")
    sizes = {r["source"]: (r["tokens"], r["n"]) for r in copies.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}  # a row a source of the plan
    total, rows = sum(t for t, _ in sizes.values()), sum(n for _, n in sizes.values())
    shards = max(1, -(-total // shard_tokens))
    block_tokens = max(1, shard_tokens // SHARD_BLOCKS)
    names = sorted(sizes)
    numbered = F.broadcast(spark.createDataFrame(list(zip(names, range(len(names)))), "source string, source_no int"))  # a row a source of the plan
    # A block is a run of a source's copies in hash order that begins within the same `block_tokens`.
    placed = hash_running_sum(copies.join(numbered, "source"), ["source_no"], "key", "n_tokens", "at", f"block{seed}", rows)
    blocks = placed.withColumn("block", F.floor(F.col("at") / block_tokens))
    dealt = splitting_tree(spark, [-(-sizes[n][0] // block_tokens) for n in names], shards, seed)
    out = blocks.join(broadcast_if_small(stored(dealt, "mix-deal")), ["source_no", "block"]).withColumn("one", F.lit(1))
    out = hash_running_sum(out, ["shard"], "key", "one", "place", f"place{seed}")
    return out.select("doc_id", "source", "copy_no", "n_tokens", F.col("shard").cast("bigint").alias("shard"), F.col("place").cast("bigint").alias("place"))


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of `targets`: target share, tokens, share reached, occurrences, documents, most repeats of one."""
    key = F.lower(F.trim(F.regexp_replace("source", r"\s+", " ")))
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    made = per_doc.groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("documents"), F.max("n").alias("most_repeats"))
    total = mixed.agg(F.sum("n_tokens").alias("all_tokens"))
    out = targets.select(key.alias("source"), "target_share", "max_repeats").join(made, "source", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("source", "target_share", "max_repeats", zero("tokens"), F.round(F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)), 6).alias("actual_share"), zero("occurrences"), zero("documents"), zero("most_repeats"))
