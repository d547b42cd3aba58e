"""TF-IDF, sign-projection hashing and neighbours (VEC-*, LSH-*, SIM-01, JON-08..10, DED-*)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from pagelode.functions.text import indel_ratio, length_match, let
from pagelode.session import broadcast_if_small, stored

#: Masks beyond which a Hamming ball is searched by pairs of occupied bins rather than by flipping bits.
MASKS = 300
#: Leading bits of the numbers of grams by which their occurrences are counted.
GRAM_BITS = 18


def word_terms(text: Column, n: int = 3, stop_words: tuple[str, ...] | None = None) -> Column:
    """VEC-01: lower-case words of two letters or more without stop words, then their 1- to n-grams, with repeats.

    The stop words are Spark's English ones unless given.
    """
    if stop_words is None:
        stop_words = tuple(w for w in StopWordsRemover.loadDefaultStopWords("english") if len(w) > 1)
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(*stop_words))
    return let(words, lambda x: F.concat(x, *[_windows(x, F.size(x), k, lambda x, i, n: F.array_join(F.slice(x, i, n), " ")) for k in range(2, n + 1)]))


def _windows(x: Column, length: Column, k: int, cut) -> Column:
    """Consecutive pieces of k elements of `x`, none if it is shorter."""
    at = F.when(length >= k, F.sequence(F.lit(1), length - (k - 1))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(at, lambda i: cut(x, i, k))


def char_terms(text: Column, n: int = 3) -> Column:
    """VEC-03: character 1- to n-grams of a short text in lower case, with repeats."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return let(low, lambda x: F.concat(*[_windows(x, F.length(x), k, lambda x, i, n: F.substring(x, i, n)) for k in range(1, n + 1)]))


def fit_idf(docs: DataFrame, id_col: str, terms: Column, max_features: int | None = None) -> DataFrame:
    """VEC-05: a stored table `(term, df, idf)` with idf = ln((1 + N) / (1 + df)) + 1; at most `max_features` terms by corpus frequency, ties by term."""
    total = docs.count()
    counted = docs.select(F.col(id_col).alias("id"), F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    out = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    if max_features:
        out = most_frequent(stored(out, "terms"), max_features)
    return stored(out.select("term", "df", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf")), "idf")


def most_frequent(terms: DataFrame, most: int, count: str = "cf", name: str = "term") -> DataFrame:
    """The `most` rows of the greatest counts, ties by name; only rows of the last count are sorted.

    Counts have few distinct values, of which only the numbers of rows come to the driver.
    """
    held, last = 0, None
    for value, n in terms.groupBy(count).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc(count)).toLocalIterator():
        if held + n > most:
            last = value
            break
        held += n
    if last is None:
        return terms
    return terms.where(F.col(count) > last).unionByName(terms.where(F.col(count) == last).orderBy(name).limit(most - held))


def tfidf(docs: DataFrame, id_col: str, terms: Column, model: DataFrame) -> DataFrame:
    """VEC-01..05: long form `(id, term, weight)`, L2-normalised per document; documents without known terms have no row."""
    counted = docs.select(F.col(id_col).alias("id"), F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighted = counted.join(broadcast_if_small(model.select("term", "idf")), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def random_planes(dimensions: int, planes: int, seed: int = 42) -> np.ndarray:
    """LSH-01: normals of random planes, `(dimensions, planes)` standard normal entries."""
    return np.random.default_rng(seed).standard_normal((dimensions, planes))


def _matrix(lists: pa.ListArray, wide: int = 1) -> np.ndarray:
    """Rows of lists as one matrix, filled up with 0 to the longest; null lists and elements are 0."""
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    out = np.zeros((len(sizes), max(wide, int(sizes.max(initial=0)))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(float))
    return out


def dense_bins(vectors: DataFrame, id_col: str, vector_col: str, planes: int, seed: int = 42) -> DataFrame:
    """LSH-02, LSH-03, MTH-02: `(id, bin)` of dense vectors, a batch at a time by one matrix product; a zero vector has all bits set.

    Planes are drawn for the longest vector of the batch, row by row, so that a dimension has the same entries whatever the
    batch; null and empty vectors have all bits set, null elements count as 0.
    """
    if planes > 62:
        raise ValueError("a bin has at most 62 bits")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = np.left_shift(np.int64(1), np.arange(planes - 1, -1, -1, dtype=np.int64))
        for batch in batches:
            x = _matrix(batch.column(1))
            found = ((x @ random_planes(x.shape[1], planes, seed)) >= 0) @ power
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "bin"])

    rows = vectors.select(F.col(id_col).alias("id"), vector_col)
    return rows.mapInArrow(bits, StructType([rows.schema["id"], StructField("bin", LongType())]))


def hashed_normals(keys: np.ndarray, count: int) -> np.ndarray:
    """LSH-01: `(keys, count)` standard normal entries drawn from the hashes of terms: no matrix is kept for open vocabularies."""
    pairs = np.arange(-(-count // 2), dtype=np.uint64)
    z = keys.view(np.uint64)[:, None] + (pairs + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ z >> np.uint64(shift)) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    radius = np.sqrt(-2 * np.log(((z >> np.uint64(32)).astype(float) + 0.5) / 2**32))
    angle = (z & np.uint64(0xFFFFFFFF)).astype(float) * (2 * np.pi / 2**32)
    return np.concatenate([radius * np.cos(angle), radius * np.sin(angle)], axis=1)[:, :count]


def sparse_sketches(weights: DataFrame, planes: int, tables: int = 1) -> DataFrame:
    """LSH-01..03: `(id, bins array<bigint>)` of long-form vectors: a bin of `planes` bits in each of `tables` hash tables."""
    if planes > 62:
        raise ValueError("a bin has at most 62 bits")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = np.left_shift(np.int64(1), np.arange(planes - 1, -1, -1, dtype=np.int64))
        for batch in batches:
            found = []
            for terms in batch.column(1):
                held = terms.values
                sums = held.field(1).to_numpy() @ hashed_normals(held.field(0).to_numpy(), planes * tables)
                found.append((sums.reshape(tables, planes) >= 0) @ power)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "bins"])

    held = weights.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("term").alias("k"), "weight"))).alias("terms"))  # of one document
    return held.mapInArrow(bits, StructType([held.schema["id"], StructField("bins", ArrayType(LongType()))]))


def sparse_bins(weights: DataFrame, planes: int) -> DataFrame:
    """LSH-01..03: `(id, bin)` of long-form vectors in one hash table."""
    return sparse_sketches(weights, planes).select("id", F.get("bins", F.lit(0)).alias("bin"))


def ball_masks(planes: int, radius: int) -> int:
    return sum(math.comb(planes, r) for r in range(min(radius, planes) + 1))


def near_bins(queries: DataFrame, bins: DataFrame, planes: int, radius: int) -> DataFrame:
    """JON-08, LSH-04: `(query_bin, bin)` of occupied bins within a Hamming radius.

    Small balls flip the bits of the query bins and join on equality; large ones compare the distinct bins of both
    sides, blocked by pieces of the bits: two bins within `radius` agree in at least one of `radius + 1` pieces.
    """
    q, b = queries.select(F.col("bin").alias("query_bin")).distinct(), bins.select("bin").distinct()
    if ball_masks(planes, radius) <= MASKS:
        masks = [0]
        level = {0}
        for _ in range(min(radius, planes)):
            level = {m | 1 << i for m in level for i in range(planes) if not m >> i & 1}
            masks += sorted(level)
        flipped = q.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])))
        return flipped.withColumn("bin", F.col("query_bin").bitwiseXOR(F.col("mask"))).join(b, "bin").select("query_bin", "bin")
    pieces = min(radius + 1, planes)
    cuts = [planes * k // pieces for k in range(pieces + 1)]

    def blocked(df: DataFrame, col: str) -> DataFrame:
        keys = [F.struct(F.lit(k).alias("k"), F.shiftright(F.col(col), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("v")) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
        return df.withColumn("piece", F.explode(F.array(*keys)))

    met = blocked(q, "query_bin").join(blocked(b, "bin"), "piece")
    return met.where(F.bit_count(F.col("query_bin").bitwiseXOR(F.col("bin"))) <= radius).select("query_bin", "bin").distinct()


def candidates(queries: DataFrame, items: DataFrame, planes: int, radius: int) -> DataFrame:
    """JON-08: `(query_id, cand_id)` of all pairs whose bins lie within the radius, self left out."""
    pairs = near_bins(queries, items, planes, radius)
    q = queries.select(F.col("id").alias("query_id"), F.col("bin").alias("query_bin"))
    i = items.select(F.col("id").alias("cand_id"), "bin")
    return q.join(pairs, "query_bin").join(i, "bin").where("query_id <> cand_id").select("query_id", "cand_id")


def cosine_distance(a: Column, b: Column) -> Column:
    """SIM-01: 1 - cosine of two dense vectors, within [0, 2]; 1 with a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    cos = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.least(F.greatest(1 - F.coalesce(cos, F.lit(0.0)), F.lit(0.0)), F.lit(2.0))


def dense_edges(pairs: DataFrame, vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`(query_id, cand_id, distance)` of candidate pairs, a batch at a time; distances are those of `cosine_distance`."""
    a = vectors.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("va"))
    b = vectors.select(F.col(id_col).alias("cand_id"), F.col(vector_col).alias("vb"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            y = _matrix(batch.column(3), x.shape[1])
            x = np.pad(x, ((0, 0), (0, y.shape[1] - x.shape[1])))
            size = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
            cos = np.divide((x * y).sum(axis=1), size, out=np.zeros(len(size)), where=size > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.clip(1 - cos, 0, 2))], names=["query_id", "cand_id", "distance"])

    both = pairs.join(a, "query_id").join(b, "cand_id").select("query_id", "cand_id", "va", "vb")
    schema = StructType([both.schema["query_id"], both.schema["cand_id"], StructField("distance", DoubleType())])
    return both.mapInArrow(measure, schema).withColumn("distance", F.round("distance", 6))


def sparse_edges(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """`(query_id, cand_id, distance)` of candidate pairs of long-form normalised vectors, summed over shared terms."""
    a = left.select(F.col("id").alias("query_id"), "term", F.col("weight").alias("wa"))
    b = right.select(F.col("id").alias("cand_id"), "term", F.col("weight").alias("wb"))
    dots = pairs.join(a, "query_id").join(b, ["cand_id", "term"]).groupBy("query_id", "cand_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    out = pairs.join(dots, ["query_id", "cand_id"], "left")
    return out.select("query_id", "cand_id", F.round(F.least(F.greatest(1 - F.coalesce("dot", F.lit(0.0)), F.lit(0.0)), F.lit(2.0)), 6).alias("distance"))


def nearest(edges: DataFrame, k: int | None = None, cutoff: float | None = None) -> DataFrame:
    """JON-09, SRT-03, FLT-10: edges within a cutoff, of each query the k nearest, ties by candidate."""
    kept = edges if cutoff is None else edges.where(F.col("distance") <= cutoff)
    if k is None:
        return kept
    order = Window.partitionBy("query_id").orderBy("distance", "cand_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def closest(edges: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """AGG-15, DED-04: `(query_id, cand_id, distance)` of the nearest candidate; queries without one get null and infinity."""
    best = edges.groupBy("query_id").agg(F.min(F.struct("distance", "cand_id")).alias("m")).select("query_id", "m.cand_id", "m.distance")
    if queries is None:
        return best
    return queries.select(F.col("id").alias("query_id")).join(best, "query_id", "left").select("query_id", "cand_id", F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def leakage_filter(url_edges: DataFrame, html_edges: DataFrame, url_limit: float = 0.1, html_limit: float = 0.2) -> DataFrame:
    """DED-05: ids of queries whose nearest url is closer than one limit or whose nearest html is closer than the other."""
    url = url_edges.groupBy("query_id").agg(F.min("distance").alias("url_distance"))
    html = html_edges.groupBy("query_id").agg(F.min("distance").alias("html_distance"))
    both = url.join(html, "query_id", "full_outer")
    return both.where((F.col("url_distance") < url_limit) | (F.col("html_distance") < html_limit))


def leakage_counts(url_edges: DataFrame, html_edges: DataFrame, url_limit: float = 0.1, html_limit: float = 0.2) -> DataFrame:
    """AGG-26: how many ids the url, the html, both and either filter."""
    found = leakage_filter(url_edges, html_edges, url_limit, html_limit)
    u, h = F.coalesce(F.col("url_distance") < url_limit, F.lit(False)), F.coalesce(F.col("html_distance") < html_limit, F.lit(False))
    return found.agg(F.count_if(u).alias("by_url"), F.count_if(h).alias("by_html"), F.count_if(u & h).alias("by_both"), F.count(F.lit(1)).alias("by_either"))


def far_queries(url_edges: DataFrame, html_edges: DataFrame, limit: float) -> DataFrame:
    """DED-07, JON-04: ids whose nearest url and nearest html both lie farther than a limit; ids need edges of both kinds."""
    url = url_edges.groupBy("query_id").agg(F.min("distance").alias("url_distance"))
    html = html_edges.groupBy("query_id").agg(F.min("distance").alias("html_distance"))
    return url.join(html, "query_id").where((F.col("url_distance") > limit) & (F.col("html_distance") > limit))


def diversity_drop(edges: DataFrame, order: DataFrame, cutoff: float = 0.02, id_col: str = "id", rank_col: str = "rank") -> DataFrame:
    """DED-06: ids dropped by the greedy pass in order: those with a neighbour within the cutoff that comes later.

    The pass drops a row if a neighbour is not yet dropped; with symmetric edges that is the case exactly if a
    neighbour comes later. Edges are made symmetric first; neighbours outside `order` do not count.
    """
    close = edges.where(F.col("distance") <= cutoff).select("query_id", "cand_id")
    both = close.unionByName(close.select(F.col("cand_id").alias("query_id"), F.col("query_id").alias("cand_id")))
    q = order.select(F.col(id_col).alias("query_id"), F.col(rank_col).alias("rq"))
    c = order.select(F.col(id_col).alias("cand_id"), F.col(rank_col).alias("rc"))
    return both.join(q, "query_id").join(c, "cand_id").where("rc > rq").select(F.col("query_id").alias(id_col)).distinct()


def threshold_sweep(edges: DataFrame, thresholds: list[float], keep: int = 100, texts: DataFrame | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """AGG-16, WIN-07: per threshold, the number of the `keep` farthest edges within it and the median similarity of their texts.

    Similarity is SIM-02; ids are unique in `texts`, and an edge without both texts counts in the number only. Without
    `texts` the median is that of the distances, which is not the blueprint's.
    """
    levels = edges.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    met = edges.crossJoin(F.broadcast(levels)).where("distance <= threshold")  # one copy per threshold, of which there are few
    order = Window.partitionBy("threshold").orderBy(F.desc("distance"), "query_id", "cand_id")
    top = met.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep)
    value = "distance"
    if texts is not None:
        value = "ratio"
        q = texts.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("query_text"))
        c = texts.select(F.col(id_col).alias("cand_id"), F.col(text_col).alias("cand_text"))
        top = top.join(q, "query_id", "left").join(c, "cand_id", "left").withColumn(value, indel_ratio()("query_text", "cand_text"))
    return top.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile(value, F.lit(0.5)), 6).alias("median"))


def same_value_pairs(rows: DataFrame, id_col: str, column: str) -> DataFrame:
    """JON-10: per row its group of equal values and the number of others in it; no pairs are spelt out."""
    rows = rows.select(id_col, column)
    groups = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("group_id"))
    return rows.join(groups, column).select(id_col, "group_id", (F.col("n") - 1).alias("others"))


def gram_numbers(text: str, q: int) -> np.ndarray:
    """A number of 64 bits for each q-gram of a text, the same for the same gram."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    z = np.zeros(max(0, len(codes) - q + 1), np.uint64)
    for k in range(q):
        z = (z + codes[k : k + len(z)] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return z ^ z >> np.uint64(29)


def rare_grams(text: str, q: int, edits: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Numbers and places of the rarest q-grams of a text that `edits` insertions and deletions cannot all break; null if they can break all.

    Rarer is what has a lower count in `held`, by leading bits of the numbers, then a lower number: one order for all texts.
    """
    z = gram_numbers(text, q)
    order = np.lexsort((z, held[z >> np.uint64(64 - GRAM_BITS)]))
    z = z[order]

    def needed(k: int) -> int:
        n, stop = 0, 0
        for at in sorted(order[:k].tolist()):
            if at >= stop:
                n, stop = n + 1, at + q
        return n

    low, high = edits + 1, len(z)
    if high < low or needed(high) <= edits:
        return None
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(mid) > edits else (mid + 1, high)
    while low < len(z) and z[low] == z[low - 1]:
        low += 1
    return z[:low], order[:low]


def indel_edges(rows: DataFrame, id_col: str, text_col: str, rank_col: str, ratio: float = 0.95, gram: int = 8) -> DataFrame:
    """DED-01, DED-02, JON-07: `(query_id, cand_id, ratio)` of texts of similarity `ratio` or more, the candidate later in order.

    Equal texts are one text throughout. Each other text is known by its rarest grams (of `gram` characters at most) that
    more edits would be needed to break than a similar text can have; of two similar texts at least one such gram is
    common to both. Where texts meet, lengths (FLT-14), the shift of the gram and the numbers of letters rule pairs out
    that cannot agree. Texts that so many edits break wholly, as the limit is low, meet all texts of like length.
    """
    most = 1 - ratio + 1e-6  # a ratio that is rounded up to the limit counts
    q = max(1, min(gram, int(0.45 * (1 - most) / (2 * most))))
    texts = rows.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t")).distinct()
    texts = stored(texts.select("t", F.length("t").alias("n"), F.xxhash64("t").alias("h")), "indel-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << GRAM_BITS, np.int64)
        for batch in batches:
            places, n = np.unique(gram_numbers("".join(batch.column(0).to_pylist()), q) >> np.uint64(64 - GRAM_BITS), return_counts=True)
            held[places.astype(np.int64)] += n
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], names=["place", "n"])

    counts = texts.select("t").mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(1 << GRAM_BITS, np.int32)
    held[counts.column("place").to_numpy()] = np.minimum(counts.column("n").to_numpy(), 2**31 - 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                loose = []
                for h, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    edits = int(2 * len(t) * most / (1 - most) + 1e-9)
                    if not edits:  # none but an equal text is so similar
                        continue
                    found = rare_grams(t, q, edits, held)
                    if found is None:
                        loose.append((h, len(t)))
                        continue
                    # How often letters occur, in bits: the numbers of unlike bits and of edits differ in one direction only.
                    letters = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % 32, minlength=32)
                    bits = ((1 << np.minimum(letters, 8)) - 1).astype(np.uint8).view(np.int64)
                    k = len(found[0])
                    for held_in, x in zip(out, (np.full(k, h, np.int64), found[0].view(np.int64), found[1], np.full(k, len(t)), np.tile(bits, (k, 1)))):
                        held_in.append(x)
                if out[0]:
                    h, g, at, n, bits = (np.concatenate(x) for x in out)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), *[pa.array(bits[:, k]) for k in range(4)]], names=names)
                if loose:
                    none = lambda kind: pa.nulls(len(loose), kind)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in loose], pa.int64()), none(pa.int64()), none(pa.int32()), pa.array([n for _, n in loose], pa.int32()), *[none(pa.int64())] * 4], names=names)

    names = ["h", "g", "at", "n", "b0", "b1", "b2", "b3"]
    grams = stored(texts.select("h", "t").mapInArrow(cut, "h bigint, g bigint, at int, n int, b0 bigint, b1 bigint, b2 bigint, b3 bigint"), "indel-grams")
    a, b = (grams.where("g is not null").select("g", *[F.col(c).alias(c + side) for c in names if c != "g"]) for side in "xy")
    edits = (F.col("nx") + F.col("ny")) * F.lit(most)
    shift = F.abs(F.col("atx") - F.col("aty")) + F.abs(F.col("nx") - F.col("atx") - F.col("ny") + F.col("aty"))
    unlike = sum((F.bit_count(F.col(f"b{k}x").bitwiseXOR(F.col(f"b{k}y"))) for k in range(1, 4)), F.bit_count(F.col("b0x").bitwiseXOR(F.col("b0y"))))
    met = a.join(b, (a["g"] == b["g"]) & (F.col("hx") < F.col("hy")) & (shift <= edits) & (unlike <= edits)).select(F.col("hx").alias("x"), F.col("hy").alias("y"))
    # Two texts of similarity r differ by at most (la + lb)(1 - r) in length: buckets of such a width, and the next ones.
    width = math.log((1 + most) / (1 - most))
    bucket = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.lit(width)).cast("int")
    near = grams.where("g is null").select("h", "n", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("k"))
    other = texts.select(F.col("h").alias("h2"), F.col("n").alias("n2"), bucket.alias("k"))
    loose = near.join(other, "k").where((F.col("h") != F.col("h2")) & length_match(F.col("n"), F.col("n2"), 1 - most))
    pairs = stored(met.unionByName(loose.select(F.least("h", "h2").alias("x"), F.greatest("h", "h2").alias("y"))).distinct(), "indel-pairs")
    a, b = texts.select(F.col("h").alias("x"), F.col("t").alias("tx")), texts.select(F.col("h").alias("y"), F.col("t").alias("ty"))
    scored = pairs.join(a, "x").join(b, "y").withColumn("ratio", F.round(indel_ratio()("tx", "ty"), 6)).where(F.col("ratio") >= ratio).select("x", "y", "ratio")
    same = texts.select(F.col("h").alias("x"), F.col("h").alias("y"), F.lit(1.0).alias("ratio"))
    links = scored.unionByName(scored.select(F.col("y").alias("x"), F.col("x").alias("y"), "ratio")).unionByName(same)
    member = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(rank_col).alias("r"), F.xxhash64(text_col).alias("h"))
    q = member.select(F.col("id").alias("query_id"), F.col("r").alias("rq"), F.col("h").alias("x"))
    c = member.select(F.col("id").alias("cand_id"), F.col("r").alias("rc"), F.col("h").alias("y"))
    return q.join(links, "x").join(c, "y").where("rc > rq").select("query_id", "cand_id", "ratio")
