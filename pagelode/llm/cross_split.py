"""Same or near-same records across splits (problem 6).

Minwise hashes of word shingles with banded buckets. Pages with the same text are one class from the start; only
classes on both sides of a bucket are paired; each pair is verified on its words: exact Jaccard similarity of the
shingles and the share of words that agree in order. Where texts meet, a sketch of their words rules out most pairs
that cannot agree, before any pair is shuffled. A short text has so few shingles that a tenth of its words can
change nearly all of them; such texts, and those of buckets with very many texts, are paired exactly by their rarest
words instead.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.functions.html import visible_text
from pagelode.functions.urls import address_key, host_key
from pagelode.session import broadcast_if_small, drop_scratch, stored, write_scratch

#: Words of a shingle, hashes per band and bands. A pair meets in a band with probability 0.99999 at a Jaccard
#: similarity of 0.6, 0.998 at 0.48, 0.986 at 0.42, which is where a tenth of the words of a long text changed by chance
#: leaves it, and 0.87 at 0.33, the least there can be: all changes more than a shingle apart.
SHINGLE, ROWS, BANDS = 5, 3, 56
#: Words of a text below which it is paired by its rarest words, and slots of the table of word frequencies.
SHORT, SLOTS = 60, 1 << 18
#: Texts with one key on one side beyond which they are spread over several tasks.
HOT_KEY = 4096
#: Least share of the longer text's words that agree in order.
AGREEMENT = 0.9
#: Texts in one bucket beyond which it is resolved by rare words.
HOT_BUCKET = 500
#: Numbers of 64 bits in the sketch of a text's words.
SKETCH = 8
#: Rows that meet at once: more are taken in slices of keys, whose shuffle files are gone before the next slice.
MEET_ROWS = 20_000_000
CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿가-힯]|[^\\s぀-ヿ㐀-鿿豈-﫿가-힯]+")


def text_words(text: str) -> list[str]:
    """Lower-case words between white space; in scripts written without spaces each character is a word."""
    text = text.lower()
    return text.split() if text.isascii() or not re.search("[぀-ヿ㐀-鿿]", text) else CJK.findall(text)


def _word_hashes(words: list[str]) -> np.ndarray:
    from pandas.util import hash_array

    return hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20250101)
    return draw.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), draw.integers(0, 2**63, n, dtype=np.uint64)


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `size` words; a shorter text is one shingle."""
    n = len(hashes) - size + 1
    if n < 1:
        size, n = len(hashes), min(1, len(hashes))
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def word_sketch(hashes: np.ndarray) -> np.ndarray:
    """Bits of the words a text has: a bit that only one of two texts has is a word that the other lacks."""
    bits = np.zeros(64 * SKETCH, np.uint8)
    bits[(hashes >> np.uint64(40)) % np.uint64(64 * SKETCH)] = 1
    return np.packbits(bits).view(np.int64)


def band_keys(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key per band from the minima of the hash functions; none for no shingles."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[part : part + 4096, None] * a + b >> np.uint64(8)).min(axis=0))
    out = np.zeros(len(a) // rows, np.uint64)
    for k in range(rows):
        out = (out ^ least[k::rows]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return ((out ^ np.arange(len(out), dtype=np.uint64)) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def agreeing_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[int, int] = defaultdict(int)
    for i, w in enumerate(a):
        where[w] |= 1 << i
    full = state = (1 << len(a)) - 1
    for w in b:
        hit = state & where.get(w, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def page_signatures(pages: DataFrame, id_col: str = "page_id", split_col: str = "split", html_col: str = "html", train: str = "train") -> DataFrame:
    """`(page_id, train, text_id, n_words, words, sketch)` of pages whose body shows any text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, ids, counts, words_of, sketches = [], [], [], [], []
            for i, page in enumerate(batch.column(2).to_pylist()):
                words = text_words(visible_text(page))
                if not words:
                    continue
                hashes = _word_hashes(words)
                keep.append(i)
                ids.append(hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest())
                counts.append(len(words))
                words_of.append(hashes.view(np.int64))
                sketches.append(word_sketch(hashes))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(ids, pa.binary()), pa.array(counts, pa.int32()), pa.array(words_of, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["page_id", "train", "text_id", "n_words", "words", "sketch"])

    rows = pages.where(F.col(id_col).isNotNull() & F.col(split_col).isNotNull() & F.col(html_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("bigint").alias("page_id"), (F.lower(F.trim(split_col)) == train).alias("train"), F.col(html_col).alias("html"))
    return rows.mapInArrow(sign, "page_id bigint, train boolean, text_id binary, n_words int, words array<bigint>, sketch array<bigint>")


def text_bands(reps: DataFrame) -> DataFrame:
    """`(key, rep, n_words, in_train, in_eval)`: each text of `SHORT` words and more under its band keys."""
    coefficients = _coefficients(ROWS * BANDS)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients
        for batch in batches:
            keys = [band_keys(shingle_hashes(w.values.to_numpy().view(np.uint64)), a, b) for w in batch.column(4)]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([flat, *(c.take(at) for c in batch.columns[:4])], names=["key", "rep", "n_words", "in_train", "in_eval"])

    long = reps.where(F.col("n_words") >= SHORT).select("rep", "n_words", "in_train", "in_eval", "words")
    return long.mapInArrow(band, "key bigint, rep bigint, n_words int, in_train boolean, in_eval boolean")


def rare_keys(texts: DataFrame, agreement: float = AGREEMENT) -> DataFrame:
    """`(key, rep, n_words, in_train, in_eval)`: each text under its rarest words, so that texts that agree share one.

    If a tenth of the words may differ, at least one of a text's `n_words // 10 + 1` rarest distinct words must be in the
    other text, and among its rarest as well, in one order of all words. Any order that all texts share will do; this
    one goes by the texts that have a word of the same slot of a fixed table, then by the word's hash.
    """
    each = texts.select(F.explode(F.array_distinct("words")).alias("word")).select(F.col("word").bitwiseAND(F.lit(SLOTS - 1)).alias("slot"))
    seen = np.zeros(SLOTS, np.int64)
    for r in each.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():  # at most SLOTS rows
        seen[r["slot"]] = r["n"]
    shared = texts.sparkSession.sparkContext.broadcast(seen)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            keys = []
            for n, words in zip(batch.column(1).to_pylist(), batch.column(4)):
                known = np.unique(words.values.to_numpy())
                order = np.lexsort((known, often[known & np.int64(SLOTS - 1)]))
                keys.append(known[order[: int(n * (1 - agreement) + 1e-9) + 1]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(keys, pa.list_(pa.int64()))], names=["rep", "n_words", "in_train", "in_eval", "keys"])

    kept = texts.select("rep", "n_words", "in_train", "in_eval", "words").mapInArrow(rarest, "rep bigint, n_words int, in_train boolean, in_eval boolean, keys array<bigint>")
    return kept.select(F.explode("keys").alias("key"), "rep", "n_words", "in_train", "in_eval")


def _meetings(rows: DataFrame, sketches: DataFrame, agreement: float, most: int | None = None) -> DataFrame:
    """Distinct pairs `(a, b)` of texts, a < b, that share a key, lie on both sides and may agree by lengths and sketches.

    If `agreement` of the longer text's words are in the other one, in any order, the rest bounds the words of either
    text that the other lacks, and so the bits: no pair that agrees is ruled out. Keys with very many texts are spread
    over several tasks, unless no key has more than `most`: their train side is cut, the other goes to every cut.
    """
    if most is not None and most <= HOT_KEY:
        cut = rows.withColumn("cuts", F.lit(1))
    else:
        hot = rows.where("in_train").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_KEY).select("key", F.ceil(F.col("n") / HOT_KEY).cast("int").alias("cuts"))
        cut = rows.join(broadcast_if_small(hot), "key", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    cut = cut.join(sketches, "rep")
    left = cut.where("in_train").select("key", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int").alias("cut"), F.col("rep").alias("x"), F.col("n_words").alias("nx"), *(F.col(f"s{k}").alias(f"x{k}") for k in range(SKETCH)))
    right = cut.where("in_eval").select("key", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.col("rep").alias("y"), F.col("n_words").alias("ny"), *(F.col(f"s{k}").alias(f"y{k}") for k in range(SKETCH)))
    least = F.lit(agreement) * F.greatest("nx", "ny") - 1e-6
    only = lambda a, b: sum((F.bit_count(F.col(f"{a}{k}").bitwiseAND(F.bitwise_not(f"{b}{k}"))) for k in range(SKETCH)), F.lit(0))
    met = left.join(right, ["key", "cut"]).where(F.col("x") != F.col("y")).where(F.least("nx", "ny") >= least)
    met = met.where(only("x", "y") <= F.col("nx") - least).where(only("y", "x") <= F.col("ny") - least)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _met(rows: DataFrame, sketches: DataFrame, agreement: float, most: int | None = None) -> list[DataFrame]:
    """The meetings of all rows as stored tables, a slice of the keys each."""
    slices = max(1, -(-rows.count() // MEET_ROWS))
    part = F.pmod(F.xxhash64("key"), F.lit(slices))
    return [stored(_meetings(rows.where(part == k) if slices > 1 else rows, sketches, agreement, most), "text-pairs", tidy=True) for k in range(slices)]


def near_texts(signed: DataFrame, texts: DataFrame, agreement: float = AGREEMENT, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """`(a, b, jaccard, agreement)`: pairs of representatives of different texts that nearly agree."""
    spark = signed.sparkSession
    reps = signed.join(texts.select(F.col("rep").alias("page_id"), "in_train", "in_eval"), "page_id").withColumnRenamed("page_id", "rep")
    sketches = signed.select(F.col("page_id").alias("rep"), *(F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH)))
    made = text_bands(reps)
    path = write_scratch(made, "bands", tidy=True)
    bands = spark.read.schema(made.schema).parquet(path)
    side = F.col("in_train").cast("int") + 2 * F.col("in_eval").cast("int")
    buckets = bands.groupBy("key").agg(F.bit_or(side).alias("sides"), F.count(F.lit(1)).alias("n")).where("sides = 3 and n > 1")
    buckets = stored(buckets.select("key", (F.col("n") > hot_bucket).alias("hot")), "buckets", tidy=True)
    words = signed.select(F.col("page_id").alias("rep"), "n_words", "words")
    live = stored(bands.join(buckets, "key"), "live-bands", tidy=True)
    drop_scratch(spark, path)
    tables = _met(live.where("not hot").drop("hot"), sketches, agreement, hot_bucket)
    # The longer one of a pair with a short text is at most that much longer.
    short = F.col("n_words") * agreement <= SHORT
    exact = reps.where(short).select("rep", "n_words", "in_train", "in_eval", "words")
    hot = live.where("hot").select("rep").distinct()
    exact = exact.unionByName(reps.where(~short).join(broadcast_if_small(hot), "rep", "left_semi").select(exact.columns))
    known = stored(exact, "exact-texts", tidy=True)
    if not known.isEmpty():
        tables += _met(stored(rare_keys(known, agreement), "rare-keys", tidy=True), sketches, agreement)
    pairs = stored(reduce(DataFrame.unionByName, tables).distinct(), "pairs", tidy=True) if len(tables) > 1 else tables[0]
    need = stored(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct(), "needed", tidy=True)
    held = words.join(broadcast_if_small(need), "rep", "left_semi")
    both = pairs.join(held.select(F.col("rep").alias("a"), F.col("words").alias("wa")), "a").join(held.select(F.col("rep").alias("b"), F.col("words").alias("wb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar, agree = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = x.values.to_numpy(), y.values.to_numpy()
                s = shingle_hashes(u.view(np.uint64)), shingle_hashes(v.view(np.uint64))
                inter = len(np.intersect1d(*s, assume_unique=True))
                similar.append(inter / (len(s[0]) + len(s[1]) - inter))
                longest = max(len(u), len(v))
                # A change touches SHINGLE shingles at most: too few in common rules the pair out.
                if inter < max(map(len, s)) - SHINGLE * 2 * (longest * (1 - agreement) + 1):
                    agree.append(0.0)
                else:
                    agree.append(agreeing_words(u.tolist(), v.tolist()) / longest)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar, pa.float64()), pa.array(agree, pa.float64())], names=["a", "b", "jaccard", "agreement"])

    checked = both.select("a", "b", "wa", "wb").mapInArrow(verify, "a bigint, b bigint, jaccard double, agreement double")
    return checked.where(F.col("agreement") >= agreement - 1e-9)


def _across(left: DataFrame, key: str) -> DataFrame:
    """Pairs `(train page, other page)` of members with the same key."""
    t = left.where("train").select(key, F.col("page_id").alias("t"))
    e = left.where("not train").select(key, F.col("page_id").alias("e"))
    return t.join(e, key).select("t", "e")


def cross_split_pairs(pages: DataFrame, id_col: str = "page_id", split_col: str = "split", html_col: str = "html", url_col: str = "url", train: str = "train") -> DataFrame:
    """`(page_id_a, page_id_b)`, smaller first: pairs of a train page and one of another split that are the same or nearly.

    Same: the visible words of the bodies agree in at least nine tenths of the longer one's words in order, or the
    urls are one address apart from scheme, host case, default port, final slash, fragment and tracking parameters.
    Null, blank and textless html matches nothing by text; null urls match nothing by url; rows without id or split
    take no part. Every pair comes once, also if repeated rows or both reasons give it.
    """
    made = page_signatures(pages, id_col, split_col, html_col, train)
    path = write_scratch(made, "signatures", tidy=True)
    signed = pages.sparkSession.read.schema(made.schema).parquet(path)
    texts = stored(signed.groupBy("text_id").agg(F.min("page_id").alias("rep"), F.bool_or("train").alias("in_train"), F.bool_or(~F.col("train")).alias("in_eval")), "texts", tidy=True)
    near = stored(near_texts(signed, texts).select("a", "b"), "near", tidy=True)
    member = signed.select("page_id", "train", "text_id").join(texts.select("text_id", "rep"), "text_id").select("page_id", "train", "rep")
    member = stored(member, "members", tidy=True)
    drop_scratch(pages.sparkSession, path)
    same = _across(member, "rep")
    x = member.select(F.col("rep").alias("a"), F.col("page_id").alias("p"), F.col("train").alias("tp"))
    y = member.select(F.col("rep").alias("b"), F.col("page_id").alias("q"), F.col("train").alias("tq"))
    close = near.join(x, "a").join(y, "b").where("tp <> tq").select(F.col("p").alias("t"), F.col("q").alias("e"))
    links = pages.where(F.col(id_col).isNotNull() & F.col(split_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("page_id"), (F.lower(F.trim(split_col)) == train).alias("train"), address_key(F.col(url_col)).alias("address")).where("address is not null")
    found = same.unionByName(close).unionByName(_across(links, "address"))
    return found.select(F.least("t", "e").alias("page_id_a"), F.greatest("t", "e").alias("page_id_b")).distinct()


def overlap_report(pairs: DataFrame, pages: DataFrame, id_col: str = "page_id", split_col: str = "split", url_col: str = "url", train: str = "train") -> DataFrame:
    """`(split, source, n_pairs, n_pages, n_train_pages)`: overlaps per split and host of the page that is not in train."""
    about = pages.select(F.col(id_col).alias("id"), F.lower(F.trim(split_col)).alias("s"), F.coalesce(host_key(F.col(url_col)), F.lit("")).alias("h"))
    a = about.select(F.col("id").alias("page_id_a"), F.col("s").alias("sa"), F.col("h").alias("ha"))
    b = about.select(F.col("id").alias("page_id_b"), F.col("s").alias("sb"), F.col("h").alias("hb"))
    full = pairs.join(a, "page_id_a").join(b, "page_id_b")
    first = F.col("sa") != train
    each = full.select(F.when(first, F.col("sa")).otherwise(F.col("sb")).alias("split"), F.when(first, F.col("ha")).otherwise(F.col("hb")).alias("source"), F.when(first, F.col("page_id_a")).otherwise(F.col("page_id_b")).alias("page"), F.when(first, F.col("page_id_b")).otherwise(F.col("page_id_a")).alias("train_page"))
    return each.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("page").alias("n_pages"), F.countDistinct("train_page").alias("n_train_pages"))
