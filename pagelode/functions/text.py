"""String, number and array column expressions (STR-*, MTH-*)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Words that mark the name of a business.
BUSINESS_WORDS = ("hair", "shop", "store", "gmbh", "restaurant")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once per row, also where a lambda inside `use` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def byte_length(text: Column) -> Column:
    """STR-07: length in UTF-8 bytes."""
    return F.octet_length(text)


def collapse_space(text: Column) -> Column:
    """STR-08: runs of Unicode white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    """STR-10: runs of characters other than white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


def tokens_by_words(text: Column) -> Column:
    """STR-10: words times 1.3, cut to a whole number."""
    return F.floor(word_count(text) * F.lit(1.3)).cast("bigint")


def tokens_by_length(text: Column) -> Column:
    """STR-10: a quarter of the length, cut to a whole number."""
    return F.floor(F.length(text) / 4).cast("bigint")


def char_ngrams(prefix: str, n: int = 4, compat: bool = True):
    """STR-09: an Arrow UDF from text to its character n-grams with a channel prefix.

    With `compat` the last n-gram is left out, so that a text of n characters or less has none; null gives [].
    """

    @pandas_udf("array<string>")
    def grams(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [f"{prefix}_{t[i : i + n]}" for i in range(len(t) - n + (not compat))] if t else [])

    return grams


def pii_candidates(url: Column) -> Column:
    """STR-12: names that path segments may spell: at least two alphabetic parts between `-` and `_`, capitalised."""
    path = F.split(url, "/")
    parts = lambda s: F.filter(F.split(F.replace(s, F.lit("-"), F.lit("_")), "_"), lambda t: t.rlike(r"^\p{L}+$"))
    named = F.transform(path, lambda s: F.when(F.size(parts(s)) >= 2, F.array_join(F.transform(parts(s), F.initcap), " ")))
    return F.filter(named, lambda s: s.isNotNull())


def is_probable_name(name: Column, business: tuple[str, ...] = BUSINESS_WORDS) -> Column:
    """STR-13: two to four words, alphabetic ones with a capital, none that marks a business."""
    words = F.split(F.trim(name), r"\s+")
    capital = F.forall(words, lambda w: ~w.rlike(r"^\p{L}+$") | w.rlike(r"^\p{Lu}"))
    return F.size(words).between(2, 4) & capital & ~F.exists(words, lambda w: F.lower(w).isin(*business))


def person_span(tokens: Column, confidence: float = 0.5) -> Column:
    """STR-14: the first person's name in `array<struct<word, tag, score>>` with BIO tags; null if there is none.

    B-PER with enough confidence begins a name (a later one begins anew), I-PER goes on, anything else ends it.
    """
    start = F.struct(F.expr("cast(array() as array<string>)").alias("name"), F.lit(False).alias("done"))

    def step(acc: Column, t: Column) -> Column:
        sure = t["score"] >= confidence
        begins, goes = (t["tag"] == "B-PER") & sure, (t["tag"] == "I-PER") & sure & (F.size(acc["name"]) > 0)
        ended = F.struct(acc["name"].alias("name"), (F.size(acc["name"]) > 0).alias("done"))
        return F.when(acc["done"], acc).when(begins, F.struct(F.array(t["word"]).alias("name"), F.lit(False).alias("done"))).when(goes, F.struct(F.concat(acc["name"], F.array(t["word"])).alias("name"), F.lit(False).alias("done"))).otherwise(ended)

    return F.aggregate(tokens, start, step, lambda acc: F.when(F.size(acc["name"]) > 0, F.array_join(acc["name"], " ")))


def answer_tag(text: Column) -> Column:
    """STR-15: what stands in the first `<answer>` tag, to the end if it is not closed; `ERROR` without one."""
    found = F.regexp_extract(text, r"(?s)<answer>(.*?)(?:</answer>|$)", 1)
    return F.when(text.contains("<answer>"), found).otherwise("ERROR")


def first_json(text: Column) -> Column:
    """STR-16: the first shortest `{...}` of a reply, code fences aside; '' if there is none."""
    return F.regexp_extract(F.regexp_replace(text, r"```(?:json)?", ""), r"(?s)\{.*?\}", 0)


def json_field(text: Column, name: str, missing: str = "N/A") -> Column:
    """STR-16: a field of the first JSON object of a reply."""
    return F.coalesce(F.get_json_object(first_json(text), f"$.{name}"), F.lit(missing))


def clean_target(target: Column, replacements: list[tuple[str, str]] = ()) -> Column:
    """FLT-08, STR-18: lower case, null as `n/a`, then the rules in order.

    A rule whose old value is part of its new one replaces whole values only, any other every occurrence.
    """
    out = F.coalesce(F.lower(target), F.lit("n/a"))
    for old, new in replacements:
        out = F.when(out == old, F.lit(new)).otherwise(out) if old in new else F.replace(out, F.lit(old), F.lit(new))
    return out


def language_text(text: Column) -> Column:
    """STR-21: one line of text for a language model; null where nothing is left."""
    line = F.trim(F.regexp_replace(text, r"[\r\n]+", " "))
    return F.when(line != "", line)


def page_input(url: Column, html: Column, parts: str = "both") -> Column:
    """PRJ-12: what a model reads of a page: url and html on lines of their own, or one of them; nulls are left out."""
    return {"both": F.concat_ws("\n", url, html), "url": url, "html": html}[parts]


def next_day(day: Column) -> Column:
    """STR-20: the day after `yyyyMMdd`, in the same form."""
    return F.date_format(F.date_add(F.to_date(day, "yyyyMMdd"), 1), "yyyyMMdd")


def class_probability(negative: Column, positive: Column, temperature: float = 8.0) -> Column:
    """PRJ-08, MTH-01: softmax of two logits at a temperature, for the second."""
    return 1 / (1 + F.exp((negative - positive) / F.lit(temperature)))


def g_mean(tpr: Column, fpr: Column) -> Column:
    """MTH-01: geometric mean of sensitivity and specificity."""
    return F.sqrt(tpr * (1 - fpr))


def bits_to_bin(bits: Column) -> Column:
    """MTH-02: array of bits as a number, the most significant first (at most 62 bits)."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1) + b.cast("bigint"))


def base_rate_size(rate: Column | float, n: Column) -> Column:
    """MTH-04: positives that make a share of `rate` per cent with `n` negatives."""
    rate = F.lit(rate) if isinstance(rate, int | float) else rate
    return F.ceil(0.01 * rate * n / (1 - 0.01 * rate)).cast("bigint")


def interpolate(points: int = 1000):
    """MTH-03: an Arrow UDF `(xs array<double>, ys array<double>) -> array<double>` on an even grid over [0, 1]."""
    import numpy as np

    @pandas_udf("array<double>")
    def on_grid(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        grid = np.linspace(0, 1, points)
        for xs, ys in parts:
            yield pd.Series([np.interp(grid, x, y) if x is not None and len(x) else None for x, y in zip(xs, ys)])

    return on_grid


def indel_ratio():
    """SIM-02: an Arrow UDF for the insertion-deletion similarity of two texts, 1 for two empty ones, null with a null."""

    @pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else indel_similarity(a, b) for a, b in zip(left, right)], dtype="float64")

    return ratio


def indel_similarity(a: str, b: str) -> float:
    """SIM-02: twice the longest common subsequence over the sum of lengths."""
    if not a and not b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for ch in b:
        hit = state & where.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return 2 * (len(a) - state.bit_count()) / (len(a) + len(b))


def length_match(la: Column, lb: Column, ratio: float) -> Column:
    """FLT-14: whether two lengths allow a similarity of `ratio`; never drops a pair that reaches it."""
    return F.abs(la - lb) <= (la + lb) * F.lit(1 - ratio)
