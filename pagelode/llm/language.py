"""Missing or wrong language labels (problem 4).

Word-first backoff. Known words score by their log frequency per language; an unseen word falls back to its
character n-grams, the longest order of which any is known, then shorter ones. The frequencies are fitted on a bounded
sample of labelled pages: once with the labels as delivered, then again with the language each sentence was given,
so that wrong labels and mixed pages wash out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.functions.html import HIDDEN, INLINE, INVISIBLE, NOSCRIPT, TAG, body_of, entities

# Language codes and names, two-letter, three-letter (both forms) and English.
LANGUAGES = {
    "en": "eng english",
    "de": "deu ger german",
    "fr": "fra fre french",
    "es": "spa spanish",
    "it": "ita italian",
    "pt": "por portuguese",
    "nl": "nld dut dutch",
    "pl": "pol polish",
    "sv": "swe swedish",
    "tr": "tur turkish",
    "ru": "rus russian",
    "ja": "jpn japanese",
}
# Very common words, so that a language is known even where no page is labelled with it.
COMMON = {
    "en": "the of and to in is that for with this are from",
    "de": "der die das und ist nicht mit ein zu den für auf",
    "fr": "le la les des et est une dans pour que sur avec",
    "es": "el los las y una del por con para es en que",
    "it": "il di che gli della un per con nel è sono dal",
    "pt": "o os uma do da em não para com que pelo no",
    "nl": "de het een van en is niet op voor met zijn aan",
    "pl": "w i na z do jest się nie przez po że dla",
    "sv": "och att det som en på är av för med till den",
    "tr": "ve bir bu için ile da de olarak daha her sonra gibi",
    "ru": "и в на не что с по это для из как к",
    "ja": "の に は を た が で て と し れ さ",
}
CODES = tuple(LANGUAGES)
#: Most labelled pages per language that the frequencies are fitted on.
TRAIN_PAGES = 600
#: Longest page that may be in that sample, so that the sample is bounded in size, too.
SAMPLE_CHARS = 100_000
#: Most characters of text in the sample of a language.
TRAIN_CHARS = 4_000_000
#: Most words kept per model; the rarest fall back to n-grams.
VOCABULARY = 200_000
#: Longest character n-gram of unseen words.
ORDER = 4
#: Largest lead one word can give a language, in nats.
CLIP = 4.0
#: Least lead of a sentence's language over the next, in nats; below, the sentence carries no language.
MARGIN = 1.5
#: Least lead per word of a stretch in another language than the page's main one.
DENSITY = 0.8
#: Least length of a stretch: words, or characters of Japanese.
LEAST_WORDS, LEAST_JA = 8, 16

SKIPPED = re.compile(r"<(nav|h[1-6]|button|select|textarea|address|label|title|th|dt|footer)\b[^>]*>.*?(?:</\1\s*>|$)", re.I | re.S)
KANA = re.compile("[぀-ヿ㐀-䶿一-鿿]")
TOKEN = re.compile("[぀-ヿ㐀-䶿一-鿿]|[^\\W\\d_぀-ヿ㐀-䶿一-鿿]+")
END = re.compile("(?<=[.!?…][\"'”’»)])\\s+|(?<=[.!?…])\\s+|(?<=[。！？])\\s*")
CLOSED = re.compile("[.!?…。！？][\"'”’»)」』]*$")


def language_code(label: Column) -> Column:
    """The two-letter code that a label names, else null: codes with a region, three letters, English names, any case."""
    key = F.regexp_replace(F.lower(F.trim(label)), r"[-_].*$", "")
    pairs = [x for code, names in LANGUAGES.items() for name in [code, *names.split()] for x in (F.lit(name), F.lit(code))]
    return F.try_element_at(F.create_map(*pairs), F.trim(key))


def sentences(page: str | None) -> list[str]:
    """Sentences of the running text of a page's body, in order.

    Navigation, headings, buttons, labels and addresses are left out, and so is whatever does not end like a sentence:
    lines of contacts, references, sizes or ratings.
    """
    if not page or page.isspace():
        return []
    text = NOSCRIPT.sub(" ", HIDDEN.sub(" ", body_of(page)))
    text = TAG.sub("\n", INLINE.sub("", SKIPPED.sub("\n", text)))
    if "&" in text:
        text = entities.unescape(text)
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    out = []
    for block in text.split("\n"):
        if len(block) > 3 and (block := " ".join(block.split())):
            out += [s for s in END.split(block) if CLOSED.search(s)]
    return out


def lines_joined(page: str | None) -> list[str]:
    """As `sentences`, with line breaks inside a block taken as spaces."""
    return sentences(page.replace("\r", " ").replace("\n", " ") if page else page)


@dataclass
class Model:
    """Log frequencies: a row of `scores` per known word or n-gram, relative to the language it fits best."""

    words: dict[str, int]
    grams: list[dict[str, int]]
    scores: np.ndarray
    cache: dict[str, np.ndarray] = field(default_factory=dict)

    def __getstate__(self):
        return {"words": self.words, "grams": self.grams, "scores": self.scores}

    def __setstate__(self, state):
        self.__dict__.update(state, cache={})

    def unseen(self, word: str) -> np.ndarray:
        """Mean of the known n-grams of the longest order that has any; zeros if even the letters are new."""
        got = self.cache.get(word)
        if got is None:
            padded = f"<{word}>"
            got = np.zeros(len(CODES))
            for n in range(ORDER, 0, -1):
                known = [i for k in range(len(padded) - n + 1) if (i := self.grams[n - 1].get(padded[k : k + n])) is not None]
                if len(known) * 2 >= len(padded) - n + 1 > 0 or known and n == 1:
                    got = self.scores[known].mean(axis=0) / 2
                    break
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[word] = got
        return got

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """Summed log frequencies of each text, and how many words (of Japanese: characters) it has."""
        get, unseen = self.words.get, self.unseen
        rows, extra, starts, counts = [], [], [], []
        for k, text in enumerate(texts):
            tokens = TOKEN.findall(text)
            starts.append(len(rows))
            counts.append(len(tokens))
            for t in tokens:
                low = t.lower()
                i = get(low)
                if i is not None:
                    rows.append(i)
                elif low[0] == t[0]:  # an unseen word with a capital is most likely a name, of no language
                    extra.append((k, unseen(low)))
        total = np.zeros((len(texts), len(CODES)))
        if rows:
            sums = np.vstack([np.zeros(len(CODES)), np.cumsum(self.scores[np.array(rows)], axis=0)])
            at = np.array([*starts, len(rows)])
            total = sums[at[1:]] - sums[at[:-1]]
        for k, v in extra:
            total[k] += v
        return total, counts

    def languages(self, texts: list[str]) -> list[tuple[str | None, float, int]]:
        """`(code or None, lead in nats, words)` per text."""
        if not texts:
            return []
        total, counts = self.score(texts)
        best = total.argmax(axis=1)
        top = total[np.arange(len(texts)), best]
        total[np.arange(len(texts)), best] = -np.inf
        lead = top - total.max(axis=1)
        return [(CODES[b] if m >= MARGIN else None, float(m), n) for b, m, n in zip(best, lead, counts)]


def fit(texts: list[tuple[str, str]]) -> Model:
    """Frequencies from `(code, text)` pairs and the common words."""
    words: dict[str, np.ndarray] = {}
    counts = {c: Counter() for c in CODES}
    for code, text in texts:
        counts[code].update(TOKEN.findall(text.lower()))
    for code, listed in COMMON.items():
        total = sum(counts[code].values())
        for w in listed.split():
            counts[code][w] += max(5, total // 1000)
    for k, code in enumerate(CODES):
        for w, n in counts[code].items():
            words.setdefault(w, np.zeros(len(CODES)))[k] += n
    size = np.array([max(1.0, sum(counts[c].values())) for c in CODES])
    keep = sorted((w for w, n in words.items() if n.sum() > 1), key=lambda w: (-words[w].sum(), w))[:VOCABULARY]
    grams: list[dict[str, np.ndarray]] = [{} for _ in range(ORDER)]
    for w, n in words.items():
        padded = f"<{w}>"
        types = np.minimum(n, 3.0) * (n * 20 >= n.max())  # word types rather than occurrences, without stray counts
        for order in range(1, ORDER + 1):
            for k in range(len(padded) - order + 1):
                g = grams[order - 1].setdefault(padded[k : k + order], np.zeros(len(CODES)))
                g += types
    rows: list[np.ndarray] = []

    def relative(n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        logs = np.log((n + 0.02) / (sizes + 5000.0) * 1e4 + 0.05)
        return np.maximum(logs - logs.max(), -CLIP)

    index: dict[str, int] = {}
    for w in keep:
        index[w] = len(rows)
        rows.append(relative(words[w], size))
    indexes: list[dict[str, int]] = []
    for found in grams:
        sizes = np.sum(list(found.values()), axis=0) if found else size
        table: dict[str, int] = {}
        for g, n in found.items():
            if n.sum() > 2:
                table[g] = len(rows)
                rows.append(relative(n, sizes))
        indexes.append(table)
    return Model(index, indexes, np.array(rows) if rows else np.zeros((1, len(CODES))))


def labelled_sample(pages: DataFrame, id_col: str, html_col: str, lang_col: str, per_language: int = TRAIN_PAGES, chars: int = TRAIN_CHARS) -> list[tuple[str, list[str]]]:
    """`(code, sentences)` of the pages of each label that come first in hash order, at most `per_language` and `chars`.

    A threshold on 63 bits of the hash leaves about twice as many pages, whatever their number; their sentences are
    taken out on the executors, so that no more than the bounded text reaches the driver.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), language_code(F.col(lang_col)).alias("code"), F.col(html_col).alias("html")).where(F.col("code").isNotNull() & F.col("id").isNotNull() & (F.length("html") <= SAMPLE_CHARS))
    sizes = {r["code"]: r["n"] for r in rows.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.xxhash64(F.lit("language"), "id").bitwiseAND(F.lit((1 << 63) - 1))
    picked = F.lit(False)
    for code, n in sorted(sizes.items()):
        picked = picked | (F.col("code") == code) & (draw <= F.lit(draw_threshold(2 * per_language, n)))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines_joined(p) for p in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.string())), pa.array([sum(map(len, f)) for f in found], pa.int64())], names=["code", "draw", "id", "found", "chars"])

    taken = rows.where(picked).select("code", draw.alias("draw"), "id", "html").mapInArrow(take, "code string, draw bigint, id bigint, found array<string>, chars bigint")
    order = Window.partitionBy("code").orderBy("draw", "id")  # of some 2 x `per_language` pages a code
    first = taken.withColumn("n", F.row_number().over(order)).withColumn("sum", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = first.where((F.col("n") <= per_language) & (F.col("sum") <= chars)).select("code", "n", "found").collect()
    return [(r["code"], r["found"]) for r in sorted(held, key=lambda r: (r["code"], r["n"]))]


def draw_threshold(most: int, total: int) -> int:
    """Greatest 63-bit hash that draws `most` of `total` rows on average."""
    return (1 << 63) - 1 if total <= most else ((1 << 63) * most) // total


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", lang_col: str = "lang", per_language: int = TRAIN_PAGES) -> Model:
    """A model from a bounded, documented sample of labelled pages; without any, from the common words alone."""
    sample = labelled_sample(pages, id_col, html_col, lang_col, per_language)
    model = fit([(code, " ".join(found)) for code, found in sample])
    return refit(model, [found for _, found in sample])


def refit(model: Model, texts: list[list[str]]) -> Model:
    """The model fitted again on its own languages: by whole texts first, then by sentence.

    A wrong label is outvoted by the rest of its page, and a sentence is taken for another language than its page's
    only if it says so clearly.
    """
    for by_sentence in (False, True):
        taught = []
        for found in texts:
            if not found:
                continue
            total, counts = model.score(found)
            main = int(total.sum(axis=0).argmax())
            for text, row, n in zip(found, total, counts):
                best = int(row.argmax())
                clear = by_sentence and n >= LEAST_WORDS and row[best] - row[main] >= 2 * n
                taught.append((CODES[best if clear else main], text))
        model = fit(taught)
    return model


def segments(found: list[tuple[str | None, float, int]], lengths: list[int]) -> list[list]:
    """Stretches `[code, words, characters, lead, sentences]` of consecutive sentences of one language, short ones left out."""
    runs: list[list] = []
    for (code, lead, words), n in zip(found, lengths):
        if code is None:
            continue
        if runs and runs[-1][0] == code:
            runs[-1][1:] = [runs[-1][1] + words, runs[-1][2] + n, runs[-1][3] + lead, runs[-1][4] + 1]
        else:
            runs.append([code, words, n, lead, 1])
    sums: Counter = Counter()
    for r in runs:
        sums[r[0]] += r[2]
    main = max(sums, key=sums.__getitem__, default=None)
    out: list[list] = []
    for r in runs:
        if r[1] < (LEAST_JA if r[0] == "ja" else LEAST_WORDS) or r[0] != main and r[3] < DENSITY * r[1]:
            continue
        if out and out[-1][0] == r[0]:
            out[-1][1:] = [x + y for x, y in zip(out[-1][1:], r[1:])]
        else:
            out.append(r)
    return out


def confidence(lead: float, words: int) -> float:
    """Between 0.5 and 1: the lead per square root of words on the logistic scale."""
    return round(float(1 / (1 + np.exp(-min(30.0, lead / max(1.0, words) ** 0.5)))), 4)


def page_languages(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", html_col: str = "html", lang_col: str = "lang") -> DataFrame:
    """`(page_id, seg_no, lang, confidence, n_words, labelled, mixed)` for every page with running text.

    Row 0 has the main language, the one with most characters; a mixed page also has rows 1, 2, ... for its stretches.
    `labelled` is the code the label names, or null. Null, blank and textless pages and null ids give no row.
    """
    model = model or train(pages, id_col, html_col, lang_col)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = ["page_id", "seg_no", "lang", "confidence", "n_words", "labelled", "mixed"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.bool_()]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = []
            per_page = [lines_joined(p) for p in batch.column(2).to_pylist()]
            flat = [s for found in per_page for s in found]
            told, at = m.languages(flat), 0
            for page, label, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), per_page):
                mine = told[at : at + len(found)]
                at += len(found)
                runs = segments(mine, [len(s) for s in found])
                if not runs:
                    continue
                sums: dict[str, list[float]] = {}
                for code, words, chars, lead, _ in runs:
                    s = sums.setdefault(code, [0, 0, 0.0])
                    s[0], s[1], s[2] = s[0] + chars, s[1] + words, s[2] + lead
                main = max(sums, key=lambda c: (sums[c][0], c))
                rows.append((page, 0, main, confidence(sums[main][2], sums[main][1]), sums[main][1], label, len(sums) > 1))
                if len(sums) > 1:
                    rows += [(page, k, code, confidence(lead, words), words, label, True) for k, (code, words, _, lead, _) in enumerate(runs, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    rows = pages.where(F.col(id_col).isNotNull() & F.col(html_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("page_id"), language_code(F.col(lang_col)).alias("labelled"), F.col(html_col).alias("html"))
    return rows.mapInArrow(tell, "page_id bigint, seg_no bigint, lang string, confidence double, n_words bigint, labelled string, mixed boolean")


def label_corrections(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", html_col: str = "html", lang_col: str = "lang") -> DataFrame:
    """`(page_id, seg_no, lang, confidence)` of the pages whose label does not name the main language or that are mixed."""
    told = page_languages(pages, model, id_col, html_col, lang_col)
    wrong = ~F.col("lang").eqNullSafe(F.col("labelled"))
    return told.where((F.col("seg_no") > 0) | F.col("mixed") | wrong).select("page_id", "seg_no", "lang", "confidence")
