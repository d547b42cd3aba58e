"""Splitting oversized items at natural boundaries (problem 10).

Structure-tree packing. A text is a tree of sections (by heading level), blocks, list items, lines, sentences,
clauses and words. From the bottom up, subtrees that stand side by side under one parent are merged as long as they
fit; a parent that fits as a whole is what this gives of its own children, so only oversized nodes are ever opened, one
level further. A section, block or item that had to be opened is not merged with what comes before or after it.
Token counts of any stretch come
from one tokenisation of the whole text, as all cuts lie between pre-tokens; only cuts inside one very long word
need the tokenizer again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.tokens import encoder, vocabulary_path

#: Tokens a piece leaves free so that its overlap may begin at a word.
SLACK = 8

HEADING = re.compile(r"^(?:(#{1,6})[ \t]+\S|[ \t]*<h([1-6])\b|(?=[^\n]+\n(=+|-{3,})[ \t]*$))", re.M)
ITEM = re.compile(r"^([ \t]*)(?:[-*+•]|\d{1,4}[.)]|[A-Za-z][.)])[ \t]+|^([ \t]*)<(?:li|tr|dt|dd)\b", re.M)
BLOCK = re.compile(r"\n[ \t\r]*\n\s*|>\s*(?=<(?:section|article|div|p|ul|ol|table|pre|blockquote|main|header|footer)\b)")
LINE = re.compile(r"\n")
SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+[」』）]*\s*")
CLAUSE = re.compile(r"[,;:–—]\s+|[、，；：]\s*")
WORD = re.compile(r"\s+")


def _headings(text: str, a: int, b: int) -> list[int]:
    """Starts of the highest headings inside `[a, b)`; the levels below follow when those sections are opened."""
    found = []
    for m in HEADING.finditer(text, a, b):
        level = len(m[1]) if m[1] else int(m[2]) if m[2] else 1 if m[3][0] == "=" else 2
        found.append((level, m.start()))
    inner = [x for x in found if x[1] > a]
    top = min((x[0] for x in inner), default=0)
    return [p for level, p in inner if level == top]


def _items(text: str, a: int, b: int) -> list[int]:
    """Starts of the least indented list items or rows inside `[a, b)`."""
    found = [(len((m[1] if m[1] is not None else m[2]).expandtabs(4)), m.start()) for m in ITEM.finditer(text, a, b)]
    inner = [x for x in found if x[1] > a]
    least = min((x[0] for x in inner), default=0)
    return [p for indent, p in inner if indent == least]


def _after(pattern: re.Pattern) -> callable:
    return lambda text, a, b: [m.end() for m in pattern.finditer(text, a, b)]


#: Levels of the tree; sections and items are opened again as long as they have inner levels. The first STRUCTURE of them
#: are structure, the others running text.
STRUCTURE = 3
LEVELS = [(_headings, True), (_after(BLOCK), False), (_items, True), (_after(LINE), False), (_after(SENTENCE), False), (_after(CLAUSE), False), (_after(WORD), False)]


class Counter:
    """Tokens of one text: counts of stretches and places where it may be cut."""

    def __init__(self, text: str, encode, lengths: np.ndarray):
        self.text = text
        ids = np.asarray(encode(text), dtype=np.int64)
        self.total = len(ids)
        self.ends = np.cumsum(lengths[ids])
        self.byte_of = None
        if not text.isascii():
            raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
            self.byte_of = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))

    def upto(self, p: int) -> int:
        """Tokens that end at or before character `p`."""
        return int(np.searchsorted(self.ends, p if self.byte_of is None else self.byte_of[p], side="right"))

    def upto_all(self, marks: list[int]) -> list[int]:
        at = np.asarray(marks)
        return np.searchsorted(self.ends, at if self.byte_of is None else self.byte_of[at], side="right").tolist()

    def char_at(self, token: int) -> int:
        """First character boundary at or before the start of a token."""
        byte = 0 if token <= 0 else int(self.ends[token - 1])
        return byte if self.byte_of is None else int(np.searchsorted(self.byte_of, byte, side="right")) - 1

    def aligned(self, p: int) -> int:
        """The next place between two pre-tokens: after a run of white space, before the blank that begins a word."""
        text = self.text
        while p < len(text) and text[p].isspace():
            p += 1
        return p - 1 if 0 < p < len(text) and text[p - 1] == " " else p


def natural_spans(counter: Counter, limit: int) -> list[tuple[int, int, bool]]:
    """Consecutive stretches `(start, stop, natural)` of at most `limit` tokens that make up the whole text.

    Both ends of a natural stretch surely lie between pre-tokens, so its tokens are those of the whole text.
    """
    text, upto = counter.text, counter.upto

    def pack(a: int, b: int, na: int, nb: int, level: int) -> list[tuple[int, int, int, int, bool]]:
        if nb - na <= limit:
            return [(a, b, na, nb, True)]
        if level == len(LEVELS):
            return hard(a, b)
        cuts, again = LEVELS[level][0](text, a, b), LEVELS[level][1]
        marks = sorted({p for p in map(counter.aligned, cuts) if a < p < b})
        if not marks:
            return pack(a, b, na, nb, level + 1)
        out: list[tuple[int, int, int, int, bool]] = []
        begin, n0, opened = a, na, False
        for p, n1 in zip([*marks, b], [*counter.upto_all(marks), nb]):
            if n1 - n0 <= limit:
                if out and not opened and n1 - out[-1][2] <= limit:
                    out[-1] = (out[-1][0], p, out[-1][2], n1, out[-1][4])
                else:
                    out.append((begin, p, n0, n1, True))
                opened = False
            else:
                inner = pack(begin, p, n0, n1, level if again else level + 1)
                opened = level < STRUCTURE
                if out and not opened and inner[0][3] - out[-1][2] <= limit:
                    out[-1] = (out[-1][0], inner[0][1], out[-1][2], inner[0][3], out[-1][4] and inner[0][4])
                    out += inner[1:]
                else:
                    out += inner
            begin, n0 = p, n1
        return out

    def hard(a: int, b: int) -> list[tuple[int, int, int, int, bool]]:
        out = []
        while upto(b) - upto(a) > limit:
            p = counter.char_at(upto(a) + limit)
            if p <= a:
                p = a + 1
            out.append((a, p, upto(a), upto(p), False))
            a = p
        return [*out, (a, b, upto(a), upto(b), False)] if a < b else out

    between = lambda p: p in (0, len(text)) or text[p].isspace() or text[p - 1].isspace()
    return [(a, b, natural and between(a) and between(b)) for a, b, _, _, natural in pack(0, len(text), 0, counter.total, 0)]


def cut(text: str, max_tokens: int, overlap: int, encode, lengths: np.ndarray, counter: Counter | None = None) -> list[tuple[int, int, int, int]]:
    """Pieces `(start, body, stop, n_tokens)` of a text that has more than `max_tokens`; none for a shorter one.

    A piece is `text[start:stop]`; `text[start:body]` repeats the last `overlap` tokens of the piece before it, or a
    few more so that it begins at a word, and the bodies follow each other without gap, so nothing is lost.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError("overlap must be smaller than the limit")
    counter = counter or Counter(text, encode, lengths)
    if counter.total <= max_tokens:
        return []
    body = max(1, max_tokens - overlap - (min(SLACK, max_tokens - overlap - 1) if overlap else 0))
    todo = natural_spans(counter, body)[::-1]
    out: list[tuple[int, int, int, int]] = []

    @lru_cache(maxsize=256)
    def size(s: str) -> int:
        return len(encode(s))

    def tokens(a: int, b: int, natural: bool) -> int:
        piece = text[a:b]
        if not natural:
            return len(encode(piece))
        n = counter.upto(b) - counter.upto(a)
        tail = piece[len(piece.rstrip()) :]
        if len(tail) > 1 and b < len(text) and not text[b].isspace():
            n += size(tail) - size(tail[:-1]) - size(tail[-1])
        return n

    while todo:
        a, b, natural = todo.pop()
        start = a
        if out and overlap:
            end = counter.upto(a)
            start = first = counter.char_at(end - overlap)
            floor = counter.char_at(end - overlap - SLACK)
            while start > floor and not (text[start].isspace() and not text[start - 1].isspace()):
                start -= 1
            if not (start == 0 or text[start].isspace() and not text[start - 1].isspace()):
                start, natural = first, False
        n = tokens(start, b, natural)
        if n > max_tokens:  # only after cuts inside words
            n, natural = len(encode(text[start:b])), False
        if n > max_tokens:
            if b - a > 1:
                p = max(a + 1, min(b - 1, counter.char_at(max(0, counter.upto(b) - (n - max_tokens)))))
                todo += [(p, b, False), (a, p, False)]
                continue
            while start < a and n > max_tokens:  # one character of many tokens: less overlap
                start += 1
                n = len(encode(text[start:b]))
        out.append((start, a, b, n))
    return out


def split_documents(docs: DataFrame, limits: DataFrame, doc_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, batch_chars: int = 4_000_000) -> DataFrame:
    """Pieces of every document that exceeds a limit: `(limit_id, doc_id, chunk_no, start, body_start, stop, n_tokens, text)`.

    `limits` has few rows `(limit_id, max_tokens, overlap_tokens)`. Positions are characters; `body_start` is where
    a piece's own text begins after the overlap, and joining the bodies gives the text back. Null, empty and short
    texts give no rows. A single character of more tokens than the limit stays a piece. Texts are split whole where
    they lie; nothing is shuffled.
    """
    path = vocabulary_path(tokenizer)
    plan = [(r["limit_id"], r["max_tokens"], r["overlap_tokens"]) for r in limits.select("limit_id", "max_tokens", "overlap_tokens").where("limit_id is not null and max_tokens > 0").orderBy("limit_id").collect()]
    if bad := [p for p in plan if not 0 <= (p[2] or 0) < p[1]]:
        raise ValueError(f"overlap must be smaller than the limit: {bad}")
    least = min((p[1] for p in plan), default=0)
    names = ["limit_id", "doc_id", "chunk_no", "start", "body_start", "stop", "n_tokens", "text"]
    kinds = [*[pa.int64()] * 7, pa.string()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        lengths = np.array([len(b) for b in enc.token_byte_values()], dtype=np.int64)
        ranks = np.array([enc._mergeable_ranks[b] for b in enc.token_byte_values()], dtype=np.int64)
        by_rank = np.zeros(int(ranks.max()) + 1, dtype=np.int64)
        by_rank[ranks] = lengths

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=names)

        rows, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(text.encode("utf-8")) <= least:  # a token has at least one byte
                    continue
                counter = Counter(text, enc.encode_ordinary, by_rank)
                for limit, most, overlap in plan:
                    for k, (start, body, stop, n) in enumerate(cut(text, most, overlap or 0, enc.encode_ordinary, by_rank, counter), 1):
                        rows.append((limit, doc, k, start, body, stop, n, text[start:stop]))
                        held += stop - start
                if held > batch_chars:
                    yield batch_of(rows)
                    rows, held = [], 0
        yield batch_of(rows)

    schema = ", ".join(f"{n} bigint" for n in names[:-1]) + ", text string"
    rows = docs.where(F.col(doc_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(doc_col).cast("bigint"), text_col)
    return rows.mapInArrow(pieces, schema)
