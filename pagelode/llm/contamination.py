"""Evaluation texts leaking into training text (problem 8).

A generalised suffix automaton over the words of all test items is built once per block of items and sent to the
executors; its size is bounded by the block size. Documents stream through it word by word. The longest match that
ends at a word is known at each step, so every run of at least `min_words` words shared with an item is found, and
the removable spans are exact.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words an item and a document must have in common, one after another.
MIN_WORDS = 12
#: Most words of test items in one automaton (it has at most twice as many states); more items make more blocks.
BLOCK_WORDS = 400_000
#: Automata a task keeps; further ones are taken in turn, batch by batch.
HELD_BLOCKS = 2
#: A document with at least this share of its words inside leaked spans is dropped whole by `clean_documents`.
MAX_COVERAGE = 0.5

NOT_WORD = re.compile(r"[^\w\s]|_")


def words_of(text: str) -> list[str]:
    """What stands between white space, in lower case, letters and digits only; empty words are skipped."""
    return NOT_WORD.sub("", text.lower()).split()


class SuffixAutomaton:
    """Generalised suffix automaton over integer words, with the items that pass each state."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int):
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])
        ends: list[set[int]] = [set()]
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)), ends)
                ends[last].add(item)
        self._finish(ends, min_words)

    def _state(self, length: int, nxt: dict[int, int], link: int, ends: list[set[int]]) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int, ends: list[set[int]]) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, ends: list[set[int]]) -> int:
        q = self.next[last].get(c)
        if q is not None:  # another item has this already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c, ends)
        cur = self._state(self.length[last] + 1, {}, 0, ends)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c, ends)
        return cur

    def _finish(self, ends: list[set[int]], min_words: int) -> None:
        """Items of a state go up the suffix links; kept where a match of exactly `min_words` words is decided."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for s in order:
            if self.length[s] >= min_words and self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        self.base = array("i", [0]) * len(self.length)
        self.items: dict[int, tuple[int, ...]] = {}
        for s in reversed(order):
            if self.length[s] < min_words:
                continue
            if self.length[self.link[s]] < min_words:
                self.base[s] = s
                self.items[s] = tuple(sorted(ends[s]))
            else:
                self.base[s] = self.base[self.link[s]]

    def runs(self, words: list[str], min_words: int) -> Iterator[tuple[int, int, int]]:
        """`(end, length, state)` at every word where a match of at least `min_words` words ends."""
        nxt, link, length, get = self.next, self.link, self.length, self.ids.get
        state = n = 0
        for i, c in enumerate(map(get, words)):
            if c is None:
                state = n = 0
                continue
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(c)
            if to is None:
                state = n = 0
            else:
                state = to
                n += 1
                if n >= min_words:
                    yield i, n, state


def _blocks(items: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in blocks of bounded size; only one block is held at a time."""
    block, size = [], 0
    for r in items.select(item_col, text_col).where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        words = words_of(r[1])
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((r[0], words))
        size += len(words)
    if block:
        yield block


class Machines:
    """The automata of all blocks of items for the executors: a task holds `held` of them at most and takes others in turn."""

    def __init__(self, items: DataFrame, item_col: str, text_col: str, block_words: int, min_words: int, held: int = HELD_BLOCKS):
        context = items.sparkSession.sparkContext
        self.shared = [context.broadcast(SuffixAutomaton(block, min_words)) for block in _blocks(items, item_col, text_col, block_words)]
        self.held = held

    def __len__(self) -> int:
        return len(self.shared)

    def __iter__(self) -> Iterator[SuffixAutomaton]:
        for k, one in enumerate(self.shared):
            yield one.value
            if k >= self.held and hasattr(one, "_value"):
                del one._value  # read again for the next batch


def _matches(docs: DataFrame, machines: Machines, doc_col: str, text_col: str, min_words: int, spans: bool) -> DataFrame:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, items, starts, stops = [], [], [], []
            told = [(doc, words) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if len(words := words_of(text)) >= min_words]
            for machine in machines:
                for doc, words in told:
                    if spans:
                        spans_of: list[list[int]] = []
                        for end, n, _ in machine.runs(words, min_words):
                            while spans_of and spans_of[-1][0] >= end - n + 1:
                                spans_of.pop()
                            if spans_of and spans_of[-1][1] >= end - n + 1:
                                spans_of[-1][1] = end + 1
                            else:
                                spans_of.append([end - n + 1, end + 1])
                        for a, b in spans_of:
                            ids.append(doc), items.append(len(words)), starts.append(a), stops.append(b)
                    else:
                        seen: set[int] = {machine.base[s] for _, _, s in machine.runs(words, min_words)}
                        for item in sorted({i for s in seen for i in machine.items[s]}):
                            ids.append(doc), items.append(item), starts.append(0), stops.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], names=["doc_id", "item_id", "start", "stop"])

    rows = docs.where(F.col(doc_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(doc_col).cast("bigint"), text_col)
    return rows.mapInArrow(found, "doc_id bigint, item_id bigint, start bigint, stop bigint")


def leaked_items(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`(doc_id, item_id)`: documents that contain at least `min_words` consecutive words of an item.

    Null ids and texts and texts of fewer words match nothing; repeated documents under their own ids each count;
    with no items the result is empty. The corpus is read once, whatever the number of items, and never shuffled.
    """
    machines = Machines(items, item_col, item_text, block_words, min_words)
    return _matches(docs, machines, doc_col, text_col, min_words, spans=False).select("doc_id", "item_id")


def leaked_spans(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`(doc_id, n_words, start, stop)`: maximal word spans (half open) covered by leaked runs, per block of items."""
    machines = Machines(items, item_col, item_text, block_words, min_words)
    return _matches(docs, machines, doc_col, text_col, min_words, spans=True).select("doc_id", F.col("item_id").alias("n_words"), "start", "stop")


def clean_documents(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The corpus without leaked passages: `(doc_id, text, removed_words, coverage, dropped)` per document.

    Leaked spans are cut out of the text word by word; a document of which they cover `max_coverage` or more is
    dropped (null text). Documents without a leak keep their text, also when it is null or empty.
    """
    machines = Machines(items, item_col, item_text, block_words, min_words)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, coverage, dropped = [], [], [], []
            every = batch.column(1).to_pylist()
            words_in = [[(i, w) for i, r in enumerate(text.split() if text else []) if (w := NOT_WORD.sub("", r.lower()))] for text in every]
            found: list[set[int]] = [set() for _ in every]
            for machine in machines:
                for kept, out in zip(words_in, found):
                    for end, n, _ in machine.runs([w for _, w in kept], min_words):
                        out.update(range(end - n + 1, end + 1))
            for text, kept, out in zip(every, words_in, found):
                share = len(out) / len(kept) if kept else 0.0
                drop = bool(out) and share >= max_coverage
                if out and not drop:
                    gone = {kept[k][0] for k in out}
                    pieces = re.split(r"(\s+)", text)
                    lead = 1 if pieces and pieces[0] == "" else 0
                    k, made = 0, []
                    for piece in pieces[lead:]:
                        if not piece or piece.isspace():
                            made.append(piece)
                        else:
                            made.append("" if k in gone else piece)
                            k += 1
                    text = "".join(made)
                texts.append(None if drop else text)
                removed.append(len(out)), coverage.append(round(share, 6)), dropped.append(drop)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(coverage, pa.float64()), pa.array(dropped, pa.bool_())], names=["doc_id", "text", "removed_words", "coverage", "dropped"])

    return docs.select(F.col(doc_col).cast("bigint"), text_col).mapInArrow(clean, "doc_id bigint, text string, removed_words bigint, coverage double, dropped boolean")
