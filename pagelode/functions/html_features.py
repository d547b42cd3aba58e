"""Page features (HTM-*): Arrow UDFs over the standard library's HTML parser, one pass per page."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

TAG_SEEN = r"<\s*\w+[^>]*>"
#: Distinct features of a channel that a task holds before it hands them on, and those of one batch; characters counted at once.
HELD_FEATURES, BATCH_FEATURES, HELD_CHARS = 300_000, 20_000, 500_000
# Tags without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def title_column(html: Column) -> Column:
    """HTM-01: text of the first title, stripped and in lower case; null where the text shows no tag or no title."""
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    has = html.rlike(TAG_SEEN) & html.rlike(r"(?is)<title[^>]*>.*?</title>")
    return F.when(has, F.lower(F.trim(F.regexp_replace(found, r"\s+", " "))))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "start", "stop")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None, start: int):
        self.tag, self.attrs, self.children, self.parent, self.start, self.stop = tag, attrs, [], parent, start, None


class Tree(HTMLParser):
    """A light tree of a page: nodes and strings in order, with the places of nodes in the source."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None, 0)
        self.lines = [0]
        for m in re.finditer("\n", page):
            self.lines.append(m.end())
        self.page = page
        self.feed(page)
        self.close()
        while self.at is not None:
            self.at.stop = self.at.stop or len(page)
            self.at = self.at.parent

    def _here(self) -> int:
        line, col = self.getpos()
        return self.lines[line - 1] + col

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at, self._here())
        self.at.children.append(node)
        if tag in VOID:
            node.stop = node.start + len(self.get_starttag_text() or "")
        else:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at, self._here())
        node.stop = node.start + len(self.get_starttag_text() or "")
        self.at.children.append(node)

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is None or node is self.root:
            return
        here = self._here()
        end = self.page.find(">", here) + 1 or len(self.page)
        while self.at is not node:
            self.at.stop = here
            self.at = self.at.parent
        node.stop = end
        self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def walk(node: Node):
    """Nodes below `node` in document order."""
    stack = [c for c in reversed(node.children) if isinstance(c, Node)]
    while stack:
        n = stack.pop()
        yield n
        stack += [c for c in reversed(n.children) if isinstance(c, Node)]


def texts(node: Node, skip: tuple[str, ...] = ("script", "style")):
    """Strings below `node` in document order, without those of `skip`."""
    stack = list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            yield c
        elif c.tag not in skip:
            stack += reversed(c.children)


def joined_text(page: str | None) -> str:
    """HTM-02: text nodes stripped and joined by a space; '' where the page shows no tag."""
    if not page or not re.search(TAG_SEEN, page):
        return ""
    return " ".join(s for t in texts(Tree(page).root) if (s := t.strip()))


def raw_text(page: str | None) -> str:
    """HTM-03: text nodes one after another, as they are."""
    return "".join(texts(Tree(page).root)) if page else ""


def part_lengths(page: str | None) -> tuple[int, int, int] | None:
    """HTM-05: summed source lengths of the head, images and scripts, each with the text that follows it; null for null."""
    if page is None:
        return None
    sums = {"head": 0, "img": 0, "script": 0}
    for node in walk(Tree(page).root):
        if node.tag in sums:
            stop = node.stop or len(page)
            tail = page.find("<", stop)
            sums[node.tag] += (len(page) if tail < 0 else tail) - node.start
    return sums["head"], sums["img"], sums["script"]


def xpaths(page: str | Tree, n: int = 4, compat: bool = True) -> list[str]:
    """HTM-08: windows of absolute paths, distinct per page and sorted.

    A path is split at `/` (its first part is empty); with fewer than n parts it comes whole. With `compat` a path
    of exactly n parts gives nothing and the last window of longer ones is left out.
    """
    found: set[str] = set()

    def visit(node: Node, path: list[str]) -> None:
        same: dict[str, int] = {}
        for c in node.children:
            if isinstance(c, Node):
                same[c.tag] = same.get(c.tag, 0) + 1
        seen: dict[str, int] = {}
        for c in node.children:
            if isinstance(c, Node):
                seen[c.tag] = seen.get(c.tag, 0) + 1
                todo.append((c, [*path, c.tag if same[c.tag] == 1 else f"{c.tag}[{seen[c.tag]}]"]))

    todo: list[tuple[Node, list[str]]] = []
    visit((Tree(page) if isinstance(page, str) else page).root, [""])
    while todo:
        node, path = todo.pop()
        if len(path) < n:
            found.add("/".join(path))
        elif (last := len(path) - n - compat) >= 0:  # the earlier windows are those of the nodes above
            found.add("/".join(path[last : last + n]))
        if node.children:
            visit(node, path)
    return sorted(found)


def channels(page: str | Tree) -> dict[str, str]:
    """HTM-07: the texts of seven channels of a page in small letters.

    Channels: te text, ta tag names, sc script text, ss script sources, li link targets, is image sources, id image
    data attributes.
    """
    root = (Tree(page) if isinstance(page, str) else page).root
    nodes = list(walk(root))
    clean = lambda parts: " ".join(" ".join(p for p in parts if p).split())
    return {
        "te": clean(texts(root)),
        "ta": clean(x.tag for x in nodes),
        "sc": clean(c for x in nodes if x.tag == "script" for c in x.children if isinstance(c, str)),
        "ss": clean(x.attrs.get("src") for x in nodes if x.tag == "script"),
        "li": clean(x.attrs.get("href") for x in nodes if x.tag == "link"),
        "is": clean(v for x in nodes if x.tag == "img" for k, v in x.attrs.items() if k.startswith("src")),
        "id": clean(v for x in nodes if x.tag == "img" for k, v in x.attrs.items() if k.startswith("data-")),
    }


def channel_features(page: str | None, n: int = 4, compat: bool = True) -> list[str]:
    """HTM-07: n-grams of seven channels and path windows of a page.

    The page is put in small letters first. Null and empty pages give no n-grams, only `body`.
    """
    page = (page or "").lower()
    out = [f"{name}_{t[i : i + n]}" for name, t in channels(page).items() for i in range(len(t) - n + (not compat))]
    return out + (xpaths(page, n, compat) if page else ["body"])


class GramCounts:
    """Counts of the n-grams of texts: of up to four characters as sorted numbers, of others in a dictionary."""

    def __init__(self, n: int):
        self.n, self.texts, self.chars = n, [], 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.rest: Counter[str] = Counter()

    def add(self, text: str) -> None:
        """Count all n-grams of a text, once there are enough characters."""
        self.texts.append(text)
        self.chars += len(text)
        if self.chars >= HELD_CHARS:
            self.settle()

    def settle(self) -> None:
        texts = [t for t in self.texts if len(t) >= self.n]
        self.texts, self.chars = [], 0
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return
        if self.n > 4 or codes.max() > 0xFFFF or not codes.min():
            if len(texts) > 1:
                for t in texts:
                    self.texts = [t]
                    self.settle()
            else:
                self.rest.update([texts[0][i : i + self.n] for i in range(len(texts[0]) - self.n + 1)])
            return
        ends = np.cumsum([len(t) for t in texts])
        starts = np.ones(len(codes), bool)
        for k in range(1, self.n):
            starts[ends - k] = False
        at = np.flatnonzero(starts)
        keys = np.zeros(len(at), np.uint64)
        for k in range(self.n):
            keys = keys << np.uint64(16) | codes[at + k]
        keys, counts = np.unique(keys, return_counts=True)
        keys, where = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.counts = np.bincount(where, np.concatenate([self.counts, counts]), len(keys)).astype(np.int64)
        self.keys = keys

    def __len__(self) -> int:
        return len(self.keys) + len(self.rest)

    def take(self) -> Iterator[tuple[list[str], list[int]]]:
        """N-grams and counts in batches; nothing is left."""
        self.settle()
        for at in range(0, len(self.keys), BATCH_FEATURES):
            keys = self.keys[at : at + BATCH_FEATURES]
            shifts = np.arange(self.n - 1, -1, -1, dtype=np.uint64) * np.uint64(16)
            grams = (keys[:, None] >> shifts & np.uint64(0xFFFF)).astype(np.uint32).view(f"<U{self.n}")[:, 0]
            yield grams.tolist(), self.counts[at : at + BATCH_FEATURES].tolist()
        rest = list(self.rest.items())
        for at in range(0, len(rest), BATCH_FEATURES):
            part = rest[at : at + BATCH_FEATURES]
            yield [f for f, _ in part], [k for _, k in part]
        self.__init__(self.n)


def channel_counts(pages: DataFrame, html_col: str, n: int = 4, compat: bool = True) -> DataFrame:
    """HTM-07: `(feature, n)` of the features of all pages, counted where they are found; a feature has several rows.

    A task holds the counts of some `HELD_FEATURES` features a channel and of the characters and paths just counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, GramCounts] = {}
        paths: Counter[str] = Counter()

        def flush(name: str) -> Iterator[pa.RecordBatch]:
            for found, counts in grams[name].take():
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}_{f}" for f in found], pa.string()), pa.array(counts, pa.int64())], names=["feature", "n"])

        def flush_paths() -> Iterator[pa.RecordBatch]:
            held = list(paths.items())
            paths.clear()
            for at in range(0, len(held), BATCH_FEATURES):
                part = held[at : at + BATCH_FEATURES]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in part], pa.string()), pa.array([k for _, k in part], pa.int64())], names=["feature", "n"])

        for batch in batches:
            for value in batch.column(0):
                tree = Tree((value.as_py() or "").lower())
                for name, t in channels(tree).items():
                    last = len(t) - n + (not compat)
                    for at in range(0, last, HELD_CHARS):
                        held = grams.setdefault(name, GramCounts(n))
                        held.add(t[at : min(last, at + HELD_CHARS) + n - 1])
                        if len(held) >= HELD_FEATURES:
                            yield from flush(name)
                paths.update(xpaths(tree, n, compat) if tree.page else ["body"])
                if len(paths) >= HELD_FEATURES:
                    yield from flush_paths()
        for name in grams:
            yield from flush(name)
        yield from flush_paths()

    return pages.select(html_col).mapInArrow(count, "feature string, n bigint")


# Tags that simplification keeps.
IMPORTANT = frozenset("html head title body form input button a img iframe h1 h2 h3 p li label select option textarea meta link".split())


def simplify(page: str | None, max_tokens: int = 2500, as_is: bool = False) -> tuple[str, str] | None:
    """HTM-09, HTM-10: a page cut down to `max_tokens` (a quarter of its length), and the stage that was enough.

    Stages: 0-as-is (only with `as_is`), 1-removed-scripts, 2-unwrapped-tags (unimportant tags are unwrapped, empty ones
    dropped, links lose scheme and www), 3-decomposed-mid-tags (the middle element is removed until it fits).
    """
    if page is None:
        return None
    fits = lambda t: len(t) // 4 <= max_tokens
    if as_is and fits(page):
        return page, "0-as-is"
    text = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "", page)
    if fits(text):
        return text, "1-removed-scripts"
    root = Tree(text).root

    def render(node: Node) -> str:
        inner = "".join(c if isinstance(c, str) else render(c) for c in node.children)
        if node.tag not in IMPORTANT:
            return inner
        if node.tag not in VOID and not inner.strip() or node.tag == "img":
            return ""
        attrs = "".join(f' {k}="{re.sub(r"^(https?://)?(www[.])?", "", v or "") if k in ("href", "src") else v or ""}"' for k, v in node.attrs.items())
        return f"<{node.tag}{attrs}>" + ("" if node.tag in VOID else f"{inner}</{node.tag}>")

    text = render(root)
    if fits(text):
        return text, "2-unwrapped-tags"
    pieces = re.findall(r"<[^>]+>[^<]*|[^<]+", text)
    size, gone = sum(map(len, pieces)), set()
    order = sorted(range(len(pieces)), key=lambda i: abs(i - len(pieces) / 2))
    for i in order:
        if size // 4 <= max_tokens:
            break
        size -= len(pieces[i])
        gone.add(i)
    return "".join(p for i, p in enumerate(pieces) if i not in gone), "3-decomposed-mid-tags"


@cache
def _udf(kind: str):
    """UDFs are made on first use: their types need a session, which workers that import this module lack."""

    @pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(joined_text, na_action=None)

    @pandas_udf("string")
    def raw(pages: pd.Series) -> pd.Series:
        return pages.map(raw_text, na_action=None)

    @pandas_udf("head_len bigint, img_len bigint, script_len bigint")
    def lengths(pages: pd.Series) -> pd.DataFrame:
        rows = [part_lengths(p) or (None, None, None) for p in pages]
        return pd.DataFrame(rows, columns=["head_len", "img_len", "script_len"]).astype("Int64")

    # Not by Arrow: the lists of a batch are many times as large as its pages, and this way a batch has 100 rows.
    listed = F.udf(lambda url, page: channel_features(page), "array<string>", useArrow=False)

    return {"text": text, "raw": raw, "lengths": lengths, "channels": listed}[kind]


def html_text(html: Column) -> Column:
    """HTM-02."""
    return _udf("text")(html)


def html_raw_text(html: Column) -> Column:
    """HTM-03."""
    return _udf("raw")(html)


def html_part_lengths(html: Column) -> Column:
    """HTM-05."""
    return _udf("lengths")(html)


def html_channels(url: Column, html: Column) -> Column:
    """HTM-07: the features of a page; `channel_counts` counts them without lists."""
    return _udf("channels")(url, html)


def simplified(max_tokens: int = 2500, as_is: bool = False):
    @pandas_udf("html string, stage string")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([simplify(p, max_tokens, as_is) or (None, None) for p in pages], columns=["html", "stage"])

    return run


def html_features(html: Column) -> Column:
    """HTM-06: total bytes beside the part lengths."""
    parts = html_part_lengths(html)
    return F.struct(F.octet_length(html).cast("bigint").alias("total_html_len"), parts["head_len"].alias("head_len"), parts["img_len"].alias("img_len"), parts["script_len"].alias("script_len"))
