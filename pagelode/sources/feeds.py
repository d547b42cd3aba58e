"""Feeds (SRC-20..27, PRJ-06, FLT-11, FLT-12, REG-01): parsers of what feeds deliver, and a replay source for polling.

Network access is left out on purpose: every feed reads files or lines that were delivered before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from pagelode.operators.sampling import accept, feed_filter
from pagelode.schema import FEED

PHISH_FEED = "array<struct<phish_id: bigint, url: string, target: string, verification_time: string, details: array<struct<ip_address: string>>>>"
REPORT_PAGE = "struct<per_page: int, next_page_url: string, data: array<struct<id: bigint, url: string, brand: string, updatedAt: bigint, ip: string, asn: string>>>"


def _feed(rows: DataFrame, **columns) -> DataFrame:
    names = [f.split()[0] for f in FEED.split(", ")]
    kinds = dict(f.split() for f in FEED.split(", "))
    return rows.select(*[columns.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names])


def phish_feed(texts: DataFrame, source: str, last: int = 0, column: str = "value") -> DataFrame:
    """SRC-23, PRJ-06: verified entries beyond the last id; the ip is the first detail's, '' without one."""
    each = texts.select(F.explode(F.from_json(column, PHISH_FEED)).alias("e")).select("e.*").where(F.col("phish_id") > last)
    return _feed(each, source=F.lit(source), url=F.col("url"), target=F.col("target"), submission_time=F.col("verification_time"), source_id=F.col("phish_id"), ip=F.coalesce(F.try_element_at("details", F.lit(1))["ip_address"], F.lit("")))


def report_feed(texts: DataFrame, source: str, last: int = 0, column: str = "value") -> DataFrame:
    """SRC-24, PRJ-06: entries of report pages beyond the last id; epoch seconds become text in the session's zone."""
    each = texts.select(F.explode(F.from_json(column, REPORT_PAGE)["data"]).alias("e")).select("e.*").where(F.col("id") > last)
    return _feed(each, source=F.lit(source), url=F.col("url"), target=F.col("brand"), submission_time=F.from_unixtime("updatedAt"), source_id=F.col("id"), ip=F.col("ip"), asn=F.col("asn"))


def top_sites(texts: DataFrame, source: str, column: str = "value") -> DataFrame:
    """SRC-21: domains of a list of top sites."""
    each = texts.select(F.explode(F.from_json(column, "struct<top_sites: array<struct<domain: string>>>")["top_sites"]).alias("e"))
    return _feed(each, source=F.lit(source), url=F.col("e.domain"))


def target_feed(texts: DataFrame, source: str, last: int = 0, column: str = "value") -> DataFrame:
    """SRC-22: benign pages of targets beyond the last id, compared as numbers."""
    each = texts.select(F.explode(F.from_json(column, "array<struct<phish_id: string, url: string, target: string>>")).alias("e")).select("e.*")
    each = each.where(F.col("phish_id").try_cast("bigint") > last)
    return _feed(each, source=F.lit(source), url=F.col("url"), target=F.col("target"), source_id=F.col("phish_id"))


def benign_feed(lines: DataFrame, source: str, day: str, low: int = 5, high: int = 100, share: float = 0.75) -> DataFrame:
    """SRC-20, SRC-25, SMP-14: accepted urls of a day's `url[,more],connects,blocks` lines with ids `day-place`."""
    kept = accept(feed_filter(lines, low=low, high=high), "url", share)
    from pagelode.operators.cleaning import add_index

    placed = add_index(kept, ["url"], "i")
    return _feed(placed, source=F.lit(source), url=F.col("url"), source_id=F.concat_ws("-", F.lit(day), F.col("i").cast("string")))


def gz_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-20: lines of compressed files, the last one also without a line end."""
    return spark.read.text(path)


def read_pages(records: list[dict], per_page: int, last: int) -> list[dict]:
    """STM-04: entries of pages in order until a page has fewer new ids than `per_page`."""
    out: list[dict] = []
    for page in records:
        new = [e for e in page.get("data", []) if e["id"] > last]
        out += new
        if len(new) < page.get("per_page", per_page):
            break
    return out


#: REG-01: feed name to parser.
FEEDS = {"phish": phish_feed, "report": report_feed, "topsites": top_sites, "target": target_feed, "benign": benign_feed}


class ReplaySource(DataSource):
    """STM-01..03, SRC-23: a polled feed replayed from a JSON file; the offset is the last id, kept in the checkpoint.

    `spark.readStream.format("feed_replay").option("path", ...).option("batch", n).load()`.
    """

    @classmethod
    def name(cls) -> str:
        return "feed_replay"

    def schema(self) -> str:
        return "phish_id bigint, url string, target string, verification_time string"

    def simpleStreamReader(self, schema):
        return ReplayReader(self.options["path"], int(self.options.get("batch", "100")))


class ReplayReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, batch: int):
        self.path, self.batch = path, batch

    def _entries(self) -> list[dict]:
        return sorted(json.loads(Path(self.path).read_text()), key=lambda e: int(e["phish_id"]))

    def initialOffset(self) -> dict:
        return {"last": 0}

    def _rows(self, entries: list[dict]) -> Iterator[tuple]:
        return iter([(int(e["phish_id"]), e.get("url"), e.get("target"), e.get("verification_time")) for e in entries])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        new = [e for e in self._entries() if int(e["phish_id"]) > start["last"]][: self.batch]
        return self._rows(new), {"last": int(new[-1]["phish_id"]) if new else start["last"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows([e for e in self._entries() if start["last"] < int(e["phish_id"]) <= end["last"]])
