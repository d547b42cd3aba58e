"""Polling cursors, quotas, rate limits and windows (STM-*, AGG-19)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def last_ids(pages: DataFrame, source_col: str = "feed_source", id_col: str = "source_id", order_col: str = "ingested_at") -> DataFrame:
    """AGG-19, STM-01: the id of the last page of each feed in crawl order, ties by the larger id."""
    return pages.where(F.col(source_col).isNotNull()).groupBy(source_col).agg(F.max_by(id_col, F.struct(order_col, id_col)).alias("last_id"))


def next_ids(last: int, n: int) -> list[int]:
    """STM-09: `last + n` down to `last + 1`."""
    return list(range(last + n, last, -1))


def assign_quota(requests: DataFrame, keys: list[str], limit: int, order_by: str, day_col: str = "day") -> DataFrame:
    """STM-08: each day's requests in order go to the first key that has calls left; null beyond the last key's limit.

    The requests of one day are ordered in one task: they are calls of a metered interface, not corpus rows.
    """
    most = limit * len(keys)
    if most <= 0:
        return requests.withColumn("api_key", F.lit(None).cast("string"))
    place = requests.withColumn("__n", F.row_number().over(Window.partitionBy(day_col).orderBy(order_by)) - 1)
    key = F.get(F.array(*[F.lit(k) for k in keys]), F.floor(F.col("__n") / limit).cast("int"))
    return place.withColumn("api_key", F.when(F.col("__n") < most, key)).drop("__n")


def simulate_limits(requests: DataFrame, group: str, order_by: str, tokens_col: str, tokens_per_minute: int = 2_000_000, requests_per_minute: int = 1000, token_share: float = 0.8, request_share: float = 0.99) -> DataFrame:
    """STM-07: when each request of a group may start, in seconds: a window is reset 60 s after it began; a request that
    would pass either limit waits until 61 s after the window's start. Requests come one after another in order.
    """
    schema = StructType([*requests.schema.fields, StructField("start_s", DoubleType())])
    most_t, most_r = int(tokens_per_minute * token_share), int(requests_per_minute * request_share)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        now, begin, used, n = 0.0, 0.0, 0, 0
        frame, out = frame.sort_values(order_by), []
        for t in frame[tokens_col]:
            if now - begin >= 60:
                begin, used, n = now, 0, 0
            if n and (used + t > most_t or n + 1 > most_r):
                now = begin + 61
                begin, used, n = now, 0, 0
            used, n = used + t, n + 1
            out.append(now)
        return frame.assign(start_s=out)

    return requests.groupBy(group).applyInPandas(run, schema)


def poll(stream: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str):
    """STM-02, STM-06: every new batch once through `handle`, which must be idempotent; offsets are committed after it.

    A failed batch is handled again at the next start: at least once, as cursors are written after the crawl.
    """
    return stream.writeStream.foreachBatch(lambda df, _: handle(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quota_loop(source: Callable[[int], list], crawl: Callable[[object], bool], wanted: int) -> int:
    """STM-05: crawl until `wanted` successes or the source runs dry; the number of successes."""
    done = 0
    while done < wanted:
        batch = source(wanted - done)
        if not batch:
            break
        done += sum(bool(crawl(x)) for x in batch)
    return done


def daily_counts(events: DataFrame, time_col: str = "ts", kind_col: str = "event_type", late: str = "1 day") -> DataFrame:
    """Extension: events per day and kind, for batches and streams; events later than the watermark are left out in streams."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(time_col, late)
    out = timed.groupBy(F.window(time_col, "1 day").alias("w"), kind_col).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.to_date("w.start").alias("day"), kind_col, "n")
