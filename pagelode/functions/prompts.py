"""Requests to and replies of language models (STR-19, MDL-09..11, AGG-18, AGG-25, JON-12); the models themselves are a callback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pagelode.functions.text import json_field

REPLY = "struct<custom_id: string, response: struct<body: struct<usage: struct<prompt_tokens: bigint, completion_tokens: bigint>, choices: array<struct<message: struct<content: string>>>>>>"


def fill(template: str, *columns: str) -> Column:
    """STR-19: a template with `%s` places for columns."""
    return F.format_string(template, *columns)


def batch_requests(pages: DataFrame, id_col: str, prompt: Column, model: str = "model", max_tokens: int = 500) -> DataFrame:
    """MDL-09: one request a page as JSON in `value`."""
    body = F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"))
    return pages.select(F.col(id_col).alias("custom_id"), F.to_json(F.struct(F.col(id_col).alias("custom_id"), F.lit("POST").alias("method"), body.alias("body"))).alias("value"))


def parse_replies(lines: DataFrame, tracker: DataFrame, fields: list[str], column: str = "value") -> DataFrame:
    """MDL-09, JON-12: replies with the tracked columns; ids without a tracker row get nulls, missing fields `N/A`."""
    r = lines.select(F.from_json(column, REPLY).alias("r")).where("r.custom_id is not null")
    content = F.try_element_at("r.response.body.choices", F.lit(1))["message"]["content"]
    out = r.select("r.custom_id", F.col("r.response.body.usage.prompt_tokens").alias("prompt_tokens"), F.col("r.response.body.usage.completion_tokens").alias("completion_tokens"), *[json_field(content, f).alias(f) for f in fields])
    return out.join(tracker, "custom_id", "left")


def usage_cost(replies: DataFrame, prompt_price: float = 0.075, completion_price: float = 0.3) -> DataFrame:
    """AGG-18: tokens and their price per million."""
    p, c = F.coalesce(F.sum("prompt_tokens"), F.lit(0)), F.coalesce(F.sum("completion_tokens"), F.lit(0))
    return replies.agg(p.alias("prompt_tokens"), c.alias("completion_tokens"), F.round(p / 1e6 * prompt_price + c / 1e6 * completion_price, 6).alias("cost"))


def with_model(rows: DataFrame, column: str, answer: Callable[[list[str]], list[str]], out: str = "answer", retries: int = 3) -> DataFrame:
    """MDL-06..10: a column of answers from any model, a batch at a time; after `retries` failures the answer is null.

    `answer` runs on the executors and must be importable there. This is the one place where a model plugs in.
    """
    schema = StructType([*rows.schema.fields, StructField(out, StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got: list[str | None] = [None] * len(frame)
            for _ in range(retries):
                try:
                    got = list(answer(frame[column].tolist()))
                    break
                except Exception:  # the next try, then null
                    continue
            yield frame.assign(**{out: got})

    return rows.mapInPandas(run, schema)


def first_by(rows: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """AGG-25: the first row of each key in order, by an aggregate rather than a window over whole groups."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order_by).alias("r"))
    return best.select(*keys, "r.*")
