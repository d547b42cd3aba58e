"""Writers (SNK-01..11). Nothing is rewritten in place; a table per call, partitioned where files used to lie in folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_pages(pages: DataFrame, path: str, by: list[str] = ("split", "label"), form: str = "parquet", mode: str = "errorifexists") -> None:
    """SNK-01, SNK-02, SNK-11: pages in folders per value of `by`; dates as text in JSON."""
    out = pages
    if form == "json":
        out = out.select(*[F.col(c).cast("string").alias(c) if t in ("date", "timestamp") else F.col(c) for c, t in out.dtypes])
    out.write.mode(mode).partitionBy(*by).format(form).save(path)


def write_table(rows: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """SNK-03: CSV or TSV with a header."""
    rows.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def append_json(rows: DataFrame, path: str) -> None:
    """SNK-04, SNK-05: JSON lines, added to what is there."""
    rows.write.mode("append").json(path)


def write_id_lists(sets: DataFrame, path: str, id_col: str = "sha256", mode: str = "errorifexists") -> None:
    """SNK-06: `<id>.json` lines, a folder per set."""
    sets.select("set_id", F.concat(id_col, F.lit(".json")).alias("value")).write.mode(mode).partitionBy("set_id").text(path)


def cached(path: str, build, spark, overwrite: bool = False) -> DataFrame:
    """SNK-07: the table at `path`, built first if it is missing or to be overwritten."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if overwrite or not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_lines(lines: DataFrame, path: str, column: str = "value", order: Column | None = None, mode: str = "errorifexists") -> None:
    """SNK-09, SNK-10: text lines; with `order` the files are in that order."""
    (lines.orderBy(order) if order is not None else lines).select(column).write.mode(mode).text(path)
