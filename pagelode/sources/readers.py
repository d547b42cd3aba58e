"""Readers of page, prediction and filter files (SRC-01..13, 17..19, 28)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagelode.functions.html_features import title_column
from pagelode.functions.urls import normalize_url
from pagelode.operators.sampling import hash_order
from pagelode.schema import FILTER, PAGE
from pagelode.session import scratch_dir  # noqa: F401

#: Fields a page record may have; `html` goes by three names.
RAW_PAGE = "sha256 string, url string, html string, html_content string, content string, title string, label string, target string, date string, lang string, _corrupt_record string"


def page_json(spark: SparkSession, path: str, most: int = -1, by_presence: bool = True) -> tuple[DataFrame, DataFrame]:
    """SRC-01..03, SRC-06..09, SRC-17, SRC-18: page files under a folder as `(pages, errors)`.

    One JSON object a file. The label is phish if the path says phishing, else what the record says. The html comes from
    `html`, `html_content` or `content`: the first that is there, or with `by_presence=False` the first that is not
    empty (`html_content` first). `most` keeps the first files by name. Unreadable files are in `errors` with their
    name and never fail the read; an empty folder gives typed empty tables.
    """
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    parsed = F.from_json("value", RAW_PAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    raw = texts.select(parsed.alias("r"), F.col("_metadata.file_path").alias("filename")).select("r.*", "filename")
    if most > 0:
        names = raw.select("filename").distinct().orderBy("filename").limit(most)
        raw = raw.join(F.broadcast(names), "filename", "left_semi") if most <= 100_000 else raw.join(names, "filename", "left_semi")
    errors = raw.where("_corrupt_record is not null").select("filename", F.col("_corrupt_record").alias("record"))
    html = F.coalesce("html", "html_content", "content") if by_presence else F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("html_content", "html", "content")])
    label = F.when(F.col("filename").contains("phishing"), "phish").otherwise(F.coalesce("label", F.when(F.col("filename").contains("benign"), "benign")))
    good = raw.where("_corrupt_record is null")
    pages = good.select("sha256", normalize_url(F.col("url")).alias("url"), html.alias("html"), title_column(html).alias("title"), label.alias("label"), F.lower("target").alias("target"), F.to_date(F.substring("date", 1, 10).try_cast("date")).alias("date"), "lang", F.lit(None).cast("double").alias("lang_score"), F.lit(None).cast("string").alias("split"), "filename")
    return pages, errors


def release(spark: SparkSession, root: str, split: str) -> DataFrame:
    """SRC-04: parquet shards `<split>-*.parquet`; columns and filters reach the scan."""
    return spark.read.parquet(f"{root}/{split}-*.parquet")


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07: one JSON array of page records, `target` in lower case, in order of date and hash."""
    raw = spark.read.schema(RAW_PAGE.replace(", _corrupt_record string", "")).option("multiLine", True).json(path)
    return raw.withColumn("target", F.lower("target")).orderBy("date", "sha256")


def json_fields(spark: SparkSession, path: str, fields: str, most: int | None = None, seed: int = 42) -> DataFrame:
    """SRC-08, SRC-10, SRC-19: named fields of JSON lines or files; with `most`, that many records by hash of their text."""
    out = spark.read.schema(fields).json(path)
    return out.orderBy(hash_order(seed, *out.columns[:1])).limit(most) if most else out


def predictions(parts: dict[int, DataFrame], score_col: str = "score") -> DataFrame:
    """SRC-11, SRC-12: `(sha256, gt, score)` of the prediction tables per class."""
    out: DataFrame | None = None
    for gt, part in sorted(parts.items()):
        one = part.select("sha256", F.lit(gt).alias("gt"), F.col(f"`{score_col}`").cast("double").alias("score"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("at least one class is needed")
    return out


def test_pages(spark: SparkSession, root: str, label: str, filtered: DataFrame | None = None) -> DataFrame:
    """SRC-13: pages of a class folder (phish lies under `phishing`) without the filtered ids."""
    pages, _ = page_json(spark, f"{root}/{'phishing' if label == 'phish' else label}")
    return pages if filtered is None else pages.join(filtered.select("sha256"), "sha256", "left_anti")


def filter_table(spark: SparkSession, path: str) -> DataFrame:
    """SRC-28: filtered ids; a missing file is an empty table."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.read.schema(FILTER).parquet(path)
    return spark.createDataFrame([], FILTER)


def empty_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PAGE)


class ArrowFileSource(DataSource):
    """SRC-05: Arrow IPC files, one partition a record batch: `spark.read.format("arrow_file").schema(...).load(path)`."""

    @classmethod
    def name(cls) -> str:
        return "arrow_file"

    def reader(self, schema):
        return ArrowFileReader(self.options["path"], [f.name for f in schema.fields])


class ArrowFileReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self):
        import glob

        import pyarrow as pa

        found = []
        for path in sorted(glob.glob(self.path)):
            with pa.memory_map(path) as source:
                found += [InputPartition((path, k)) for k in range(pa.ipc.open_file(source).num_record_batches)]
        return found or [InputPartition(None)]  # no batch at all

    def read(self, partition) -> Iterator:
        import pyarrow as pa

        if partition.value is None:
            return
        path, k = partition.value
        with pa.memory_map(path) as source:
            yield pa.ipc.open_file(source).get_batch(k).select(self.names)
