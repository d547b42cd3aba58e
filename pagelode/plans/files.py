"""Registered queries of readers, writers and replies: tables are written in a format, read again and compared by SQL.

Files lie in the shared folder of the session. Tables without rows give files without rows.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import prompts, text
from pagelode.operators import eda, features, sampling
from pagelode.plans.core import query
from pagelode.schema import FILTER
from pagelode.session import scratch_dir, ship_package, table
from pagelode.sources import feeds, readers, sinks


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out texts as page records; files of their own are cheap, as there is a fixed number of them."""
    return table(spark, sf_dir, "bench_items").where("item_id is not null").select(F.col("item_id").cast("string").alias("sha256"), F.concat(F.lit("HTTP://H.test/"), F.col("item_id"), F.lit("/")).alias("url"), F.concat(F.lit("<title> T </title>"), F.col("text")).alias("html_content"), F.col("suite").alias("target"))


def _page_files(spark: SparkSession, sf_dir: str, root: str) -> str:
    p = _items(spark, sf_dir)
    broken = spark.createDataFrame([("x", "{")], "k string, value string")
    lines = p.select(F.col("sha256").alias("k"), F.to_json(F.struct("sha256", "url", "html_content", "target")).alias("value")).unionByName(broken)
    # One file an object, with a name that readers of page files look for.
    lines.repartition("k").write.partitionBy("k").option("compression", "none").format("text").save(f"{root}/phishing/raw")
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/phishing/raw")):
        name = folder.getPath().getName()
        if name.startswith("k="):
            for f in fs.listStatus(folder.getPath()):
                fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{root}/phishing/{name[2:]}.json"))
    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/phishing/raw"), True)
    return root


_ITEM = "CAST(item_id AS VARCHAR) AS sha256, 'http://h.test/' || item_id AS url, '<title> T </title>' || text AS html, 't' AS title, 'phish' AS label, lower(suite) AS target"


@query(f"SELECT {_ITEM} FROM bench_items")
def page_json_files(spark, sf_dir):
    """SRC-01..03, SRC-06, SRC-09, SRC-17, SRC-18, SNK-11."""
    pages, _ = readers.page_json(spark, _page_files(spark, sf_dir, place(spark, "pages")))
    return pages.select("sha256", "url", "html", "title", "label", "target")


@query("SELECT 'x.json' AS file, '{' AS record")
def page_json_errors(spark, sf_dir):
    """SRC-03."""
    _, errors = readers.page_json(spark, _page_files(spark, sf_dir, place(spark, "pages")))
    return errors.select(F.regexp_extract("filename", "[^/]*$", 0).alias("file"), F.trim("record").alias("record"))


@query("SELECT CAST(item_id AS VARCHAR) AS sha256 FROM bench_items WHERE item_id % 7 <> 0")
def unfiltered_test_pages(spark, sf_dir):
    """SRC-13, SRC-28, JON-05: page files without the ids that a stored filter names."""
    path = place(spark, "filter")
    ids = _items(spark, sf_dir).where(F.col("sha256").cast("bigint") % 7 == 0)
    ids.select(F.lit("phish").alias("class_type"), F.lit("leakage").alias("stage"), "sha256").write.parquet(path)
    return readers.test_pages(spark, _page_files(spark, sf_dir, place(spark, "pages")), "phish", readers.filter_table(spark, path)).select("sha256")


@query("SELECT CAST(NULL AS VARCHAR) AS class_type, CAST(NULL AS VARCHAR) AS stage, CAST(NULL AS VARCHAR) AS sha256 WHERE false")
def missing_filter(spark, sf_dir):
    """SRC-28: a missing file is an empty filter."""
    return readers.filter_table(spark, place(spark, "none"))


@query("SELECT page_id, url, label FROM release_pages WHERE split = 'train' AND page_id > 100")
def release_shards(spark, sf_dir):
    """SRC-04."""
    root = place(spark, "release")
    pages = table(spark, sf_dir, "release_pages")
    for split in ("train", "test"):
        pages.where(F.col("split") == split).write.parquet(f"{root}/{split}-00000.parquet")
    return readers.release(spark, root, "train").where("page_id > 100").select("page_id", "url", "label")


@query("SELECT n_nationkey, n_name FROM nation")
def arrow_files(spark, sf_dir):
    """SRC-05."""
    spark.dataSource.register(readers.ArrowFileSource)
    held = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").toArrow()
    path = place(spark, "nation").removeprefix("file://") + ".arrow"
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, held.schema) as writer:
        writer.write_table(held, max_chunksize=10)
    return spark.read.format("arrow_file").schema("n_nationkey int, n_name string").option("path", path).load()


@query("SELECT CAST(item_id AS VARCHAR) AS sha256, lower(suite) AS target FROM bench_items")
def json_array_file(spark, sf_dir):
    """SRC-07, SNK-05: one array of records, of a fixed number of items."""
    path = place(spark, "array")
    _items(spark, sf_dir).agg(F.to_json(F.collect_list(F.struct("sha256", "url", "target"))).alias("value")).write.text(path)
    return readers.json_array(spark, path).where("sha256 is not null").select("sha256", "target")


@query("SELECT crawl_id, status, target FROM crawl_pages UNION ALL SELECT crawl_id, status, target FROM crawl_pages WHERE status = 404")
def json_lines_appended(spark, sf_dir):
    """SRC-08, SRC-10, SRC-19, SNK-04."""
    path = place(spark, "lines")
    c = table(spark, sf_dir, "crawl_pages").select("crawl_id", "status", "target", "url")
    sinks.append_json(c, path)
    sinks.append_json(c.where("status = 404"), path)
    return readers.json_fields(spark, path, "crawl_id bigint, status int, target string")


@query("SELECT sha256, gt, round(score, 6) AS score FROM (SELECT sha256, 1 AS gt, page_id / 1000.0 AS score FROM release_pages WHERE page_id % 2 = 0 UNION ALL SELECT sha256, 0, page_id / 1000.0 FROM release_pages WHERE page_id % 2 = 1)")
def prediction_tables(spark, sf_dir):
    """SRC-11, SRC-12, PRJ-04."""
    p = table(spark, sf_dir, "release_pages").select("sha256", "page_id", (F.col("page_id") / 1000.0).alias("score@temp8"))
    parts = {}
    for gt in (0, 1):
        path = place(spark, "scores")
        p.where(F.col("page_id") % 2 == 1 - gt).write.parquet(path)
        parts[gt] = spark.read.parquet(path)
    return readers.predictions(parts, "score@temp8").withColumn("score", F.round("score", 6))


@query("SELECT set_id, value FROM (SELECT 'set-' || (item_id % 3) AS set_id, item_id || '.json' AS value FROM bench_items)")
def id_lists(spark, sf_dir):
    """SNK-06."""
    path = place(spark, "sets")
    sinks.write_id_lists(_items(spark, sf_dir).select(F.concat(F.lit("set-"), F.pmod(F.col("sha256").cast("bigint"), F.lit(3))).alias("set_id"), "sha256"), path)
    return spark.read.option("recursiveFileLookup", True).text(path).select(F.regexp_extract("_metadata.file_path", "set_id=([^/]*)/", 1).alias("set_id"), "value")


@query("SELECT crawl_id, status, asn FROM crawl_pages")
def tab_separated(spark, sf_dir):
    """SNK-03."""
    path = place(spark, "tsv")
    sinks.write_table(table(spark, sf_dir, "crawl_pages").select("crawl_id", "status", "asn"), path, "\t")
    return spark.read.option("header", True).option("sep", "\t").schema("crawl_id bigint, status int, asn string").csv(path)


@query("SELECT page_id, label, CAST(page_date AS VARCHAR) AS page_date FROM release_pages WHERE split IS NOT NULL")
def pages_in_folders(spark, sf_dir):
    """SNK-01, SNK-02."""
    path = place(spark, "folders")
    sinks.write_pages(table(spark, sf_dir, "release_pages").where("split is not null").select("page_id", "label", "page_date", "split"), path, ["split"], "json")
    return spark.read.schema("page_id bigint, label string, page_date string").option("recursiveFileLookup", True).json(path)


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def cached_table(spark, sf_dir):
    """SNK-07, VEC-04: built once, then read."""
    path = place(spark, "cache")
    build = lambda: table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    sinks.cached(path, build, spark)
    return sinks.cached(path, lambda: build().limit(0), spark)


@query("SELECT 'No of features ' || count(*) AS value FROM part UNION ALL SELECT 'weightvectorbias\t0.5' UNION ALL SELECT p_name || '\t' || printf('%.6f', p_retailprice) FROM part")
def weight_file(spark, sf_dir):
    """SNK-09."""
    path = place(spark, "weights")
    p = table(spark, sf_dir, "part").where("p_partkey is not null")
    sinks.write_lines(features.weight_lines(p, 0.5, "p_name", "p_retailprice"), path, order=F.col("line"))
    return spark.read.text(path)


@query("SELECT CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS label, CAST(l_linenumber AS INTEGER) AS first, CAST(l_suppkey AS INTEGER) AS second FROM lineitem")
def index_file(spark, sf_dir):
    """SNK-10, SRC-16."""
    path = place(spark, "indices")
    l = table(spark, sf_dir, "lineitem").where("l_orderkey is not null").select((F.col("l_quantity") > 25).cast("int").alias("label"), F.array(F.col("l_linenumber").cast("int"), F.col("l_suppkey").cast("int")).alias("indices"))  # noqa: E741
    sinks.write_lines(features.index_lines(l), path)
    return features.parse_index_lines(spark.read.text(path)).select("label", F.get("indices", F.lit(0)).alias("first"), F.get("indices", F.lit(1)).alias("second"))


@query("SELECT website_url AS url, 'top' AS source FROM frequent_targets")
def top_sites_feed(spark, sf_dir):
    """SRC-21, PRJ-06."""
    t = table(spark, sf_dir, "frequent_targets").where("target is not null").select(F.to_json(F.struct(F.array(F.struct(F.col("website_url").alias("domain"))).alias("top_sites"))).alias("value"))
    return feeds.top_sites(t, "top").select("url", "source")


@query("SELECT url, target, CAST(crawl_id AS VARCHAR) AS source_id FROM crawl_pages WHERE crawl_id > 200")
def target_benign_feed(spark, sf_dir):
    """SRC-22, FLT-12."""
    c = table(spark, sf_dir, "crawl_pages").select(F.to_json(F.array(F.struct(F.col("crawl_id").cast("string").alias("phish_id"), "url", "target"))).alias("value"))
    return feeds.target_feed(c, "t", 200).select("url", "target", "source_id")


@query("SELECT url, target AS target, CAST(crawl_id AS VARCHAR) AS source_id, ip, asn, strftime(make_timestamp(crawl_id * 1000000), '%Y-%m-%d %H:%M:%S') AS submission_time FROM crawl_pages WHERE crawl_id > 50")
def report_pages_feed(spark, sf_dir):
    """SRC-24."""
    entry = F.struct(F.col("crawl_id").alias("id"), "url", F.col("target").alias("brand"), F.col("crawl_id").alias("updatedAt"), "ip", "asn")
    c = table(spark, sf_dir, "crawl_pages").where("crawl_id is not null").select(F.to_json(F.struct(F.lit(100).alias("per_page"), F.array(entry).alias("data"))).alias("value"))
    return feeds.report_feed(c, "r", 50).select("url", "target", "source_id", "ip", "asn", "submission_time")


@query("SELECT url, 7 AS nconnects FROM (SELECT url FROM crawl_pages WHERE url IS NOT NULL AND crawl_id % 2 = 0)")
def gz_feed_lines(spark, sf_dir):
    """SRC-20, SRC-25, FLT-11: lines of a compressed file."""
    path = place(spark, "gz")
    c = table(spark, sf_dir, "crawl_pages").where("url is not null and crawl_id is not null")
    c.select(F.concat("url", F.lit(",7,"), F.pmod("crawl_id", F.lit(2))).alias("value")).write.option("compression", "gzip").text(path)
    return sampling.feed_filter(feeds.gz_lines(spark, path))


@query("SELECT page_id, 'train' AS split FROM release_pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'test' FROM release_pages WHERE page_id % 2 = 1")
def splits_united(spark, sf_dir):
    """PRJ-01, SET-01."""
    p = table(spark, sf_dir, "release_pages").drop("split")
    return eda.union_splits({"train": p.where("page_id % 2 = 0"), "test": p.where("page_id % 2 = 1")}).select("page_id", "split")


@query("SELECT crawl_id FROM crawl_pages WHERE target IS NOT NULL AND status IS NOT NULL")
def rows_without_nulls(spark, sf_dir):
    """FLT-15."""
    return sampling.drop_nulls(table(spark, sf_dir, "crawl_pages"), ["target", "status"]).select("crawl_id")


@query("SELECT page_id FROM release_pages WHERE sha256 IN (SELECT sha256 FROM crawl_pages)")
def listed_rows(spark, sf_dir):
    """JON-06."""
    return sampling.keep_only(table(spark, sf_dir, "release_pages"), table(spark, sf_dir, "crawl_pages")).select("page_id")


@query("SELECT page_id FROM release_pages WHERE page_id NOT IN (SELECT page_id FROM release_pages WHERE split = 'test')")
def rows_left_to_do(spark, sf_dir):
    """JON-13."""
    p = table(spark, sf_dir, "release_pages").where("page_id is not null")
    return sampling.skip_done(p, p.where("split = 'test'"), "page_id").select("page_id")


@query("SELECT p.page_id, p.title FROM (SELECT page_id FROM release_pages WHERE split = 'test') t JOIN release_pages p USING (page_id)")
def test_ids_with_pages(spark, sf_dir):
    """JON-14, PRJ-03: ids of a split joined to their texts."""
    p = table(spark, sf_dir, "release_pages").where("page_id is not null")
    return p.where("split = 'test'").select("page_id").join(p.select("page_id", "title"), "page_id")


@query("SELECT sha256, min(page_id) AS page_id, min_by(label, page_id) AS label FROM (SELECT sha256, page_id, coalesce(label, '-') AS label FROM release_pages WHERE sha256 IS NOT NULL) GROUP BY sha256")
def first_of_each_key(spark, sf_dir):
    """AGG-25."""
    p = table(spark, sf_dir, "release_pages").where("sha256 is not null").select("sha256", "page_id", F.coalesce("label", F.lit("-")).alias("label"))
    return prompts.first_by(p, ["sha256"], "page_id")


@query("SELECT CAST(page_id AS VARCHAR) AS custom_id, CAST(page_id % 50 AS BIGINT) AS prompt_tokens, CAST(page_id % 10 AS VARCHAR) AS score, 'N/A' AS why, CASE WHEN page_id % 2 = 0 THEN url END AS url FROM release_pages")
def tracked_replies(spark, sf_dir):
    """JON-12, MDL-09: replies joined to what was asked; half of the tracker is missing."""
    p = table(spark, sf_dir, "release_pages").where("page_id is not null")
    said = F.format_string('{"custom_id":"%d","response":{"body":{"usage":{"prompt_tokens":%d,"completion_tokens":1},"choices":[{"message":{"content":"{\\"score\\": %d}"}}]}}}', "page_id", F.col("page_id") % 50, F.col("page_id") % 10)
    tracker = p.where("page_id % 2 = 0").select(F.col("page_id").cast("string").alias("custom_id"), "url")
    return prompts.parse_replies(p.select(said.alias("value")), tracker, ["score", "why"]).select("custom_id", F.col("prompt_tokens").cast("bigint").alias("prompt_tokens"), "score", "why", "url")


@query("SELECT page_id, 'Is ' || url || ' of ' || coalesce(target, '-') || '?' AS prompt FROM release_pages")
def filled_templates(spark, sf_dir):
    """STR-19."""
    p = table(spark, sf_dir, "release_pages").where("page_id is not null").withColumn("target", F.coalesce("target", F.lit("-")))
    return p.select("page_id", F.when(F.col("url").isNotNull(), prompts.fill("Is %s of %s?", "url", "target")).alias("prompt"))


@query("SELECT DISTINCT strftime(page_date, '%Y%m%d') AS day, strftime(page_date + INTERVAL 1 DAY, '%Y%m%d') AS next FROM release_pages WHERE page_date IS NOT NULL")
def days_and_next(spark, sf_dir):
    """STR-20."""
    d = table(spark, sf_dir, "release_pages").where("page_date is not null").select(F.date_format("page_date", "yyyyMMdd").alias("day")).distinct()
    return d.select("day", text.next_day(F.col("day")).alias("next"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Ann Lee' WHEN s_suppkey % 3 = 1 THEN 'Ann' END AS name FROM supplier")
def tagged_persons(spark, sf_dir):
    """STR-14, MDL-07: names put together from tagged words."""
    word = lambda w, tag: F.struct(F.lit(w).alias("word"), tag.alias("tag"), F.lit(0.9).alias("score"))
    kind = F.col("s_suppkey") % 3
    first = F.when(kind < 2, F.lit("B-PER")).otherwise(F.lit("O"))
    second = F.when(kind == 0, F.lit("I-PER")).otherwise(F.lit("O"))
    s = table(spark, sf_dir, "supplier").where("s_suppkey is not null")
    return s.select("s_suppkey", text.person_span(F.array(word("so", F.lit("O")), word("Ann", first), word("Lee", second))).alias("name"))


@query("SELECT page_id, upper(url) AS answer FROM release_pages WHERE page_id IS NOT NULL")
def model_answers(spark, sf_dir):
    """MDL-08, MDL-10, UDF-06: answers of a stand-in model, a batch at a time."""
    p = table(spark, sf_dir, "release_pages").where("page_id is not null").select("page_id", "url")
    ship_package(spark)
    return prompts.with_model(p, "url", shout).select("page_id", "answer")


def shout(texts: list[str]) -> list[str]:
    return [t.upper() if t is not None else None for t in texts]


@query("SELECT count(*) AS n FROM release_pages WHERE false")
def empty_filter_counts(spark, sf_dir):
    """SRC-28: nothing is filtered by an empty filter."""
    return spark.createDataFrame([], FILTER).agg(F.count(F.lit(1)).alias("n"))
