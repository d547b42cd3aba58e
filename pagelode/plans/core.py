"""Registered queries of the core operators over the test tables, each with its SQL where SQL can say it.

Concepts the tables lack are derived by expressions: a page's score is `page_id * 7919 mod 1000 / 1000`, and `keep`
marks are dealt by `page_id mod 3`.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import html_features as hf
from pagelode.functions import prompts, text, urls
from pagelode.operators import cleaning, eda, features, leakage, metrics, sampling, schema_drift, vectors
from pagelode.session import table
from pagelode.sources import feeds
from pagelode.streaming import quota

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

LABEL = "CASE WHEN lower(trim(label)) IN ('phish','phishing','phishes','1') THEN 'phish' WHEN lower(trim(label)) IN ('benign','benigns','0','-1') THEN 'benign' END"
PAGES = f"(SELECT page_id, sha256, url, html, title, {LABEL} AS label, target, page_date AS date, lang, split, ingested_at, ((page_id * 7919) % 1000) / 1000.0 AS score, CASE WHEN {LABEL} = 'phish' THEN 1 ELSE 0 END AS gt, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS keep FROM release_pages)"
SUFFIXES = ("test", "example", "invalid", "co.example", "shop.test")


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "release_pages")
    label = cleaning.canonical_label(F.col("label"))
    score = (F.col("page_id") * 7919 % 1000) / F.lit(1000.0)
    keep = F.when(F.col("page_id") % 3 == 0, True).when(F.col("page_id") % 3 == 1, False)
    return p.select("page_id", "sha256", "url", "html", "title", label.alias("label"), "target", F.col("page_date").alias("date"), "lang", "split", "ingested_at", score.alias("score"), F.when(label == "phish", 1).otherwise(0).alias("gt"), keep.alias("keep"))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return cleaning.mark_duplicate_urls(cleaning.mark_bad_titles(cleaning.mark_empty_html(p)), ["ingested_at", "page_id"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning flags, bad rows dropped, class balance per split."""
    return eda.class_balance(cleaning.drop_bad_rows(flagged(spark, sf_dir)))


_BAD = "|".join(map(re.escape, cleaning.BAD_TITLES))
_FLAGS = f"(SELECT *, html IS NULL OR html = '' AS empty_html, coalesce(regexp_matches(title, '(?i){_BAD}'), false) AS bad_title, row_number() OVER (PARTITION BY url ORDER BY ingested_at, page_id) > 1 AS duplicate_url FROM {PAGES})"


@query(f"SELECT split, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS frac FROM {_FLAGS} WHERE NOT bad_title AND NOT empty_html AND NOT duplicate_url GROUP BY split, label")
def clean_class_balance(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f"SELECT page_id, empty_html, bad_title, duplicate_url FROM {_FLAGS}")
def clean_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("page_id", "empty_html", "bad_title", "duplicate_url")


@query(f"SELECT page_id, duplicate_url FROM {_FLAGS} WHERE NOT bad_title AND NOT empty_html")
def clean_notebook_variant(spark, sf_dir):
    return cleaning.drop_bad_rows(flagged(spark, sf_dir), drop_duplicates=False).select("page_id", "duplicate_url")


@query(f"SELECT label, count(label) AS n FROM {PAGES} GROUP BY label")
def count_by_label(spark, sf_dir):
    return eda.count_by_label(pages(spark, sf_dir))


@query("SELECT l_linestatus AS split, l_returnflag AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 6) AS frac FROM lineitem GROUP BY 1, 2")
def class_balance_lineitem(spark, sf_dir):
    return eda.class_balance(table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("split"), F.col("l_returnflag").alias("label")))


_LAST = "split_part(split_part(list_extract(string_split(url, '//'), -1), '/', 1), ':', 1)"


@query(f"SELECT domain, n FROM (SELECT {_LAST} AS domain, count(*) AS n FROM crawl_pages GROUP BY 1) ORDER BY n DESC, domain NULLS FIRST LIMIT 10")
def top_domains(spark, sf_dir):
    return eda.top_k(table(spark, sf_dir, "crawl_pages").select(urls.last_domain(F.col("url")).alias("domain")), "domain")


@query(f"SELECT lang, label, count(*) AS n FROM {PAGES} GROUP BY lang, label ORDER BY n DESC, lang NULLS FIRST, label NULLS FIRST LIMIT 10")
def top_languages(spark, sf_dir):
    return eda.top_k(pages(spark, sf_dir), "lang", 10, "label")


@query("SELECT target, count(*) AS n FROM crawl_pages GROUP BY target ORDER BY n DESC, target NULLS FIRST LIMIT 10")
def top_targets(spark, sf_dir):
    return eda.top_k(table(spark, sf_dir, "crawl_pages"), "target")


@query(f"SELECT date, split, label, count(*) AS n FROM {PAGES} GROUP BY ALL")
def daily_collection(spark, sf_dir):
    return eda.daily_collection(pages(spark, sf_dir))


_PAIRS = [f"{s}_{c}" for s in ("train", "validation", "test") for c in ("phish", "benign")]


@query("SELECT date, " + ", ".join(f"count(*) FILTER (split || '_' || label = '{p}') AS {p}" for p in _PAIRS) + f" FROM {PAGES} GROUP BY date")
def daily_pivot(spark, sf_dir):
    return eda.daily_pivot(pages(spark, sf_dir), _PAIRS)


@query(f"SELECT label, min(date) AS first_day FROM {PAGES} WHERE split = 'test' GROUP BY label")
def first_test_day(spark, sf_dir):
    return eda.first_test_day(pages(spark, sf_dir))


@query(f"SELECT page_id, date FROM {PAGES} WHERE label = 'phish' AND date BETWEEN DATE '2025-08-01' AND DATE '2025-08-31'")
def snapshot_august(spark, sf_dir):
    return eda.snapshot(pages(spark, sf_dir), "phish", "2025-08-01", "2025-08-31").select("page_id", "date")


@query(f"""WITH k AS (SELECT * FROM {PAGES} WHERE label = 'phish' AND target NOT IN ('unknown', 'other')),
 t AS (SELECT target FROM k GROUP BY target ORDER BY count(*) DESC, target LIMIT 9)
 SELECT date, CASE WHEN target IN (SELECT target FROM t) THEN target ELSE 'other' END AS target, count(*) AS n FROM k GROUP BY 1, 2""")
def daily_targets(spark, sf_dir):
    return eda.daily_targets(pages(spark, sf_dir))


def _stats_sql(source: str, cols: list[str]) -> str:
    one = lambda c: f"SELECT label, '{c}' AS feature, {c}::DOUBLE AS v FROM {source}"
    at = lambda q: f"list_sort(list(v) FILTER (v IS NOT NULL))[CAST(floor((count(v) - 1) * {q} + 0.5) AS BIGINT) + 1]"
    return f"SELECT label, feature, min(v) AS min, {at(0.25)} AS p25, {at(0.5)} AS p50, {at(0.75)} AS p75, max(v) AS max, count(v) AS count FROM ({' UNION ALL '.join(map(one, cols))}) GROUP BY label, feature"


_URLF = f"(SELECT label, length(url) AS url_len, length(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')) AS path_len, strlen(html) AS html_bytes FROM {PAGES})"


@query(_stats_sql(_URLF, ["url_len", "path_len", "html_bytes"]))
def feature_statistics(spark, sf_dir):
    p = pages(spark, sf_dir)
    f = urls.url_features(F.col("url"))
    return eda.feature_statistics(p.select("label", f["url_len"].alias("url_len"), f["path_len"].alias("path_len"), text.byte_length(F.col("html")).alias("html_bytes")), ["url_len", "path_len", "html_bytes"])


@query(f"""WITH f AS (SELECT page_id, label, strlen(html) AS bytes FROM {PAGES} WHERE html IS NOT NULL),
 q AS (SELECT label, list_sort(list(bytes))[CAST(floor((count(*) - 1) * 0.99 + 0.5) AS BIGINT) + 1] AS m FROM f GROUP BY label)
 SELECT f.page_id, f.label, f.bytes FROM f JOIN q ON f.label IS NOT DISTINCT FROM q.label WHERE f.bytes <= q.m""")
def outliers_removed(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", "label", F.octet_length("html").cast("bigint").alias("bytes"))
    return cleaning.remove_outliers(p, "bytes", ["label"])


_RULES = [("yogux cloud", "yogux"), ("bank", "bank group"), ("n/a", "none")]
_CLEAN = "replace(CASE WHEN replace(coalesce(lower(target), 'n/a'), 'yogux cloud', 'yogux') = 'bank' THEN 'bank group' ELSE replace(coalesce(lower(target), 'n/a'), 'yogux cloud', 'yogux') END, 'n/a', 'none')"


@query(f"SELECT {_CLEAN} AS target, count(*) AS count FROM crawl_pages WHERE {_CLEAN} <> 'other' GROUP BY 1 HAVING count(*) >= 5")
def target_counts(spark, sf_dir):
    return eda.target_counts(table(spark, sf_dir, "crawl_pages"), text.clean_target(F.col("target"), _RULES), 5, ("other",))


@query(f"SELECT CAST(floor(score / 0.025) AS BIGINT) AS bin, count(*) AS n FROM {PAGES} GROUP BY 1")
def score_histogram(spark, sf_dir):
    return eda.histogram(pages(spark, sf_dir), F.col("score"), 0.025)


@query(f"""SELECT round(count(*) FILTER (split = 'test') / count(*) FILTER (split IN ('test', 'train')), 6) AS test_ratio,
 round(count(*) FILTER (split = 'train' AND label = 'phish') / count(*) FILTER (split = 'train'), 6) AS phish_train,
 round(count(*) FILTER (split = 'test' AND label = 'phish') / count(*) FILTER (split = 'test'), 6) AS phish_test FROM {PAGES}""")
def split_ratios(spark, sf_dir):
    return eda.split_ratios(pages(spark, sf_dir))


@query("SELECT event_id, CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w, 6) END AS rolling FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING)")
def rolling_mean(spark, sf_dir):
    return eda.rolling_mean(table(spark, sf_dir, "events"), "value", "event_id", 5, "user_id").select("event_id", "rolling")


@query(f"SELECT label, count(*) FILTER (NOT keep) AS rejected, count(*) AS reviewed FROM {PAGES} WHERE keep IS NOT NULL GROUP BY label")
def reject_stats(spark, sf_dir):
    return cleaning.reject_stats(pages(spark, sf_dir))


@query(f"""SELECT count(*) AS total, count(keep) AS processed, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS rejected, round(count(keep) * 100 / count(*), 6) AS processed_pct,
 round(count(*) FILTER (keep) * 100 / count(*), 6) AS kept_pct, round(count(*) FILTER (NOT keep) * 100 / count(*), 6) AS rejected_pct FROM {PAGES}""")
def review_progress(spark, sf_dir):
    return cleaning.progress(pages(spark, sf_dir))


@query(f"SELECT title, count(*) AS n, count(keep) AS reviewed, round(count(keep) / count(*), 6) AS coverage, round(count(keep) / count(*), 6) >= 0.8 AS covered FROM {PAGES} GROUP BY title")
def group_coverage(spark, sf_dir):
    return cleaning.group_coverage(pages(spark, sf_dir), "title")


@query(f"SELECT title, count(*) AS n FROM {PAGES} WHERE label = 'phish' GROUP BY title ORDER BY n DESC, title NULLS FIRST LIMIT 10")
def neighbour_profile(spark, sf_dir):
    return cleaning.neighbour_profile(pages(spark, sf_dir).where("label = 'phish'"), "title")


@query(f"SELECT page_id, CASE WHEN label = 'phish' THEN true ELSE keep END AS keep FROM {PAGES}")
def update_keep(spark, sf_dir):
    p = pages(spark, sf_dir)
    return cleaning.update_keep(p, p.where("label = 'phish'").select("page_id"), True, "page_id").select("page_id", "keep")


@query(f"SELECT page_id, row_number() OVER (ORDER BY date, page_id) - 1 AS index FROM {PAGES}")
def row_index(spark, sf_dir):
    return cleaning.add_index(pages(spark, sf_dir).select("page_id", "date"), ["date", "page_id"]).select("page_id", "index")


@query(f"""SELECT crawl_id, rtrim(lower(url), '/') AS normal, {_LAST} AS last_domain, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) AS netloc, sha256(url) AS hash,
 regexp_replace(url, '^(https?://)?(www\\.)?', '') AS stripped FROM crawl_pages""")
def url_forms(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "crawl_pages").select("crawl_id", urls.normalize_url(u).alias("normal"), urls.last_domain(u).alias("last_domain"), urls.netloc(u).alias("netloc"), urls.url_hash(u).alias("hash"), urls.strip_link(u).alias("stripped"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\\.+$', '')"


@query(f"SELECT page_id, regexp_extract({_HOST}, '([^.]+\\.)?(co\\.example|shop\\.test|example|test|invalid)$', 0) AS domain FROM release_pages")
def registered_domains(spark, sf_dir):
    return table(spark, sf_dir, "release_pages").select("page_id", urls.registered_domain(F.col("url"), SUFFIXES).alias("domain"))


@query(f"""WITH h AS (SELECT page_id, url, {_HOST} AS host FROM release_pages), s AS (SELECT *, regexp_extract(host, '(?:^|\\.)(co\\.example|shop\\.test|example|test|invalid)$', 1) AS t, regexp_extract(host, '([^.]+)\\.(?:co\\.example|shop\\.test|example|test|invalid)$', 1) AS d FROM h)
 SELECT page_id, length(url) AS url_len, length(d) + 1 + length(t) AS domain_len, greatest(length(host) - length(d) - length(t) - 2, 0) AS subdomain_len,
 length(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')) AS path_len FROM s""")
def url_features(spark, sf_dir):
    return table(spark, sf_dir, "release_pages").select("page_id", urls.url_features(F.col("url"), SUFFIXES).alias("f")).select("page_id", *[F.col(f"f.{c}").cast("bigint").alias(c) for c in ("url_len", "domain_len", "subdomain_len", "path_len")])


@query(r"SELECT doc_id, strlen(text) AS bytes, len(regexp_extract_all(text, '\S+')) AS words, CAST(floor(len(regexp_extract_all(text, '\S+')) * 1.3::DOUBLE) AS BIGINT) AS by_words, CAST(floor(length(text) / 4) AS BIGINT) AS by_length FROM documents")
def text_sizes(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.byte_length(t).cast("bigint").alias("bytes"), text.word_count(t).cast("bigint").alias("words"), text.tokens_by_words(t).alias("by_words"), text.tokens_by_length(t).alias("by_length"))


@query(r"SELECT doc_id, length(trim(regexp_replace(text, '[\s\p{Z}\x{0B}\x{85}]+', ' ', 'g'))) AS n FROM documents")
def collapsed_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text.collapse_space(F.col("text"))).cast("bigint").alias("n"))


_CAND = r"""(SELECT page_id, array_to_string(list_transform(p, lambda t: upper(t[1]) || lower(t[2:])), ' ') AS candidate FROM
 (SELECT page_id, list_filter(string_split(replace(unnest(string_split(url, '/')), '-', '_'), '_'), lambda t: regexp_full_match(t, '\p{L}+')) AS p FROM release_pages) WHERE len(p) >= 2)"""


@query(f"SELECT page_id, candidate, len(string_split(candidate, ' ')) BETWEEN 2 AND 4 AND NOT regexp_matches(lower(candidate), '(^| )(hair|shop|store|gmbh|restaurant)( |$)') AS probable FROM {_CAND}")
def name_candidates(spark, sf_dir):
    each = table(spark, sf_dir, "release_pages").select("page_id", F.explode(text.pii_candidates(F.col("url"))).alias("candidate"))
    return each.withColumn("probable", text.is_probable_name(F.col("candidate")))


@query("SELECT doc_id, CAST(doc_id % 10 AS VARCHAR) AS score, 'N/A' AS reason, CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'ERROR' END AS answer FROM documents")
def reply_parsing(spark, sf_dir):
    reply = F.concat(F.lit("Sure:\n```json\n{\"score\": "), (F.col("doc_id") % 10).cast("string"), F.lit("}\n``` {}"))
    answer = F.when(F.col("doc_id") % 3 == 0, "so <answer>true</answer>.").otherwise("none")
    return table(spark, sf_dir, "documents").select("doc_id", text.json_field(reply, "score").alias("score"), text.json_field(reply, "reason").alias("reason"), text.answer_tag(answer).alias("answer"))


@query("SELECT sum(length(text) // 4) AS prompt_tokens, sum(doc_id % 50) AS completion_tokens, round(sum(length(text) // 4) / 1e6 * 0.075 + sum(doc_id % 50) / 1e6 * 0.3, 6) AS cost FROM documents")
def usage_cost(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(text.tokens_by_length(F.col("text")).alias("prompt_tokens"), (F.col("doc_id") % 50).alias("completion_tokens"))
    return prompts.usage_cost(d)


@query("SELECT doc_id, CAST(round(1 / (1 + exp(((doc_id % 17) - (doc_id % 11)) / 8.0)), 6) AS DOUBLE) AS p FROM documents")
def class_probability(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.class_probability(F.col("doc_id") % 17, F.col("doc_id") % 11), 6).alias("p"))


@query("SELECT page_id, length(concat_ws(chr(10), url, html)) AS n FROM release_pages")
def page_inputs(spark, sf_dir):
    return table(spark, sf_dir, "release_pages").select("page_id", F.length(text.page_input(F.col("url"), F.col("html"))).cast("bigint").alias("n"))


@query("SELECT doc_id, nullif(trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g')), '') AS line FROM documents")
def language_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.language_text(F.col("text")).alias("line"))


# --- samples, splits, benchmark sets


def _rank(seed: object, by: str = "", key: str = "page_id") -> str:
    return f"row_number() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY md5(concat_ws('|', '{seed}', {key})), {key})"


@query(f"SELECT page_id FROM release_pages ORDER BY md5(concat_ws('|', '42', page_id)), page_id LIMIT 100")
def sample_rows(spark, sf_dir):
    return sampling.sample_rows(pages(spark, sf_dir).select("page_id"), 100, "page_id")


@query(f"SELECT page_id, label FROM (SELECT page_id, label, {_rank(42, 'label')} AS rn FROM {PAGES}) WHERE label = 'phish' AND rn <= 30 OR label = 'benign' AND rn <= 70")
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(pages(spark, sf_dir).select("page_id", "label"), {"phish": 30, "benign": 70}, "label", "page_id")


@query(f"SELECT page_id, CASE WHEN {_rank(42, 'label')} <= floor(count(*) OVER (PARTITION BY label) * 0.1) THEN 'test' ELSE 'train' END AS part FROM {PAGES}")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(pages(spark, sf_dir).select("page_id", "label"), "label", "page_id").select("page_id", "part")


@query(f"SELECT page_id, CASE WHEN row_number() OVER (ORDER BY date, page_id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS part FROM {PAGES}")
def time_split(spark, sf_dir):
    return sampling.time_split(pages(spark, sf_dir).select("page_id", "date"), ["date", "page_id"]).select("page_id", "part")


@query(f"""WITH p AS (SELECT page_id, score FROM {PAGES} WHERE label = 'phish'), q AS (SELECT quantile_cont(score, 0.85) AS q, count(*) AS n FROM p),
 e AS (SELECT page_id, {_rank(42)} AS rn FROM p, q WHERE score >= q.q)
 SELECT page_id, score FROM p WHERE page_id NOT IN (SELECT page_id FROM e, q WHERE rn <= CAST(floor(0.1 * n) AS BIGINT))""")
def difficulty_filter(spark, sf_dir):
    return sampling.difficulty_filter(pages(spark, sf_dir).where("label = 'phish'").select("page_id", "score"), True, id_col="page_id")


@query(f"SELECT page_id, round((score + ((page_id * 31) % 1000) / 1000.0 + ((page_id * 17) % 1000) / 1000.0) / 3, 6) AS score FROM {PAGES}")
def score_ensemble(spark, sf_dir):
    p = pages(spark, sf_dir)
    other = lambda k: p.select("page_id", ((F.col("page_id") * k % 1000) / F.lit(1000.0)).alias("score"))
    return sampling.ensemble([p.select("page_id", "score"), other(31), other(17)], "page_id")


@query(f"SELECT page_id, split FROM {PAGES} WHERE NOT (score < 0.1 OR score > 0.95 OR label = 'phish' AND split = 'validation')")
def filters_applied(spark, sf_dir):
    p = pages(spark, sf_dir)
    f = [p.where(c).select("page_id") for c in ("score < 0.1", "score > 0.95", "label = 'phish' and split = 'validation'")]
    return sampling.apply_filters(p.select("page_id", "split"), f, "page_id").where("page_id is not null")


@query(f"SELECT page_id FROM {PAGES} WHERE score < 0.5 INTERSECT SELECT page_id FROM {PAGES} WHERE label = 'phish'")
def filters_both(spark, sf_dir):
    p = pages(spark, sf_dir)
    return sampling.both_filters(p.where("score < 0.5"), p.where("label = 'phish'"), "page_id")


_SIZE = lambda b: f"CAST(ceil(0.01 * {b} * (SELECT count(*) FROM {PAGES} WHERE label = 'benign') / (1 - 0.01 * {b})) AS BIGINT)"


@query(f"""WITH p AS (SELECT page_id, {_rank(42)} AS rn, count(*) OVER () AS n, {_SIZE(5)} AS size FROM {PAGES} WHERE label = 'phish')
 SELECT '5.00-' || ((rn - 1) // size) AS set_id, page_id FROM p WHERE (rn - 1) // size < n // size""")
def benchmark_sets(spark, sf_dir):
    p = pages(spark, sf_dir)
    return sampling.benchmark_sets(p.where("label = 'phish'"), p.where("label = 'benign'").count(), 5, "page_id")


@query(f"""WITH p AS (SELECT page_id, {_rank(42)} AS rn, {_SIZE(0.5)} AS a, {_SIZE(1)} AS b, {_SIZE(5)} AS c FROM {PAGES} WHERE label = 'phish')
 SELECT CASE WHEN rn <= a THEN '0.50' WHEN rn <= a + b THEN '1.00' ELSE '5.00' END AS set_id, page_id FROM p WHERE rn <= a + b + c""")
def sequential_sets(spark, sf_dir):
    p = pages(spark, sf_dir)
    return sampling.sequential_sets(p.where("label = 'phish'"), p.where("label = 'benign'").count(), [0.5, 1, 5], "page_id")


@query()
def resampled_sets(spark, sf_dir):
    p = pages(spark, sf_dir)
    return sampling.resampled_sets(p.where("label = 'phish'"), p.where("label = 'benign'").count(), 5, 4, "page_id")


@query(f"""WITH p AS (SELECT page_id, {_rank(42)} AS rn, count(*) OVER () AS n, {_SIZE(5)} AS size FROM {PAGES} WHERE label = 'phish'),
 s AS (SELECT '5.00-' || ((rn - 1) // size) AS set_id, page_id FROM p WHERE (rn - 1) // size < n // size), b AS (SELECT count(*) AS k FROM {PAGES} WHERE label = 'benign')
 SELECT set_id, gt, n FROM (SELECT set_id, 1 AS gt, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT DISTINCT set_id, 0, k FROM s, b)""")
def benchmark_with_negatives(spark, sf_dir):
    p = pages(spark, sf_dir)
    return sampling.with_negatives(benchmark_sets(spark, sf_dir), p.where("label = 'benign'"), "page_id").groupBy("set_id", "gt").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT url, CAST(crawl_id % 120 AS INT) AS nconnects FROM crawl_pages WHERE crawl_id % 2 = 0 AND crawl_id % 120 BETWEEN 5 AND 100")
def feed_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "crawl_pages").select(F.concat_ws(",", "url", F.col("crawl_id") % 120, F.col("crawl_id") % 2).alias("value"))
    return sampling.feed_filter(lines)


@query("SELECT crawl_id FROM crawl_pages WHERE TRY_CAST(source_id AS BIGINT) > 501000")
def new_feed_ids(spark, sf_dir):
    return sampling.new_ids(table(spark, sf_dir, "crawl_pages"), "source_id", 501000).select("crawl_id")


@query("SELECT crawl_id, length(html_content) AS n FROM crawl_pages WHERE length(html_content) >= 1500")
def size_gate(spark, sf_dir):
    return sampling.size_gate(table(spark, sf_dir, "crawl_pages"), least=1500).select("crawl_id", F.length("html_content").cast("bigint").alias("n"))


@query("SELECT feed_source, max_by(source_id, (ingested_at, source_id)) AS last_id FROM crawl_pages WHERE feed_source IS NOT NULL GROUP BY feed_source")
def last_feed_ids(spark, sf_dir):
    return quota.last_ids(table(spark, sf_dir, "crawl_pages"))


@query("SELECT target, unnest(list_distinct(list_filter(list_concat([website_url], coalesce(top_10_domain_urls, [])), lambda u: u IS NOT NULL AND u <> ''))) AS url FROM frequent_targets")
def target_urls(spark, sf_dir):
    return table(spark, sf_dir, "frequent_targets").select("target", F.explode(sampling.dedup_urls(F.col("website_url"), F.col("top_10_domain_urls"))).alias("url"))


@query("SELECT title, count(*) - 1 AS others, min(page_id) AS group_id FROM release_pages WHERE title IS NOT NULL GROUP BY title")
def same_titles(spark, sf_dir):
    p = table(spark, sf_dir, "release_pages")
    return vectors.same_value_pairs(p, "page_id", "title").join(p.select("page_id", "title"), "page_id").select("title", "others", "group_id").distinct()


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 300 AS BIGINT) AS file_no FROM documents")
def packed_requests(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    return features.packed_requests(d, "size", ["doc_id"], 300, 10**15).select("doc_id", F.col("file_no").cast("bigint").alias("file_no"))


# --- vectors


def _bins_sql(n: int) -> str:
    planes = vectors.random_planes(64, n)
    bit = lambda p: f"CASE WHEN list_dot_product(embedding::DOUBLE[], {[float(x) for x in planes[:, p]]}::DOUBLE[]) >= 0 THEN {1 << (n - 1 - p)} ELSE 0 END"
    return f"(SELECT vec_id AS id, embedding, label, CAST({' + '.join(bit(p) for p in range(n))} AS BIGINT) AS bin FROM embeddings)"


@query(f"SELECT id, bin FROM {_bins_sql(16)}")
def lsh_bins(spark, sf_dir):
    return vectors.dense_bins(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 16)


def _edges_sql(n: int, r: int) -> str:
    return f"(WITH b AS MATERIALIZED {_bins_sql(n)} SELECT x.id AS query_id, y.id AS cand_id, round(least(greatest(1 - list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 0), 2), 6) AS distance FROM b x JOIN b y ON x.id <> y.id AND bit_count(xor(x.bin, y.bin)) <= {r})"


def _edges(spark, sf_dir, n: int, r: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    bins = vectors.dense_bins(e, "vec_id", "embedding", n)
    return vectors.dense_edges(vectors.candidates(bins, bins, n, r), e, "vec_id", "embedding")


@query(f"SELECT query_id, cand_id FROM {_edges_sql(16, 4)}")
def lsh_hamming_pairs(spark, sf_dir):
    bins = vectors.dense_bins(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 16)
    return vectors.candidates(bins, bins, 16, 4)


@query(f"SELECT query_id, cand_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, cand_id) AS rank FROM {_edges_sql(16, 4)}) WHERE rank <= 5")
def nearest_neighbours(spark, sf_dir):
    return vectors.nearest(_edges(spark, sf_dir, 16, 4), 5).select("query_id", "cand_id", "distance", F.col("rank").cast("bigint").alias("rank"))


@query(f"SELECT v.vec_id AS query_id, m.cand_id, coalesce(m.distance, 'inf'::DOUBLE) AS distance FROM embeddings v LEFT JOIN (SELECT query_id, min_by(cand_id, (distance, cand_id)) AS cand_id, min(distance) AS distance FROM {_edges_sql(16, 2)} GROUP BY query_id) m ON v.vec_id = m.query_id")
def closest_neighbour(spark, sf_dir):
    return vectors.closest(_edges(spark, sf_dir, 16, 2), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))


@query(f"""WITH u AS (SELECT query_id, min(distance) AS url_distance FROM {_edges_sql(8, 2)} GROUP BY 1), h AS (SELECT query_id, min(distance) AS html_distance FROM {_edges_sql(16, 2)} GROUP BY 1)
 SELECT coalesce(u.query_id, h.query_id) AS query_id, url_distance, html_distance FROM u FULL JOIN h ON u.query_id = h.query_id WHERE url_distance < 0.5 OR html_distance < 0.6""")
def leakage_filter(spark, sf_dir):
    return vectors.leakage_filter(_edges(spark, sf_dir, 8, 2), _edges(spark, sf_dir, 16, 2), 0.5, 0.6)


@query(f"""WITH u AS (SELECT query_id, min(distance) AS url_distance FROM {_edges_sql(8, 2)} GROUP BY 1), h AS (SELECT query_id, min(distance) AS html_distance FROM {_edges_sql(16, 2)} GROUP BY 1)
 SELECT query_id, url_distance, html_distance FROM u JOIN h USING (query_id) WHERE url_distance > 0.7 AND html_distance > 0.7""")
def far_queries(spark, sf_dir):
    return vectors.far_queries(_edges(spark, sf_dir, 8, 2), _edges(spark, sf_dir, 16, 2), 0.7)


@query(f"""SELECT count(*) FILTER (url_distance < 0.7) AS by_url, count(*) FILTER (html_distance < 0.8) AS by_html, count(*) FILTER (url_distance < 0.7 AND html_distance < 0.8) AS by_both, count(*) FILTER (url_distance < 0.7 OR html_distance < 0.8) AS by_either
 FROM (SELECT query_id, min(distance) AS url_distance FROM {_edges_sql(8, 2)} GROUP BY 1) FULL JOIN (SELECT query_id, min(distance) AS html_distance FROM {_edges_sql(16, 2)} GROUP BY 1) USING (query_id)""")
def leakage_counts(spark, sf_dir):
    return vectors.leakage_counts(_edges(spark, sf_dir, 8, 2), _edges(spark, sf_dir, 16, 2), 0.7, 0.8)


@query(f"SELECT DISTINCT query_id AS id FROM {_edges_sql(16, 5)} WHERE distance <= 0.6 AND cand_id > query_id")
def diversity_drop(spark, sf_dir):
    order = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("rank"))
    return vectors.diversity_drop(_edges(spark, sf_dir, 16, 5), order, 0.6)


@query(f"""SELECT threshold, count(*) AS n, round(quantile_cont(distance, 0.5), 6) AS median FROM (SELECT t.threshold, e.distance, row_number() OVER (PARTITION BY t.threshold ORDER BY distance DESC, query_id, cand_id) AS rn
 FROM {_edges_sql(16, 2)} e JOIN (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold) t ON e.distance <= t.threshold) WHERE rn <= 100 GROUP BY threshold""")
def threshold_sweep(spark, sf_dir):
    return vectors.threshold_sweep(_edges(spark, sf_dir, 16, 2), [k / 10 for k in range(1, 10)])


@query(f"""SELECT label AS "group", count(*) AS pairs, round(avg(CASE WHEN distance <= 0.6 THEN 1.0 ELSE 0.0 END), 6) AS share FROM {_edges_sql(16, 4)} e JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = cand_id AND a.label = b.label GROUP BY a.label""".replace("SELECT label", "SELECT a.label"))
def within_cutoff(spark, sf_dir):
    groups = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group"))
    return cleaning.within_cutoff(_edges(spark, sf_dir, 16, 4), groups, 0.6)


@query("""WITH t AS (SELECT page_id AS id, substr(lower(url), i, k) AS term FROM (SELECT page_id, url, k, unnest(range(1, length(url) - k + 2)) AS i FROM release_pages, (SELECT unnest([1, 2, 3]) AS k) WHERE url IS NOT NULL)),
 c AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, ln((1 + (SELECT count(*) FROM release_pages)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term),
 w AS (SELECT id, term, tf * idf AS w FROM c JOIN d USING (term)) SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w""")
def tfidf_urls(spark, sf_dir):
    p = table(spark, sf_dir, "release_pages")
    terms = vectors.char_terms(F.col("url"))
    return vectors.tfidf(p, "page_id", terms, vectors.fit_idf(p, "page_id", terms)).withColumn("weight", F.round("weight", 6))


@query()
def tfidf_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    terms = vectors.word_terms(F.col("text"))
    return vectors.tfidf(d, "doc_id", terms, vectors.fit_idf(d, "doc_id", terms, 1_000_000)).withColumn("weight", F.round("weight", 6))


@query()
def sparse_bins(spark, sf_dir):
    p = table(spark, sf_dir, "release_pages")
    terms = vectors.char_terms(F.col("url"))
    return vectors.sparse_bins(vectors.tfidf(p, "page_id", terms, vectors.fit_idf(p, "page_id", terms)), 8)


@query()
def page_leakage(spark, sf_dir):
    p = table(spark, sf_dir, "release_pages").select(F.col("page_id").alias("id"), "url", "html", "split")
    return leakage.leakage(p.where("split = 'train'"), p.where("split = 'test'"), id_col="id")


@query()
def indel_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "release_pages").withColumn("rank", F.col("page_id"))
    return vectors.indel_edges(p, "page_id", "url", "rank", 0.95)


# --- metrics

_CURVE = f"(SELECT s, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS pos, sum(q) OVER () AS neg FROM (SELECT score AS s, count(*) FILTER (gt = 1) AS p, count(*) FILTER (gt = 0) AS q FROM {PAGES} GROUP BY score) WINDOW w AS (ORDER BY s DESC))"


@query(f"SELECT round(sum(p / pos * tp / (tp + fp)), 6) AS average_precision FROM {_CURVE}")
def average_precision(spark, sf_dir):
    return metrics.average_precision(pages(spark, sf_dir))


@query(f"SELECT round(coalesce(max(tp / (tp + fp)) FILTER (tp >= 0.9 * pos), 0), 6) AS precision FROM {_CURVE}")
def precision_at_recall(spark, sf_dir):
    return metrics.precision_at_recall(pages(spark, sf_dir))


@query(f"SELECT round(sum(q * (tp - p / 2.0)) / max(pos * neg), 6) AS auc FROM {_CURVE}")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(pages(spark, sf_dir))


@query(f"SELECT s AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall FROM {_CURVE}")
def pr_curve(spark, sf_dir):
    return metrics.pr_curve(pages(spark, sf_dir)).select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"SELECT s AS threshold, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM {_CURVE}")
def roc_curve(spark, sf_dir):
    return metrics.roc_curve(pages(spark, sf_dir)).select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(f"SELECT s AS threshold, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr, round(round(sqrt(tp / pos * (1 - fp / neg)), 9), 6) AS g_mean FROM {_CURVE} ORDER BY round(sqrt(tp / pos * (1 - fp / neg)), 9) DESC, s DESC LIMIT 1")
def best_threshold(spark, sf_dir):
    return metrics.best_threshold(pages(spark, sf_dir))


@query()
def evaluation(spark, sf_dir):
    return metrics.evaluation(pages(spark, sf_dir))


_CONF = f"(SELECT threshold, count(*) FILTER (gt = 1 AND score > threshold) AS tp, count(*) FILTER (gt = 0 AND score > threshold) AS fp, count(*) FILTER (gt = 0 AND score <= threshold) AS tn, count(*) FILTER (gt = 1 AND score <= threshold) AS fn FROM {PAGES}, (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS threshold) GROUP BY threshold)"


@query(f"""SELECT threshold, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
 round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1 FROM {_CONF}""")
def confusion_thresholds(spark, sf_dir):
    return metrics.confusion(pages(spark, sf_dir), [0.3, 0.4, 0.5, 0.6, 0.7])


_REP = f"(SELECT count(*) FILTER (gt = 1 AND score >= 0.5) AS tp, count(*) FILTER (gt = 0 AND score >= 0.5) AS fp, count(*) FILTER (gt = 0 AND score < 0.5) AS tn, count(*) FILTER (gt = 1 AND score < 0.5) AS fn FROM {PAGES})"


@query(f"""SELECT 'phish' AS class, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1, tp + fn AS support FROM {_REP}
 UNION ALL SELECT 'benign', round(tn / (tn + fn), 6), round(tn / (tn + fp), 6), round(2.0::DOUBLE * tn / (2 * tn + fp + fn), 6), tn + fp FROM {_REP}""")
def classification_report(spark, sf_dir):
    return metrics.classification_report(pages(spark, sf_dir))


@query()
def bootstrap_mean(spark, sf_dir):
    return metrics.bootstrap_mean(pages(spark, sf_dir).groupBy("split", "date").agg(F.avg("score").alias("v")), "v", "split")


@query()
def confidence_intervals(spark, sf_dir):
    return metrics.confidence_intervals(pages(spark, sf_dir), replicates=10_000)


@query()
def mean_pr_curve(spark, sf_dir):
    return metrics.mean_curve(pages(spark, sf_dir), "split")


@query()
def mean_roc_curve(spark, sf_dir):
    return metrics.mean_curve(pages(spark, sf_dir), "split", "roc")


# --- features, html, streams


@query("SELECT feature, n, row_number() OVER (ORDER BY n DESC, feature) - 1 AS idx FROM (SELECT 'te_' || substr(url, i, 4) AS feature, count(*) AS n FROM (SELECT url, unnest(range(1, length(url) - 3)) AS i FROM release_pages WHERE length(url) > 4) GROUP BY 1 HAVING count(*) > 10)")
def feature_dictionary(spark, sf_dir):
    grams = table(spark, sf_dir, "release_pages").select(F.explode(text.char_ngrams("te")("url")).alias("feature"))
    return features.feature_dictionary(grams)


@query()
def reduced_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "release_pages").select("page_id", F.explode(text.char_ngrams("te")("url")).alias("feature"))
    return features.reduce_rows(rows, feature_dictionary(spark, sf_dir), ["page_id"])


@query("SELECT event_type AS feature, min(event_id) AS first_pos, round(sum(value), 4) AS total, count(value) AS n, max(value) AS most, round(round(sum(value), 4) / count(value), 4) AS missing_value FROM events GROUP BY 1")
def vectorizer_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("feature"), "value", F.col("event_id").alias("pos"))
    return features.vectorizer_stats(e).withColumn("total", F.round("total", 4)).withColumn("missing_value", F.round(F.col("total") / F.col("n"), 4))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END AS label, 's' || doc_id AS sha256, 2 AS n, CAST(doc_id % 7 AS DOUBLE) AS a FROM documents")
def feature_lines(spark, sf_dir):
    line = F.concat_ws(" ", F.when(F.col("doc_id") % 2 == 0, "1").otherwise("-1"), F.concat(F.lit("s"), "doc_id"), F.lit("a:9"), F.concat(F.lit("a:"), F.col("doc_id") % 7), F.lit("bad:x"), F.lit("b:0.5"))
    rows = features.parse_feature_lines(table(spark, sf_dir, "documents").select(line.alias("value")))
    return rows.select("label", "sha256", F.size("features").alias("n"), F.col("features")["a"].alias("a"))


@query()
def linear_scores(spark, sf_dir):
    p = pages(spark, sf_dir)
    rows = features.reduce_rows(p.select("sha256", "gt", F.explode(text.char_ngrams("te")("url")).alias("feature")), feature_dictionary(spark, sf_dir), ["sha256", "gt"])
    weights, bias = features.train_linear(rows, label_col="gt", features_col="indices")
    return features.decision_scores(weights, bias, rows, features_col="indices").withColumn("decision", F.round("decision", 4))


@query("SELECT page_id, CASE WHEN regexp_matches(html, '<\\s*\\w+[^>]*>') AND regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN lower(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))) END AS title FROM release_pages")
def html_titles(spark, sf_dir):
    return table(spark, sf_dir, "release_pages").select("page_id", hf.title_column(F.col("html")).alias("title"))


@query()
def html_texts(spark, sf_dir):
    return table(spark, sf_dir, "release_pages").select("page_id", F.length(hf.html_text("html")).alias("n_text"), F.length(hf.html_raw_text("html")).alias("n_raw"))


@query()
def html_feature_lengths(spark, sf_dir):
    return table(spark, sf_dir, "release_pages").select("page_id", hf.html_features(F.col("html")).alias("f")).select("page_id", "f.*")


@query()
def html_feature_dictionary(spark, sf_dir):
    counts = hf.channel_counts(table(spark, sf_dir, "release_pages"), "html")
    return features.feature_dictionary(counts, max_features=300_000, count_col="n")


@query()
def html_simplified(spark, sf_dir):
    return table(spark, sf_dir, "release_pages").select("page_id", hf.simplified(2500, True)("html").alias("s")).select("page_id", "s.stage", F.length("s.html").alias("n"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_daily(spark, sf_dir):
    return quota.daily_counts(table(spark, sf_dir, "events"))


@query("SELECT event_id, CASE WHEN rn < 200 THEN 'k' || (rn // 100) END AS api_key FROM (SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) - 1 AS rn FROM events)")
def quota_daily(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return quota.assign_quota(e, ["k0", "k1"], 100, "event_id").select("event_id", "api_key")


@query()
def rate_limits(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") * 1000).cast("bigint").alias("tokens"))
    return quota.simulate_limits(e, "user_id", "event_id", "tokens", 100_000, 20)


@query("SELECT 'report' AS source, url, target, NULL::VARCHAR AS submission_time, CAST(crawl_id AS VARCHAR) AS source_id, coalesce(ip, '') AS ip, NULL::VARCHAR AS asn, NULL::INT AS min_html_size FROM crawl_pages WHERE crawl_id > 100")
def phish_feed(spark, sf_dir):
    entry = F.struct(F.col("crawl_id").alias("phish_id"), "url", "target", F.lit(None).cast("string").alias("verification_time"), F.array(F.struct(F.col("ip").alias("ip_address"))).alias("details"))
    return feeds.phish_feed(table(spark, sf_dir, "crawl_pages").select(F.to_json(F.array(entry)).alias("value")), "report", 100)


@query()
def p7_found(spark, sf_dir):
    return schema_drift.changes(table(spark, sf_dir, "page_files"))


@query()
def p7_table(spark, sf_dir):
    return schema_drift.consistent_table(table(spark, sf_dir, "page_files"))


@query()
def p7_lifespans(spark, sf_dir):
    files = table(spark, sf_dir, "page_files")
    return schema_drift.lifespans(schema_drift.catalogue(schema_drift.field_values(files), files))


def queries() -> dict[str, Query]:
    from pagelode.plans import files  # noqa: F401 - registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from pagelode.plans import files  # noqa: F401 - registers its queries

    return dict(_SQL)
