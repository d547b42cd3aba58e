"""Registered queries of the problems: `queries()` and `oracle_sql()`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelode.llm import chunking, contamination, cross_split, diverse_subset, language, mixing, pii, residue
from pagelode.llm import group_split as gs
from pagelode.session import table


def p1_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        "crawl_pages": (table(spark, sf_dir, "crawl_pages"), "crawl_id", "html_content", "target"),
        "release_pages": (table(spark, sf_dir, "release_pages"), "page_id", "html", "target"),
    }
    return diverse_subset.choose_subsets(tables, table(spark, sf_dir, "subset_plan"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_places(table(spark, sf_dir, "release_pages")).select("page_id", "field", "kind", "nth")


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "release_pages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_rows(table(spark, sf_dir, "crawl_pages"))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.without_residue(table(spark, sf_dir, "crawl_pages"), p3_found(spark, sf_dir))


def p3_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.blank_slots(table(spark, sf_dir, "crawl_pages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.label_corrections(table(spark, sf_dir, "release_pages")).select("page_id", "seg_no", "lang")


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.page_languages(table(spark, sf_dir, "release_pages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gs.related_groups(table(spark, sf_dir, "crawl_pages"), table(spark, sf_dir, "target_aliases"))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gs.split_groups(p5_found(spark, sf_dir), table(spark, sf_dir, "split_plan"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gs.split_report(p5_splits(spark, sf_dir), table(spark, sf_dir, "split_plan"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split.cross_split_pairs(table(spark, sf_dir, "release_pages"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split.overlap_report(p6_found(spark, sf_dir), table(spark, sf_dir, "release_pages"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "bench_items"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.clean_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "bench_items"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "chunk_limits"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1].isdigit()}


_WORDS = r"list_filter(list_transform(regexp_split_to_array(trim(text), '[\s\v\p{Z}\x{85}]+'), lambda w: regexp_replace(lower(w), '[^\p{L}\p{N}]', '', 'g')), lambda w: w <> '')"


def _runs(key: str, table: str) -> str:
    """SQL of the runs of twelve words of a table."""
    return f"SELECT DISTINCT {key} AS id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS run FROM (SELECT {key}, {_WORDS} AS w FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL) WHERE len(w) >= 12"


_LEAKED = f"SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM ({_runs('doc_id', 'documents')}) d JOIN ({_runs('item_id', 'bench_items')}) i USING (run)"
_PLAIN = r"regexp_replace(lower({c}), '[\s-]', '', 'g')"
_HOST = r"nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)', 1)), '^.*@', ''), ':\d*$', ''), '(^www\.)|(\.$)', '', 'g'), '')"
_GROUPS = f"""WITH RECURSIVE k AS (SELECT crawl_id, 'h:' || {_HOST} AS h, 't:' || coalesce(a.t, p.t) AS t FROM (SELECT crawl_id, url, CASE WHEN {_PLAIN.format(c='target')} NOT IN ('', 'unknown', 'other', 'n/a') THEN {_PLAIN.format(c='target')} END AS t FROM crawl_pages) p
  LEFT JOIN (SELECT {_PLAIN.format(c='alias')} AS a, min({_PLAIN.format(c='target')}) AS t FROM target_aliases GROUP BY 1) a ON p.t = a.a),
 e AS (SELECT DISTINCT h AS x, t AS y FROM k WHERE h IS NOT NULL AND t IS NOT NULL), n AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
 r(node, reached) AS (SELECT coalesce(h, t) AS node, coalesce(h, t) AS reached FROM k WHERE coalesce(h, t) IS NOT NULL UNION SELECT node, y FROM r JOIN n ON reached = x),
 f AS (SELECT coalesce(h, t) AS node, min(crawl_id) AS id FROM k GROUP BY 1), g AS (SELECT r.node, min(f.id) AS group_id FROM r JOIN f ON r.reached = f.node GROUP BY 1)
 SELECT crawl_id, coalesce(group_id, crawl_id) AS group_id FROM k LEFT JOIN g ON coalesce(k.h, k.t) = g.node"""


def oracle_sql() -> dict[str, str]:
    return {"p5_found": _GROUPS, "p8_found": _LEAKED}
