"""Canonical schemas (section 1.3 of the blueprint)."""

from __future__ import annotations

PAGE = "sha256 string, url string, html string, title string, label string, target string, date date, lang string, lang_score double, split string, filename string"
FEED = "source string, url string, target string, submission_time string, source_id string, ip string, asn string, min_html_size int"
CRAWL = "sha256 string, url string, html_content string, status int, crawl_time double, feed_source string, target string, source_id string, ip string, asn string, submission_time string"
EDGE = "class_type string, feat_type string, query_id string, cand_id string, distance double"
PRED = "sha256 string, gt int, score double, model string"
FILTER = "class_type string, stage string, sha256 string"
TARGET = "target string, count bigint, website_url string, domain string, top_10_domain_urls array<string>, scraping_status array<struct<url: string, status: string>>"
PII = "sha256 string, url string, candidate string, name string, pii string"
LLM = "sha256 string, url string, label int, simplification string, phishing boolean, score double, reason string, exception string"
