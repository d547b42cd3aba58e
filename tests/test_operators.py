import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from pagelode.functions.text import indel_similarity
from pagelode.operators import cleaning, eda, features, metrics, prefix, sampling, schema_drift, vectors
from pagelode.sources import feeds, readers, sinks
from pagelode.streaming import quota


def test_flags(spark):
    urls = spark.createDataFrame([(k, u) for k, u in enumerate(["a", "b", "a", None, None, "a"])], "i int, url string")
    got = cleaning.mark_duplicate_urls(urls, ["i"]).orderBy("i").collect()
    assert [r["duplicate_url"] for r in got] == [False, False, True, False, True, True]
    html = spark.createDataFrame([(k, h) for k, h in enumerate([None, "", " ", "<p>"])], "i int, html string")
    assert [r["empty_html"] for r in cleaning.mark_empty_html(html).orderBy("i").collect()] == [True, True, False, False]
    titles = spark.createDataFrame([(k, t) for k, t in enumerate([None, "Page not FOUND", "Welcome", "ERROR 1"])], "i int, title string")
    assert [r["bad_title"] for r in cleaning.mark_bad_titles(titles).orderBy("i").collect()] == [False, True, False, True]
    assert cleaning.mark_duplicate_urls(urls.limit(0), ["i"]).count() == 0


def test_nearest_quantiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", None)], "label string, v double")
    got = {r["label"]: r for r in eda.feature_statistics(df, ["v"]).collect()}
    assert (got["a"]["p25"], got["a"]["p50"], got["a"]["p75"], got["a"]["count"]) == (2, 3, 3, 4)
    assert got["b"]["p50"] is None and got["b"]["count"] == 0
    rng = random.Random(1)
    values = [rng.choice([rng.random() * 100, 7.0]) for _ in range(500)]
    big = spark.createDataFrame([("x", v) for v in values], "g string, v double")
    want = sorted(values)[int(np.floor(499 * 0.9 + 0.5))]
    assert eda.nearest_quantiles(big, ["g"], "v", {"q": 0.9}).first()["q"] == want


def test_top_bucket_and_outliers(spark):
    df = spark.createDataFrame([(c,) for c in "aaabbc"] + [(None,)], "t string")
    assert rows(eda.bucket_top(df, "t", 2).groupBy("t").count()) == [("a", 3), ("b", 2), ("other", 2)]
    v = spark.createDataFrame([("g", x) for x in range(100)] + [("g", None), (None, 5)], "g string, v int")
    assert cleaning.remove_outliers(v, "v", ["g"], 0.5).count() == 52


def test_running_sum_is_exact_under_skew(spark):
    df = spark.createDataFrame([("hot" if k % 3 else "cold", k, k % 5) for k in range(600)] + [(None, 600, None)], "g string, id int, v int")
    got = prefix.hash_running_sum(df, ["g"], "id", "v", "before", "s", 16).withColumn("h", F.md5(F.concat_ws("|", F.lit("s"), F.col("id").cast("string"))))
    for g in ("hot", "cold", None):
        total = 0
        for r in sorted((r for r in got.collect() if r["g"] == g), key=lambda r: (r["h"], r["id"])):
            assert r["before"] == total
            total += r["v"] or 0


def test_samples_and_sets(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("sha256"), (F.col("id") % 2).alias("c"), (F.col("id") / 200).alias("score"))
    assert sampling.sample_rows(df, 500, "sha256").count() == 200
    split = sampling.stratified_split(df, "c", "sha256")
    assert rows(split.where("part = 'test'").groupBy("c").count()) == [(0, 10), (1, 10)]
    sets = sampling.benchmark_sets(spark.range(10).select(F.col("id").cast("string").alias("sha256")), 56, 5)
    assert rows(sets.groupBy("set_id").count()) == [("5.00-0", 3), ("5.00-1", 3), ("5.00-2", 3)] and sets.select("sha256").distinct().count() == 9
    with pytest.raises(AssertionError):
        sampling.difficulty_filter(df, True, delta=0.15, drop=0.2)
    assert sampling.difficulty_filter(df, True).count() == 180
    assert sampling.difficulty_filter(df.limit(0), True).count() == 0
    parts = sampling.time_split(df.withColumn("n", F.col("sha256").cast("int")), ["n"])
    assert parts.where("part = 'train'").count() == 160 and parts.where("part = 'train'").agg(F.max("n")).first()[0] == 159
    with pytest.raises(ValueError):
        sampling.sample_fraction(df, 0, "sha256")
    lines = spark.createDataFrame([("http://a,b,7,0",), ("x,7",), ("y,3,0",), ("z,7,1",), ("w,q,0",)], "value string")
    assert rows(sampling.feed_filter(lines)) == [("http://a,b", 7)] and rows(sampling.feed_filter(lines, keep_commas=False)) == [("http://ab", 7)]


def greedy(edges, order):
    dropped = set()
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    for x in order:
        if any(y not in dropped for y in near.get(x, ())):
            dropped.add(x)
    return dropped


def test_diversity_equals_the_greedy_pass(spark):
    cases = [[(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)], [(0, 1), (1, 2), (2, 3), (3, 4)], [(0, 1), (0, 2), (0, 3)]]
    rng = random.Random(5)
    cases += [[(a, b) for a in range(8) for b in range(a) if rng.random() < 0.3] for _ in range(4)]
    order = spark.range(9).select("id", F.col("id").alias("rank"))
    for edges in cases:
        df = spark.createDataFrame([(a, b, 0.01) for a, b in edges] or [(0, 0, 1.0)], "query_id long, cand_id long, distance double")
        assert {r[0] for r in vectors.diversity_drop(df, order).collect()} == greedy(edges, range(9))


def test_hamming_balls_agree_with_brute_force(spark):
    rng = random.Random(2)
    bins = [(k, rng.getrandbits(10)) for k in range(60)] + [(60, 1023), (61, 1023)]
    df = spark.createDataFrame(bins, "id long, bin long")
    for radius in (1, 2, 5):
        want = {(a, b) for a, x in bins for b, y in bins if a != b and (x ^ y).bit_count() <= radius}
        assert {tuple(r) for r in vectors.candidates(df, df, 10, radius).collect()} == want
    assert "BroadcastNestedLoopJoin" not in vectors.candidates(df, df, 16, 5)._jdf.queryExecution().toString()


def test_leakage_filter_is_strict(spark):
    u = spark.createDataFrame([("a", 0.05), ("b", 0.5), ("c", 0.1), ("d", 0.5)], "query_id string, distance double")
    h = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("c", 0.2), ("d", 0.5)], "query_id string, distance double")
    assert {r[0] for r in vectors.leakage_filter(u, h).collect()} == {"a", "b"}
    assert vectors.leakage_counts(u, h).first()[:] == (1, 1, 0, 2)


def test_tfidf_weights(spark):
    docs = spark.createDataFrame([(1, "red fox fox"), (2, "red dog"), (3, None), (4, "")], "id int, t string")
    terms = vectors.word_terms(F.col("t"), 1)
    w = {(r["id"], r["term"]): r["weight"] for r in vectors.tfidf(docs, "id", terms, vectors.fit_idf(docs, "id", terms)).collect()}
    idf = lambda df: np.log(5 / (1 + df)) + 1
    a, b = 1 * idf(2), 2 * idf(1)
    assert abs(w[1, "fox"] - b / np.hypot(a, b)) < 1e-9 and {k[0] for k in w} == {1, 2}


def test_indel_edges_lose_no_pair(spark):
    from pagelode.functions.text import indel_similarity

    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh/.-") for _ in range(40)) for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(6):
            t = list(b)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([[], [rng.choice("xyz")], [t[k], "q"]])
            texts.append("".join(t))
    texts += ["", "a", "ab"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id int, t string").withColumn("r", F.col("id"))
    got = {(r[0], r[1]) for r in vectors.indel_edges(df, "id", "t", "r", 0.9).collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] and texts[j] and indel_similarity(texts[i], texts[j]) >= 0.9}
    assert got >= want and all(indel_similarity(texts[i], texts[j]) >= 0.9 for i, j in got)


def test_metrics_against_plain_python(spark):
    rng = random.Random(6)
    data = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(300)] + [(1, None)]
    df = spark.createDataFrame(data, "gt int, score double")
    data = data[:-1]
    pos = sum(y for y, _ in data)
    ap = tp = fp = best = 0.0
    for s in sorted({s for _, s in data}, reverse=True):
        p = sum(1 for y, x in data if x == s and y)
        q = sum(1 for y, x in data if x == s and not y)
        tp, fp = tp + p, fp + q
        ap += p / pos * tp / (tp + fp)
        if tp >= 0.9 * pos:
            best = max(best, tp / (tp + fp))
    assert abs(metrics.average_precision(df).first()[0] - ap) < 1e-6
    assert abs(metrics.precision_at_recall(df).first()[0] - best) < 1e-6
    auc = np.mean([(a > b) + 0.5 * (a == b) for y, a in data if y for z, b in data if not z])
    assert abs(metrics.roc_auc(df).first()[0] - auc) < 1e-6
    assert metrics.precision_at_recall(df.where("gt = 0")).first()[0] == 0.0
    ci = {r["metric"]: r for r in metrics.confidence_intervals(df, replicates=200).collect()}
    cut = {r["metric"]: r for r in metrics.confidence_intervals(df, replicates=200, range_scores=7).collect()}
    assert all(abs(ci[m][k] - cut[m][k]) < 0.05 for m in ci for k in ("mean", "low", "high"))
    assert ci["average_precision"]["low"] < ap < ci["average_precision"]["high"]
    with pytest.raises(ValueError):
        metrics.confidence_intervals(spark.createDataFrame([(2, 0.5)], "gt int, score double"))
    assert metrics.mean_curve(df.withColumn("s", F.lit("x")), "s").count() == 1000


def test_feature_files(spark):
    lines = spark.createDataFrame([("1 s1 a:1 a:2 b:x c:1:2",), ("",), ("x s2 a:1",), ("-1 s3",)], "value string")
    got = {r["sha256"]: r["features"] for r in features.parse_feature_lines(lines).collect()}
    assert got == {"s1": {"a": 2.0}, "s3": {}}
    assert rows(features.parse_index_lines(spark.createDataFrame([("1\t0:1\t7:1",), ("0",), ("",)], "value string"))) == [(0, []), (1, [0, 7])]
    feats = spark.createDataFrame([("f0",)] * 20 + [("f1",)] * 15 + [("f2",)] * 10, "feature string")
    d = features.feature_dictionary(feats)
    assert rows(d.select("feature", "idx")) == [("f0", 0), ("f1", 1)]
    r = spark.createDataFrame([("x", "f0"), ("x", "f1"), ("y", "f0"), ("z", "f2")], "id string, feature string")
    assert rows(features.reduce_rows(r, d, ["id"])) == [("x", [0, 1]), ("y", [0])]
    assert rows(features.reduce_rows(r, d, ["id"], compat_drop_zero=True)) == [("x", [1])]
    w = features.weight_lines(spark.createDataFrame([("a", 0.5)], "feature string, weight double"), 1.0).orderBy("line")
    assert [x["value"] for x in w.collect()] == ["No of features 1", "weightvectorbias\t1.0", "a\t0.500000"]


def test_linear_classifier_separates(spark):
    data = [(f"s{k}", k % 2, {"a": float(k % 2), "b": 1.0, f"n{k % 7}": 1.0}) for k in range(60)]
    df = spark.createDataFrame(data, "sha256 string, label int, features map<string,double>")
    weights, bias = features.train_linear(df, iterations=12)
    got = features.decision_scores(weights, bias, df).join(df.select(F.col("sha256").alias("id"), "label"), "id")
    assert got.where("predicted <> label").count() == 0


def test_requests_are_packed(spark):
    df = spark.range(25).select("id", F.lit(10).alias("size"))
    by_rows = features.packed_requests(df, "size", ["id"], 10, 10**9).groupBy("file_no").count()
    assert rows(by_rows) == [(0, 10), (1, 10), (2, 5)]
    assert features.packed_requests(df, "size", ["id"], 10**6, 50).groupBy("file_no").count().agg(F.max("count")).first()[0] == 5


def test_review_loop(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    pages = spark.createDataFrame([(k, "g" if k < 6 else None) for k in range(8)], "id long, group string")
    edges = spark.createDataFrame([(a, b, 0.1) for a in range(6) for b in range(6) if a != b], "query_id long, cand_id long, distance double")
    done = cleaning.review(pages, edges, lambda _: "r", "group")
    assert rows(done.groupBy("keep").count()) == [(False, 6), (None, 2)]
    assert cleaning.review(pages, edges, lambda _: "x", "group").where("keep is not null").count() == 0


def files(spark, records):
    out = [(f, feed, t, k, json.dumps(p) if isinstance(p, dict) else p) for f, feed, t, ps in records for k, p in enumerate(ps)]
    df = spark.createDataFrame(out, "file_id long, feed string, file_time string, line_no long, payload string")
    return df.withColumn("file_time", F.to_timestamp("file_time")).withColumn("loaded_at", F.col("file_time")).withColumn("file_name", F.lit("x"))


def test_schema_changes(spark):
    h = lambda k: f"<html><body>page {k}</body></html>"
    recs = [
        (1, "a", "2025-01-01", [{"html": h(k), "status": k + 200, "lang": "en", "ip": None} for k in range(5)]),
        (2, "a", "2025-01-02", [{"content": h(k), "status": str(k + 200), "lang": "en", "ip": "1.2.3.4"} for k in range(5)] + ["{broken"]),
        (3, "a", "2025-01-03", [{"content": h(k), "html": h(k), "status": str(k + 200), "ip": "1.2.3.4"} for k in range(5)] + [None, "[1]"]),
        (9, "b", "2025-01-01", [{"x": 1}]),
    ]
    df = files(spark, recs)
    df = df.unionByName(df.where("file_id = 2"))
    want = [(2, "renamed", "html", "content"), (2, "retyped", "status", "status"), (3, "added", "", "html"), (3, "removed", "lang", "")]
    assert rows(schema_drift.changes(df)) == want
    table = schema_drift.consistent_table(df)
    assert table.count() == 16 and table.where("html is not null").count() == 15 and dict(table.dtypes)["status"] == "bigint"
    assert schema_drift.changes(df.limit(0)).count() == 0 and schema_drift.consistent_table(df.limit(0)).count() == 0
    assert schema_drift.lifespans(schema_drift.catalogue(schema_drift.field_values(df), df)).where("feed = 'a' and name = 'html'").count() == 2


def test_threshold_sweep_compares_texts(spark):
    rng = random.Random(3)
    said = {k: "".join(rng.choice("abc") for _ in range(rng.randrange(30))) for k in range(12)}
    edges = [(a, b, rng.randrange(10) / 10) for a in said for b in said if a != b]
    texts = spark.createDataFrame(list(said.items()), "id long, text string")
    got = {r["threshold"]: (r["n"], r["median"]) for r in vectors.threshold_sweep(spark.createDataFrame(edges, "query_id long, cand_id long, distance double"), [0.2, 0.5, 0.9], 20, texts).collect()}
    for t in (0.2, 0.5, 0.9):
        top = sorted((e for e in edges if e[2] <= t), key=lambda e: (-e[2], e[0], e[1]))[:20]
        assert got[t] == (len(top), pytest.approx(np.median([indel_similarity(said[a], said[b]) for a, b, _ in top]), abs=1e-6))


def test_pages_in_long_pieces_stay_whole(spark):
    pieces = lambda k: [f"<p>{k} {'x' * 300}</p>", f"<p>second of {k}</p>", "<p>third</p>"]
    df = files(spark, [(1, "a", "2025-01-01", [{"html": pieces(k), "codes": [k, k + 1]} for k in range(4)] + [{"html": ["<p>one</p>"], "codes": [7]}])])
    got = {r["line_no"]: (r["html"], r["codes"]) for r in schema_drift.consistent_table(df).collect()}
    assert sorted(got.values()) == sorted([("".join(pieces(k)), [str(k), str(k + 1)]) for k in range(4)] + [("<p>one</p>", ["7"])])


def test_whole_values_decide_types_and_kinds(spark):
    note, pad = "2025-01-01 10:00 and then more", "7" * 250
    recs = [(1, "a", "2025-01-01", [{"code": pad + "x", "at": note, "size": " " * 250 + "big"} for _ in range(3)])]
    table = schema_drift.consistent_table(files(spark, recs))
    assert {(r["code"], r["at"], r["size"].strip()) for r in table.collect()} == {(pad + "x", note, "big")}

    first, later = "a" * 120, ["b" * 120, "c" * 120]
    small = lambda k: " ".join(["word"] * 60)
    mixed = lambda k: small(k) + " 12 END; " + small(k)
    recs = [
        (1, "a", "2025-01-01", [{"x": mixed(k), "y": [first, *later, "http://h.test/1", "http://h.test/2", "http://h.test/3"]} for k in range(4)]),
        (2, "a", "2025-01-02", [{"u": small(k), "v": [first, *later, "1", "2", "3"]} for k in range(4)]),
        (3, "a", "2025-01-03", [{"w": mixed(k), "z": ",".join(["one", "two"] * 8000)} for k in range(4)]),
        (4, "a", "2025-01-04", [{"w": "Word " * 20_000 + "End", "z": {f"k{n}": n for n in range(3000)}} for k in range(4)]),
    ]
    values = schema_drift.field_values(files(spark, recs))
    kinds = {(r["file_id"], r["name"]): r["kinds"] for r in values.collect()}
    noted = schema_drift.field_values(files(spark, [(1, "a", "2025-01-01", [{"at": note, "from": "http://h.test/ as seen"}])])).collect()
    assert all(r["kinds"][0].startswith("shape:") for r in noted)
    assert kinds[1, "x"] == kinds[3, "w"] != kinds[2, "u"] == ["lower phrase"]
    assert kinds[1, "y"][3:] == ["url"] * 3 and kinds[2, "v"][3:] == ["number:1", "number:2", "number:3"]
    assert len(kinds[3, "z"]) == 16_000 and kinds[4, "w"] == ["title phrase"] and kinds[4, "z"] == ["number:0"]


def test_readers_and_sinks(spark, tmp_path):
    folder = tmp_path / "phishing"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"sha256": "1", "url": "HTTP://A/", "html_content": "<title>T</title>", "date": "2025-01-02T03:04:05"}))
    (folder / "b.json").write_text("{broken")
    pages, errors = readers.page_json(spark, str(tmp_path))
    got = pages.first()
    assert (got["url"], got["title"], got["label"], str(got["date"])) == ("http://a", "t", "phish", "2025-01-02") and errors.count() == 1
    sinks.write_pages(pages.withColumn("split", F.lit("train")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("split = 'train'").count() == 1
    assert readers.filter_table(spark, str(tmp_path / "none")).count() == 0
    sinks.append_json(pages.select("url"), str(tmp_path / "j"))
    sinks.append_json(pages.select("url"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_arrow_files_and_replayed_feed(spark, tmp_path):
    import pyarrow as pa

    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as sink, pa.ipc.new_file(sink, pa.schema([("sha256", pa.string()), ("label", pa.int64())])) as w:
        w.write_batch(pa.record_batch([["a", "b"], [-1, 0]], names=["sha256", "label"]))
    spark.dataSource.register(readers.ArrowFileSource)
    got = spark.read.format("arrow_file").schema("sha256 string, label bigint").option("path", str(tmp_path / "*.arrow")).load()
    assert rows(got) == [("a", -1), ("b", 0)]
    (tmp_path / "feed.json").write_text(json.dumps([{"phish_id": k, "url": f"u{k}"} for k in (3, 1, 2)]))
    spark.dataSource.register(feeds.ReplaySource)
    seen = []
    stream = spark.readStream.format("feed_replay").option("path", str(tmp_path / "feed.json")).option("batch", "10").load()
    q = stream.writeStream.foreachBatch(lambda df, _: seen.extend(r["phish_id"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [1, 2, 3]


def test_feeds_and_quotas(spark):
    page = json.dumps({"per_page": 2, "data": [{"id": 5, "url": "u", "brand": "b", "updatedAt": 0}, {"id": 4, "url": "v"}]})
    got = feeds.report_feed(spark.createDataFrame([(page,)], "value string"), "r", 4).collect()
    assert [(r["source_id"], r["submission_time"]) for r in got] == [("5", "1970-01-01 00:00:00")]
    assert quota.next_ids(5, 3) == [8, 7, 6]
    req = spark.range(5).select("id", F.lit("d").alias("day"))
    assert [r["api_key"] for r in quota.assign_quota(req, ["k1", "k2"], 2, "id").orderBy("id").collect()] == ["k1", "k1", "k2", "k2", None]
    assert quota.assign_quota(req, [], 2, "id").where("api_key is null").count() == 5
    lim = quota.simulate_limits(spark.range(5).select("id", F.lit("g").alias("g"), F.lit(60).alias("t")), "g", "id", "t", 200, 100)
    assert [r["start_s"] for r in lim.orderBy("id").collect()] == [0, 0, 61, 61, 122]
    assert feeds.read_pages([{"data": [{"id": 9}, {"id": 8}]}, {"data": [{"id": 7}, {"id": 1}]}, {"data": [{"id": 6}]}], 2, 5) == [{"id": 9}, {"id": 8}, {"id": 7}]
    calls = iter([[1, 2], [3], []])
    assert quota.quota_loop(lambda n: next(calls), lambda x: x != 2, 5) == 2


def test_jobs(spark, tmp_path):
    from pagelode.jobs import cli

    pages = spark.createDataFrame([("a", "http://x.test/john-smith", "<p>red fox runs far</p>", "Welcome", "phish"), ("b", "http://x.test/john-smith", "<p>red fox runs far</p>", "404", "phish")], "sha256 string, url string, html string, title string, label string").withColumn("split", F.lit("train"))
    pages.write.parquet(str(tmp_path / "in"))
    for argv in (["clean", "--input", str(tmp_path / "in"), "--order", "sha256", "--output", str(tmp_path / "clean")], ["names", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "names")]):
        args = cli.parser().parse_args(argv)
        args.run(spark, args)
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 1 and spark.read.json(str(tmp_path / "names")).count() == 2
    near = cli.leakage(pages, pages.where("sha256 = 'a'").withColumn("sha256", F.lit("t")))
    assert [r["query_id"] for r in near.collect()] == ["t"]


def test_sparse_neighbours_against_brute_force(spark):
    import math
    import random

    from pagelode.operators import leakage

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(60)] for _ in range(40)]
    pages = []
    for k in range(160):
        w = list(base[k % 40])
        for _ in range(rng.randint(0, 8) if k >= 40 else 0):
            w[rng.randrange(60)] = word()
        pages.append((k, " ".join(w)))
    pages += [(900, None), (901, ""), (None, "x y")]
    df = spark.createDataFrame(pages, "id long, html string").withColumn("term", F.lit("clash"))
    train, test = df.where("id < 80 or id >= 900 or id is null"), df.where("id >= 80 and id < 900")
    found = {(r["query_id"], r["cand_id"]): r["distance"] for r in leakage.sparse_neighbours(test, train, "id", "html", vectors.word_terms, 16, 2, 6, 0.2).collect()}

    weights = {r["id"]: {} for r in df.where("id is not null").collect()}
    model = vectors.fit_idf(train.where("id is not null"), "id", vectors.word_terms(F.col("html")))
    for r in vectors.tfidf(df.where("id is not null"), "id", vectors.word_terms(F.col("html")), model).collect():
        weights[r["id"]][r["term"]] = r["weight"]
    exact = {(q, c): 1 - math.fsum(w * weights[c].get(t, 0.0) for t, w in weights[q].items()) for q in range(80, 160) for c in range(80)}
    near = {p for p, d in exact.items() if d < 0.2}
    assert len(near) > 30 and len(near & set(found)) >= 0.9 * len(near), (len(near), len(near & set(found)))
    assert all(abs(found[p] - exact[p]) < 1e-5 for p in found if p in exact) and not {900, 901} & {p[1] for p in found}


def test_planes_are_normal_and_dimensions_keep_their_entries(spark):
    p = vectors.random_planes(400, 32)
    assert abs(p.mean()) < 0.03 and abs(p.std() - 1) < 0.03 and (vectors.random_planes(10, 32) == p[:10]).all()
    df = spark.createDataFrame([(1, [1.0, -2.0, 3.0]), (2, [1.0, -2.0, 3.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0])], "id long, v array<double>")
    bins = {r["id"]: r["bin"] for r in vectors.dense_bins(df, "id", "v", 8).collect()}
    assert bins[1] == bins[2] and bins[3] == bins[4] == bins[5] == 255
    drawn = vectors.hashed_normals(np.arange(20_000, dtype=np.int64), 5)
    assert drawn.shape == (20_000, 5) and (abs(drawn.mean(axis=0)) < 0.03).all() and (abs(drawn.std(axis=0) - 1) < 0.03).all()
    assert (abs(np.corrcoef(drawn.T) - np.eye(5)) < 0.03).all()


def test_most_frequent_sorts_only_the_last_count(spark):
    df = spark.createDataFrame([(t, c) for t, c in zip("abcdefg", [5, 3, 3, 3, 1, 1, 9])], "term string, cf long")
    assert sorted(r["term"] for r in vectors.most_frequent(df, 4).collect()) == ["a", "b", "c", "g"]
    assert vectors.most_frequent(df, 100).count() == 7 and vectors.most_frequent(df, 0).count() == 0


def test_dictionary_of_counted_features_is_cut_by_rows_not_by_counts(spark):
    df = spark.createDataFrame([(f"f{k}", n) for k in range(6) for n in (20 - k, 5)], "feature string, n long")
    got = features.feature_dictionary(df, max_features=4, count_col="n")
    assert rows(got) == [(f"f{k}", 25 - k, k) for k in range(4)]
    each = df.select("feature", F.explode(F.sequence(F.lit(1), "n")))
    assert rows(features.feature_dictionary(each, max_features=30)) == [(f"f{k}", 25 - k, k) for k in range(6)]


def test_indel_edges_meet_by_rare_grams_and_lose_no_pair(spark):
    rng = random.Random(9)
    made = lambda n: "".join(rng.choice("abcdefghijklmnop0123456789") for _ in range(n))
    texts = []
    for k in range(60):
        t = f"https://www.some-common-host.example/{rng.choice(['account', 'session', 'catalog'])}/{made(rng.choice([3, 9, 30]))}/index.html?\U0001f600={k % 3}"
        texts.append(t)
        for _ in range(3):
            u = list(t)
            for _ in range(rng.randint(0, 7)):
                i = rng.randrange(len(u))
                u[i : i + 1] = rng.choice([[], [rng.choice("xyz")], [u[i], "q"]])
            texts.append("".join(u))
    texts += ["", "", "a", "ab", "abcd", "abcde", "x" * 40, "x" * 41, "x" * 39]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9999, None)], "id int, t string").withColumn("r", F.col("id"))
    for ratio in (0.95, 0.9, 0.55):
        got = {(r[0], r[1]): r[2] for r in vectors.indel_edges(df, "id", "t", "r", ratio).collect()}
        every = {(i, j): round(indel_similarity(texts[i], texts[j]), 6) for i in range(len(texts)) for j in range(i + 1, len(texts))}
        assert got == {p: s for p, s in every.items() if s >= ratio}


def test_rare_grams_outlast_the_edits():
    held = np.zeros(1 << vectors.GRAM_BITS, np.int32)
    for g in vectors.gram_numbers("https://www.", 4):
        held[int(g) >> 64 - vectors.GRAM_BITS] = 1000
    # Of texts that all begin alike, none meets by its beginning.
    _, at = vectors.rare_grams("https://www.k3ksdukje-wvu38v-halrafy-r29k.test/", 4, 5, held)
    assert at.min() >= 9 and len(set(at.tolist())) == len(at)
    assert vectors.rare_grams("abcdefgh", 4, 2, held) is None and vectors.rare_grams("abc", 4, 0, held) is None


def test_sparse_neighbours_are_all_that_are_within(spark, monkeypatch):
    from pagelode.operators import leakage

    monkeypatch.setattr(leakage, "BLOCK_TERMS", 4000)
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    base = [rng.choices(pool, [1 / (k + 1) for k in range(300)], k=40) for _ in range(30)]
    docs = []
    for k in range(150):
        w = list(base[k % 30])
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(40)] = rng.choice(pool)
        docs.append((k, " ".join(w)))
    train = spark.createDataFrame(docs[:90] + [(500, None), (501, "")], "id long, t string")
    test = spark.createDataFrame(docs[80:] + [(502, "unknownword"), (503, None)], "id long, t string")
    terms = lambda c: vectors.word_terms(c, 2)
    model = vectors.fit_idf(train, "id", terms(F.col("t")))
    weights = []
    for side in (train, test):
        held: dict = {}
        for r in vectors.tfidf(side, "id", terms(F.col("t")), model).collect():
            held.setdefault(r["id"], {})[r["term"]] = r["weight"]
        weights.append(held)
    exact = {(q, c): 1 - sum(w * y.get(t, 0.0) for t, w in x.items()) for q, x in weights[1].items() for c, y in weights[0].items() if q != c}
    for within in (0.1, 0.3, 2.0):
        found = {(r["query_id"], r["cand_id"]): r["distance"] for r in leakage.sparse_neighbours(test, train, "id", "t", terms, 8, 2, 6, within).collect()}
        assert set(found) == {p for p, d in exact.items() if round(d, 6) <= within} and all(abs(exact[p] - d) < 2e-6 for p, d in found.items())
