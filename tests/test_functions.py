import random

from pyspark.sql import functions as F

from conftest import rows
from pagelode.functions import html as hx
from pagelode.functions import html_features as hf
from pagelode.functions import prompts, text, urls


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "v string").select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def test_url_forms(spark):
    v = F.col("v")
    assert one(spark, "HTTP://A.com/x//", urls.normalize_url(v))[0] == "http://a.com/x"
    for u, want in [("http://u@h.com:80/p", "u@h.com"), ("h.com/p", "h.com"), ("http://a/x//b.c/d", "b.c")]:
        assert one(spark, u, urls.last_domain(v))[0] == want
    for u, want in [("https://WWW.A.example.:8080/x", "a.example"), ("a.example:80/x", "a.example"), ("u:p@b.test", "b.test"), ("", None), (None, None), ("//c.test/x", "c.test"), ("http://[::1]:80/", "[::1]")]:
        assert one(spark, u, urls.host_key(v))[0] == want, u
    same = ["http://A.test:80/x/?utm_source=a&b=1#f", "https://a.test/x?b=1&gclid=3", "a.test/x/?b=1"]
    assert len({one(spark, u, urls.address_key(v))[0] for u in same}) == 1
    assert one(spark, "https://a.test:80/x", urls.address_key(v))[0] == "a.test:80/x"
    assert one(spark, "https://a.test/X", urls.address_key(v))[0] != one(spark, "https://a.test/x", urls.address_key(v))[0]


def test_registered_domain_and_features(spark):
    v = F.col("v")
    for u, want in [("http://a.b.co.uk/x", "b.co.uk"), ("http://x.y.ck/", "x.y.ck"), ("http://www.ck/", "www.ck"), ("http://localhost/", "localhost"), ("http://a.b.example/", "example")]:
        assert one(spark, u, urls.registered_domain(v))[0] == want, u
    f = one(spark, "http://s.a.com/a;b/c;d?q#f", urls.url_features(v))[0]
    assert (f["path_len"], f["domain_len"], f["subdomain_len"]) == (len("/a;b/c"), len("a.com"), 1)
    assert one(spark, None, urls.url_features(v))[0] is None


def test_text_functions(spark):
    v = F.col("v")
    assert one(spark, "abcdef", text.char_ngrams("te")("v"))[0] == ["te_abcd", "te_bcde"]
    assert one(spark, "abcd", text.char_ngrams("te")("v"), text.char_ngrams("te", compat=False)("v"))[:] == ([], ["te_abcd"])
    assert one(spark, "/john-smith/x1-ab/mary_ann-LEE", text.pii_candidates(v))[0] == ["John Smith", "Mary Ann Lee"]
    for name, want in [("John Smith", True), ("john Smith", False), ("Best Shop", False), ("A B C D E", False)]:
        assert one(spark, name, text.is_probable_name(v))[0] is want
    assert one(spark, "x <answer>true</answer>.", text.answer_tag(v))[0] == "true"
    assert one(spark, "none", text.answer_tag(v))[0] == "ERROR"
    assert one(spark, "x <answer>open", text.answer_tag(v))[0] == "open"
    assert one(spark, "  a  \n b ", text.collapse_space(v))[0] == "a b"
    assert one(spark, "20241231", text.next_day(v))[0] == "20250101"
    bits = spark.sql("select array(1,0,1) as b, array(1,1,1) as z").select(text.bits_to_bin(F.col("b")), text.bits_to_bin(F.col("z"))).first()
    assert bits[:] == (5, 7)
    assert spark.range(1).select(text.base_rate_size(5, F.lit(1000))).first()[0] == 53


def test_bio_spans(spark):
    schema = "t array<struct<word: string, tag: string, score: double>>"
    cases = [
        ([("A", "B-PER", 0.9), ("B", "I-PER", 0.9), ("x", "O", 0.9), ("C", "B-PER", 0.9)], "A B"),
        ([("A", "B-PER", 0.9), ("B", "B-PER", 0.9), ("C", "I-PER", 0.9)], "B C"),
        ([("A", "B-PER", 0.9), ("B", "I-PER", 0.1)], "A"),
        ([("x", "O", 1.0)], None),
        ([], None),
    ]
    for tokens, want in cases:
        assert spark.createDataFrame([(tokens,)], schema).select(text.person_span(F.col("t"))).first()[0] == want


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_indel_against_brute_force_and_length_bound():
    rng = random.Random(3)
    assert text.indel_similarity("ab", "ba") == 0.5 and text.indel_similarity("", "") == 1.0
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in "xy")
        if a or b:
            s = text.indel_similarity(a, b)
            assert abs(s - 2 * brute_lcs(a, b) / (len(a) + len(b))) < 1e-12
            assert s < 0.8 or abs(len(a) - len(b)) <= (len(a) + len(b)) * 0.2 + 1e-9


PAGE = '<html><head><title> Hi &amp; <!-- x -->You </title><style>p{}</style></head><body><nav><a>Menu</a></nav><p>A<b>B</b> c</p><script>var x="<p>no</p>"</script><img src="i.png" data-k="v"><p>Z</body></html>'


def test_html_functions(spark):
    assert hx.visible_text(PAGE) == "Menu AB c Z"
    assert hx.visible_text(None) == hx.visible_text("  ") == ""
    assert hx.visible_text("plain &lt;text&gt;") == "plain <text>"
    assert hf.joined_text("no tags") == "" and hf.joined_text(PAGE).startswith("Hi &")
    assert hf.raw_text("<p>a</p> <p>b</p>") == "a b"
    head, img, script = hf.part_lengths(PAGE)
    assert img == len('<img src="i.png" data-k="v">') and script == len('<script>var x="<p>no</p>"</script>') and head > 60
    assert hf.part_lengths(None) is None and hf.part_lengths("") == (0, 0, 0)
    assert hf.xpaths("<html><body></body></html>") == ["/html", "/html/body"]
    assert hf.xpaths("<html><body><p></p></body></html>") == ["/html", "/html/body"]
    assert "/html/body/p[2]" in hf.xpaths("<html><body><p></p><p></p></body></html>", compat=False)
    feats = hf.channel_features(PAGE)
    assert any(f.startswith("is_i.pn") for f in feats) and any(f.startswith("ta_html") for f in feats)
    assert hf.channel_features(None) == ["body"] and hf.channel_features("") == ["body"]
    assert hf.channel_features("<p>ABCDE FG</p>")[0] == "te_abcd"
    assert hf.simplify(PAGE, 10_000, True) == (PAGE, "0-as-is")
    small, stage = hf.simplify("<p>" + "x" * 400 + "</p>" + "<p>y</p>" * 50, 40)
    assert stage == "3-decomposed-mid-tags" and len(small) // 4 <= 40
    titled = spark.createDataFrame([("<TITLE>\n A  b</title>",), ("x",), (None,)], "h string").select(hf.title_column(F.col("h"))).collect()
    assert [r[0] for r in titled] == ["a b", None, None]


def test_channel_counts_are_those_of_the_lists(spark, monkeypatch):
    from collections import Counter

    pages = [None, "", " ", "<p>a", PAGE, PAGE.replace("Menu", "\U0001f600 caf\u00e9 \u4e2d\u6587\u5b57\u5178"), "<p>x\x00yz w</p>" * 3, "<p>" + "ab cd " * 90 + "</p>"]
    for n, compat, chars, most in [(4, True, 500_000, 300_000), (4, False, 37, 20), (6, True, 37, 20)]:
        monkeypatch.setattr(hf, "HELD_CHARS", chars)
        monkeypatch.setattr(hf, "HELD_FEATURES", most)
        monkeypatch.setattr(hf, "BATCH_FEATURES", 7)
        want = Counter(f for p in pages for f in hf.channel_features(p, n, compat))
        count, got = _counting(hf, pages, n, compat), Counter()
        for batch in count:
            assert batch.num_rows <= 7
            for f, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got[f] += k
        assert got == want
    monkeypatch.undo()
    df = spark.createDataFrame([(p,) for p in pages], "h string")
    found = hf.channel_counts(df, "h").groupBy("feature").sum("n")
    assert {r[0]: r[1] for r in found.collect()} == Counter(f for p in pages for f in hf.channel_features(p))


def _counting(hf, pages, n, compat):
    """The batches of the function that `channel_counts` gives to Spark, here."""
    import pyarrow as pa

    class Pages:
        def select(self, _):
            return self

        def mapInArrow(self, function, _):
            return function(iter([pa.RecordBatch.from_arrays([pa.array(pages, pa.string())], names=["h"])]))

    return hf.channel_counts(Pages(), "h", n, compat)


def test_prompts(spark):
    reply = '{"custom_id":"a","response":{"body":{"usage":{"prompt_tokens":1000000,"completion_tokens":10},"choices":[{"message":{"content":"```json\\n{\\"score\\": 3}\\n```"}}]}}}'
    lines = spark.createDataFrame([(reply,), ("broken",)], "value string")
    tracker = spark.createDataFrame([("b", "u")], "custom_id string, url string")
    got = prompts.parse_replies(lines, tracker, ["score", "why"]).first()
    assert (got["score"], got["why"], got["url"]) == ("3", "N/A", None)
    assert prompts.usage_cost(prompts.parse_replies(lines, tracker, [])).first()["cost"] == 0.075003
    first = prompts.first_by(spark.createDataFrame([("s", "n", 2), ("s", "n", 1)], "s string, n string, o int"), ["s", "n"], "o")
    assert rows(first) == [("s", "n", 1)]
