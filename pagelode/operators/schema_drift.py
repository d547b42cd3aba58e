"""Schemas that drift between files (problem 7).

Column lifespan catalogue. Every file leaves one catalogue row per field and JSON type (its "footer"). Per producer,
field and type, `lag` over the file order cuts the rows into islands; where an island starts or ends, a field came or
went, and changes of type are starts with the name already there. A field that went and one that came with the same
file are a rename if the contents they have over their lifespans are alike. Renames make an alias table, from which
the casts of the one consistent table are generated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.session import stored

#: Least overlap of two content profiles for a rename.
SAME_CONTENT = 0.4
#: Names the page itself is known to go by, whatever the files show.
PAGE_NAMES = ("html", "html_content", "content")
#: Longest drawn shape that is a kind of its own; of longer ones the marks in them are.
SHAPE = 12
#: Text that lists words or numbers. Groups are possessive here and below: they repeat without recursion on long texts.
LISTED = r'^[\p{L}\d"]++(?:"?\s*+,\s*+"?[\p{L}\d]++)++"?$'


def readable(files: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows whose payload is a JSON object, as VARIANT `v`; lines loaded twice count once (the latest load)."""
    rows = files.withColumn("v", F.try_parse_json(F.col(payload))).where(F.col("v").isNotNull())
    return rows.where(F.schema_of_variant("v").startswith("OBJECT"))


def _kind_of(text: Column) -> Column:
    """What sort of content a scalar is, by all of it; short words and small numbers stand for themselves."""
    t = F.trim(text)
    drawn = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), r"\d+", "9")
    marks = F.array_join(F.array_sort(F.array_distinct(F.split(drawn, ""))), "")
    return (
        F.when(t == "", F.lit("empty"))
        .when(t.rlike(r"^<[!A-Za-z]"), "markup")
        .when(t.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://|www\.)\S*$"), "url")
        .when(t.rlike(r"^[0-9a-fA-F]{32,128}$"), "digest")
        .when(t.rlike(r"^[^\s@]+@[^\s@]+$"), "mail")
        .when(t.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(t.rlike(r"^\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d[\d:.,]*\s*(?:Z|UTC|GMT|[+-]\d\d:?\d\d)?)?$") | t.rlike(r"^1\d{9}(\d{3})?$"), "time")
        .when(t.rlike(r"(?i)^(true|false)$"), F.concat(F.lit("is:"), F.lower(t)))
        .when(t.rlike(r"^[+-]?\d{1,3}$"), F.concat(F.lit("number:"), t))
        .when(t.rlike(r"^[+-]?\d+$"), F.concat(F.lit("digits:"), F.length(t).cast("string")))
        .when(t.rlike(r"^[+-]?\d*\.\d+([eE][+-]?\d+)?$"), F.lit("decimal"))
        .when(t.rlike(r"^[A-Za-z]{1,4}\d+$"), F.concat(F.lit("code:"), F.regexp_replace(t, r"\d+", ""), F.length(t).cast("string")))
        .when(t.rlike(r"^\p{L}{1,20}$"), F.concat(F.lit("word:"), t))
        .when(t.rlike(r"^\p{Lu}[\p{L}'\-]*+(?:\s++\p{Lu}[\p{L}'\-]*+)++$"), "title phrase")
        .when(t.rlike(r"^[\p{Ll}'\-]++(?:\s++[\p{Ll}'\-]++)++$"), "lower phrase")
        .otherwise(F.concat(F.lit("shape:"), F.when(F.length(drawn) <= SHAPE, drawn).otherwise(marks)))
    )


def _unwrapped(text: Column) -> Column:
    """The value of a text: of a list the first item, of an object the longest value, else the text itself."""
    longest = lambda m: F.array_max(F.transform(F.map_values(m), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return F.when(text.rlike(r"^\s*\["), F.coalesce(F.get(F.from_json(text, "array<string>"), 0), text)).when(text.rlike(r"^\s*\{"), F.coalesce(longest(F.from_json(text, "map<string,string>")), text)).otherwise(text)


def _facts(text: Column) -> Column:
    """Which types the value of a text fits as a whole, and how it begins; types are those that `consistent_table` casts to."""
    t = F.trim(_unwrapped(text))
    time = t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d") & t.try_cast("timestamp").isNotNull() | t.rlike(r"^1\d{9}$")
    tests = {
        "filled": t != "",
        "int": t.rlike(r"^[+-]?\d{1,18}$"),
        "num": t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
        "bool": t.rlike(r"(?i)^(true|false)$"),
        "time": time,
        "iso": t.rlike(r"^\d{4}-"),
        "markup": t.startswith("<"),
    }
    return F.struct(*(c.alias(n) for n, c in tests.items()))


def field_values(files: DataFrame) -> DataFrame:
    """`(feed, file_id, line_no, name, type, kinds, facts, many)`: one row per field of each readable record.

    All are read from the whole value, which itself is not kept: `kinds` are the kinds of content of its items, `facts`
    the types it fits, `many` tells whether it is a list of several.
    """
    rows = readable(files.select("feed", "file_id", "line_no", "payload")).select("feed", "file_id", "line_no", "v")
    out = rows.sparkSession.sql("select feed, file_id, line_no, key as name, schema_of_variant(value) as s, value from {rows}, lateral variant_explode(v) as t(pos, key, value)", rows=rows)
    kind = (
        F.when(F.col("s").startswith("OBJECT"), "object")
        .when(F.col("s").startswith("ARRAY"), "array")
        .when(F.col("s") == "STRING", "string")
        .when(F.col("s") == "BOOLEAN", "boolean")
        .when(F.col("s") != "VOID", "number")
    )
    text = F.expr("try_variant_get(value, '$', 'string')")
    # An object stands for its first text, else for its first value; a list for its items.
    listed = F.expr("transform(try_variant_get(value, '$', 'array<variant>'), x -> try_variant_get(x, '$', 'string'))")
    held = "map_values(try_variant_get(value, '$', 'map<string,variant>'))"
    first = F.expr(f"try_variant_get(coalesce(get(filter({held}, x -> schema_of_variant(x) = 'STRING'), 0), get({held}, 0)), '$', 'string')")
    items = F.when(kind == "array", F.filter(listed, F.isnotnull)).when(kind == "object", F.array(first)).otherwise(F.split(text, r'"?\s*,\s*"?'))
    several = kind.isin("array", "object") | text.rlike(LISTED)
    whole = F.transform(F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(""))), lambda x: _kind_of(F.coalesce(x, F.lit(""))))
    kinds = F.when(several, whole).when(text.isNotNull(), F.array(_kind_of(text)))
    many = F.when(kind == "array", F.expr("size(try_variant_get(value, '$', 'array<variant>'))") > 1).otherwise(F.lit(False))
    return out.select("feed", "file_id", "line_no", "name", kind.alias("type"), kinds.alias("kinds"), _facts(text).alias("facts"), many.alias("many"))


def catalogue(values: DataFrame, files: DataFrame) -> DataFrame:
    """`(feed, file_no, file_id, name, type)`: the fields of each file and the type most non-null values have.

    Files are numbered from 1 per feed by `file_time` (ties by id), unreadable ones too. The type is null where all
    values are null; of types that are equally frequent the first in the alphabet is taken.
    """
    per_file = files.groupBy("feed", "file_id").agg(F.min("file_time").alias("file_time"))
    order = Window.partitionBy("feed").orderBy(F.col("file_time").asc_nulls_first(), "file_id")
    numbered = per_file.withColumn("file_no", F.row_number().over(order)).select("feed", "file_id", "file_no")
    seen = values.groupBy("feed", "file_id", "name", "type").agg(F.countDistinct("line_no").alias("n"))
    typed = seen.groupBy("feed", "file_id", "name").agg(F.min_by("type", F.when(F.col("type").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("type").alias("t")))).alias("type"))
    return typed.join(numbered, ["feed", "file_id"])


def lifespans(cat: DataFrame) -> DataFrame:
    """Islands of consecutive files per feed, field and type: `(feed, name, type, first_no, last_no, first_file, last_file, n_files)`."""
    w = Window.partitionBy("feed", "name", "type").orderBy("file_no")
    marked = cat.withColumn("new", (F.col("file_no") - F.coalesce(F.lag("file_no").over(w), F.lit(-1)) != 1).cast("int"))
    marked = marked.withColumn("island", F.sum("new").over(w))
    out = marked.groupBy("feed", "name", "type", "island").agg(F.min("file_no").alias("first_no"), F.max("file_no").alias("last_no"), F.min_by("file_id", "file_no").alias("first_file"), F.max_by("file_id", "file_no").alias("last_file"), F.count(F.lit(1)).alias("n_files"))
    return out.drop("island")


def _profiles(values: DataFrame) -> DataFrame:
    """`(feed, name, kind, share)`: how the values of a field spread over kinds of content, over its lifespan."""
    items = values.where("kinds is not null").select("feed", "name", F.explode("kinds").alias("kind"))
    counted = items.groupBy("feed", "name", "kind").agg(F.count(F.lit(1)).alias("n"))
    whole = counted.groupBy("feed", "name").agg(F.sum("n").alias("total"))
    return counted.join(whole, ["feed", "name"]).select("feed", "name", "kind", (F.col("n") / F.col("total")).alias("share"))


def changes(files: DataFrame, values: DataFrame | None = None, threshold: float = SAME_CONTENT) -> DataFrame:
    """`(file_id, change_kind, old_name, new_name)` for each file against the one before it in its feed.

    Null values and nulls instead of fields make no type; lines that are no JSON object count as unread; repeated
    lines change nothing; one file or none in a feed gives no row. Of several possible renames the pairs with the
    most similar contents are taken, ties by name, and each field takes part in one only.
    """
    if values is None:
        values = stored(field_values(files).drop("facts", "many"), "field-values")
    cat = stored(catalogue(values, files), "catalogue")
    last = files.groupBy("feed").agg(F.countDistinct("file_id").alias("last"))
    spans = Window.partitionBy("feed", "name").orderBy("file_no")
    marked = cat.withColumn("before", F.lag("file_no").over(spans)).withColumn("after", F.lead("file_no").over(spans)).withColumn("type_before", F.lag("type").over(spans))
    marked = marked.join(last, "feed")
    came = marked.where("file_no > 1 and (before is null or before < file_no - 1)").select("feed", "file_no", F.col("name").alias("new_name"))
    went = marked.where("file_no < last and (after is null or after > file_no + 1)").select("feed", (F.col("file_no") + 1).alias("file_no"), F.col("name").alias("old_name"))
    retyped = marked.where("before = file_no - 1 and type is not null and type_before is not null and type <> type_before")
    retyped = retyped.select("feed", "file_no", F.lit("retyped").alias("change_kind"), F.col("name").alias("old_name"), F.col("name").alias("new_name"))
    profile = _profiles(values)
    pairs = went.join(came, ["feed", "file_no"])
    a = profile.select("feed", F.col("name").alias("old_name"), "kind", F.col("share").alias("x"))
    b = profile.select("feed", F.col("name").alias("new_name"), "kind", F.col("share").alias("y"))
    # Profiles of possible pairs only, one score per pair of names of a feed however many files it concerns.
    named = pairs.select("feed", "old_name", "new_name").distinct()
    scores = named.join(a, ["feed", "old_name"]).join(b, ["feed", "new_name", "kind"]).groupBy("feed", "old_name", "new_name").agg(F.sum(F.least("x", "y")).alias("score")).where(F.col("score") >= threshold)
    scored = pairs.join(scores, ["feed", "old_name", "new_name"])
    ranked = scored.groupBy("feed", "file_no").agg(F.sort_array(F.collect_list(F.struct((-F.round("score", 9)).alias("s"), "old_name", "new_name"))).alias("all"))
    none = F.expr("cast(array() as array<struct<old_name: string, new_name: string>>)")
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["old_name"] == x["old_name"]) | (y["new_name"] == x["new_name"]))
    taken = F.aggregate("all", none, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(F.struct(x["old_name"].alias("old_name"), x["new_name"].alias("new_name"))))).otherwise(acc))
    renamed = ranked.select("feed", "file_no", F.explode(taken).alias("p")).select("feed", "file_no", F.lit("renamed").alias("change_kind"), "p.old_name", "p.new_name")
    added = came.join(renamed, ["feed", "file_no", "new_name"], "left_anti").select("feed", "file_no", F.lit("added").alias("change_kind"), F.lit("").alias("old_name"), "new_name")
    removed = went.join(renamed, ["feed", "file_no", "old_name"], "left_anti").select("feed", "file_no", F.lit("removed").alias("change_kind"), "old_name", F.lit("").alias("new_name"))
    per_file = files.groupBy("feed", "file_id").agg(F.min("file_time").alias("file_time"))
    order = Window.partitionBy("feed").orderBy(F.col("file_time").asc_nulls_first(), "file_id")
    ids = per_file.select("feed", "file_id", F.row_number().over(order).alias("file_no"))
    found = renamed.unionByName(added).unionByName(removed).unionByName(retyped)
    return found.join(ids, ["feed", "file_no"]).select("file_id", "change_kind", "old_name", "new_name")


def alias_table(found: DataFrame, values: DataFrame) -> dict[str, list[str]]:
    """Canonical name -> all names of a field, most frequent first, from the renames that were found.

    Only field names come to the driver, never values. A rename counts if it was seen more than once or runs between
    names no other rename links; names that differ in case alone are one field.
    """
    counts = {r["name"]: r["n"] for r in values.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    links = found.where("change_kind = 'renamed'").groupBy("old_name", "new_name").agg(F.count(F.lit(1)).alias("n")).collect()
    weight: dict[tuple[str, str], int] = {}
    for r in links:
        k = tuple(sorted((r["old_name"], r["new_name"])))
        weight[k] = weight.get(k, 0) + r["n"]
    alike: dict[str, list[str]] = {}
    for n in sorted(counts):
        alike.setdefault("the page" if n in PAGE_NAMES else f"name {n.lower()}", []).append(n)
        if n.lower() in PAGE_NAMES and n not in PAGE_NAMES:
            alike.setdefault("the page", []).append(n)
    for group in alike.values():
        for a, b in zip(sorted(group), sorted(group)[1:]):
            weight[a, b] = weight.get((a, b), 0) + 1_000_000
    parent = {n: n for n in counts}

    def root(n: str) -> str:
        while parent[n] != n:
            n = parent[n]
        return n

    best: dict[str, int] = {}
    for (a, b), n in weight.items():
        best[a], best[b] = max(best.get(a, 0), n), max(best.get(b, 0), n)
    for (a, b), n in sorted(weight.items(), key=lambda x: (-x[1], x[0])):
        if a in parent and b in parent and (n > 1 or best[a] == n or best[b] == n) and root(a) != root(b):
            parent[root(b)] = root(a)
    groups: dict[str, list[str]] = {}
    for n in counts:
        groups.setdefault(root(n), []).append(n)
    ordered = (sorted(g, key=lambda n: (n not in PAGE_NAMES[:1], -counts[n], n)) for g in groups.values())
    return {g[0]: g for g in sorted(ordered)}


def consistent_table(files: DataFrame, values: DataFrame | None = None, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """All readable records in one table: `(file_id, feed, file_time, line_no, <canonical fields>)`.

    Each canonical field takes the first non-null value of its names. Its type is the narrowest that all its values
    fit: BIGINT, DOUBLE, BOOLEAN, TIMESTAMP (ISO text or epoch seconds), ARRAY<STRING> where several values occur (pieces of markup are joined),
    else STRING; a list of one value stands for that value, an object for its longest one. A record loaded twice comes once, as loaded
    last. Field names that clash with the file columns get the prefix `field_`. No readable line gives no row.
    """
    if values is None:
        values = stored(field_values(files), "field-values")
    if aliases is None:
        aliases = alias_table(changes(files, values), values)
    fits = [F.count_if(~F.col(f"facts.{n}")).alias(n) for n in ("int", "num", "bool", "time")]
    seen = [F.count_if(f"facts.{n}").alias(n) for n in ("iso", "markup")]
    facts = {r["name"]: r for r in values.where("many or facts.filled").groupBy("name").agg(*fits, *seen, F.count_if("many").alias("many")).collect()}
    best = Window.partitionBy("file_id", "line_no").orderBy(F.col("loaded_at").desc_nulls_last(), F.length("payload").desc())
    rows = readable(files).withColumn("rn", F.row_number().over(best)).where("rn = 1")
    fixed = ["file_id", "feed", "file_time", "line_no"]
    out = []
    for canonical, names in aliases.items():
        known = [facts[n] for n in names if n in facts]
        total = lambda k: sum(f[k] for f in known)  # noqa: E731, B023
        quoted = [F.lit("$['" + n.replace("\\", "\\\\").replace("'", "\\'") + "']") for n in names]
        raw = [F.call_function("try_variant_get", F.col("v"), q, F.lit("string")) for q in quoted]
        text = F.coalesce(*raw)
        unwrapped = _unwrapped(text)
        if known and total("many") and total("markup"):  # a page that came in pieces
            value = F.when(text.rlike(r"^\s*\["), F.array_join(F.from_json(text, "array<string>"), "")).otherwise(unwrapped)
        elif known and total("many"):
            value = F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>")).otherwise(F.split(text, r"\s*,\s*"))
        elif known and not total("bool"):
            value = F.lower(F.trim(unwrapped)).try_cast("boolean")
        elif known and total("iso") and not total("time"):
            value = F.coalesce(F.to_timestamp(F.timestamp_seconds(unwrapped.try_cast("bigint"))), unwrapped.try_cast("timestamp"))
        elif known and not total("int"):
            value = F.trim(unwrapped).try_cast("bigint")
        elif known and not total("num"):
            value = F.trim(unwrapped).try_cast("double")
        else:
            value = unwrapped
        out.append(value.alias(f"field_{canonical}" if canonical in fixed else canonical))
    return rows.select(*fixed, *out)
