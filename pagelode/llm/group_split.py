"""Splits that keep related records together (problem 5).

Frontier breadth-first components. Nodes are target and host keys, edges say that some row has both. Local hubs
are seeds; all seeds expand concurrently over adjacency lists that are hash-partitioned by node, hub nodes in
several salts. Where two seeds meet, their labels make an edge of a much smaller graph, whose components are found
by repeated hooking to the smallest neighbour and pointer jumping. Splits are given by component hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions.urls import host_key
from pagelode.operators.prefix import hash_running_sum
from pagelode.session import broadcast_if_small, stored

#: Values of `target` that name nothing, after normalisation.
NO_TARGET = ("", "unknown", "other", "n/a")
#: Rows of an adjacency list per salt.
SALT_ROWS = 20_000
#: Expansions from the seeds before nodes that are still unlabelled become seeds themselves.
EXPANSIONS = 4


def target_key(target: Column) -> Column:
    """Target without case, blanks and hyphens; null where it names none."""
    key = F.regexp_replace(F.lower(target), r"[\s \-‐-―]+", "")
    return F.when(~key.isin(*NO_TARGET), key)


def with_keys(pages: DataFrame, aliases: DataFrame | None, id_col: str = "crawl_id", target_col: str = "target", url_col: str = "url") -> DataFrame:
    """`(id, target_key, host_key)`: the two things that relate rows; either may be null."""
    rows = pages.select(F.col(id_col).alias("id"), target_key(F.col(target_col)).alias("t0"), host_key(F.col(url_col)).alias("host"))
    if aliases is None:
        return rows.select("id", F.col("t0").alias("target"), "host")
    known = aliases.select(target_key(F.col("alias")).alias("t0"), target_key(F.col("target")).alias("t1")).where("t0 is not null").groupBy("t0").agg(F.min("t1").alias("t1"))
    return rows.join(broadcast_if_small(known), "t0", "left").select("id", F.coalesce("t1", "t0").alias("target"), "host")


def _min_labels(pairs: DataFrame) -> DataFrame:
    """Components of a graph of labels `(a, b)`: `(node, root)` with the smallest label of each component.

    Every round hooks each root to the smallest root it touches and then jumps pointers, so that the number of
    distinct roots falls by a constant factor; rounds are cut by written tables.
    """
    edges = stored(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "label-edges")
    parents: list[DataFrame] = []
    while not edges.isEmpty():
        # Hook every node to its smallest neighbour below itself; a node without one stays a root.
        hook = edges.groupBy("a").agg(F.min("b").alias("p"))
        hook = stored(hook, "hook")
        jumps = hook
        while True:  # pointers go strictly down, so this ends after log2(depth) rounds
            up = jumps.select(F.col("a").alias("p"), F.col("p").alias("g"))
            nxt = stored(jumps.join(up, "p", "left").select("a", F.coalesce("g", "p").alias("p"), F.col("g").isNotNull().alias("moved")), "jump")
            moved = not nxt.where("moved").isEmpty()
            jumps = nxt.select("a", "p")
            if not moved:
                break
        parents.append(jumps)
        a = jumps.select("a", F.col("p").alias("pa"))
        b = jumps.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        lifted = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")).where("x <> y")
        edges = stored(lifted.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "label-edges")
    found: DataFrame | None = None
    for step in parents:
        moved = step.select(F.col("a").alias("node"), F.col("p").alias("root"))
        if found is None:
            found = moved
        else:
            nxt = moved.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            found = found.join(nxt, "root", "left").select("node", F.coalesce("higher", "root").alias("root")).unionByName(moved)
    if found is None:
        return pairs.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return stored(found, "label-roots")


def components(edges: DataFrame, expansions: int = EXPANSIONS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """`(node, label)` of every node in `edges (a, b)`; two nodes have one label iff a path joins them.

    Nodes may be of any orderable type. Self-loops and repeated edges change nothing; no edges give no rows.
    """
    both = edges.where("a is not null and b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = stored(both, "adjacency-raw")
    nodes = both.groupBy("src").agg(F.count(F.lit(1)).alias("degree")).withColumn("salts", F.ceil(F.col("degree") / F.lit(salt_rows)).cast("int"))
    nodes = stored(nodes, "nodes")
    # A salted adjacency list: the lists of hubs lie in `salts` parts, all others in one.
    hubs = nodes.where("salts > 1").select("src", "salts")
    adj = both.join(broadcast_if_small(hubs), "src", "left").select("src", "dst", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("dst"), F.col("salts"))).otherwise(F.lit(0)).cast("int").alias("salt"))
    rank = F.struct("degree", F.xxhash64("src").alias("h"), "src")
    ranked = nodes.select("src", rank.alias("rank"), "salts")

    def spread(front: DataFrame) -> DataFrame:
        return front.join(ranked.select("src", "salts"), "src").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def step(front: DataFrame, value: str, agg) -> DataFrame:
        sent = adj.join(spread(front).select("src", "salt", value), ["src", "salt"]).select("dst", value)
        return sent.groupBy(F.col("dst").alias("src")).agg(agg(value).alias(value))

    # Seeds: nodes of a higher rank than all their neighbours. A star has one, however many rows it has.
    above = step(ranked.select("src", "rank"), "rank", F.max).withColumnRenamed("rank", "best")
    labelled = stored(ranked.join(above, "src", "left").where("best is null or rank > best").select("src", F.col("src").alias("label")), "seeds")
    frontier, meets = labelled, []
    for _ in range(expansions):
        if frontier.isEmpty():
            break
        reached = step(frontier, "label", F.min)
        new = stored(reached.join(labelled.select("src"), "src", "left_anti"), "frontier")
        labelled = labelled.unionByName(new)
        frontier = new
    rest = ranked.join(labelled.select("src"), "src", "left_anti").select("src", F.col("src").alias("label"))
    labelled = stored(labelled.unionByName(rest), "labelled")
    # Colliding labels: both ends of an edge are known now; distinct label pairs make the small graph.
    # Each end sends its label to the edge, along the salted lists, so no hub meets all its edges in one task.
    ends = adj.join(spread(labelled).select("src", "salt", "label"), ["src", "salt"]).groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(F.min("label").alias("a"), F.max("label").alias("b"))
    pairs = ends.where("a <> b").select("a", "b").distinct()
    roots = _min_labels(pairs)
    return labelled.join(roots.withColumnRenamed("node", "label"), "label", "left").select(F.col("src").alias("node"), F.coalesce("root", "label").alias("label"))


def related_groups(pages: DataFrame, aliases: DataFrame | None = None, id_col: str = "crawl_id", target_col: str = "target", url_col: str = "url") -> DataFrame:
    """`(id_col, group_id)` for every row: rows joined by target or host, through chains, share the smallest id.

    Null, empty, unknown, other and n/a targets relate nothing, nor do urls without a host; a row with neither is a
    group of its own, also when its id is null. Empty input gives no rows; other columns are ignored.
    """
    keyed = stored(with_keys(pages, aliases, id_col, target_col, url_col), "keyed")
    t, h = F.concat(F.lit("t:"), F.col("target")), F.concat(F.lit("h:"), F.col("host"))
    rows = keyed.select("id", t.alias("t"), h.alias("h"))
    # A row's node: its host if it has one, else its target; the row itself never becomes a node.
    labels = components(rows.where("t is not null and h is not null").select(F.col("h").alias("a"), F.col("t").alias("b")))
    rows = rows.select("id", F.coalesce("h", "t").alias("node"))
    # Ids are brought together per node before the join, so a hot node costs one row per task.
    firsts = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    joined = stored(firsts.join(labels, "node", "left").select("node", "first", "n", F.coalesce("label", "node").alias("label")), "node-labels")
    tops = joined.groupBy("label").agg(F.min("first").alias("group_id"))
    by_node = stored(joined.join(tops, "label").select("node", "n", "group_id"), "node-groups")
    # Nodes of a thousandth of the rows, of which there are a thousand at most, are broadcast to their rows.
    bound = max(2, (by_node.agg(F.sum("n")).first()[0] or 0) // 1000)
    hot = F.broadcast(by_node.where(F.col("n") >= bound).select("node", F.col("group_id").alias("hot_id")))
    marked = rows.join(hot, "node", "left")
    rest = marked.where("hot_id is null").join(by_node.where(F.col("n") < bound).select("node", "group_id"), "node", "left").select("id", "group_id")
    found = marked.where("hot_id is not null").select("id", F.col("hot_id").alias("group_id")).unionByName(rest)
    return found.select(F.col("id").alias(id_col), F.coalesce("group_id", "id").alias("group_id"))


def split_groups(groups: DataFrame, plan: DataFrame, id_col: str = "crawl_id", seed: str = "split") -> DataFrame:
    """`(id_col, group_id, split_name)`: whole groups get a split so that the row shares of `plan` are met.

    Groups of at least a thousandth of the rows, of which there are at most a thousand, are placed one by one,
    largest first, where most is missing. The others follow in hash order along the running sum of their sizes and
    fill what is left of each share. A plan without rows or shares gives null splits.
    """
    spark: SparkSession = groups.sparkSession
    groups = stored(groups, "groups")
    sizes = stored(groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shares = [(r["split_name"], float(r["target_share"])) for r in plan.select("split_name", "target_share").where("target_share > 0").orderBy("split_name").collect()]
    whole = sum(s for _, s in shares)
    if not shares or not total:
        return groups.withColumn("split_name", F.lit(None).cast("string"))
    missing = {name: total * s / whole for name, s in shares}
    bound = max(2, -(-total // 1000))
    placed = []
    for r in sizes.where(F.col("n") >= bound).orderBy(F.desc("n"), "group_id").collect():
        name = max(missing, key=lambda k: (missing[k], k))
        missing[name] -= r["n"]
        placed.append((r["group_id"], name))
    small = sizes.where(F.col("n") < bound)
    room = {k: max(0.0, v) for k, v in missing.items()}
    left, scale = sum(room.values()), small.agg(F.sum("n")).first()[0] or 0
    small = hash_running_sum(small, [], "group_id", "n", "before", seed, scale) if scale else small.withColumn("before", F.lit(0))
    edge, choice = 0.0, F.lit(shares[-1][0])
    marks = []
    for name, _ in shares:
        edge += (room[name] / left if left else 1 / len(shares)) * scale
        marks.append((edge, name))
    for edge, name in reversed(marks[:-1]):
        choice = F.when(F.col("before") + F.col("n") / 2 <= edge, name).otherwise(choice)
    if marks:
        choice = choice if len(marks) > 1 else F.lit(marks[0][1])
    chosen = small.select("group_id", choice.alias("split_name"))
    if placed:
        chosen = chosen.unionByName(spark.createDataFrame(placed, chosen.schema))
    return groups.join(chosen, "group_id", "left").select(id_col, "group_id", "split_name")


def split_report(assigned: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows, groups and share reached of each split beside its target share."""
    made = assigned.groupBy("split_name").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("group_id").alias("n_groups"))
    total = assigned.agg(F.count(F.lit(1)).alias("total"))
    out = plan.select("split_name", "target_share").join(made, "split_name", "left").crossJoin(F.broadcast(total))
    return out.select("split_name", "target_share", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.round(F.coalesce("n_rows", F.lit(0)) / F.greatest("total", F.lit(1)), 6).alias("actual_share"))
