"""The link graph of each vault: edges between normalized paths, real or not.

Edges have (vault, src, pos, target_raw, target, text, line, type); nodes are (vault, node, is_real).  A target that no
note has is a node as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.text import resolved_target, slash_path
from notemill.operators.contain import contained
from notemill.operators.skew import join_unique
from notemill.session import cut, static_plans


def link_edges(notes: DataFrame, style: str = "as_coded") -> DataFrame:
    """One row per outgoing link, in the notes' order; null targets are no links."""
    rows = notes.select("vault", "path", F.posexplode("links").alias("pos", "l")).where(F.col("l.target").isNotNull())
    return rows.select(
        "vault", slash_path("path").alias("src"), "pos", F.col("l.target").alias("target_raw"), resolved_target(F.col("l.target"), F.col("path"), style).alias("target"),
        F.col("l.text").alias("text"), F.col("l.line").alias("line"), F.col("l.type").alias("type"),
    )


def real_nodes(notes: DataFrame) -> DataFrame:
    return notes.select("vault", slash_path("path").alias("node"), "ord").groupBy("vault", "node").agg(F.min("ord").alias("ord"))


def link_nodes(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(vault, node, is_real): all notes and all targets."""
    both = real_nodes(notes).select("vault", "node", F.lit(True).alias("is_real")).unionByName(edges.select("vault", F.col("target").alias("node"), F.lit(False).alias("is_real")))
    return both.groupBy("vault", "node").agg(F.max("is_real").alias("is_real"))


def backlinks(edges: DataFrame, node: str) -> DataFrame:
    """(vault, direction, other, text, line, type) of one node's links, outgoing and incoming."""
    n = node.replace("\\", "/").lower()
    out = edges.where(F.col("src") == n).select("vault", F.lit("outgoing").alias("direction"), F.col("target").alias("other"), "text", "line", "type")
    return out.unionByName(edges.where(F.col("target") == n).select("vault", F.lit("incoming").alias("direction"), F.col("src").alias("other"), "text", "line", "type"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(vault, node, is_real, outgoing, incoming): links counted with repeats."""
    ends = edges.select("vault", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    per = ends.groupBy("vault", F.col("e.node").alias("node")).agg(F.sum("e.o").alias("outgoing"), F.sum("e.i").alias("incoming"))
    zero = F.lit(0).cast("bigint")
    return nodes.join(per, ["vault", "node"], "left").withColumns({"outgoing": F.coalesce("outgoing", zero), "incoming": F.coalesce("incoming", zero)})


def broken_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose target is no note's path."""
    real = nodes.where("is_real").select("vault", F.col("node").alias("target"), F.lit(True).alias("_real"))
    return join_unique(edges, real, ["vault", "target"]).where("_real IS NULL").drop("_real")


def orphaned(degree: DataFrame) -> DataFrame:
    """Nodes without incoming links."""
    return degree.where("incoming = 0").select("vault", "node", "is_real")


def ranked(degree: DataFrame, by: str, limit: int = 10) -> DataFrame:
    """(vault, node, n, rank): the ``limit`` nodes of each vault with most links, ties by name.  by: outgoing (hubs) or
    incoming (authorities)."""
    w = Window.partitionBy("vault").orderBy(F.desc(by), "node")
    return degree.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("vault", "node", F.col(by).alias("n"), "rank")


def link_suggestions(broken: DataFrame, notes: DataFrame, limit: int = 5) -> DataFrame:
    """(vault, target_raw, suggestion, rank): for each distinct broken target the first notes (by ord) whose path holds
    the target or is held in it, letter case aside."""
    broken = cut(broken.select("vault", "target_raw").distinct(), "suggestions-targets")
    needle = broken.select(F.col("vault").alias("scope"), F.lower("target_raw").alias("s")).distinct()
    files = cut(real_nodes(notes), "suggestions-notes")
    paths = files.select(F.col("vault").alias("scope"), F.col("node").alias("p"))
    ahead = contained(needle.select("scope", F.col("s").alias("needle")), files.select(F.col("vault").alias("scope"), F.col("node").alias("hay"), "ord"), "ord", limit).select("scope", F.col("needle").alias("s"), F.col("hay").alias("p"))
    back = contained(paths.select("scope", F.col("p").alias("needle")), needle.select("scope", F.col("s").alias("hay"))).select("scope", F.col("hay").alias("s"), F.col("needle").alias("p"))
    found = ahead.unionByName(back).distinct().join(files.select(F.col("vault").alias("scope"), F.col("node").alias("p"), "ord"), ["scope", "p"])
    w = Window.partitionBy("scope", "s").orderBy("ord")
    few = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    raw = broken.select(F.col("vault").alias("scope"), "target_raw").distinct().withColumn("s", F.lower("target_raw"))
    return raw.join(few, ["scope", "s"]).select(F.col("scope").alias("vault"), "target_raw", F.col("p").alias("suggestion"), "rank")


def link_stats(edges: DataFrame, degree: DataFrame, broken: DataFrame) -> DataFrame:
    """(vault, nodes, real_nodes, links, broken, orphans)."""
    a = degree.groupBy("vault").agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.col("is_real"), 1)).alias("real_nodes"), F.sum("outgoing").alias("links"), F.count(F.when(F.col("incoming") == 0, 1)).alias("orphans"))
    b = broken.groupBy("vault").agg(F.count(F.lit(1)).alias("broken"))
    return a.join(b, "vault", "left").withColumn("broken", F.coalesce("broken", F.lit(0).cast("bigint")))


def top_linked(degree: DataFrame, limit: int = 5) -> DataFrame:
    """(vault, hubs, authorities): the nodes of most outgoing and most incoming links, as arrays of (node, n)."""
    each = lambda by, name: ranked(degree, by, limit).groupBy("vault").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node", "n"))), lambda x: F.struct(x["node"].alias("node"), x["n"].alias("n"))).alias(name))
    return each("outgoing", "hubs").join(each("incoming", "authorities"), "vault")


def undirected(edges: DataFrame) -> DataFrame:
    """(vault, a, b): each link in both directions, once."""
    e = edges.select("vault", F.col("src").alias("a"), F.col("target").alias("b"))
    return e.unionByName(e.select("vault", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def related(edges: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """(vault, start, node, distance): nodes within ``hops`` undirected links of each start (vault, node).

    A frontier search: each step joins only the newest nodes, and drops those already reached.
    """
    both = undirected(edges)
    reached = starts.select("vault", F.col("node").alias("start"), "node", F.lit(0).alias("distance")).distinct()
    frontier = reached
    for d in range(1, hops + 1):
        step = frontier.join(both.withColumnRenamed("a", "node"), ["vault", "node"]).select("vault", "start", F.col("b").alias("node")).distinct()
        frontier = step.join(reached, ["vault", "start", "node"], "left_anti").withColumn("distance", F.lit(d))
        reached = reached.unionByName(frontier)
        if d % 3 == 0:
            reached = cut(reached, "related")
            frontier = reached.where(F.col("distance") == d)
    return reached.where("distance > 0")


def shortest_path(edges: DataFrame, vault: str, start: str, goal: str, max_depth: int = 6) -> DataFrame:
    """One row (step, node) per node of a shortest undirected path; no rows where there is none within ``max_depth`` links.

    The same node at both ends is a path of one node, known or not.  Of several shortest paths, the one whose nodes come
    first by name from the goal backwards.
    """
    spark = edges.sparkSession
    if start == goal:
        return spark.createDataFrame([(0, start)], "step int, node string")
    both = undirected(edges.where(F.col("vault") == vault)).select("a", "b")
    seen = spark.createDataFrame([(start, None, 0)], "node string, before string, depth int")
    frontier = seen
    for d in range(1, max_depth + 1):
        step = frontier.select(F.col("node").alias("a")).join(both, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("before"))
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)), "path-frontier")
        seen = seen.unionByName(frontier)
        if frontier.where(F.col("node") == goal).limit(1).count():
            path, at = [], goal
            while at is not None:  # at most max_depth + 1 lookups
                path.append(at)
                at = seen.where(F.col("node") == at).first()["before"]
            return spark.createDataFrame(list(enumerate(reversed(path))), "step int, node string")
        if frontier.isEmpty():
            break
    return spark.createDataFrame([], "step int, node string")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """(vault, node, rank) after a fixed number of iterations per vault, from 1/N; repeated links count, and the rank of
    nodes without outgoing links is lost, so ranks may sum to less than 1.

    The links are reduced once to weighted edges, which stay cached under the partitioning of the ranks: an iteration
    shuffles nothing but the combined contributions.  Lineage is cut every fifth iteration; what is cached can be made again
    from written tables, so a lost executor costs time only.
    """
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    weight = cut(edges.groupBy("vault", "src", "target").agg(F.count(F.lit(1)).alias("c")), "pagerank-weights")
    total = weight.groupBy("vault", "src").agg(F.sum("c").alias("o"))
    links = weight.join(total, ["vault", "src"]).select("vault", F.col("src").alias("node"), "target", (F.col("c") / F.col("o")).alias("w"))
    nodes = cut(nodes.select("vault", "node"), "pagerank-nodes")
    sizes = nodes.groupBy("vault").agg(F.count(F.lit(1)).alias("n"))
    base = join_unique(nodes, sizes, ["vault"])
    links = links.repartition(n, "vault", "node").persist()
    base = base.repartition(n, "vault", "node").persist()
    ranks = base.withColumn("rank", F.lit(1.0) / F.col("n"))
    with static_plans(spark):
        for i in range(1, iterations + 1):
            given = ranks.join(links, ["vault", "node"]).groupBy("vault", F.col("target").alias("node")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
            rank = (1 - damping) / F.col("n") + damping * F.coalesce(F.col("got"), F.lit(0.0))
            ranks = base.join(given, ["vault", "node"], "left").select("vault", "node", "n", rank.alias("rank"))
            if i % 5 == 0 or i == iterations:
                ranks = cut(ranks, "pagerank")
    links.unpersist()
    base.unpersist()
    return ranks.select("vault", "node", "rank")
