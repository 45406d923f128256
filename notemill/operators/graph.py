"""Graph analytics over notes, link targets and tags, and over any other graph in the same form.

A graph is two tables: nodes (scope, id, ord) and undirected adjacency (scope, a, b), both directions, once.  A scope is
a graph of its own (a vault).  All-pairs measures take V * E work whatever the engine, so they accept a table of sources.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.operators.order import numbered
from notemill.operators.skew import join_unique
from notemill.session import cut

#: Bridges of a component with at most so many adjacency rows are found within one task.
ONE_TASK_EDGES = 200_000


def analyzer_nodes(notes: DataFrame, with_tags: bool = True) -> DataFrame:
    """(vault, id, type, label, ord): ``file:`` nodes of notes and raw link targets, ``tag:`` nodes of raw tags.

    The first to name a node gives its label and order: notes in their order, each before its links and then its tags.
    """
    own = notes.select("vault", F.concat(F.lit("file:"), F.col("path")).alias("id"), F.lit("file").alias("type"), F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("path")).alias("label"), F.struct("ord", F.lit(0).alias("k"), F.lit(0).alias("pos")).alias("at"))
    target = notes.select("vault", "ord", F.posexplode("links.target").alias("pos", "t")).where(F.col("t").isNotNull())
    out = own.unionByName(target.select("vault", F.concat(F.lit("file:"), F.col("t")).alias("id"), F.lit("file").alias("type"), F.col("t").alias("label"), F.struct("ord", F.lit(1).alias("k"), "pos").alias("at")))
    if with_tags:
        tag = notes.select("vault", "ord", F.posexplode("tags").alias("pos", "t")).where(F.col("t").isNotNull())
        out = out.unionByName(tag.select("vault", F.concat(F.lit("tag:"), F.col("t")).alias("id"), F.lit("tag").alias("type"), F.col("t").alias("label"), F.struct("ord", F.lit(2).alias("k"), "pos").alias("at")))
    first = out.groupBy("vault", "id", "type").agg(F.min(F.struct("at", "label")).alias("f"))
    return first.select("vault", "id", "type", F.col("f.label").alias("label"), F.col("f.at").alias("ord"))


def analyzer_edges(notes: DataFrame, with_tags: bool = True) -> DataFrame:
    """(vault, source, target, type, weight, ord, pos): one row per link and per tag of a note, repeats kept."""
    src = F.concat(F.lit("file:"), F.col("path")).alias("source")
    link = notes.select("vault", src, "ord", F.posexplode("links.target").alias("pos", "t")).where(F.col("t").isNotNull())
    out = link.select("vault", "source", F.concat(F.lit("file:"), F.col("t")).alias("target"), F.lit("link").alias("type"), F.lit(1.0).alias("weight"), "ord", "pos")
    if with_tags:
        tag = notes.select("vault", src, "ord", F.posexplode("tags").alias("pos", "t")).where(F.col("t").isNotNull())
        out = out.unionByName(tag.select("vault", "source", F.concat(F.lit("tag:"), F.col("t")).alias("target"), F.lit("tag").alias("type"), F.lit(1.0).alias("weight"), "ord", "pos"))
    return out


def adjacency(edges: DataFrame, scope: str = "vault", source: str = "source", target: str = "target") -> DataFrame:
    """(scope, a, b): both directions of every edge, repeats and directions merged; a self-loop is one row."""
    e = edges.select(F.col(scope).alias("scope"), F.col(source).alias("a"), F.col(target).alias("b"))
    return e.unionByName(e.select("scope", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def degree(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """(scope, id, degree): distinct neighbours, a self-loop counts one."""
    d = adj.groupBy("scope", F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("scope", "id").join(d, ["scope", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))


def graph_stats(nodes: DataFrame, edges: DataFrame, adj: DataFrame) -> DataFrame:
    """(scope, nodes, edges, density, components): repeated edges count, so the density may exceed 1."""
    comps = components(nodes, adj).groupBy("scope").agg(F.count_distinct("component").alias("components"))
    n = nodes.groupBy("scope").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.groupBy("scope").agg(F.count(F.lit(1)).alias("edges"))
    out = n.join(e, "scope", "left").join(comps, "scope").withColumn("edges", F.coalesce("edges", F.lit(0).cast("bigint")))
    return out.withColumn("density", F.coalesce(F.try_divide(F.col("edges").cast("double"), F.col("nodes") * (F.col("nodes") - 1) / 2), F.lit(0.0)))


def components(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """(scope, id, component): weakly connected components, named by their least id.

    Alternating large and small stars: every round hangs all greater neighbours, then all smaller ones, under the
    least; the number of rounds grows with the logarithm of the longest path.  Rounds go on until the edges stop changing.
    """
    e = cut(adj.where("a > b").select("scope", F.col("a").alias("u"), F.col("b").alias("v")), "components")
    mark = None
    while True:
        both = e.unionByName(e.select("scope", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("scope", "u").agg(F.min("v").alias("m")).select("scope", "u", F.least("u", "m").alias("m"))
        large = join_unique(both, low, ["scope", "u"]).where("v > u").select("scope", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "components")
        least = large.groupBy("scope", "u").agg(F.min("v").alias("m"))
        small = join_unique(large, least, ["scope", "u"]).select("scope", F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("s"))
        e = cut(small.select("scope", F.col("s.u").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct(), "components")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("scope", "u", "v"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    star = e.groupBy("scope", F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return nodes.select("scope", "id").join(star, ["scope", "id"], "left").select("scope", "id", F.coalesce("component", "id").alias("component"))


def distances(adj: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(scope, src, node, dist): undirected distances from each source (scope, id), 0 to itself; unreached nodes are absent.

    Level by level: only the newest level is joined with the edges.  Every level is written, so the plan stays small.
    """
    frontier = cut(sources.select("scope", F.col("id").alias("src"), F.col("id").alias("node"), F.lit(0).alias("dist")).distinct(), "distances")
    levels = [frontier]
    adj = cut(adj, "distances-edges")
    while max_depth is None or len(levels) <= max_depth:
        step = frontier.join(adj.select("scope", F.col("a").alias("node"), "b"), ["scope", "node"]).select("scope", "src", F.col("b").alias("node")).distinct()
        # in an undirected graph the neighbours of a level lie in it, the one before or the next
        for old in levels[-2:]:
            step = step.join(old, ["scope", "src", "node"], "left_anti")
        frontier = cut(step.withColumn("dist", F.lit(len(levels))), "distances")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def path_stats(dist: DataFrame) -> DataFrame:
    """(scope, diameter, pairs, average): over ordered pairs of different connected nodes."""
    d = dist.where("dist > 0").groupBy("scope").agg(F.max("dist").alias("diameter"), F.count(F.lit(1)).alias("pairs"), F.avg("dist").alias("average"))
    return dist.select("scope").distinct().join(d, "scope", "left").select("scope", F.coalesce("diameter", F.lit(0)).alias("diameter"), F.coalesce("pairs", F.lit(0).cast("bigint")).alias("pairs"), F.coalesce("average", F.lit(0.0)).alias("average"))


def closeness(dist: DataFrame) -> DataFrame:
    """(scope, id, closeness): nodes reached by the sum of their distances; 0 for isolated nodes."""
    return dist.groupBy("scope", F.col("src").alias("id")).agg(F.coalesce(F.try_divide(F.count(F.when(F.col("dist") > 0, 1)).cast("double"), F.sum("dist")), F.lit(0.0)).alias("closeness"))


def betweenness(nodes: DataFrame, adj: DataFrame, dist: DataFrame, standard: bool = False) -> DataFrame:
    """(scope, id, betweenness) from the distances of all sources.

    As coded in the model, each predecessor gains 1 + the dependency of its successor, without path counts; ``standard``
    shares the gain by the number of shortest paths.  Dependencies flow back level by level.
    """
    dist = cut(dist, "betweenness")
    deepest = dist.agg(F.max("dist")).first()[0] or 0
    link = dist.join(adj.select("scope", F.col("a").alias("node"), F.col("b").alias("pred")), ["scope", "node"])
    before = dist.select("scope", "src", F.col("node").alias("pred"), (F.col("dist") + 1).alias("dist"))
    link = cut(link.join(before, ["scope", "src", "pred", "dist"]), "betweenness")
    paths = dist.where("dist = 0").select("scope", "src", "node", F.lit(1.0).alias("sigma"))
    if standard:
        every = [paths]
        for d in range(1, deepest + 1):
            prev = every[-1].withColumnRenamed("node", "pred")
            every.append(cut(link.where(F.col("dist") == d).join(prev, ["scope", "src", "pred"]).groupBy("scope", "src", "node").agg(F.sum("sigma").alias("sigma")), "sigma"))
        paths = every[0]
        for x in every[1:]:
            paths = paths.unionByName(x)
    total = dist.select("scope", "src", "node", F.lit(0.0).alias("dep")).where(F.lit(False))
    dep = total
    for d in range(deepest, 0, -1):
        step = link.where(F.col("dist") == d).join(dep, ["scope", "src", "node"], "left").withColumn("gain", 1 + F.coalesce("dep", F.lit(0.0)))
        if standard:
            step = step.join(paths, ["scope", "src", "node"]).withColumnRenamed("sigma", "own").join(paths.select("scope", "src", F.col("node").alias("pred"), "sigma"), ["scope", "src", "pred"])
            step = step.withColumn("gain", F.col("gain") * F.col("sigma") / F.col("own"))
        dep = cut(step.groupBy("scope", "src", F.col("pred").alias("node")).agg(F.sum("gain").alias("dep")), "betweenness")
        total = total.unionByName(dep)
    got = total.where("src <> node").groupBy("scope", F.col("node").alias("id")).agg(F.sum("dep").alias("dep"))
    n = nodes.groupBy("scope").agg(F.count(F.lit(1)).cast("double").alias("n"))
    norm = F.when(F.col("n") > 2, 2 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(1.0)
    out = join_unique(nodes.select("scope", "id"), n, ["scope"]).join(got, ["scope", "id"], "left")
    return out.select("scope", "id", (F.coalesce("dep", F.lit(0.0)) * norm).alias("betweenness"))


def eigenvector(nodes: DataFrame, adj: DataFrame, iterations: int = 100) -> DataFrame:
    """(scope, id, score): power iteration from equal scores, scaled to length 1; without edges the start is kept.

    The scale does not affect the direction, so it is restored at every tenth iteration only, where lineage is cut.
    """
    sizes = nodes.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    x = cut(join_unique(nodes.select("scope", "id"), sizes, ["scope"]).select("scope", "id", (1 / F.sqrt("n")).alias("score")), "eigenvector")
    adj = cut(adj, "eigenvector-edges")
    done = 0
    while done < iterations:
        y = x
        for _ in range(min(10, iterations - done)):
            y = adj.join(y.select("scope", F.col("id").alias("a"), "score"), ["scope", "a"]).groupBy("scope", F.col("b").alias("id")).agg(F.sum("score").alias("score"))
            done += 1
        y = cut(y, "eigenvector")
        length = y.groupBy("scope").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("l"))
        scaled = join_unique(y, length, ["scope"]).select("scope", "id", (F.col("score") / F.col("l")).alias("new"), F.lit(True).alias("moved"))
        # a scope without edges keeps its start; elsewhere a node without neighbours has 0
        live = length.select("scope", F.lit(True).alias("has"))
        x = x.join(scaled, ["scope", "id"], "left").join(live, "scope", "left")
        x = cut(x.select("scope", "id", F.when(F.col("has"), F.coalesce("new", F.lit(0.0))).otherwise(F.col("score")).alias("score")), "eigenvector")
    return x


def modularity(adj: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(scope, modularity) of a partition (scope, id, community): over adjacent pairs of one community, as the model sums it."""
    k = adj.groupBy("scope", "a").agg(F.count(F.lit(1)).cast("double").alias("k"))
    m2 = adj.groupBy("scope").agg(F.count(F.lit(1)).cast("double").alias("m2"))
    c = communities.select("scope", F.col("id").alias("a"), "community")
    ends = k.join(c, ["scope", "a"])
    e = cut(join_unique(adj, ends, ["scope", "a"]), "modularity")
    other = ends.select("scope", F.col("a").alias("b"), F.col("k").alias("kb"), F.col("community").alias("cb"))
    e = join_unique(cut(join_unique(e, other, ["scope", "b"]), "modularity"), m2, ["scope"]).where(F.col("community") == F.col("cb"))
    got = e.groupBy("scope").agg(F.sum((1 - resolution * F.col("k") * F.col("kb") / F.col("m2")) / F.col("m2")).alias("modularity"))
    return communities.select("scope").distinct().join(got, "scope", "left").select("scope", F.coalesce("modularity", F.lit(0.0)).alias("modularity"))


def _local_moving(resolution: float):
    """Single-level local moving of one connected component: (scope, c, i, near, m2), a row per node with its neighbours in order."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        m2 = t["m2"][0].as_py()
        ids = t["i"].to_numpy()
        count = pc.list_value_length(t["near"]).to_numpy()
        start = [0, *np.cumsum(count, dtype=np.int64).tolist()]
        to = np.searchsorted(ids, pc.list_flatten(t["near"]).to_numpy()).astype(np.int32)
        k = count.astype(float).tolist()
        com = list(range(len(ids)))
        # a node whose neighbours have stayed since its last turn would stay as well
        due = bytearray(b"\1") * len(ids)
        while any(due):
            for a in range(len(ids)):
                if not due[a]:
                    continue
                due[a] = 0
                near = to[start[a] : start[a + 1]].tolist()
                gain: dict[int, float] = {}
                for b in near:
                    if b != a:
                        gain[com[b]] = gain.get(com[b], 0.0) + 2 * (1 - resolution * k[a] * k[b] / m2) / m2
                stay = gain.get(com[a], 0.0)
                best, most = com[a], 1e-12
                for c, g in gain.items():
                    if c != com[a] and g - stay > most:
                        best, most = c, g - stay
                if best != com[a]:
                    com[a] = best
                    for b in near:
                        due[b] = 1
        name: dict[int, int] = {}
        for a, c in enumerate(com):
            name.setdefault(c, a)
        first = ids[[name[c] for c in com]]
        return pa.table({"scope": t["scope"], "i": ids, "first": first})

    return run


def communities(nodes: DataFrame, adj: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(scope, id, community): modularity communities by moving single nodes, named by their first node.

    Nodes move in the model's order, sweep by sweep, until none does.  Every move counts on those before it, so a component
    is one task whatever its size; it gets numbers in place of names, a list of neighbours per node.  Gains are local
    and moves never cross components.
    """
    adj = cut(adj, "communities")
    numbers = cut(numbered(nodes.select("scope", "id", "ord"), "scope", ["ord", "id"], "i").select("scope", "id", F.col("i").cast("int").alias("i")), "communities")
    comp = components(nodes, adj).join(numbers, ["scope", "id"])
    comp = cut(comp.select("scope", "i", F.col("component").alias("id")), "communities")
    comp = join_unique(comp, numbers.withColumnRenamed("i", "c"), ["scope", "id"]).select("scope", "i", "c")
    e = cut(join_unique(adj, numbers.select("scope", F.col("id").alias("a"), "i"), ["scope", "a"]).select("scope", "i", "b"), "communities")
    e = join_unique(e, numbers.select("scope", F.col("id").alias("b"), F.col("i").alias("j")), ["scope", "b"])
    near = e.groupBy("scope", "i").agg(F.sort_array(F.collect_list("j")).alias("near"))
    m2 = adj.groupBy("scope").agg(F.count(F.lit(1)).cast("double").alias("m2"))
    near = join_unique(cut(near.join(comp, ["scope", "i"]), "communities"), m2, ["scope"]).select("scope", "c", "i", "near", "m2")
    got = cut(near.groupBy("scope", "c").applyInArrow(_local_moving(resolution), "scope string, i int, first int"), "communities")
    got = join_unique(got, numbers.select("scope", F.col("i").alias("first"), F.col("id").alias("community")), ["scope", "first"]).select("scope", "i", "community")
    return numbers.join(got, ["scope", "i"], "left").select("scope", "id", F.coalesce("community", "id").alias("community"))


def cluster_stats(adj: DataFrame, com: DataFrame) -> DataFrame:
    """(scope, community, members, internal, cohesion): linked pairs by possible pairs, 0 for single nodes."""
    n = com.groupBy("scope", "community").agg(F.count(F.lit(1)).alias("members"))
    a = com.select("scope", F.col("id").alias("a"), "community")
    b = com.select("scope", F.col("id").alias("b"), F.col("community").alias("cb"))
    e = join_unique(join_unique(adj.where("a < b"), a, ["scope", "a"]), b, ["scope", "b"]).where("community = cb")
    inside = e.groupBy("scope", "community").agg(F.count(F.lit(1)).alias("internal"))
    out = n.join(inside, ["scope", "community"], "left").withColumn("internal", F.coalesce("internal", F.lit(0).cast("bigint")))
    pairs = F.col("members").cast("double") * (F.col("members") - 1) / 2
    return out.withColumn("cohesion", F.coalesce(F.try_divide(F.col("internal").cast("double"), pairs), F.lit(0.0)))


def cluster_tags(com: DataFrame, member_tags: DataFrame, limit: int = 5) -> DataFrame:
    """(scope, community, tag, n, rank): the most frequent tags (scope, id, tag) of each community's members."""
    per = member_tags.join(com, ["scope", "id"]).groupBy("scope", "community", "tag").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("scope", "community").orderBy(F.desc("n"), "tag")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def influential(scores: DataFrame, by: str, limit: int = 10) -> DataFrame:
    """(scope, id, score, rank): the nodes of greatest ``by`` in each scope, ties by id."""
    w = Window.partitionBy("scope").orderBy(F.desc(by), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("scope", "id", F.col(by).alias("score"), "rank")


def _cuts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bridges and cut vertices of one component, by low points without recursion."""
    near: dict[str, list[str]] = defaultdict(list)
    for a, b in zip(pdf["a"], pdf["b"], strict=True):
        if a != b:
            near[a].append(b)
    seen, low, out = {}, {}, []
    for root in sorted(near):
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        stack, children = [(root, "", iter(near[root]))], 0
        points = set()
        while stack:
            v, parent, it = stack[-1]
            for w in it:
                if w not in seen:
                    seen[w] = low[w] = len(seen)
                    stack.append((w, v, iter(near[w])))
                    break
                if w != parent:
                    low[v] = min(low[v], seen[w])
            else:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] > seen[u]:
                        out.append(("bridge", min(u, v), max(u, v)))
                    if u == root:
                        children += 1
                    elif low[v] >= seen[u]:
                        points.add(u)
        if children > 1:
            points.add(root)
        out += [("articulation", p, None) for p in points]
    return pd.DataFrame({"scope": pdf["scope"].iloc[0], "kind": [x[0] for x in out], "a": [x[1] for x in out], "b": [x[2] for x in out]}, columns=["scope", "kind", "a", "b"]).astype({"kind": object, "a": object, "b": object})


def _ancestors(tree: DataFrame) -> list[DataFrame]:
    """(scope, id, up) per power of two: the ancestor so many levels up, where there is one."""
    ups = [cut(tree.where("parent IS NOT NULL").select("scope", "id", F.col("parent").alias("up")), "ancestors")]
    while True:
        last = ups[-1]
        far = join_unique(last, last.select("scope", F.col("id").alias("up"), F.col("up").alias("far")), ["scope", "up"])
        far = cut(far.where("far IS NOT NULL").select("scope", "id", F.col("far").alias("up")), "ancestors")
        if far.isEmpty():
            return ups
        ups.append(far)


def _of_subtrees(rows: DataFrame, ups: list[DataFrame], how: dict) -> DataFrame:
    """``rows`` (scope, id, ...) with each column of ``how`` taken together over the node's subtree: (aggregate, of two)."""
    for up in ups:
        got = up.join(rows.select("scope", "id", *how), ["scope", "id"]).groupBy("scope", F.col("up").alias("id")).agg(*[f(c).alias(f"_{c}") for c, (f, _) in how.items()])
        rows = rows.join(got, ["scope", "id"], "left").withColumns({c: F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(two(F.col(c), F.col(f"_{c}"))) for c, (_, two) in how.items()})
        rows = cut(rows.drop(*[f"_{c}" for c in how]), "subtrees")
    return rows


def _cuts_together(e: DataFrame) -> DataFrame:
    """Bridges and cut vertices of components (scope, component, a, b) of any size, after Tarjan and Vishkin.

    A breadth-first tree is grown level by level, so rounds grow with its depth; numbers in preorder and what the edges
    beside the tree reach from each subtree then take rounds in the logarithm of the depth.  An edge of the tree is named by
    its lower end; those on a common cycle are linked, and the components of these links are the blocks.
    """
    adj = cut(e.where("a <> b").select("scope", "a", "b"), "cuts-edges")
    level = e.select("scope", F.col("component").alias("id")).distinct().select("scope", "id", F.lit(None).cast("string").alias("parent"))
    levels = [cut(level, "cuts-tree")]
    while True:
        step = levels[-1].select("scope", F.col("id").alias("a")).join(adj, ["scope", "a"]).groupBy("scope", F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        for old in levels[-2:]:
            step = step.join(old, ["scope", "id"], "left_anti")
        level = cut(step, "cuts-tree")
        if level.isEmpty():
            break
        levels.append(level)
    tree = levels[0]
    for x in levels[1:]:
        tree = tree.unionByName(x)
    tree = cut(tree, "cuts-tree")
    ups = _ancestors(tree)
    tree = _of_subtrees(tree.withColumn("size", F.lit(1).cast("bigint")), ups, {"size": (F.sum, lambda x, y: x + y)})
    # a child is numbered after its parent and the subtrees of the children before it
    before = F.sum("size").over(Window.partitionBy("scope", "parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    tree = cut(tree.withColumn("pre", F.when(F.col("parent").isNull(), 0).otherwise(1 + F.coalesce(before, F.lit(0)))), "cuts-tree")
    for up in ups:
        add = join_unique(up, tree.select("scope", F.col("id").alias("up"), F.col("pre").alias("add")), ["scope", "up"]).select("scope", "id", "add")
        tree = cut(tree.join(add, ["scope", "id"], "left").withColumn("pre", F.col("pre") + F.coalesce("add", F.lit(0))).drop("add"), "cuts-tree")
    # a breadth-first tree has no edges beside it between a node and its ancestors
    ends = tree.select("scope", "id", "parent", "pre")
    off = cut(join_unique(adj, ends.select("scope", F.col("id").alias("a"), F.col("parent").alias("up_a")), ["scope", "a"]), "cuts-edges")
    off = join_unique(off, ends.select("scope", F.col("id").alias("b"), F.col("parent").alias("up_b"), F.col("pre").alias("pre_b")), ["scope", "b"])
    off = cut(off.where("NOT (up_a <=> b) AND NOT (up_b <=> a)").select("scope", "a", "b", "pre_b"), "cuts-edges")
    own = off.groupBy("scope", F.col("a").alias("id")).agg(F.min("pre_b").alias("l"), F.max("pre_b").alias("h"))
    tree = tree.join(own, ["scope", "id"], "left").withColumns({"low": F.least("pre", "l"), "high": F.greatest("pre", "h")}).drop("l", "h")
    tree = _of_subtrees(cut(tree, "cuts-tree"), ups, {"low": (F.min, F.least), "high": (F.max, F.greatest)})
    over = tree.select("scope", F.col("id").alias("parent"), F.col("parent").alias("above"), F.col("pre").alias("pre_up"), F.col("size").alias("size_up"))
    child = cut(join_unique(tree.where("parent IS NOT NULL"), over, ["scope", "parent"]), "cuts-tree")
    along = child.where("above IS NOT NULL AND (low < pre_up OR high >= pre_up + size_up)").select("scope", F.col("id").alias("a"), F.col("parent").alias("b"))
    same = off.select("scope", "a", "b").unionByName(along).unionByName(along.select("scope", F.col("b").alias("a"), F.col("a").alias("b")))
    block = cut(components(child.select("scope", "id"), same), "cuts-blocks")
    met = child.select("scope", "id", "parent").join(block, ["scope", "id"]).select("scope", F.explode(F.array("id", "parent")).alias("a"), "component")
    points = met.groupBy("scope", "a").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    bridges = child.where("low >= pre AND high < pre + size").select("scope", F.lit("bridge").alias("kind"), F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))
    return bridges.unionByName(points.select("scope", F.lit("articulation").alias("kind"), "a", F.lit(None).cast("string").alias("b")))


def bridges_and_articulation(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """(scope, kind, a, b): bridges (a < b) and articulation points (b null).

    A component up to ``ONE_TASK_EDGES`` is worked within one task, a greater one by joins; both are exact.
    """
    adj = cut(adj, "cuts-edges")
    comp = components(nodes, adj)
    e = cut(join_unique(adj, comp.select("scope", F.col("id").alias("a"), "component"), ["scope", "a"]), "cuts")
    sizes = e.groupBy("scope", "component").agg((F.count(F.lit(1)) > ONE_TASK_EDGES).alias("big"))
    e = cut(join_unique(e, sizes, ["scope", "component"]), "cuts")
    out = e.where("NOT big").drop("big").groupBy("scope", "component").applyInPandas(_cuts, "scope string, kind string, a string, b string")
    if e.where("big").limit(1).count():
        out = out.unionByName(_cuts_together(e.where("big")))
    return out


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def exported(nodes: DataFrame, edges: DataFrame, form: str, escape: bool = False) -> DataFrame:
    """(scope, section, ord, pos, line): the lines of a graph file in ``dot``, ``gexf`` or ``json`` (one object per line).

    Sort by section, ord, pos within a scope and write the lines as text.  ``escape`` escapes XML in gexf, and quotes in
    dot ids; without it lines are as the model writes them.
    """
    q = F.lit('"')
    none = F.struct(F.lit(0).cast("bigint").alias("ord"), F.lit(0).alias("k"), F.lit(0).alias("pos"))
    n = nodes.select(F.col("vault").alias("scope"), F.col("ord").alias("at"), "id", "label", "type")
    e = edges.select(F.col("vault").alias("scope"), F.struct("ord", F.when(F.col("type") == "link", 1).otherwise(2).alias("k"), "pos").alias("at"), "source", "target", "type", "weight")
    scopes = n.select("scope").distinct()
    if form == "dot":
        clean = (lambda c: F.replace(F.col(c), q, F.lit('\\"'))) if escape else F.col
        parts = [
            (0, scopes.select("scope", none.alias("at"), F.lit("graph G {").alias("line"))),
            (1, n.select("scope", "at", F.concat(F.lit('  "'), clean("id"), F.lit('" [label="'), F.replace("label", q, F.lit('\\"')), F.lit('"];')).alias("line"))),
            (2, e.select("scope", "at", F.concat(F.lit('  "'), clean("source"), F.lit('" -- "'), clean("target"), F.lit('";')).alias("line"))),
            (3, scopes.select("scope", none.alias("at"), F.lit("}").alias("line"))),
        ]
    elif form == "gexf":
        x = (lambda c: _escaped(F.col(c))) if escape else F.col
        head = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">\n  <graph mode="static" defaultedgetype="undirected">\n    <nodes>'
        parts = [
            (0, scopes.select("scope", none.alias("at"), F.lit(head).alias("line"))),
            (1, n.select("scope", "at", F.concat(F.lit('      <node id="'), x("id"), F.lit('" label="'), x("label"), F.lit('" />')).alias("line"))),
            (2, scopes.select("scope", none.alias("at"), F.lit("    </nodes>\n    <edges>").alias("line"))),
            (3, numbered(e, "scope", ["at", "target"], "i").select("scope", "at", F.concat(F.lit('      <edge id="'), F.col("i").cast("string"), F.lit('" source="'), x("source"), F.lit('" target="'), x("target"), F.lit('" weight="1" />')).alias("line"))),
            (4, scopes.select("scope", none.alias("at"), F.lit("    </edges>\n  </graph>\n</gexf>").alias("line"))),
        ]
    elif form == "json":
        parts = [
            (0, n.select("scope", "at", F.to_json(F.struct(F.lit("node").alias("kind"), "id", "type", "label")).alias("line"))),
            (1, e.select("scope", "at", F.to_json(F.struct(F.lit("edge").alias("kind"), "source", "target", "type", "weight")).alias("line"))),
        ]
    else:
        raise ValueError("form must be json, gexf or dot")
    out = None
    for k, part in parts:
        part = part.withColumn("section", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.select("scope", "section", F.col("at.ord").alias("ord"), F.col("at.k").alias("k"), F.col("at.pos").alias("pos"), "line")
