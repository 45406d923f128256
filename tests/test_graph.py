"""Graph measures against plain Python on small random graphs."""

import os
import random
from collections import deque

import pytest

from notemill.operators import graph as A
from notemill.operators.tags import note_tags
from notemill.plans import graph_queries as Q
from notemill.plans.note_queries import base
from notemill.session import cut


def build(spark, seed, n=14, m=20):
    rng = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(n)]
    edges = [(rng.choice(ids[:-2]), rng.choice(ids[:-2])) for _ in range(m)]
    near = {i: set() for i in ids}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    nodes = spark.createDataFrame([("g", i, i) for i in ids], "scope string, id string, ord string")
    adj = A.adjacency(spark.createDataFrame([("g", a, b) for a, b in edges], "vault string, source string, target string"))
    return ids, near, nodes, adj


def bfs(near, s):
    d = {s: 0}
    q = deque([s])
    while q:
        v = q.popleft()
        for w in near[v]:
            if w not in d:
                d[w] = d[v] + 1
                q.append(w)
    return d


def brute_betweenness(ids, near, standard):
    score = dict.fromkeys(ids, 0.0)
    for s in ids:
        d = bfs(near, s)
        order = sorted(d, key=d.get)
        sigma = {v: 0.0 for v in d}
        sigma[s] = 1
        for v in order:
            for w in near[v]:
                if d[w] == d[v] + 1:
                    sigma[w] += sigma[v]
        dep = dict.fromkeys(d, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if d[v] == d[w] - 1:
                    dep[v] += (sigma[v] / sigma[w] if standard else 1) * (1 + dep[w])
            if w != s:
                score[w] += dep[w]
    n = len(ids)
    return {k: v * 2 / ((n - 1) * (n - 2)) for k, v in score.items()}


def test_distances_and_centralities(spark):
    ids, near, nodes, adj = build(spark, 1)
    dist = A.distances(adj, nodes)
    want = {(s, t): k for s in ids for t, k in bfs(near, s).items()}
    assert {(r["src"], r["node"]): r["dist"] for r in dist.collect()} == want
    far = [k for (s, t), k in want.items() if s != t]
    p = A.path_stats(dist).first()
    assert (p["diameter"], p["pairs"]) == (max(far), len(far)) and p["average"] == pytest.approx(sum(far) / len(far))
    for standard in (False, True):
        got = {r["id"]: r["betweenness"] for r in A.betweenness(nodes, adj, dist, standard).collect()}
        assert got == pytest.approx(brute_betweenness(ids, near, standard))
    close = {r["id"]: r["closeness"] for r in A.closeness(dist).collect()}
    assert close[ids[-1]] == 0 and close[ids[0]] == pytest.approx((len(bfs(near, ids[0])) - 1) / max(1, sum(bfs(near, ids[0]).values())))
    assert {r["id"]: r["degree"] for r in A.degree(nodes, adj).collect()} == {i: len(near[i]) for i in ids}


def test_eigenvector(spark):
    ids, near, nodes, adj = build(spark, 3)
    x = {i: len(ids) ** -0.5 for i in ids}
    for _ in range(30):
        y = {i: sum(x[j] for j in near[i]) for i in ids}
        size = sum(v * v for v in y.values()) ** 0.5
        x = {i: v / size for i, v in y.items()}
    assert {r["id"]: r["score"] for r in A.eigenvector(nodes, adj, 30).collect()} == pytest.approx(x)


def test_components_and_cuts(spark):
    ids, near, nodes, adj = build(spark, 2, n=30, m=24)
    comp = {r["id"]: r["component"] for r in A.components(nodes, adj).collect()}
    assert comp == {i: min(bfs(near, i)) for i in ids}
    cuts = A.bridges_and_articulation(nodes, adj).collect()

    def parts(drop_node=None, drop_edge=None):
        keep = {i: {j for j in near[i] if j != drop_node and {i, j} != drop_edge} for i in ids if i != drop_node}
        return len({min(bfs(keep, i)) for i in keep})

    base = parts()
    assert {(r["a"], r["b"]) for r in cuts if r["kind"] == "bridge"} == {(i, j) for i in ids for j in near[i] if i < j and parts(drop_edge={i, j}) > base}
    assert {r["a"] for r in cuts if r["kind"] == "articulation"} == {i for i in ids if parts(drop_node=i) > base}


@pytest.mark.parametrize(("n", "m"), [(30, 24), (40, 46)])
def test_cuts_of_components_too_great_for_one_task(spark, monkeypatch, n, m):
    ids, near, nodes, adj = build(spark, n, n=n, m=m)
    chain = [f"x{i}" for i in range(9)]  # a path that ends in a triangle
    pairs = [*zip(chain, chain[1:]), ("x6", "x8")]
    adj = cut(adj.unionByName(spark.createDataFrame([("h", *p) for a, b in pairs for p in ((a, b), (b, a))], adj.schema)))
    nodes = nodes.unionByName(spark.createDataFrame([("h", x, x) for x in chain], nodes.schema))
    want = set(map(tuple, A.bridges_and_articulation(nodes, adj).collect()))
    assert {("h", "bridge", "x5", "x6"), ("h", "articulation", "x6", None)} <= want and ("h", "bridge", "x6", "x7") not in want
    monkeypatch.setattr(A, "ONE_TASK_EDGES", 1)
    got = list(map(tuple, A.bridges_and_articulation(nodes, adj).collect()))
    assert len(got) == len(set(got)) and set(got) == want


def test_communities(spark, monkeypatch):
    groups = [[f"{g}{i}" for i in range(5)] for g in "abc"]
    edges = [(x, y) for g in groups for i, x in enumerate(g) for y in g[i + 1 :]] + [("a0", "b0"), ("b1", "c1")]
    nodes = spark.createDataFrame([("g", x, x) for g in groups for x in g] + [("g", "z", "z")], "scope string, id string, ord string")
    adj = A.adjacency(spark.createDataFrame([("g", a, b) for a, b in edges], "vault string, source string, target string"))
    com = A.communities(nodes, adj)
    of = {r["id"]: r["community"] for r in com.collect()}
    assert len(set(of.values())) == 4 and all(len({of[x] for x in g}) == 1 for g in groups) and of["z"] == "z"
    stats = {r["community"]: r for r in A.cluster_stats(adj, com).collect()}
    assert all(stats[of[g[0]]]["cohesion"] == 1.0 for g in groups) and stats["z"]["cohesion"] == 0
    m2 = 2 * len(edges)
    near = {x: sum(x in e for e in edges) for x in of}
    want = sum((1 - near[a] * near[b] / m2) / m2 for e in edges for a, b in (e, e[::-1]) if of[a] == of[b])
    assert A.modularity(adj, com).first()["modularity"] == pytest.approx(want)
    monkeypatch.setattr(A, "ONE_TASK_EDGES", 1)  # all move together
    other = {r["id"]: r["community"] for r in A.communities(nodes, adj).collect()}
    assert len(set(other.values())) < len(other) / 2


def brute_communities(ids, near):
    """The model's sweeps over all nodes in order, until no node moves."""
    m2 = sum(map(len, near.values()))
    at = {i: n for n, i in enumerate(ids)}
    com, moved = {i: i for i in ids}, True
    while moved:
        moved = False
        for a in ids:
            gain = {com[a]: 0.0}
            for b in sorted(near[a] - {a}, key=at.get):
                gain[com[b]] = gain.get(com[b], 0.0) + 2 * (1 - len(near[a]) * len(near[b]) / m2) / m2
            best, most = com[a], 1e-12
            for c in gain:
                if gain[c] - gain[com[a]] > most:
                    best, most = c, gain[c] - gain[com[a]]
            com[a], moved = best, moved or best != com[a]
    first = {}
    for i in ids:
        first.setdefault(com[i], i)
    return {i: first[com[i]] for i in ids}


def test_communities_do_not_depend_on_the_size(spark, monkeypatch):
    ids, near, nodes, adj = build(spark, 5, n=60, m=110)
    want = brute_communities(ids, near)
    for most in (200_000, 1):
        monkeypatch.setattr(A, "ONE_TASK_EDGES", most)
        assert {r["id"]: r["community"] for r in A.communities(nodes, adj).collect()} == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_measures_of_the_note_graph(spark):
    folder = "/root/testdata/sf0.001"
    nodes, adj, _ = Q._notes(spark, folder)
    near = {}
    for r in nodes.collect():
        near.setdefault(r["scope"], {})[r["id"]] = set()
    for r in adj.collect():
        near[r["scope"]][r["a"]].add(r["b"])
    order = {}
    for r in nodes.orderBy("ord", "id").collect():
        order.setdefault(r["scope"], []).append(r["id"])
    want = {(v, s): bfs(near[v], s) for v in near for s in order[v][: Q.SOURCES]}
    got = {(r["scope"], r["src"], r["node"]): r["dist"] for r in Q.QUERIES["note_distances"](spark, folder).collect()}
    assert got == {(v, s, t): k for (v, s), d in want.items() for t, k in d.items()}
    com = {v: brute_communities(order[v], near[v]) for v in near}
    modularity = {r["scope"]: r["modularity"] for r in Q.QUERIES["note_modularity"](spark, folder).collect()}
    for v in near:
        m2 = sum(map(len, near[v].values()))
        q = sum((1 - len(near[v][a]) * len(near[v][b]) / m2) / m2 for a in near[v] for b in near[v][a] if com[v][a] == com[v][b])
        assert modularity[v] == pytest.approx(q, abs=1e-6)
    counts = {}
    for r in note_tags(base(spark, folder)).collect():
        c = counts.setdefault((r["vault"], com[r["vault"]]["file:" + r["path"]]), {})
        c[r["tag"]] = c.get(r["tag"], 0) + 1
    top = {(v, c, t): n for (v, c), x in counts.items() for t, n in sorted(x.items(), key=lambda y: (-y[1], y[0]))[:5]}
    assert {(r["scope"], r["community"], r["tag"]): r["n"] for r in Q.QUERIES["note_cluster_tags"](spark, folder).collect()} == top
    path = [r["node"] for r in Q.QUERIES["note_shortest_path"](spark, folder).orderBy("step").collect()]
    links = near["fieldwork"]
    assert not path or (all(b in links[a] for a, b in zip(path, path[1:])) and len(path) == bfs(links, path[0])[path[-1]] + 1)
