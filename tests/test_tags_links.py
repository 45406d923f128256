"""The five-note vault: goldens derived by hand, and the tag index on small inputs."""

import pytest

from notemill.operators import graph as A
from notemill.operators import links as L
from notemill.operators import tags as G

NOTES = {
    "notes/getting-started.md": (["tutorial", "basics", "tags", "project"], ["Linking Notes", "Advanced Features"]),
    "notes/linking-notes.md": (["tutorial", "linking"], ["Getting Started", "Getting Started", "./advanced-features.md"]),
    "notes/advanced-features.md": (["advanced", "features"], ["Getting Started"]),
    "projects/project-alpha.md": (["project", "alpha", "active"], ["Getting Started", "Advanced Features"]),
    "daily/2024-01-01.md": (["daily", "reflection"], ["Getting Started", "Advanced Features"]),
}


@pytest.fixture(scope="module")
def notes(spark):
    from datetime import datetime

    rows = [("v", p, i, datetime(2024, 1, 1 + i), t, [(x, x, "wikilink", 1) for x in ls], None) for i, (p, (t, ls)) in enumerate(NOTES.items())]
    return spark.createDataFrame(rows, "vault string, path string, ord bigint, last_modified timestamp, tags array<string>, links array<struct<target:string,text:string,type:string,line:int>>, title string")


def test_tag_counts(spark, notes):
    t = G.note_tags(notes)
    stats = {r["tag"]: r["file_count"] for r in G.tag_stats(t).collect()}
    assert len(stats) == 11 and stats["tutorial"] == stats["project"] == 2 and sum(stats.values()) == 13
    top = {r["other"]: r["n"] for r in G.top_cooccurring(t).where("tag = 'tutorial'").collect()}
    assert top == {"basics": 1, "tags": 1, "project": 1, "linking": 1}
    assert G.files_by_tags(t, ["Tutorial", "#project"]).count() == 1
    assert G.files_by_tags(t, ["tutorial", "project"], "or").count() == 3
    assert G.files_by_tags(t, []).count() == 0 and G.files_by_tags(t, [" "], "or").count() == 0
    with pytest.raises(ValueError):
        G.files_by_tags(t, ["x"], "xor")


def test_hierarchy_and_suggestions(spark):
    rows = [("v", "a", None, ["project/web", "project/web/frontend", "react"]), ("v", "b", None, ["project", "react", "css"]), ("v", "c", None, ["project/web/backend", None, ""])]
    t = G.note_tags(spark.createDataFrame(rows, "vault string, path string, last_modified timestamp, tags array<string>"))
    assert {(r["parent"], r["tag"]) for r in G.child_tags(t).collect()} == {("project", "project/web"), ("project/web", "project/web/frontend"), ("project/web", "project/web/backend")}
    got = [(r["tag"], r["score"], r["reason"]) for r in G.suggested_tags(t, ["project/web"]).orderBy("rank").collect()]
    assert got == [("project", 5, "hierarchy"), ("project/web/backend", 3, "hierarchy"), ("project/web/frontend", 3, "hierarchy"), ("project/web/frontend", 1, "co_occurrence"), ("react", 1, "co_occurrence")]


def test_bulk_tags(spark):
    n = spark.createDataFrame([("v", "a", ["x", "x", "y"]), ("v", "b", None)], "vault string, path string, tags array<string>")
    got = lambda *a: {r["path"]: r["new_tags"] for r in G.bulk_tags(n, *a).collect()}
    assert got("add", ["y", "z"]) == {"a": ["x", "x", "y", "z"], "b": ["y", "z"]}
    assert got("remove", ["x"]) == {"a": ["y"]}
    assert got("replace", ["n"], ["y"]) == {"a": ["x", "x", "n"], "b": ["n"]}


def test_link_goldens(spark, notes):
    e = L.link_edges(notes)
    n = L.link_nodes(notes, e)
    d = L.degrees(n, e)
    assert e.count() == 10 and n.count() == 12 and n.where("is_real").count() == 5
    assert L.broken_links(e, n).count() == 9
    assert L.link_suggestions(L.broken_links(e, n), notes).count() == 0
    assert {r["node"] for r in L.orphaned(d).collect()} == {"notes/getting-started.md", "notes/linking-notes.md", "projects/project-alpha.md", "daily/2024-01-01.md"}
    assert L.ranked(d, "incoming", 1).first()["node"] == "notes/getting started"
    assert L.ranked(d, "outgoing", 1).first()["node"] == "notes/linking-notes.md"
    s = L.link_stats(e, d, L.broken_links(e, n)).first()
    assert (s["nodes"], s["links"], s["broken"], s["orphans"]) == (12, 10, 9, 4)


def test_pagerank_leaks(spark, notes):
    e = L.link_edges(notes)
    r = {x["node"]: x["rank"] for x in L.pagerank(L.link_nodes(notes, e), e).collect()}
    assert r["notes/advanced-features.md"] == pytest.approx(0.0160416667)
    assert r["notes/getting started"] == pytest.approx(0.03321875)
    assert r["notes/linking-notes.md"] == pytest.approx(0.0125)
    assert sum(r.values()) == pytest.approx(0.2061354167)


def test_paths(spark, notes):
    e = L.link_edges(notes)
    start = spark.createDataFrame([("v", "notes/linking-notes.md")], "vault string, node string")
    assert {(r["node"], r["distance"]) for r in L.related(e, start, 2).collect()} == {("notes/advanced-features.md", 1), ("notes/getting started", 1)}
    assert L.shortest_path(e, "v", "notes/linking-notes.md", "notes/getting-started.md").count() == 0
    p = L.shortest_path(e, "v", "notes/linking-notes.md", "notes/advanced-features.md").orderBy("step").collect()
    assert [x["node"] for x in p] == ["notes/linking-notes.md", "notes/advanced-features.md"]
    assert L.shortest_path(e, "v", "nowhere", "nowhere").count() == 1


def test_analyzer_graph_goldens(spark, notes):
    for with_tags, n, m, density in ((False, 9, 10, 0.2777777778), (True, 20, 23, 0.1210526316)):
        nodes, edges = A.analyzer_nodes(notes, with_tags), A.analyzer_edges(notes, with_tags)
        s = A.graph_stats(nodes.withColumnRenamed("vault", "scope"), edges.withColumnRenamed("vault", "scope"), A.adjacency(edges)).first()
        assert (s["nodes"], s["edges"]) == (n, m) and s["density"] == pytest.approx(density)
        if not with_tags:
            assert s["components"] == 1
            d = {r["id"]: r["degree"] for r in A.degree(nodes.withColumnRenamed("vault", "scope"), A.adjacency(edges)).collect()}
            assert d["file:Getting Started"] == 4 and d["file:Advanced Features"] == 3 and d["file:notes/linking-notes.md"] == 2


def test_exports(spark, notes):
    nodes, edges = A.analyzer_nodes(notes, False), A.analyzer_edges(notes, False)
    lines = [r["line"] for r in A.exported(nodes, edges, "dot").orderBy("section", "ord", "k", "pos").collect()]
    assert lines[0] == "graph G {" and lines[-1] == "}" and len(lines) == 21
    assert lines[1] == '  "file:notes/getting-started.md" [label="notes/getting-started.md"];'
    assert A.exported(nodes, edges, "gexf").count() == 22 and A.exported(nodes, edges, "json").count() == 19
    with pytest.raises(ValueError):
        A.exported(nodes, edges, "svg")
