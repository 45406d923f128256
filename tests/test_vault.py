"""Folders of notes, the facade over them, validation, templates and streams."""

import os
import time
from datetime import datetime, timezone

import pytest

from notemill.api import NoteEngine
from notemill.operators import templates as P
from notemill.operators import validation as C
from notemill.operators.embeddings import HashProvider, TrainedProvider
from notemill.operators.orphans import orphans
from notemill.operators.search import Filters
from notemill.sources import config as S
from notemill.sources import vault as V
from notemill.sources.changes import NoteChanges, differences, snapshot
from notemill.streaming.changes import Monitor, coalesced, indexed, latest_paths, maintained, refresh_index
from notemill.streaming.orphans import OrphanTables, follow, snapshots

FILES = {
    "notes/start.md": "---\ntitle: Start Here\ncreated: 2024-01-01\nmodified: 2024-01-02\ntags: [guide, '#Basics']\n---\n\n# Start\n\nSee [[Other]] and [x](./other.md). #inline\n",
    "notes/other.md": "No frontmatter, just text about gardens and more gardens. #guide\n\n### Deep\n",
    "notes/broken.md": "---\ntitle: [unclosed\n---\nBody stays\n",
    "empty.md": "",
    ".hidden/x.md": "no",
    "node_modules/y.md": "no",
    "notes/pic.png": "no",
}


@pytest.fixture
def root(tmp_path):
    for p, text in FILES.items():
        f = tmp_path / "my vault" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text, encoding="utf-8")
    return str(tmp_path / "my vault")


def test_read_vault(spark, root):
    rows = {r["path"]: r for r in V.read_vault(spark, root, "v").collect()}
    assert set(rows) == {"notes/start.md", "notes/other.md", "notes/broken.md", "empty.md"}
    r = rows["notes/start.md"]
    assert r["title"] == "Start Here" and r["tags"] == ["guide", "Basics", "inline"] and [x["target"] for x in r["links"]] == ["Other", "./other.md"]
    assert r["frontmatter"]["created"] == '"2024-01-01"' and r["chunks"] and "---" not in r["content"]
    assert rows["notes/broken.md"]["_error"] and rows["notes/other.md"]["_error"] is None and rows["empty.md"]["chunks"] == []
    assert {r["path"] for r in V.listing(spark, root, r"\.png\z").collect()} == {"notes/pic.png"}


def test_paths_stay_inside(root):
    for bad in ("../x.md", "a/../../x", "../my vault2/x"):
        with pytest.raises(ValueError):
            V.safe_path(root, bad)
    assert V.split_text(V.markdown_text({"a": [1, "x"]}, "body\n")) == ({"a": [1, "x"]}, "body\n")
    assert V.markdown_text({}, "body") == "body" and V.split_text("plain") == ({}, "plain")


def test_bulk_search_is_the_search_of_each_query(spark, root):
    e = NoteEngine(spark, {"v": root}, provider=HashProvider(64))
    at = datetime.now(timezone.utc).replace(tzinfo=None)
    queries = ["gardens", "start guide", ""]
    want = {(q, r["path"]): r["score"] for q in queries for r in e.search_content(q, limit=10, now=at).collect()}
    each = {(r["query"], r["path"]): r["score"] for r in e.bulk_search(queries, now=at).collect()}
    assert each == pytest.approx(want) and any(q == "start guide" for q, _ in each) and 0 < each["gardens", "notes/other.md"] < 1
    best = e.bulk_search(queries, limit=1, combine=True, now=at).collect()
    assert len(best) == 3 and best[0]["score"] == pytest.approx(max(want.values()))


def test_engine(spark, root):
    t = [P.Template(r"^notes/", ["title"], {"title": {"type": "string"}}, "# {{title}}\n")]
    e = NoteEngine(spark, {"v": root}, t, [C.Rule("required-frontmatter"), C.Rule("heading-structure")], HashProvider(64))
    assert e.list_vaults().first()["files"] == 4
    assert [r["path"] for r in e.text_search("gardens").collect()] == ["notes/other.md"]
    assert e.text_search("GARDENS", case_sensitive=True).count() == 0
    found = e.search_content("gardens", filters=Filters(tags=["guide"]), now=datetime(2100, 1, 1)).collect()
    assert [r["path"] for r in found][:1] == ["notes/other.md"] or found
    assert e.search_content("", now=datetime(2100, 1, 1)).count() == 4
    assert e.semantic_search("gardens", threshold=0.01).first()["path"] == "notes/other.md"
    assert e.get_backlinks("notes/other.md").where("direction = 'incoming'").count() == 1
    assert [r["target_raw"] for r in e.get_broken_links().collect()] == ["Other"]
    assert {r["suggestions"][0] for r in e.get_broken_links().collect()} == {"notes/other.md"}
    assert e.get_tags().first()["tag"] == "guide" and e.get_files_by_tag(["guide", "inline"]).count() == 1
    assert e.find_related("notes/start.md").count() == 2
    assert e.bulk_validate(only_errors=True).count() == 3
    assert e.write_file("notes/new.md", "no frontmatter") != [] and e.read_file("notes/new.md").count() == 0
    ok = "---\ntitle: New\ncreated: 2024-01-01\nmodified: 2024-01-01\n---\nSee [[start.md]]\n"
    assert e.write_file("notes/new.md", ok) == [] and e.read_file("notes/new.md").first()["title"] == "New"
    assert e.bulk_tag_operation("add", ["done"], filters=Filters(paths=["new"])).count() == 1
    e.bulk_tag_operation("add", ["done"], filters=Filters(paths=["new"]), dry_run=False)
    assert e.read_file("notes/new.md").first()["tags"] == ["done"]
    assert not e.delete_file("notes/new.md") and e.delete_file("notes/new.md", confirm=True) and e.read_file("notes/new.md").count() == 0
    assert e.preview_template("notes/z.md", {"title": "Z"}).endswith("# Z\n") and e.preview_template("other/z.md") is None
    assert e.analyze_vault_health().first()["files"] == 4
    assert e.export_graph("dot").first()["line"] == "graph G {"
    with pytest.raises(KeyError):
        e.read_file("x", "nowhere")


def test_engine_options(spark, root, tmp_path):
    (tmp_path / "second").mkdir()
    (tmp_path / "second" / "a.md").write_text("# A\n[[b.md]] #x #y", encoding="utf-8")
    e = NoteEngine(spark, {"v": root}, [P.Template(r"^odd$", ["n"])], [], HashProvider(64))
    e.add_vault("w", str(tmp_path / "second"), default=True)
    assert e.read_file("a.md", metadata=False).columns == ["path", "content", "frontmatter"] and e.list_vaults().count() == 2
    r = e.get_backlinks("notes/other.md", "v", include_content=True).where("direction = 'incoming'").first()
    assert r["title"] == "Start Here" and "# Start" in r["excerpt"] and "guide" in r["other_tags"]
    s = {r["vault"]: r for r in e.get_graph_stats(include_metrics=True).collect()}
    assert s["w"]["tags"] == 2 and s["w"]["hubs"][0]["node"] == "a.md" and s["w"]["bridges"] == 1 and s["v"]["files"] == 4 and s["v"]["top_pagerank"]
    t = e.get_tag("#X").first()
    assert t["tag"] == "x" and t["together"] == {"y": 1} and e.get_tag("none").count() == 0
    e.configure(max_results=1)
    assert e.search_content("", now=datetime(2100, 1, 1)).count() == 1 and e.search_stats()["max_results"] == 1
    e.add_rule(C.Rule("content-length", "a"))
    e.add_rule(C.Rule("content-length", "b"))
    assert [r.pattern for r in e.rules_for("b.md")] == ["b"] and not e.rules_for("x") and e.remove_rule("content-length") and not e.remove_rule("content-length")
    assert e.create_file("new one", "text", template="^odd$") == [] and e.read_file("new_one.md").first()["frontmatter"] == {"n": "null"}
    with pytest.raises(KeyError):
        e.create_file("z", template="nope")
    e.vectors().count()
    before = e._known.count()
    e._set(e.notes)
    e.vectors().count()
    assert e._known.count() == before
    e.remove_vault("w")
    assert e.default_vault == "v" and e.list_vaults().count() == 1
    info = {r["path"]: r for r in V.file_info(spark, root, ["empty.md", "gone.md"]).collect()}
    assert info["empty.md"]["present"] and not info["gone.md"]["present"] and info["gone.md"]["size"] == 0


def test_rule_scripts(spark, root, tmp_path):
    good, bad = tmp_path / "good.py", tmp_path / "bad.py"
    good.write_text("def check(note):\n    yield {'message': 'seen ' + note['path']}\n")
    bad.write_text("raise RuntimeError\n")
    notes = V.read_vault(spark, root, "v").where("path = 'empty.md'")
    got = {(r["rule"], r["message"]) for r in C.findings(notes, [C.Rule("mine", script=str(good)), C.Rule("content-length", script=str(bad)), C.Rule("other", script=str(bad))]).collect()}
    assert got == {("mine", "seen empty.md"), ("content-length", "Content too short: 0 characters (minimum: 50)"), ("other", "Unknown built-in rule: other")}


def test_trained_provider(spark):
    rows = [("cat purrs cat milk",), ("cat milk purrs",), ("train rails engine",), ("engine train steam",), (None,), ("",)] * 5
    p = TrainedProvider.fit(spark.createDataFrame(rows, "text string"), dimension=4, features=256)
    x = p.embed(["cat purrs", "milk cat", "rails engine", ""])
    assert x.shape == (4, 4) and x[0] @ x[1] > 0.8 > 0.3 > x[0] @ x[2] and not x[3].any()


def test_incremental_update(spark, root):
    index = V.read_vault(spark, root, "v")
    index = spark.createDataFrame(index.collect(), index.schema)
    time.sleep(0.05)
    with open(os.path.join(root, "notes/other.md"), "w") as f:
        f.write("changed #fresh")
    os.utime(os.path.join(root, "notes/other.md"), (time.time() + 5, time.time() + 5))
    os.remove(os.path.join(root, "empty.md"))
    V.write_file(root, "notes/added.md", "new")
    rows = {r["path"]: r for r in V.update_index(index, spark, root, "v").collect()}
    assert set(rows) == {"notes/start.md", "notes/other.md", "notes/broken.md", "notes/added.md"} and rows["notes/other.md"]["tags"] == ["fresh"]


def test_rules(spark, root):
    notes = V.read_vault(spark, root, "v")

    def shout(n):
        if "gardens" in n["content"]:
            yield {"severity": "error", "message": "gardens!", "fix": "no more"}
        if "Body" in n["content"]:
            raise RuntimeError("oops")

    found = C.findings(notes, [C.Rule("shout", check=shout), C.Rule("nonsense", "empty"), C.Rule("bad", "(")])
    got = {(r["path"], r["rule"], r["message"]) for r in found.collect()}
    assert got == {("notes/other.md", "shout", "gardens!"), ("notes/broken.md", "shout", "Rule execution failed: oops"), ("empty.md", "nonsense", "Unknown built-in rule: nonsense")}
    assert {r["path"]: r["content"] for r in C.fixed(notes, found).collect()}["notes/other.md"] == "no more"
    assert C.rollup(notes, found, only_errors=True, rules=["nonsense"]).where("valid").count() == 2
    assert C.findings(notes, []).count() == 0


def test_template_filling():
    now = datetime(2024, 3, 5, 7, 8, 9, 120000, timezone.utc)
    t = P.Template("x", ["title", "created", "note"], {"title": {"type": "string"}, "n": {"type": "integer", "minimum": 2}, "l": {"type": "array"}, "odd": {}}, "{{title}} {{l}} {{date}} {{what}} ${date.year}-${date.month} ${title} ${what}")
    f = P.filled_frontmatter(t, {"l": ["a", "b"]}, now)
    assert f == {"l": ["a", "b"], "title": "Untitled", "created": "2024-03-05", "note": None, "n": 2}
    assert P.filled_content(t.content, f, now) == "Untitled a, b 2024-03-05 {{what}} 2024-03 Untitled what"
    assert P.applied(t, "---\ntitle: T\n---\nkept", now).endswith("kept")
    with pytest.raises(KeyError):
        P.created([t], "y", {}, now)


def test_config(tmp_path):
    (tmp_path / "vaults").mkdir()
    (tmp_path / "settings.yaml").write_text("search:\n  max_results: 7\n")
    (tmp_path / "vaults" / "w.yaml").write_text("indexing:\n  chunk_size: 5\n")
    c = S.vault_config(str(tmp_path), "/data/w")
    assert c["search"]["max_results"] == 7 and c["search"]["similarity_threshold"] == 0.7 and c["indexing"]["chunk_size"] == 5 and c["name"] == "w"
    with pytest.raises(ValueError):
        S.checked({"search": {"similarity_threshold": 2}})
    bad = {"search": {"max_results": 0, "ranking_weights": {"tags": 3}}, "links": {"patterns": [1]}, "templates": [{"required": "x"}], "validation": {"rules": [{"name": "a", "pattern": "b", "on": ["write"]}]}, "indexing": {"debounce_ms": True}, "more": {"x": 1}}
    assert len(S.problems(bad)) == 6 and S.problems(S.DEFAULTS) == []
    made = S.skeleton(str(tmp_path), str(tmp_path / "vault"))
    assert len(made) == 2 and S.skeleton(str(tmp_path), str(tmp_path / "vault")) == []
    os.environ["NOTEMILL_X"] = "1"
    assert S.with_environment("a${NOTEMILL_X}b${NOTEMILL_NONE}") == "a1b"


def test_snapshots(root):
    a = snapshot(root, stable_s=0)
    assert "notes/start.md" in a and not any(p.startswith((".hidden", "node_modules")) for p in a)
    b = {**a, "n.md": [1, 2]}
    b["empty.md"] = [9, 9]
    del b["notes/pic.png"]
    assert differences(a, b) == [("change", "empty.md"), ("add", "n.md"), ("unlink", "notes/pic.png")]


def test_change_stream_keeps_an_index(spark, root, tmp_path):
    spark.dataSource.register(NoteChanges)
    table, state = str(tmp_path / "index"), str(tmp_path / "state")
    os.makedirs(table)
    changes = spark.readStream.format("note_changes").option("path", root).option("stable", 0).load()
    query = maintained(changes, refresh_index(spark, table, root, "v"), state, gap="1 second", once=False)
    try:
        query.processAllAvailable()
        V.write_file(root, "notes/added.md", "hello #live")
        os.remove(os.path.join(root, "empty.md"))
        deadline, paths = time.time() + 90, set()
        while time.time() < deadline and ("notes/added.md" not in paths or "empty.md" in paths):
            time.sleep(0.5)
            assert query.exception() is None, query.exception()
            now = indexed(spark, table)
            if now is not None:
                paths = {r["path"] for r in now.collect()}
    finally:
        query.stop()
    assert paths == {"notes/start.md", "notes/other.md", "notes/broken.md", "notes/added.md"}


def test_sessions_in_batch_and_stream(spark, tmp_path):
    T = lambda s: datetime(2024, 1, 1, 0, s // 60, s % 60)
    rows = [("a", "x", "add", T(0), 1), ("a", "y", "change", T(0), 2), ("a", "x", "unlink", T(1), 3), ("a", "x", "add", T(60), 4), ("b", "x", "change", T(30), 5)]
    schema = "scope string, path string, type string, ts timestamp, seq bigint"
    df = spark.createDataFrame(rows, schema)
    got = {(r["scope"], r["session"], r["path"], r["type"], r["events"]) for r in coalesced(df, "5 seconds").collect()}
    assert got == {("a", 1, "x", "unlink", 2), ("a", 1, "y", "change", 1), ("a", 2, "x", "add", 1), ("b", 1, "x", "change", 1)}
    df.write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([("z", "z", "add", datetime(2024, 1, 2), 9)], schema)
    late.write.mode("append").parquet(str(tmp_path / "in"))
    s = coalesced(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "5 seconds", "1 minute")
    q = s.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = {(r["scope"], r["path"], r["type"]) for r in latest_paths(spark.table("sessions")).collect()}
    assert {("a", "x", "unlink"), ("a", "y", "change"), ("a", "x", "add"), ("b", "x", "change")} <= out


def test_orphans_on_a_stream(spark, tmp_path):
    schema = "kind string, ref_table string, ref_field string, ref_id bigint, space string, key string, seen_at timestamp, owner string, version bigint, live boolean, arrived_at timestamp"
    src, at = str(tmp_path / "in"), datetime(2024, 5, 1)
    ref = lambda i, k: ("ref", "t", "f", i, "s", k, at, None, None, None, None)
    par = lambda k, v, live: ("parent", None, None, None, "s", k, None, "o" + k, v, live, at)
    tables = OrphanTables(spark, str(tmp_path / "state"))
    want = [({1: "missing", 2: "missing"}, [ref(1, "a"), ref(2, "b")]), ({2: "missing"}, [par("a", 1, True)]), ({1: "deleted", 2: "missing", 3: "deleted"}, [par("a", 2, False), ref(3, "a")])]
    for state, rows in want:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        follow(spark.readStream.schema(schema).parquet(src), tables, str(tmp_path / "cp")).awaitTermination(120)
        assert {r["ref_id"]: r["reason"] for r in orphans(tables.load()).collect()} == state
    assert snapshots(tables).first()["version"] == tables.version()
