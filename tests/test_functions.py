from pyspark.sql import functions as F

from notemill.functions import text as T
from notemill.functions import vectors as V
from notemill.functions.keys import normal_tag, normal_tags, path_key, target_key, valid_vector


def one(spark, col, **values):
    kinds = {str: "string", int: "bigint", list: "array<string>"}
    fields = ", ".join(f"{k} {'array<float>' if isinstance(v, list) and v and isinstance(v[0], float) else kinds.get(type(v), 'string')}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], fields) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def test_tags_have_one_normal_form(spark):
    for raw, want in ((" #Work Log ", "work-log"), ("##a", "#a"), ("# a", "-a"), ("A\u00a0b", "a-b"), (None, None), ("#", ""), ("  ", "")):
        assert one(spark, normal_tag("t"), t=raw) == want
    assert one(spark, normal_tags("t"), t=["#A", "a", None, " ", "b c"]) == ["a", "b-c"]
    assert one(spark, normal_tags(F.lit(None).cast("array<string>"))) == []


def test_path_and_target_keys(spark):
    assert one(spark, path_key("p"), p=" \\Notes//A b.MD/ ") == "notes/a b"
    cases = {
        ("daily/x.md", "../Home.md#top"): "home", ("daily/x.md", "y%20z"): "daily/y z", ("daily/x.md", "/a/./b/../C.md"): "a/c", ("x.md", "../../up"): "up", ("a\\b.md", "#part"): "a/b", ("a/b", ""): "a/b",
        ("a/b", "c%zz+d"): "a/c%zz+d", ("a/b", "./c"): "a/c", ("a/b", "x\\y"): "a/x/y", ("a/b.md", "  "): "a/b",
    }
    for (src, target), want in cases.items():
        assert one(spark, target_key("s", "t"), s=src, t=target) == want, (src, target)
    assert one(spark, target_key("s", "t"), s="a", t=None) is None


def test_links_tags_headings(spark):
    text = "See [[A|b]] and [[ C ]] [x](y.md) [u](http://z)\n# Top\n####### no\n### Deep  \n#tag/one #tag/one [[d#e]]"
    links = one(spark, T.links_of("c"), c=text)
    assert [tuple(x) for x in links] == [("A", "b", "wikilink", 1), ("C", "C", "wikilink", 1), ("y.md", "x", "markdown", 1), ("d#e", "d#e", "wikilink", 5)]
    assert one(spark, T.tags_of("c", "f"), c=text, f=["#x", "x", "tag/one"]) == ["x", "x", "tag/one", "e"]
    assert [tuple(h) for h in one(spark, T.headings_of("c"), c=text)] == [(1, "Top", 2), (3, "Deep", 4)]
    assert one(spark, T.links_of(F.lit(None).cast("string"))) == []


def test_plain_text_keeps_the_models_quirks(spark):
    assert one(spark, T.plain_text("c"), c="# H\n![i](p.png)[t](u) [[w]] **b** *i* `c`\n\n\n\n---\nx\n---\nend") == "H\n$1 w b i c\n\nend"
    assert one(spark, T.plain_text("c", strict=False), c="[t](u) z") == "t z"


def test_hash_and_lengths(spark):
    for s, want in (("", "0"), ("abc", "22ci"), ("hello world", "to5x38")):
        assert one(spark, T.content_hash("s"), s=s) == want
    assert one(spark, T.estimated_tokens("s"), s="😀😀😀") == 2
    assert one(spark, T.truncated("s", 2), s="a" * 100) == "a" * 7
    # 12 units, 3 tokens: floor(12 * 2 / 3 * 0.9) = 7 units, the fourth pair is cut in half
    assert one(spark, T.truncated("s", 2), s="\U0001f600" * 6) == "\U0001f600" * 3 and one(spark, T.truncated("s", 2), s="") == ""


def test_resolved_targets(spark):
    for target, want in (("./b.md", "x/b.md"), ("../b.md", "b.md"), ("/Q", "/q"), ("B C", "x/b c"), ("../../../z", "z")):
        assert one(spark, T.resolved_target("t", "s"), t=target, s="X/a.md") == want
    assert one(spark, T.resolved_target("t", "s", "wikilink"), t="B", s="X/a.md") == "x/b.md"
    assert one(spark, T.wikilink_path("t", "s"), t="[[N|x]]", s="a/b.md") == "a/N.md"
    assert one(spark, T.safe_filename("t"), t=' a:b  c?') == "a_b_c"


def test_chunks():
    assert T.paragraph_chunks("aaaa\n\nbb\n\ncccc", 6) == ["aaaa\n\nbb", "cccc"]
    assert T.paragraph_chunks("x" * 50, 10) == ["x" * 50]
    assert T.paragraph_chunks("", 10) == []
    assert T.heading_chunks("intro\n# A\nx\n## B\ny", 100) == ["intro", "# A\nx", "# A\n## B\ny"]
    assert T.sentence_chunks("Aa. Bb! Cc?", 1) == ["Aa", "Bb", "Cc"]


def test_matches_and_hits(spark):
    found = one(spark, T.term_matches("c", "ab"), c="xABab" + "-" * 60)
    assert [(m["position"], len(m["context"])) for m in found] == [(1, 53), (3, 55)]
    assert one(spark, T.term_matches("c", ""), c="x") == []
    assert [m["position"] for m in one(spark, T.term_matches("c", "ab"), c="\u0130\U0001f600ab ab")] == [3, 6]
    assert one(spark, T.hits("c", "aa"), c="aaaaa") == 2


def test_vectors(spark):
    assert one(spark, V.cosine("a", "b"), a=[1.0, 0.0], b=[1.0, 0.0]) == 1
    assert one(spark, V.cosine("a", "b"), a=[1.0, 0.0], b=[0.0, 0.0]) == 0
    assert one(spark, V.cosine("a", "b"), a=[1.0, 0.0], b=[0.0]) is None
    assert one(spark, V.normalized("a"), a=[3.0, 4.0]) == [0.6, 0.8]
    for v, d, ok in (([1.0, 0.0], 2, True), ([0.0, 0.0], 2, False), ([1.0], 2, False), ([float("nan"), 1.0], 2, False)):
        assert one(spark, valid_vector("v", "d"), v=v, d=d) is ok
    assert one(spark, valid_vector(F.lit(None).cast("array<float>"), F.lit(2))) is False
