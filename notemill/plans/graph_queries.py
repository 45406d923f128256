"""Queries on graphs: the analyzer graph of the notes, and a small trade graph for measures over all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notemill.operators import graph as A
from notemill.operators import links as L
from notemill.operators.tags import note_tags
from notemill.plans.note_queries import LIVE, ORACLES as _NOTE_SQL, base
from notemill.sources.tables import table


def _named(nodes: DataFrame) -> DataFrame:
    at = F.format_string("%020d-%d-%010d", F.col("ord.ord"), F.col("ord.k"), F.col("ord.pos"))
    return nodes.select(F.col("vault").alias("scope"), "id", at.alias("ord"))


def _notes(spark: SparkSession, folder: str, with_tags: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, adjacency and edges of the analyzer graph."""
    notes = base(spark, folder)
    edges = A.analyzer_edges(notes, with_tags)
    return _named(A.analyzer_nodes(notes, with_tags)), A.adjacency(edges), edges


def _trade(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations, each linked to the three other nations whose customers bought most of its suppliers."""
    t = lambda n: table(spark, folder, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    sold = lines.join(t("supplier").select("s_suppkey", "s_nationkey"), lines.l_suppkey == F.col("s_suppkey"))
    sold = sold.join(t("orders").select("o_orderkey", "o_custkey"), sold.l_orderkey == F.col("o_orderkey"))
    sold = sold.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).where("s_nationkey <> c_nationkey")
    # cents: sums that do not depend on the order of addition
    value = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    per = sold.groupBy("s_nationkey", "c_nationkey").agg(value.alias("v"))
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("v"), "c_nationkey")
    top = per.withColumn("r", F.row_number().over(w)).where("r <= 3")
    name = lambda c: F.format_string("n%02d", F.col(c))
    edges = top.select(F.lit("trade").alias("vault"), name("s_nationkey").alias("source"), name("c_nationkey").alias("target"))
    nodes = t("nation").select(F.lit("trade").alias("scope"), name("n_nationkey").alias("id"), name("n_nationkey").alias("ord"))
    return nodes, A.adjacency(edges), edges.withColumnRenamed("vault", "scope")


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return A.analyzer_nodes(base(spark, folder)).select("vault", "id", "type", "label")


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return A.analyzer_edges(base(spark, folder)).select("vault", "source", "target", "type", "ord", "pos")


def graph_stats(spark: SparkSession, folder: str) -> DataFrame:
    nodes, adj, edges = _notes(spark, folder)
    return _r(A.graph_stats(nodes, edges.withColumnRenamed("vault", "scope"), adj), "density")


def graph_degree(spark: SparkSession, folder: str) -> DataFrame:
    nodes, adj, _ = _notes(spark, folder, True)
    return A.degree(nodes, adj)


def graph_components(spark: SparkSession, folder: str) -> DataFrame:
    nodes, adj, _ = _notes(spark, folder)
    return A.components(nodes, adj)


def note_communities(spark: SparkSession, folder: str) -> DataFrame:
    nodes, adj, _ = _notes(spark, folder)
    return A.communities(nodes, adj)


def note_cluster_tags(spark: SparkSession, folder: str) -> DataFrame:
    """The five most frequent tags of each community."""
    nodes, adj, _ = _notes(spark, folder)
    com = A.communities(nodes, adj)
    tags = note_tags(base(spark, folder)).select(F.col("vault").alias("scope"), F.concat(F.lit("file:"), F.col("path")).alias("id"), "tag")
    return A.cluster_tags(com, tags)


def influential_degree(spark: SparkSession, folder: str) -> DataFrame:
    nodes, adj, _ = _notes(spark, folder)
    return A.influential(A.degree(nodes, adj), "degree")


def influential_pagerank(spark: SparkSession, folder: str) -> DataFrame:
    notes = base(spark, folder)
    edges = L.link_edges(notes)
    ranks = L.pagerank(L.link_nodes(notes, edges), edges).select(F.col("vault").alias("scope"), F.col("node").alias("id"), F.round("rank", 9).alias("rank"))
    return A.influential(ranks.withColumnRenamed("rank", "pagerank"), "pagerank")


def note_bridges(spark: SparkSession, folder: str) -> DataFrame:
    nodes, adj, _ = _notes(spark, folder)
    return A.bridges_and_articulation(nodes, adj)


#: Measures over all pairs take V * E work, so on notes they start from the first nodes of each vault: so many.
SOURCES = 3


def _note_dist(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, adj, _ = _notes(spark, folder)
    first = F.row_number().over(Window.partitionBy("scope").orderBy("ord", "id"))
    sources = nodes.withColumn("r", first).where(F.col("r") <= SOURCES).select("scope", "id")
    return nodes, adj, A.distances(adj, sources)


def note_distances(spark: SparkSession, folder: str) -> DataFrame:
    """From the first SOURCES nodes of each vault, as the three below."""
    return _note_dist(spark, folder)[2]


def note_path_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _r(A.path_stats(_note_dist(spark, folder)[2]), "average")


def note_closeness(spark: SparkSession, folder: str) -> DataFrame:
    return _r(A.closeness(_note_dist(spark, folder)[2]), "closeness")


def note_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    nodes, adj, dist = _note_dist(spark, folder)
    return _r(A.betweenness(nodes, adj, dist), "betweenness")


def note_betweenness_standard(spark: SparkSession, folder: str) -> DataFrame:
    nodes, adj, dist = _note_dist(spark, folder)
    return _r(A.betweenness(nodes, adj, dist, standard=True), "betweenness")


def note_eigenvector(spark: SparkSession, folder: str) -> DataFrame:
    nodes, adj, _ = _notes(spark, folder)
    return _r(A.eigenvector(nodes, adj), "score")


def note_modularity(spark: SparkSession, folder: str) -> DataFrame:
    nodes, adj, _ = _notes(spark, folder)
    return _r(A.modularity(adj, A.communities(nodes, adj)), "modularity")


def note_cohesion(spark: SparkSession, folder: str) -> DataFrame:
    nodes, adj, _ = _notes(spark, folder)
    return _r(A.cluster_stats(adj, A.communities(nodes, adj)), "cohesion")


def note_shortest_path(spark: SparkSession, folder: str) -> DataFrame:
    """Between the first and the last node by name of vault fieldwork that link anywhere, at any depth."""
    edges = A.analyzer_edges(base(spark, folder), False).select("vault", F.col("source").alias("src"), "target")
    ends = edges.where("vault = 'fieldwork'").agg(F.min("src"), F.max("src")).first()
    return L.shortest_path(edges, "fieldwork", *ends, max_depth=10**6)


def _export(form: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        notes = base(spark, folder)
        return A.exported(A.analyzer_nodes(notes), A.analyzer_edges(notes), form)

    return run


def _trade_dist(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, adj, _ = _trade(spark, folder)
    return nodes, adj, A.distances(adj, nodes)


def trade_distances(spark: SparkSession, folder: str) -> DataFrame:
    return _trade_dist(spark, folder)[2]


def trade_path_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _r(A.path_stats(_trade_dist(spark, folder)[2]), "average")


def trade_closeness(spark: SparkSession, folder: str) -> DataFrame:
    return _r(A.closeness(_trade_dist(spark, folder)[2]), "closeness")


def trade_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    nodes, adj, dist = _trade_dist(spark, folder)
    return _r(A.betweenness(nodes, adj, dist), "betweenness")


def trade_betweenness_standard(spark: SparkSession, folder: str) -> DataFrame:
    nodes, adj, dist = _trade_dist(spark, folder)
    return _r(A.betweenness(nodes, adj, dist, standard=True), "betweenness")


def trade_eigenvector(spark: SparkSession, folder: str) -> DataFrame:
    nodes, adj, _ = _trade(spark, folder)
    return _r(A.eigenvector(nodes, adj), "score")


def trade_communities(spark: SparkSession, folder: str) -> DataFrame:
    nodes, adj, _ = _trade(spark, folder)
    return A.communities(nodes, adj)


def _by_region(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(F.lit("trade").alias("scope"), F.format_string("n%02d", "n_nationkey").alias("id"), F.format_string("r%d", "n_regionkey").alias("community"))


def region_modularity(spark: SparkSession, folder: str) -> DataFrame:
    _, adj, _ = _trade(spark, folder)
    return _r(A.modularity(adj, _by_region(spark, folder)), "modularity")


def region_cohesion(spark: SparkSession, folder: str) -> DataFrame:
    _, adj, _ = _trade(spark, folder)
    return _r(A.cluster_stats(adj, _by_region(spark, folder)), "cohesion")


def trade_shortest_path(spark: SparkSession, folder: str) -> DataFrame:
    _, _, edges = _trade(spark, folder)
    return L.shortest_path(edges.select(F.col("scope").alias("vault"), F.col("source").alias("src"), "target"), "trade", "n00", "n17")


QUERIES = {
    f.__name__: f
    for f in (
        graph_nodes, graph_edges, graph_stats, graph_degree, graph_components, note_communities, note_cluster_tags, influential_degree, influential_pagerank, note_bridges, trade_distances,
        trade_path_stats, trade_closeness, trade_betweenness, trade_betweenness_standard, trade_eigenvector, trade_communities, region_modularity, region_cohesion, trade_shortest_path,
        note_distances, note_path_stats, note_closeness, note_betweenness, note_betweenness_standard, note_eigenvector, note_modularity, note_cohesion, note_shortest_path,
    )
} | {f"export_{x}": _export(x) for x in ("dot", "gexf", "json")}

_NODES = """every AS (
  SELECT vault, 'file:' || path AS id, 'file' AS type, coalesce(nullif(title, ''), path) AS label, ord, 0 AS k, 0 AS pos FROM titled
  UNION ALL SELECT vault, 'file:' || t, 'file', t, ord, 1, pos FROM (SELECT vault, ord, l.target AS t, pos FROM (SELECT vault, ord, unnest(links) AS l, unnest(range(len(links))) AS pos FROM live)) WHERE t IS NOT NULL
  UNION ALL SELECT vault, 'tag:' || t, 'tag', t, ord, 2, pos FROM (SELECT vault, ord, unnest(tags) AS t, unnest(range(len(tags))) AS pos FROM live) WHERE t IS NOT NULL),
gnodes AS (SELECT vault, id, type, label, ord, k, pos FROM every QUALIFY row_number() OVER (PARTITION BY vault, id, type ORDER BY ord, k, pos, label) = 1),
gedges AS (
  SELECT vault, 'file:' || path AS source, 'file:' || (l.target) AS target, 'link' AS type, ord, pos FROM (SELECT vault, path, ord, unnest(links) AS l, unnest(range(len(links))) AS pos FROM live) WHERE l.target IS NOT NULL
  UNION ALL SELECT vault, 'file:' || path, 'tag:' || t, 'tag', ord, pos FROM (SELECT vault, path, ord, unnest(tags) AS t, unnest(range(len(tags))) AS pos FROM live) WHERE t IS NOT NULL)
"""
_ADJ = "adj AS (SELECT vault, source AS a, target AS b FROM gedges WHERE {0} UNION SELECT vault, target, source FROM gedges WHERE {0})"
_R_LIVE = LIVE.replace("WITH cur", "WITH RECURSIVE cur")
#: The analyzer graph without tags: nodes, and both directions of every edge.
_LINKED = _R_LIVE + ", " + _NODES + ", " + _ADJ.format("type = 'link'").replace("adj AS", "adj AS MATERIALIZED") + ", n AS MATERIALIZED (SELECT vault, id, ord, k, pos FROM gnodes WHERE type = 'file')\n"
_COMPONENTS = """, comp(vault, id, component) USING KEY (vault, id) AS (SELECT vault, id, id FROM n
  UNION SELECT c.vault, a.b, min(c.component) FROM comp c JOIN adj a ON a.vault = c.vault AND a.a = c.id JOIN recurring.comp r ON r.vault = c.vault AND r.id = a.b WHERE c.component < r.component GROUP BY 1, 2)
"""
_DIST = """, first AS (SELECT vault, id FROM n QUALIFY row_number() OVER (PARTITION BY vault ORDER BY ord, k, pos, id) <= 3),
reach(vault, src, node, dist) USING KEY (vault, src, node) AS (SELECT vault, id, id, 0 FROM first
  UNION SELECT DISTINCT d.vault, d.src, a.b, d.dist + 1 FROM reach d JOIN adj a ON a.vault = d.vault AND a.a = d.node LEFT JOIN recurring.reach r ON r.vault = d.vault AND r.src = d.src AND r.node = a.b WHERE r.node IS NULL),
dist AS MATERIALIZED (SELECT vault AS scope, src, node, dist FROM reach)
"""
#: Dependencies of all nodes of each level, the deepest level first; {0} is the gain from a successor.
_BETWEEN = """, link AS MATERIALIZED (SELECT d.scope, d.src, d.node, p.node AS pred, p.dist FROM dist d JOIN sadj a ON a.scope = d.scope AND a.a = d.node JOIN dist p ON p.scope = d.scope AND p.src = d.src AND p.node = a.b AND p.dist = d.dist - 1),
sigma AS (SELECT scope, src, node, dist, 1.0::DOUBLE AS s FROM dist WHERE dist = 0
  UNION ALL SELECT l.scope, l.src, l.node, l.dist + 1, sum(g.s) FROM sigma g JOIN link l ON l.scope = g.scope AND l.src = g.src AND l.pred = g.node GROUP BY 1, 2, 3, 4),
paths AS MATERIALIZED (SELECT scope, src, node, s FROM sigma),
steps AS MATERIALIZED (SELECT l.*, x.s AS up, y.s AS own FROM link l JOIN paths x ON x.scope = l.scope AND x.src = l.src AND x.node = l.pred JOIN paths y ON y.scope = l.scope AND y.src = l.src AND y.node = l.node),
deep AS MATERIALIZED (SELECT max(dist) AS m FROM dist),
dep AS (SELECT scope, src, node, dist, 0.0::DOUBLE AS v FROM dist, deep WHERE dist = m
  UNION ALL SELECT scope, src, node, dist, sum(v) FROM (
    SELECT l.scope, l.src, l.pred AS node, l.dist, {0} AS v FROM dep d JOIN steps l ON l.scope = d.scope AND l.src = d.src AND l.node = d.node
    UNION ALL SELECT p.scope, p.src, p.node, p.dist, 0.0 FROM (SELECT DISTINCT dist AS level FROM dep) z JOIN dist p ON p.dist = z.level - 1) GROUP BY 1, 2, 3, 4),
got AS (SELECT scope, node, sum(v) AS v FROM dep WHERE src <> node GROUP BY 1, 2), size AS (SELECT scope, CAST(count(*) AS DOUBLE) AS c FROM snodes GROUP BY 1)
SELECT n.scope, n.id, round(coalesce(v, 0) * CASE WHEN c > 2 THEN 2 / ((c - 1) * (c - 2)) ELSE 1 END, 6) AS betweenness FROM snodes n JOIN size s ON s.scope = n.scope LEFT JOIN got g ON g.scope = n.scope AND g.node = n.id"""
_GAIN, _GAIN_STANDARD = "1 + d.v", "(1 + d.v) * up / own"
_EIGEN = """, size AS (SELECT scope, 1 / sqrt(count(*)) AS x FROM snodes GROUP BY 1),
power AS (SELECT 0 AS it, n.scope, n.id, x AS score FROM snodes n JOIN size s ON s.scope = n.scope
  UNION ALL SELECT it, scope, id, score / sqrt(sum(score * score) OVER (PARTITION BY scope)) FROM (SELECT p.it + 1 AS it, p.scope, a.b AS id, sum(p.score) AS score FROM power p JOIN sadj a ON a.scope = p.scope AND a.a = p.id WHERE p.it < 100 GROUP BY 1, 2, 3))
SELECT n.scope, n.id, round(CASE WHEN e.scope IS NULL THEN x ELSE coalesce(p.score, 0) END, 6) AS score FROM snodes n JOIN size s ON s.scope = n.scope LEFT JOIN (SELECT DISTINCT scope FROM sadj) e ON e.scope = n.scope
LEFT JOIN power p ON p.it = 100 AND p.scope = n.scope AND p.id = n.id"""
_SCOPED = ", sadj AS MATERIALIZED (SELECT vault AS scope, a, b FROM adj), snodes AS (SELECT vault AS scope, id FROM n)"
_TRADE = """WITH RECURSIVE sold AS (SELECT s_nationkey AS s, c_nationkey AS c, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
top AS (SELECT 'n' || lpad(CAST(s AS VARCHAR), 2, '0') AS a, 'n' || lpad(CAST(c AS VARCHAR), 2, '0') AS b FROM sold QUALIFY row_number() OVER (PARTITION BY s ORDER BY v DESC, c) <= 3),
adj AS MATERIALIZED (SELECT a, b FROM top UNION SELECT b, a FROM top), n AS (SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id, 'r' || n_regionkey AS region FROM nation),
walk AS (SELECT id AS src, id AS node, 0 AS dist FROM n UNION SELECT src, b, dist + 1 FROM walk JOIN adj ON a = node WHERE dist < 12),
dist AS (SELECT 'trade' AS scope, src, node, min(dist) AS dist FROM walk GROUP BY src, node)
"""
_TRADE_SCOPED = _TRADE.replace("dist AS (SELECT 'trade'", "dist AS MATERIALIZED (SELECT 'trade'") + ", sadj AS MATERIALIZED (SELECT 'trade' AS scope, a, b FROM adj), snodes AS (SELECT 'trade' AS scope, id FROM n)"
# The frame of a GEXF file.
_GEXF_HEAD = """'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">' || chr(10) || '  <graph mode="static" defaultedgetype="undirected">' || chr(10) || '    <nodes>'"""
_K = "CASE type WHEN 'link' THEN 1 ELSE 2 END"
_PATH = """, bfs(node, before, depth) USING KEY (node) AS (SELECT s, NULL::VARCHAR, 0 FROM ends
  UNION SELECT a.b, min(a.a), min(d.depth) + 1 FROM bfs d JOIN sadj a ON a.a = d.node LEFT JOIN recurring.bfs r ON r.node = a.b WHERE r.node IS NULL GROUP BY 1),
seen AS MATERIALIZED (SELECT node, before, depth FROM bfs),
back AS (SELECT node, before, depth FROM seen, ends WHERE node = g UNION ALL SELECT b.node, b.before, b.depth FROM back k JOIN seen b ON b.node = k.before)
SELECT depth AS step, node FROM back"""
#: A breadth-first tree; every other edge closes a cycle, found by climbing from its ends; tree edges (by their lower end) of common
#: cycles are a block, those of no cycle are bridges; a node of two blocks is a cut vertex.
_CUTS = """, tree0(vault, node, parent, depth) USING KEY (vault, node) AS (SELECT DISTINCT vault, component, NULL::VARCHAR, 0 FROM comp
  UNION SELECT a.vault, a.b, min(a.a), min(d.depth) + 1 FROM tree0 d JOIN adj a ON a.vault = d.vault AND a.a = d.node LEFT JOIN recurring.tree0 r ON r.vault = a.vault AND r.node = a.b WHERE r.node IS NULL GROUP BY 1, 2),
tree AS MATERIALIZED (SELECT vault, node, parent, depth FROM tree0),
climb AS (SELECT a.vault, a.a AS p, a.b AS q, a.a AS x, a.b AS y, x.depth AS dx, y.depth AS dy, x.parent AS px, y.parent AS py FROM adj a JOIN tree x ON x.vault = a.vault AND x.node = a.a JOIN tree y ON y.vault = a.vault AND y.node = a.b
    WHERE a.a < a.b AND x.parent IS DISTINCT FROM a.b AND y.parent IS DISTINCT FROM a.a
  UNION ALL SELECT c.vault, p, q, CASE WHEN dx >= dy THEN t.node ELSE x END, CASE WHEN dx >= dy THEN y ELSE t.node END, CASE WHEN dx >= dy THEN t.depth ELSE dx END, CASE WHEN dx >= dy THEN dy ELSE t.depth END,
    CASE WHEN dx >= dy THEN t.parent ELSE px END, CASE WHEN dx >= dy THEN py ELSE t.parent END FROM climb c JOIN tree t ON t.vault = c.vault AND t.node = CASE WHEN dx >= dy THEN px ELSE py END WHERE x <> y),
mark AS MATERIALIZED (SELECT DISTINCT vault, p, q, CASE WHEN dx >= dy THEN x ELSE y END AS e FROM climb WHERE x <> y),
star AS (SELECT vault, e, min(e) OVER (PARTITION BY vault, p, q) AS f FROM mark), tie AS MATERIALIZED (SELECT vault, e, f FROM star WHERE e <> f UNION SELECT vault, f, e FROM star WHERE e <> f),
part(vault, e, block) USING KEY (vault, e) AS (SELECT vault, node, node FROM tree WHERE parent IS NOT NULL
  UNION SELECT c.vault, t.f, min(c.block) FROM part c JOIN tie t ON t.vault = c.vault AND t.e = c.e JOIN recurring.part r ON r.vault = c.vault AND r.e = t.f WHERE c.block < r.block GROUP BY 1, 2),
ends2 AS (SELECT t.vault, t.node AS v, block FROM tree t JOIN part b ON b.vault = t.vault AND b.e = t.node UNION ALL SELECT t.vault, t.parent, block FROM tree t JOIN part b ON b.vault = t.vault AND b.e = t.node)
SELECT t.vault AS scope, 'bridge' AS kind, least(t.node, parent) AS a, greatest(t.node, parent) AS b FROM tree t LEFT JOIN (SELECT DISTINCT vault, e FROM mark) m ON m.vault = t.vault AND m.e = t.node WHERE parent IS NOT NULL AND m.e IS NULL
UNION ALL SELECT vault, 'articulation', v, NULL FROM ends2 GROUP BY 1, 3 HAVING count(DISTINCT block) > 1"""
ORACLES = {
    "note_bridges": _LINKED + _COMPONENTS + _CUTS,
    "note_shortest_path": _LINKED
    + ", ends AS (SELECT min(source) AS s, max(source) AS g FROM gedges WHERE type = 'link' AND vault = 'fieldwork'), sadj AS MATERIALIZED (SELECT a, b FROM adj WHERE vault = 'fieldwork')"
    + _PATH,
    "graph_components": _LINKED + _COMPONENTS + "SELECT vault AS scope, id, component FROM comp",
    "graph_stats": _LINKED
    + _COMPONENTS
    + """, c AS (SELECT vault, count(*) AS nodes, count(DISTINCT component) AS components FROM comp GROUP BY 1), e AS (SELECT vault, count(*) AS edges FROM gedges WHERE type = 'link' GROUP BY 1)
SELECT c.vault AS scope, nodes, coalesce(edges, 0) AS edges, components, round(coalesce(CAST(edges AS DOUBLE) / nullif(CAST(nodes AS DOUBLE) * (nodes - 1) / 2, 0), 0), 6) AS density FROM c LEFT JOIN e ON e.vault = c.vault""",
    "note_distances": _LINKED + _DIST + "SELECT scope, src, node, dist FROM dist",
    "note_path_stats": _LINKED
    + _DIST
    + "SELECT scope, coalesce(max(dist) FILTER (dist > 0), 0) AS diameter, count(*) FILTER (dist > 0) AS pairs, round(coalesce(avg(dist) FILTER (dist > 0), 0), 6) AS average FROM dist GROUP BY scope",
    "note_closeness": _LINKED + _DIST + "SELECT scope, src AS id, round(coalesce(CAST(count(*) FILTER (dist > 0) AS DOUBLE) / nullif(sum(dist), 0), 0), 6) AS closeness FROM dist GROUP BY 1, 2",
    "note_betweenness": _LINKED + _DIST + _SCOPED + _BETWEEN.format(_GAIN),
    "note_betweenness_standard": _LINKED + _DIST + _SCOPED + _BETWEEN.format(_GAIN_STANDARD),
    "note_eigenvector": _LINKED + _SCOPED + _EIGEN,
    "trade_betweenness": _TRADE_SCOPED + _BETWEEN.format(_GAIN),
    "trade_betweenness_standard": _TRADE_SCOPED + _BETWEEN.format(_GAIN_STANDARD),
    "trade_eigenvector": _TRADE_SCOPED + _EIGEN,
    "influential_pagerank": "SELECT vault AS scope, node AS id, rank AS score, CAST(row_number() OVER (PARTITION BY vault ORDER BY rank DESC, node) AS INTEGER) AS rank FROM ("
    + _NOTE_SQL["pagerank"]
    + ") QUALIFY row_number() OVER (PARTITION BY vault ORDER BY rank DESC, node) <= 10",
    "export_gexf": LIVE
    + ", "
    + _NODES
    + f""", v AS (SELECT DISTINCT vault FROM gnodes), e AS (SELECT *, {_K} AS k, row_number() OVER (PARTITION BY vault ORDER BY ord, {_K}, pos, target) - 1 AS i FROM gedges)
SELECT vault AS scope, 0 AS section, 0 AS ord, 0 AS k, 0 AS pos, {_GEXF_HEAD} AS line FROM v
UNION ALL SELECT vault, 1, ord, k, CAST(pos AS INTEGER), '      <node id="' || id || '" label="' || label || '" />' FROM gnodes
UNION ALL SELECT vault, 2, 0, 0, 0, '    </nodes>' || chr(10) || '    <edges>' FROM v
UNION ALL SELECT vault, 3, ord, k, CAST(pos AS INTEGER), '      <edge id="' || i || '" source="' || source || '" target="' || target || '" weight="1" />' FROM e
UNION ALL SELECT vault, 4, 0, 0, 0, '    </edges>' || chr(10) || '  </graph>' || chr(10) || '</gexf>' FROM v""",
    "export_json": LIVE
    + ", "
    + _NODES
    + f"""SELECT vault AS scope, 0 AS section, ord, k, CAST(pos AS INTEGER) AS pos, CAST(json_object('kind', 'node', 'id', id, 'type', type, 'label', label) AS VARCHAR) AS line FROM gnodes
UNION ALL SELECT vault, 1, ord, {_K}, CAST(pos AS INTEGER), CAST(json_object('kind', 'edge', 'source', source, 'target', target, 'type', type, 'weight', 1.0::DOUBLE) AS VARCHAR) FROM gedges""",
    "graph_nodes": LIVE + ", " + _NODES + "SELECT vault, id, type, label FROM gnodes",
    "graph_edges": LIVE + ", " + _NODES + "SELECT vault, source, target, type, ord, CAST(pos AS INTEGER) AS pos FROM gedges",
    "graph_degree": LIVE + ", " + _NODES + ", " + _ADJ.format("true") + " SELECT g.vault AS scope, g.id, count(b) AS degree FROM gnodes g LEFT JOIN adj ON adj.vault = g.vault AND a = g.id GROUP BY 1, 2",
    "influential_degree": LIVE
    + ", "
    + _NODES
    + ", "
    + _ADJ.format("type = 'link'")
    + """, d AS (SELECT g.vault AS scope, g.id, count(b) AS score FROM gnodes g LEFT JOIN adj ON adj.vault = g.vault AND a = g.id WHERE g.type = 'file' GROUP BY 1, 2)
SELECT scope, id, score, CAST(row_number() OVER (PARTITION BY scope ORDER BY score DESC, id) AS INTEGER) AS rank FROM d QUALIFY rank <= 10""",
    "trade_distances": _TRADE + "SELECT scope, src, node, CAST(dist AS INTEGER) AS dist FROM dist",
    "trade_path_stats": _TRADE + "SELECT scope, CAST(max(dist) AS INTEGER) AS diameter, count(*) FILTER (dist > 0) AS pairs, round(avg(dist) FILTER (dist > 0), 6) AS average FROM dist GROUP BY scope",
    "trade_closeness": _TRADE + "SELECT scope, src AS id, round(coalesce(CAST(count(*) FILTER (dist > 0) AS DOUBLE) / nullif(sum(dist), 0), 0), 6) AS closeness FROM dist GROUP BY 1, 2",
    "region_modularity": _TRADE
    + """, k AS (SELECT a, CAST(count(*) AS DOUBLE) AS k FROM adj GROUP BY a), m AS (SELECT CAST(count(*) AS DOUBLE) AS m2 FROM adj)
SELECT 'trade' AS scope, round(coalesce(sum((1 - x.k * y.k / m2) / m2), 0), 6) AS modularity FROM adj JOIN k x ON x.a = adj.a JOIN k y ON y.a = adj.b JOIN n p ON p.id = adj.a JOIN n q ON q.id = adj.b, m WHERE p.region = q.region""",
    "region_cohesion": _TRADE
    + """, i AS (SELECT p.region, count(*) AS c FROM adj JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE a < b AND p.region = q.region GROUP BY 1)
SELECT 'trade' AS scope, n.region AS community, count(*) AS members, coalesce(any_value(c), 0) AS internal, round(coalesce(any_value(c) / nullif(count(*) * (count(*) - 1) / 2, 0), 0), 6) AS cohesion FROM n LEFT JOIN i ON i.region = n.region GROUP BY n.region""",
    "trade_shortest_path": _TRADE + ", ends AS (SELECT 'n00' AS s, 'n17' AS g), sadj AS (SELECT a, b FROM adj)" + _PATH,
    "export_dot": LIVE
    + ", "
    + _NODES
    + """, v AS (SELECT DISTINCT vault FROM gnodes) SELECT vault AS scope, 0 AS section, 0 AS ord, 0 AS k, 0 AS pos, 'graph G {' AS line FROM v
UNION ALL SELECT vault, 1, ord, k, CAST(pos AS INTEGER), '  "' || id || '" [label="' || replace(label, '"', '\\"') || '"];' FROM gnodes
UNION ALL SELECT vault, 2, ord, CASE type WHEN 'link' THEN 1 ELSE 2 END, CAST(pos AS INTEGER), '  "' || source || '" -- "' || target || '";' FROM gedges
UNION ALL SELECT vault, 3, 0, 0, 0, '}' FROM v""",
}
