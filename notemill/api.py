"""One object over vault folders with a method for each public tool.

Methods that read return DataFrames (lazy) over the index; methods that write act on the files of one vault and refresh
the index rows they changed.  Defaults are those of the tools' schemas.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions.text import plain_text, safe_filename, slash_path, with_md
from notemill.operators import graph as A
from notemill.operators import links as L
from notemill.operators import listing, search, tags, templates, validation
from notemill.operators.embeddings import Provider, best_chunks, embedded, new_vectors
from notemill.operators.notes import index_stats
from notemill.session import cut, drop_cuts
from notemill.sources import vault as V


class NoteEngine:
    """The index of one or several vaults (name -> folder)."""

    def __init__(self, spark: SparkSession, vaults: Mapping[str, str], templates: Sequence[templates.Template] = (), rules: Sequence[validation.Rule] = (), provider: Provider | None = None, chunk_size: int = 1000):
        if not vaults:
            raise ValueError("at least one vault is needed")
        self.default_vault = next(iter(vaults))
        self.max_results, self.threshold, self.weights = 20, 0.0, search.Weights()
        self._known: DataFrame | None = None
        self.spark, self.vaults, self.templates, self.rules, self.provider, self.chunk_size = spark, dict(vaults), list(templates), list(rules), provider, chunk_size
        self.reindex_vault()

    # ---- index -------------------------------------------------------------------------------------------------------
    def reindex_vault(self) -> DataFrame:
        """Read all folders anew; returns the statistics per vault."""
        rows = None
        for name, root in self.vaults.items():
            one = V.read_vault(self.spark, root, name, self.chunk_size)
            rows = one if rows is None else rows.unionByName(one)
        self._set(rows)
        return self.list_vaults()

    def _set(self, rows: DataFrame) -> None:
        self.notes = cut(rows, "index")
        self.edges = cut(L.link_edges(self.notes), "index-links")
        self.nodes = L.link_nodes(self.notes, self.edges)
        self.note_tags = tags.note_tags(self.notes)
        self._ranks: DataFrame | None = None
        self._vectors: DataFrame | None = None

    def add_vault(self, name: str, root: str, default: bool = False) -> None:
        """Take up a further vault; a name in use is refused."""
        if name in self.vaults:
            raise ValueError(f"vault {name} exists")
        self.vaults[name] = root
        self.default_vault = name if default else self.default_vault
        self._set(self.notes.unionByName(V.read_vault(self.spark, root, name, self.chunk_size)))

    def remove_vault(self, name: str) -> None:
        """Forget a vault; its files stay.  The last one cannot go."""
        self._root(name)
        if len(self.vaults) == 1:
            raise ValueError("at least one vault is needed")
        del self.vaults[name]
        self.default_vault = self.default_vault if name != self.default_vault else next(iter(self.vaults))
        self._set(self.notes.where(F.col("vault") != name))

    def close(self) -> None:
        """Drop the index and the tables behind it."""
        drop_cuts()

    def configure(self, max_results: int | None = None, threshold: float | None = None, weights: search.Weights | None = None) -> None:
        """Change the defaults of searches; ranks are made anew."""
        self.max_results = self.max_results if max_results is None else max_results
        self.threshold = self.threshold if threshold is None else threshold
        self.weights = weights or self.weights
        self._ranks = None

    def search_stats(self) -> dict[str, Any]:
        return {"max_results": self.max_results, "threshold": self.threshold, "weights": self.weights, "ranks_kept": self._ranks is not None}

    def update(self, vault: str) -> None:
        """Take up what changed in a vault's folder."""
        own = V.update_index(self.notes.where(F.col("vault") == vault), self.spark, self.vaults[vault], vault, self.chunk_size)
        self._set(self.notes.where(F.col("vault") != vault).unionByName(own))

    def ranks(self) -> DataFrame:
        """PageRank of all nodes, kept until the index changes."""
        if self._ranks is None:
            self._ranks = cut(L.pagerank(self.nodes, self.edges), "index-ranks")
        return self._ranks

    def vectors(self) -> DataFrame:
        if self.provider is None:
            raise ValueError("no embedding provider")
        if self._vectors is None:
            fresh = cut(new_vectors(self.notes, self.provider, known=self._known), "index-new-vectors")
            # what was embedded before, for any state of the notes, is not embedded again
            self._known = fresh if self._known is None else self._known.unionByName(fresh)
            self._vectors = cut(embedded(self.notes, self.provider, known=self._known), "index-vectors")
        return self._vectors

    def _in(self, vault: str | None, rows: DataFrame | None = None) -> DataFrame:
        rows = self.notes if rows is None else rows
        return rows if vault is None else rows.where(F.col("vault") == vault)

    def _root(self, vault: str | None) -> tuple[str, str]:
        name = vault or self.default_vault
        if name not in self.vaults:
            raise KeyError(f"unknown vault {name}")
        return name, self.vaults[name]

    # ---- search ------------------------------------------------------------------------------------------------------
    def _semantic(self, query: str) -> DataFrame | None:
        return best_chunks(self.vectors(), self.provider.embed([query])[0].tolist()) if self.provider and query.strip() else None

    def search_content(self, query: str, vault: str | None = None, filters: search.Filters | None = None, limit: int | None = None, threshold: float | None = None, now: datetime | None = None) -> DataFrame:
        now = now or datetime.now(timezone.utc).replace(tzinfo=None)
        limit, threshold = self.max_results if limit is None else limit, self.threshold if threshold is None else threshold
        return search.search(self._in(vault), query, plain_text("content"), self.ranks(), now, filters, self.note_tags, self._semantic(query), limit, threshold, weights=self.weights)

    def semantic_search(self, query: str, vault: str | None = None, limit: int = 10, threshold: float = 0.7) -> DataFrame:
        best = best_chunks(self._in(vault, self.vectors()), self.provider.embed([query])[0].tolist())
        return best.where(F.col("score") >= threshold).orderBy(F.desc("score"), "vault", "path").limit(limit)

    def text_search(self, query: str, vault: str | None = None, case_sensitive: bool = False, limit: int = 20) -> DataFrame:
        return search.text_search(self._in(vault), query, plain_text("content"), limit, case_sensitive)

    def bulk_search(self, queries: Sequence[str], vault: str | None = None, limit: int = 10, combine: bool = False, threshold: float = 0.0, now: datetime | None = None) -> DataFrame:
        now = now or datetime.now(timezone.utc).replace(tzinfo=None)
        semantic = {q: self._semantic(q) for q in queries}
        return search.bulk_search(self._in(vault), queries, plain_text("content"), self.ranks(), now, semantic, limit, combine, threshold, self.weights)

    # ---- files -------------------------------------------------------------------------------------------------------
    def read_file(self, path: str, vault: str | None = None, metadata: bool = True) -> DataFrame:
        """The note's row; without ``metadata`` its path, content and frontmatter alone."""
        name, _ = self._root(vault)
        rows = self._in(name).where(F.col("path") == path)
        return rows if metadata else rows.select("path", "content", "frontmatter")

    def get_file_metadata(self, path: str, vault: str | None = None) -> DataFrame:
        return listing.file_metadata(self.read_file(path, vault))

    def validate_text(self, path: str, text: str, rules: Sequence[str] | None = None) -> DataFrame:
        files = self.spark.createDataFrame([(path, len(text.encode()), datetime.now(), text)], "path string, size bigint, mtime timestamp, text string")
        found = validation.findings(V.parsed(files, "", self.chunk_size), self.rules)
        return found.where(F.col("rule").isin(list(rules))) if rules else found

    def write_file(self, path: str, content: str, vault: str | None = None, validate_only: bool = False) -> list[str]:
        """Messages of the errors; the file is written when there are none."""
        errors = [r["message"] for r in self.validate_text(path, content).where("severity = 'error'").collect()]
        if not errors and not validate_only:
            name, root = self._root(vault)
            V.write_file(root, path, content)
            self.update(name)
        return errors

    def update_file(self, path: str, content: str, frontmatter: Mapping[str, Any] | None = None, vault: str | None = None, preserve_metadata: bool = True) -> list[str]:
        _, root = self._root(vault)
        old = V.split_text(V.read_file(root, path))[0] if preserve_metadata else {}
        new, body = V.split_text(content)
        values = old | new | dict(frontmatter or {}) | {"modified": datetime.now(timezone.utc).isoformat()}
        return self.write_file(path, V.markdown_text(values, body), vault)

    def create_file(self, path: str, content: str = "", frontmatter: Mapping[str, Any] | None = None, vault: str | None = None, template: str | None = None) -> list[str]:
        """The name is made safe; ``template`` is the pattern of one to use in place of the one that fits the path."""
        name = self.spark.range(1).select(with_md(safe_filename(F.lit(path)))).first()[0]
        chosen = next((t for t in self.templates if t.pattern == template), None)
        if template is not None and chosen is None:
            raise KeyError(f"no template has the pattern {template}")
        template = chosen or templates.template_for(path, self.templates)
        front, body = V.split_text(content)
        text = V.markdown_text(front | dict(frontmatter or {}), body)
        return self.write_file(name, templates.applied(template, text, datetime.now(timezone.utc)) if template else text, vault)

    def delete_file(self, path: str, vault: str | None = None, confirm: bool = False) -> bool:
        if not confirm:
            return False
        name, root = self._root(vault)
        V.delete_file(root, path)
        self.update(name)
        return True

    # ---- tags, links, graph ------------------------------------------------------------------------------------------
    def get_tags(self, vault: str | None = None, sort_by: str = "usage", limit: int = 100) -> DataFrame:
        by = {"usage": F.desc("file_count"), "name": F.asc("tag"), "recent": F.desc("last_seen")}[sort_by]
        return tags.tag_stats(self._in(vault, self.note_tags)).orderBy(by, "vault", "tag").limit(limit)

    def get_files_by_tag(self, wanted: Sequence[str], vault: str | None = None, mode: str = "and") -> DataFrame:
        return tags.files_by_tags(self._in(vault, self.note_tags), wanted, mode)

    def suggest_tags(self, existing: Sequence[str] = (), vault: str | None = None, limit: int = 10) -> DataFrame:
        return tags.suggested_tags(self._in(vault, self.note_tags), existing, limit)

    def get_tag(self, tag: str, vault: str | None = None) -> DataFrame:
        return tags.tag_record(self._in(vault, self.note_tags), tag)

    def get_backlinks(self, path: str, vault: str | None = None, include_content: bool = False) -> DataFrame:
        """With ``include_content`` also title, first 200 characters and tags of the notes at the other ends, where there are any."""
        found = L.backlinks(self._in(vault, self.edges), path)
        if not include_content:
            return found
        title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("path")).alias("title")
        ends = self._in(vault).select("vault", slash_path("path").alias("other"), title, F.substring("content", 1, 200).alias("excerpt"), F.col("tags").alias("other_tags"))
        return found.join(ends, ["vault", "other"], "left").withColumn("title", F.coalesce("title", "other"))

    def find_related(self, path: str, vault: str | None = None, hops: int = 2) -> DataFrame:
        name, _ = self._root(vault)
        start = self.spark.createDataFrame([(name, path.replace("\\", "/").lower())], "vault string, node string")
        out = L.related(self._in(name, self.edges), start, hops)
        return out.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("distance") / hops))

    def find_shortest_path(self, start: str, goal: str, vault: str | None = None, max_depth: int = 6) -> DataFrame:
        return L.shortest_path(self.edges, self._root(vault)[0], start.replace("\\", "/").lower(), goal.replace("\\", "/").lower(), max_depth)

    def get_broken_links(self, vault: str | None = None, suggestions: bool = True) -> DataFrame:
        broken = L.broken_links(self._in(vault, self.edges), self._in(vault, self.nodes))
        if not suggestions:
            return broken
        few = L.link_suggestions(broken, self._in(vault)).groupBy("vault", "target_raw").agg(F.array_sort(F.collect_list(F.struct("rank", "suggestion"))).alias("s"))
        return broken.join(few.select("vault", "target_raw", F.col("s.suggestion").alias("suggestions")), ["vault", "target_raw"], "left")

    def _analyzer(self, vault: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        rows = self._in(vault)
        nodes, edges = A.analyzer_nodes(rows, False), A.analyzer_edges(rows, False)
        at = F.format_string("%020d-%d-%010d", F.col("ord.ord"), F.col("ord.k"), F.col("ord.pos"))
        return nodes.select(F.col("vault").alias("scope"), "id", at.alias("ord")), A.adjacency(edges), edges.withColumnRenamed("vault", "scope")

    def get_graph_stats(self, vault: str | None = None, include_metrics: bool = False) -> DataFrame:
        """Link, note and tag counts with the five greatest hubs and authorities; with metrics also the five of greatest PageRank,
        the communities' modularity, components, bridges and cut vertices."""
        edges, nodes = self._in(vault, self.edges), self._in(vault, self.nodes)
        degree = L.degrees(nodes, edges)
        count = tags.tag_stats(self._in(vault, self.note_tags)).groupBy("vault").agg(F.count(F.lit(1)).alias("tags"))
        out = L.link_stats(edges, degree, L.broken_links(edges, nodes)).join(L.top_linked(degree), "vault", "left").join(count, "vault", "left")
        out = out.join(index_stats(self._in(vault)), "vault", "left").withColumn("tags", F.coalesce("tags", F.lit(0).cast("bigint")))
        if not include_metrics:
            return out
        n, adj, e = self._analyzer(vault)
        com = cut(A.communities(n, adj), "index-communities")
        cuts = A.bridges_and_articulation(n, adj).groupBy("scope").agg(F.count(F.when(F.col("kind") == "bridge", 1)).alias("bridges"), F.count(F.when(F.col("kind") == "articulation", 1)).alias("cut_vertices"))
        top = A.influential(self._in(vault, self.ranks()).select(F.col("vault").alias("scope"), F.col("node").alias("id"), "rank").withColumnRenamed("rank", "pagerank"), "pagerank", 5)
        top = top.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("top_pagerank"))
        for more in (A.graph_stats(n, e, adj).select("scope", "density", "components"), A.modularity(adj, com), com.groupBy("scope").agg(F.count_distinct("community").alias("communities")), cuts, top):
            out = out.join(more.withColumnRenamed("scope", "vault"), "vault", "left")
        return out

    def _link_stats(self, vault: str | None) -> DataFrame:
        edges, nodes = self._in(vault, self.edges), self._in(vault, self.nodes)
        return L.link_stats(edges, L.degrees(nodes, edges), L.broken_links(edges, nodes))

    def get_graph_metrics(self, vault: str) -> dict[str, DataFrame]:
        """Centralities, communities, distances and connectivity of one vault's analyzer graph: V * E work."""
        nodes, adj, edges = self._analyzer(vault)
        dist = cut(A.distances(adj, nodes), "index-distances")
        com = A.communities(nodes, adj)
        return {
            "stats": A.graph_stats(nodes, edges, adj), "degree": A.degree(nodes, adj), "betweenness": A.betweenness(nodes, adj, dist), "closeness": A.closeness(dist), "eigenvector": A.eigenvector(nodes, adj),
            "pagerank": self._in(vault, self.ranks()), "communities": com, "modularity": A.modularity(adj, com), "paths": A.path_stats(dist), "distances": dist, "components": A.components(nodes, adj),
            "cuts": A.bridges_and_articulation(nodes, adj),
        }

    def analyze_communities(self, vault: str | None = None, resolution: float = 1.0) -> DataFrame:
        nodes, adj, _ = self._analyzer(vault)
        return A.communities(nodes, adj, resolution)

    def get_influential_files(self, metric: str = "pagerank", vault: str | None = None, limit: int = 10) -> DataFrame:
        if metric == "pagerank":
            scores = self._in(vault, self.ranks()).select(F.col("vault").alias("scope"), F.col("node").alias("id"), F.col("rank").alias("pagerank"))
            return A.influential(scores, "pagerank", limit)
        nodes, adj, _ = self._analyzer(vault)
        if metric == "degree":
            return A.influential(A.degree(nodes, adj), "degree", limit)
        if metric == "betweenness":
            return A.influential(A.betweenness(nodes, adj, A.distances(adj, nodes)), "betweenness", limit)
        raise ValueError("metric must be pagerank, betweenness or degree")

    def export_graph(self, form: str = "json", vault: str | None = None, tag_nodes: bool = True, min_connections: int = 0, to: str | None = None) -> DataFrame:
        """The lines of the export in order; with ``to`` they are also written there as text, one folder per vault."""
        rows = self._in(vault).where(F.size("links") >= min_connections)
        lines = A.exported(A.analyzer_nodes(rows, tag_nodes), A.analyzer_edges(rows, tag_nodes), form)
        ordered = lines.orderBy("scope", "section", "ord", "k", "pos", "line")
        if to is not None:
            ordered.select("scope", "line").write.partitionBy("scope").text(to)
        return ordered

    # ---- discovery ---------------------------------------------------------------------------------------------------
    def list_vaults(self) -> DataFrame:
        return index_stats(self.notes)

    def list_files(self, vault: str | None = None, pattern: str | None = None, sort_by: str = "modified", limit: int = 50) -> DataFrame:
        return listing.listed(self._in(vault), pattern, sort_by, limit)

    def get_recent_files(self, vault: str | None = None, by: str = "modified", limit: int = 20, since: str | None = None) -> DataFrame:
        return listing.recent(self._in(vault), by, limit, since)

    def get_templates(self, pattern: str | None = None) -> list[dict[str, Any]]:
        return templates.template_info(self.templates, pattern)

    def preview_template(self, path: str, values: Mapping[str, Any] | None = None) -> str | None:
        t = templates.template_for(path, self.templates)
        return templates.created(self.templates, t.pattern, values or {}, datetime.now(timezone.utc)) if t else None

    # ---- rules -------------------------------------------------------------------------------------------------------
    def rules_for(self, path: str) -> list[validation.Rule]:
        """The rules whose pattern fits a path; one that is no regex fits none."""
        return [r for r in self.rules if validation.fits(r.pattern, path)]

    def add_rule(self, rule: validation.Rule) -> None:
        """A rule of the same name is replaced."""
        self.remove_rule(rule.name)
        self.rules.append(rule)

    def remove_rule(self, name: str) -> bool:
        kept = [r for r in self.rules if r.name != name]
        gone, self.rules = len(kept) < len(self.rules), kept
        return gone

    # ---- validation, bulk, health ------------------------------------------------------------------------------------
    def validate_file(self, path: str, vault: str | None = None, rules: Sequence[str] | None = None) -> DataFrame:
        found = validation.findings(self.read_file(path, vault), self.rules)
        return found.where(F.col("rule").isin(list(rules))) if rules else found

    def bulk_validate(self, vault: str | None = None, pattern: str | None = None, rules: Sequence[str] | None = None, only_errors: bool = False) -> DataFrame:
        rows = self._in(vault) if pattern is None else self._in(vault).where(F.col("path").rlike(f"(?iu){pattern}"))
        return validation.rollup(rows, validation.findings(rows, self.rules), only_errors, rules)

    def bulk_tag_operation(self, operation: str, names: Sequence[str], target_tags: Sequence[str] | None = None, vault: str | None = None, filters: search.Filters | None = None, dry_run: bool = True) -> DataFrame:
        """The changed notes; without ``dry_run`` their files are rewritten by the tasks and the index takes them up."""
        name, root = self._root(vault)
        rows = search.filtered(self._in(name), filters, self.note_tags)
        changes = cut(tags.bulk_tags(rows, operation, names, target_tags), "bulk-tags")
        if not dry_run:
            changes.foreachPartition(V.tag_rewriter(root, datetime.now(timezone.utc).isoformat()))
            self.update(name)
        return changes

    def analyze_vault_health(self, vault: str | None = None) -> DataFrame:
        rows = self._in(vault)
        vectors = self._in(vault, self.vectors()) if self.provider else self.spark.createDataFrame([], "vault string, path string")
        return listing.vault_health(rows, self._link_stats(vault), tags.tag_stats(self._in(vault, self.note_tags)), index_stats(rows, vectors))
