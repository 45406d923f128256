"""Validation of notes: built-in and user-defined rules as tables of findings."""

from __future__ import annotations

import re
import runpy
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.text import headings_of, links_of, plain_text
from notemill.functions.compat import utf16_length

FINDING = "vault string, path string, rule string, severity string, message string, line int, suggestion string, fix string"
#: Required frontmatter, the form of tags, and bounds of the content length.
REQUIRED, TAG_FORM, SHORTEST, LONGEST = ("title", "created", "modified"), r"\A[a-z0-9][a-z0-9-/]*[a-z0-9]\z", 50, 10_000


@dataclass(frozen=True)
class Rule:
    """A rule, for paths that match ``pattern`` (letter case aside).

    ``check`` takes a dict of one note (path, content, frontmatter, tags) and yields dicts with any of severity, message, line,
    suggestion, fix.  ``script`` is a Python file that defines such a ``check``; it is read when the rule is used.  Without either, or
    if the script fails to load, the rule is the built-in of that name.
    """

    name: str
    pattern: str = ".*"
    check: Callable[[dict], Iterator[dict]] | None = None
    script: str | None = None

    def checker(self) -> Callable[[dict], Iterator[dict]] | None:
        """``check``, or the one that the script defines; None where the script cannot be loaded or defines none."""
        if self.check is not None or self.script is None:
            return self.check
        try:
            return runpy.run_path(self.script).get("check")
        except Exception:  # whatever the script does: the built-in of that name is used
            return None


def _finding(rows: DataFrame, rule: str, severity: str, message: Column, line: Column | None = None, suggestion: Column | None = None) -> DataFrame:
    return rows.select(
        "vault", "path", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"), (line if line is not None else F.lit(None)).cast("int").alias("line"),
        (suggestion if suggestion is not None else F.lit(None)).cast("string").alias("suggestion"), F.lit(None).cast("string").alias("fix"),
    )


# The messages and suggestions of the built-in rules below are output values.


def required_frontmatter(notes: DataFrame) -> DataFrame:
    keys = F.map_keys(F.coalesce("frontmatter", F.create_map().cast("map<string,string>")))
    rows = notes.select("vault", "path", F.explode(F.array_except(F.array(*[F.lit(x) for x in REQUIRED]), keys)).alias("f"))
    return _finding(rows, "required-frontmatter", "error", F.concat(F.lit("Missing required frontmatter field: "), "f"), suggestion=F.concat(F.lit("Add "), "f", F.lit(" to frontmatter")))


def valid_links(notes: DataFrame) -> DataFrame:
    rows = notes.select("vault", "path", F.explode(links_of("content")).alias("l")).select("vault", "path", F.col("l.target").alias("t"), F.col("l.line").alias("n"))
    rows = rows.where(~F.col("t").startswith("http") & ~F.col("t").endswith(".md"))
    return _finding(rows, "valid-links", "warning", F.concat(F.lit("Link target should end with .md: "), "t"), suggestion=F.concat(F.lit("Change to "), "t", F.lit(".md")))


def tag_format(notes: DataFrame) -> DataFrame:
    rows = notes.select("vault", "path", F.explode("tags").alias("t")).where(F.col("t").isNotNull() & ~F.col("t").rlike(TAG_FORM))
    return _finding(rows, "tag-format", "warning", F.concat(F.lit("Tag format invalid: "), "t"), suggestion=F.lit("Use lowercase, numbers, hyphens, and forward slashes only"))


def heading_structure(notes: DataFrame) -> DataFrame:
    """Levels that jump down by more than one; within a note's own array, so there is no shuffle."""
    h = F.col("h")
    jumps = F.filter(F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.struct(F.get(h, i - 1)["level"].alias("a"), F.get(h, i)["level"].alias("b"), F.get(h, i)["line"].alias("n"))), lambda x: x["b"] > x["a"] + 1)
    rows = notes.select("vault", "path", headings_of("content").alias("h")).where(F.size("h") > 1).select("vault", "path", F.explode(jumps).alias("j")).select("vault", "path", "j.*")
    text = lambda f, *c: F.format_string(f, *[F.col(x) for x in c])
    return _finding(rows, "heading-structure", "warning", text("Heading level jump from H%d to H%d at line %d", "a", "b", "n"), F.col("n"), F.format_string("Use H%d instead of H%d", F.col("a") + 1, F.col("b")))


def content_length(notes: DataFrame) -> DataFrame:
    rows = notes.select("vault", "path", utf16_length(plain_text("content")).alias("n"))
    short = _finding(rows.where(F.col("n") < SHORTEST), "content-length", "warning", F.format_string(f"Content too short: %d characters (minimum: {SHORTEST})", F.col("n")), suggestion=F.lit("Add more content to provide value"))
    long = _finding(rows.where(F.col("n") > LONGEST), "content-length", "warning", F.format_string("Content very long: %d characters (consider splitting)", F.col("n")), suggestion=F.lit("Consider breaking into multiple files"))
    return short.unionByName(long)


BUILT_IN = {"required-frontmatter": required_frontmatter, "valid-links": valid_links, "tag-format": tag_format, "heading-structure": heading_structure, "content-length": content_length}


def _custom(notes: DataFrame, rule: Rule, check: Callable[[dict], Iterator[dict]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FINDING.split(", ")]
        for pdf in batches:
            out = []
            for n in pdf.to_dict("records"):
                try:
                    found = list(check(n) or [])
                except Exception as e:  # a failing rule is a finding of its note
                    found = [{"severity": "error", "message": f"Rule execution failed: {e}"}]
                for x in found:
                    if not isinstance(x, dict):
                        x = {"severity": "error", "message": "Rule returned invalid result"}
                    out.append({"vault": n["vault"], "path": n["path"], "rule": rule.name, "severity": "warning"} | x)
            yield pd.DataFrame(out, columns=names, dtype=object)

    return notes.select("vault", "path", "content", "frontmatter", "tags").mapInPandas(run, FINDING)


def fits(pattern: str, path: str) -> bool:
    """Whether a rule's pattern is a regex that is found in a path, letter case aside."""
    try:
        return re.search(pattern, path, re.I) is not None
    except re.error:
        return False


def findings(notes: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All findings of the rules that apply to each note's path.  A rule of unknown name warns; a bad pattern skips it."""
    out = None
    for rule in rules:
        try:
            re.compile(rule.pattern)
        except re.error:
            continue
        rows = notes if rule.pattern == ".*" else notes.where(F.col("path").rlike(f"(?iu){rule.pattern}"))
        check = rule.checker()
        if check is not None:
            found = _custom(rows, rule, check)
        elif rule.name in BUILT_IN:
            found = BUILT_IN[rule.name](rows)
        else:
            found = _finding(rows, rule.name, "warning", F.lit(f"Unknown built-in rule: {rule.name}"), suggestion=F.lit("Check rule configuration"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else notes.sparkSession.createDataFrame([], FINDING)


def rollup(notes: DataFrame, found: DataFrame, only_errors: bool = False, rules: Sequence[str] | None = None) -> DataFrame:
    """(vault, path, valid, errors, warnings) per note.  ``only_errors`` keeps notes with an error of any rule, before the
    counts are narrowed to ``rules``."""
    n = lambda s, c: F.count(F.when((F.col("severity") == s) & c, 1))
    wanted = F.col("rule").isin(list(rules)) if rules else F.lit(True)
    per = found.groupBy("vault", "path").agg(n("error", F.lit(True)).alias("_any"), n("error", wanted).alias("errors"), n("warning", wanted).alias("warnings"))
    zero = F.lit(0).cast("bigint")
    out = notes.select("vault", "path").join(per, ["vault", "path"], "left").withColumns({c: F.coalesce(c, zero) for c in ("_any", "errors", "warnings")})
    if only_errors:
        out = out.where("_any > 0")
    return out.select("vault", "path", (F.col("errors") == 0).alias("valid"), "errors", "warnings")


def fixed(notes: DataFrame, found: DataFrame) -> DataFrame:
    """(vault, path, content): each note's content, replaced by the last fix that a finding offers, if any."""
    w = Window.partitionBy("vault", "path").orderBy(F.desc("rule"), F.desc("message"))
    fix = found.where(F.col("fix").isNotNull()).withColumn("r", F.row_number().over(w)).where("r = 1").select("vault", "path", "fix")
    return notes.join(fix, ["vault", "path"], "left").select("vault", "path", F.coalesce("fix", "content").alias("content"))


def missing_fields(notes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(vault, path, field, problem): required frontmatter fields that are missing or null."""
    value = F.try_element_at("frontmatter", F.col("field"))
    has = F.coalesce(F.map_contains_key("frontmatter", F.col("field")), F.lit(False))
    rows = notes.select("vault", "path", "frontmatter", F.explode(F.array(*[F.lit(x) for x in fields])).alias("field"))
    problem = F.when(~has, "missing").when(value.isNull() | (value == "null"), "null")
    return rows.select("vault", "path", "field", problem.alias("problem")).where(F.col("problem").isNotNull())
