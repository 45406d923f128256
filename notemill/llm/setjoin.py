"""All similar pairs between set-valued records: an extended-prefix join.

Sets are ordered by a global token order (rarest first).  If two sets x, y have Jaccard similarity >= t, they share at
least ``ceil(t * max(|x|, |y|))`` tokens, so for every l >= 1 their *l-prefixes* (the first ``n - ceil(t n) + l`` tokens of a
set of n) share at least l tokens.  A longer prefix (larger l) makes more postings per record, but a candidate must
share l tokens at once.  The join posts every combination of l prefix tokens and joins on equal combinations.

The level l is chosen adaptively for each size of the *smaller* set by a cost estimate over all records: postings made
plus candidates expected from the token frequencies.  A record posts for every level that a partner of admissible size
may ask for, and a pair counts only at the level of its smaller set, so each pair meets at one level exactly.

Skew: exact copies are collapsed to one representative first; rare tokens come first, so a token that a third of all
records hold is reached only by sets made of such tokens; posting lists longer than ``block`` are cut into blocks, and
pairs of blocks are joined in separate tasks.  No pair is dropped.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.llm.blocks import in_cells, met, pairs_within
from notemill.operators.skew import HOT_SHARE, join_unique
from notemill.session import cut

#: The levels considered, and the longest prefix (tokens) for which a level above 1 may post all combinations.
LEVELS = (1, 2, 3)
LONGEST = {1: None, 2: 24, 3: 10}
#: Posting lists above this length are joined block by block.
BLOCK = 2000


def _need(n: Column, t: float) -> Column:
    """ceil(t * n) without falling for rounding (t has at most 6 decimals)."""
    p = round(t * 1_000_000)
    return F.floor((n.cast("bigint") * p + 999_999) / 1_000_000).cast("int")


def classes(records: DataFrame, id_col: str, set_col: str, min_size: int = 1) -> DataFrame:
    """(id, class_id, tokens): the sorted distinct non-null tokens of each record and the class of its exact copies.

    The class is the MD5 of the token list, so membership takes no join and no shuffle.  Null arrays are empty sets;
    sets below ``min_size`` distinct tokens are left out.
    """
    tokens = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(set_col), F.array().cast("array<string>")), lambda x: x.isNotNull())))
    # the length before each token keeps ('ab','c') and ('a','bc') apart
    flat = F.array_join(F.transform(F.col("tokens"), lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), "")
    out = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), tokens.alias("tokens"))
    return out.where(F.size("tokens") >= max(1, min_size)).select("id", F.unhex(F.md5(flat)).alias("class_id"), "tokens")


def _ordered(sets: DataFrame) -> DataFrame:
    """(class_id, n, toks, dfs): 64-bit token codes, rarest token first, with their document frequencies."""
    each = sets.select("class_id", F.explode(F.transform("tokens", lambda x: F.xxhash64(x))).alias("tok"))
    df = each.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    df = cut(df, "setjoin-frequencies")
    # a hot token is one that makes up a two-hundredth of all, so there are fewer than that; they are looked up first
    total = df.agg(F.sum("df")).first()[0] or 0
    hot = F.broadcast(df.where(F.col("df") * HOT_SHARE > total))
    each = each.join(hot, "tok").unionByName(each.join(hot, "tok", "left_anti").join(df, "tok"))
    ranked = each.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("o"))
    return ranked.select("class_id", F.size("o").alias("n"), F.col("o.tok").alias("toks"), F.col("o.df").alias("dfs"))


def _prefix(n: Column, t: float, level: int) -> Column:
    return F.least(n, n - _need(n, t) + level)


def _power_sum(values: Column, k: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.pow(x, F.lit(float(k))))


def choose_levels(ordered: DataFrame, t: float) -> dict[int, int]:
    """The level for each set size that occurs: one aggregate over all records, one row per distinct size.

    The cost of level l for a record: the combinations it posts, plus the candidates it may meet, estimated from the
    token frequencies df as the sum over its combinations of N * prod(df / N).
    """
    total = ordered.agg(F.count(F.lit(1)).alias("records"))
    costs = []
    for level in LEVELS:
        p = _prefix(F.col("n"), t, level)
        f = F.transform(F.slice("dfs", F.lit(1), p), lambda d: d / F.col("records"))
        # elementary symmetric sums by Newton's identities
        s = [None, *[_power_sum(f, k) for k in (1, 2, 3)]]
        e = {1: s[1], 2: (s[1] * s[1] - s[2]) / 2, 3: (s[1] * s[1] * s[1] - 3 * s[1] * s[2] + 2 * s[3]) / 6}[level]
        posts = {1: p, 2: p * (p - 1) / 2, 3: p * (p - 1) * (p - 2) / 6}[level]
        cost = 3.0 * posts + F.col("records") * F.greatest(e, F.lit(0.0))
        if LONGEST[level]:
            cost = F.when((p <= LONGEST[level]) & (F.col("n") - _need(F.col("n"), t) + level <= F.col("n")), cost).otherwise(F.lit(float("inf")))
        costs.append(F.avg(cost).alias(f"c{level}"))
    rows = ordered.join(F.broadcast(total)).groupBy("n").agg(*costs).collect()  # one row per set size
    return {r["n"]: min(LEVELS, key=lambda k: (r[f"c{k}"], k)) for r in rows}


def _postings(ordered: DataFrame, t: float, levels: dict[int, int]) -> DataFrame:
    """(level, key, class_id, n) for each combination a record posts."""
    parts = []
    for level in sorted(set(levels.values())):
        # the sizes that meet a smaller partner of this level: m <= n <= m / t
        sizes = sorted(n for n in levels if any(levels[m] == level for m in levels if m <= n and m * 1_000_000 >= n * round(t * 1_000_000)))
        p = _prefix(F.col("n"), t, level)
        # a token that one record alone has pairs nobody
        pre = F.filter(F.slice("toks", F.lit(1), p), lambda x, i: F.get("dfs", i) > 1)
        rows = ordered.where(F.col("n").isin(sizes)).withColumn("pre", pre).where(F.size("pre") >= level)
        if level == 1:
            keys = F.col("pre")
        else:
            rows = rows.withColumn("ix", F.sequence(F.lit(0), F.size("pre") - 1))
            keys = _combos(level)
        # as many shared tokens as the whole set has: the level cannot exceed what the prefix holds
        parts.append(rows.select(F.lit(level).alias("level"), F.explode(keys).alias("key"), "class_id", "n"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _combos(level: int) -> Column:
    """Codes of all combinations of ``level`` prefix tokens (their order is global, so equal sets give equal codes)."""
    pre = F.col("pre")
    if level == 2:
        return F.flatten(F.transform("ix", lambda i: F.transform(F.slice(pre, i + 2, F.size(pre)), lambda b: F.xxhash64(F.get(pre, i), b))))
    return F.flatten(
        F.flatten(
            F.transform(
                "ix",
                lambda i: F.transform(
                    F.filter("ix", lambda j: j > i),
                    lambda j: F.transform(F.slice(pre, j + 2, F.size(pre)), lambda c: F.xxhash64(F.get(pre, i), F.get(pre, j), c)),
                ),
            )
        )
    )


def similar_classes(sets: DataFrame, t: float) -> DataFrame:
    """(class_a, class_b, shared, size_a, size_b) for all pairs of different classes with Jaccard similarity >= t.

    ``sets`` has (class_id, tokens), unique by class, tokens distinct.
    """
    p = round(t * 1_000_000)
    if not 0 < p <= 1_000_000:
        raise ValueError("the similarity must be above 0 and at most 1")
    ordered = cut(_ordered(sets), "setjoin-ordered")
    levels = choose_levels(ordered, t)
    empty = "class_a binary, class_b binary, shared int, size_a int, size_b int"
    if not levels:
        return ordered.sparkSession.createDataFrame([], empty)
    # only numbers travel, no tokens
    posts = cut(_postings(ordered, t, levels), "setjoin-postings")
    cells = in_cells(posts, ["level", "key"], "class_id", BLOCK)
    small_level = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    a, b = cells.alias("a"), cells.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("level", "key", "i", "j")]
    size_ok = (F.col("a.n") * 1_000_000 >= F.col("b.n") * p) & (F.col("b.n") * 1_000_000 >= F.col("a.n") * p)
    at_level = F.element_at(small_level, F.least("a.n", "b.n")) == F.col("a.level")
    # a pair that meets under several combinations is one candidate
    pairs = a.join(b, [*on, F.col("a.class_id") < F.col("b.class_id"), met("a", "b"), size_ok, at_level]).select(F.col("a.class_id").alias("class_a"), F.col("b.class_id").alias("class_b")).distinct()
    # token codes are hashes, the tokens themselves decide
    return _verified(cut(pairs, "setjoin-candidates"), sets.select("class_id", F.col("tokens").alias("set")), t)


def _verified(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """(class_a, class_b, shared, size_a, size_b) of the pairs with similarity >= t; ``sets`` (class_id, set) is unique by class."""
    p = round(t * 1_000_000)
    for x in ("a", "b"):
        # one class may be a partner of very many
        pairs = join_unique(pairs, sets.select(F.col("class_id").alias(f"class_{x}"), F.col("set").alias(f"set_{x}")), [f"class_{x}"])
        if x == "a":
            pairs = cut(pairs, "setjoin-candidates")
    sizes = pairs.select("class_a", "class_b", F.size(F.array_intersect("set_a", "set_b")).alias("shared"), F.size("set_a").alias("size_a"), F.size("set_b").alias("size_b"))
    return sizes.where(F.col("shared").cast("bigint") * 1_000_000 >= (F.col("size_a") + F.col("size_b") - F.col("shared")).cast("bigint") * p)


def similar_pairs(records: DataFrame, id_col: str, set_col: str, threshold: float, min_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs of classes) for one table of records.

    membership: (id, class_id) for every record of at least ``min_size`` distinct tokens; records of one class have
    equal sets.  pairs: (class_a, class_b, shared, size_a, size_b).  For two tables, union them under distinct ids.
    An empty table gives empty results; repeated rows of an id count once when their sets agree.
    """
    rows = cut(classes(records, id_col, set_col, min_size), "setjoin-classes")
    sets = cut(rows.groupBy("class_id").agg(F.first("tokens").alias("tokens")), "setjoin-sets")
    return rows.select("id", "class_id").distinct(), similar_classes(sets, threshold)


def expanded(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of records, within classes and between similar ones."""
    x, y = members.select(F.col("id").alias("x"), F.col("class_id").alias("class_a")), members.select(F.col("id").alias("y"), F.col("class_id").alias("class_b"))
    across = pairs.select("class_a", "class_b").join(x, "class_a").join(y, "class_b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return across.unionByName(pairs_within(cut(members, "setjoin-members"), "class_id", "id"))
