"""A join on string containment without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.session import cut

#: Length of the grams that needles and haystacks meet on.
GRAM = 6


def _grams(text: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    count = F.length(text) - n + 1
    return F.when(count >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def contained(needles: DataFrame, haystacks: DataFrame, order: str | None = None, limit: int | None = None) -> DataFrame:
    """(scope, needle, hay): pairs of one scope in which the haystack contains the needle.

    ``needles`` (scope, needle) and ``haystacks`` (scope, hay) are distinct strings.  Each needle is looked up under its one
    gram that fewest haystacks have; a needle shorter than a gram under itself, with haystacks posting grams of just
    the short lengths that occur.  The empty needle is in every haystack and is left out.

    With ``order`` (a column of the haystacks) and ``limit`` only a needle's first haystacks are asked for: a needle that is a
    gram itself, and may be in very many, then meets no more than so many; others may give more than the limit.
    """
    lengths = [r["n"] for r in needles.select(F.least(F.length("needle"), F.lit(GRAM)).alias("n")).distinct().collect() if r["n"]]  # at most GRAM rows
    if not lengths:
        return needles.join(haystacks, "scope").select("scope", "needle", "hay").where(F.lit(False))
    held = [] if order is None else [order]
    posts = cut(haystacks.select("scope", "hay", *held, F.explode(F.flatten(F.array(*[_grams(F.col("hay"), n) for n in sorted(lengths)]))).alias("gram")), "contained-grams")
    df = posts.groupBy("scope", "gram").agg(F.count(F.lit(1)).alias("df"))
    own = needles.where(F.length("needle") > 0).select("scope", "needle", F.explode(_grams(F.col("needle"), F.least(F.length("needle"), F.lit(GRAM)))).alias("gram"))
    # a gram that no haystack has rules the needle out
    rare = own.join(df, ["scope", "gram"], "left").groupBy("scope", "needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0).cast("bigint")).alias("df"), "gram")).alias("g"))
    key = rare.where("g.df > 0").select("scope", "needle", F.col("g.gram").alias("gram"))
    if order is None or limit is None:
        return key.join(posts, ["scope", "gram"]).where(F.contains("hay", F.col("needle"))).select("scope", "needle", "hay")
    whole = F.col("needle") == F.col("gram")
    w = Window.partitionBy("scope", "gram").orderBy(order)
    first = posts.join(key.where(whole).select("scope", "gram"), ["scope", "gram"], "left_semi").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")
    rest = key.where(~whole).join(posts, ["scope", "gram"]).where(F.contains("hay", F.col("needle")))
    return key.where(whole).join(first, ["scope", "gram"]).select("scope", "needle", "hay").unionByName(rest.select("scope", "needle", "hay"))
