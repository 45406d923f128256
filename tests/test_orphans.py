from datetime import datetime as D

from notemill.operators.orphans import PARENT_COLUMNS, REF_COLUMNS, OrphanState, advance, orphans, replay, snapshot
from notemill.operators.order import numbered
from notemill.operators.skew import hot_keys, join_unique


def refs(spark, *rows):
    return spark.createDataFrame([("t", "f", i, "s", k, at) for i, k, at in rows], REF_COLUMNS)


def parents(spark, *rows):
    return spark.createDataFrame([("s", k, o, v, live, at) for k, o, v, live, at in rows], PARENT_COLUMNS)


def reasons(state):
    return {r["ref_id"]: r["reason"] for r in state.refs.collect()}


T1, T2, T3 = D(2024, 1, 1), D(2024, 2, 1), D(2024, 3, 1)


def test_arrivals_resolve_and_deletions_reopen(spark):
    first = (refs(spark, (1, "a", T2), (2, "b", T2), (3, None, T2), (4, "c", None)), parents(spark, ("a", "o", 1, True, T1)))
    state = replay(spark, [first])
    assert reasons(state) == {1: None, 2: "missing", 3: "missing", 4: "missing"}
    state = advance(state.saved(), None, parents(spark, ("b", "p", 1, True, T3), ("c", "q", 1, True, T3)))
    assert reasons(state) == {1: None, 2: "late", 3: "missing", 4: None}
    state = advance(state.saved(), refs(spark, (5, "a", T3), (1, "a", T2)), parents(spark, ("a", "o", 2, False, T1)))
    assert reasons(state) == {1: "deleted", 2: "late", 3: "missing", 4: None, 5: "deleted"}
    # an older version that is delivered late changes nothing, nor does a repeated batch
    again = advance(state.saved(), refs(spark, (5, "a", T3)), parents(spark, ("a", "o", 1, True, T1)))
    assert reasons(again) == reasons(state)
    assert {(r["seen_month"], r["missing"], r["deleted"], r["late"]) for r in snapshot(again).collect()} == {("2024-02", 1, 1, 1), ("2024-03", 0, 1, 0), (None, 0, 0, 0)}
    assert orphans(again).count() == 4


def test_any_split_into_batches_gives_the_same(spark):
    r = [(i, "k%d" % (i % 7), T2) for i in range(60)] + [(i, "hot", T1) for i in range(60, 120)]
    p = [("k%d" % i, "o%d" % i, v, v != 3, T1 if i % 2 else T3) for i in range(5) for v in range(i)] + [("hot", "h", 1, True, T2)]
    whole = reasons(replay(spark, [(refs(spark, *r), parents(spark, *p))]))
    parts = [(refs(spark, *r[i::3]), parents(spark, *p[i::3])) for i in (2, 0, 1)]
    assert reasons(replay(spark, parts)) == whole
    assert whole[60] == "late" and whole[6] == "missing"


def test_empty_tables(spark):
    state = replay(spark, [(refs(spark), parents(spark))])
    assert orphans(state).count() == 0
    assert advance(OrphanState.empty(spark), refs(spark, (1, "x", T1)), None, first=True).refs.count() == 1


def test_hot_keys_join_without_loss(spark):
    left = spark.createDataFrame([("hot" if i % 3 else None if i % 2 else f"k{i}", i) for i in range(900)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("zz", 3)], "k string, v int")
    got = join_unique(left, right, ["k"])
    assert got.count() == 900 and got.where("v = 1").count() == 600 and got.where("v = 2").count() == 1
    assert {r["k"] for r in hot_keys(left, ["k"]).collect()} == {"hot", None}


def test_numbers_follow_the_order_across_partitions(spark):
    rows = [("hot" if i % 5 else f"s{i % 3}", (i * 37) % 1000) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "scope string, k int").repartition(7), "scope", ["k"], "n").collect()
    for scope in {s for s, _ in rows}:
        mine = sorted((r["n"], r["k"]) for r in got if r["scope"] == scope)
        assert [n for n, _ in mine] == list(range(len(mine))) and [k for _, k in mine] == sorted(k for s, k in rows if s == scope)
