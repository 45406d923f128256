import numpy as np
from pyspark.sql import functions as F

from notemill.llm import permindex as P

SCHEMA = "vec_id bigint, model string, vec array<float>, dimension int"


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(n // 2, n):
        x[i] = x[rng.integers(n // 2)] + 0.15 * rng.standard_normal(dim) * rng.random()
    return x.astype(np.float32)


def exact(ids, x, k, least):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    out = set()
    for i in range(len(ids)):
        best = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if s[i, j] >= least)[:k]
        out |= {(ids[i], b) for _, b in best}
    return out


def run(spark, rows, k, least):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("space", F.lit(1)).withColumn("id", F.lit("x"))
    return {(r["a"], r["b"]): r["cos"] for r in P.nearest(P.prepared(df, "vec_id", ["model"], "vec", "dimension"), k, least).collect()}


def test_close_neighbours_are_found(spark):
    x, y = clustered(1500, 32, 1), clustered(300, 16, 2)
    rows = [(i, "m", v.tolist(), 32) for i, v in enumerate(x)] + [(10_000 + i, "n", (v * 7).tolist(), 16) for i, v in enumerate(y)]
    got = run(spark, rows, 5, 0.85)
    want = exact(list(range(1500)), x, 5, 0.85) | exact([10_000 + i for i in range(300)], y, 5, 0.85)
    assert set(got) == want
    assert all(c >= 0.85 for c in got.values()) and max(sum(1 for a, _ in got if a == i) for i in range(50)) <= 5


def test_recall_at_k_on_queries(spark):
    """Five neighbours of every twentieth vector, most of them far: recall of at least 0.9 against brute force."""
    x = clustered(3000, 64, 3)
    x[7::50] = x[7]
    df = spark.createDataFrame([(i, "m", v.tolist(), 64) for i, v in enumerate(x)], SCHEMA)
    rows = P.prepared(df, "vec_id", ["model"], "vec", "dimension")
    got = P.nearest_to(rows, rows.where("id % 20 = 0").select("id"), 5).collect()
    assert all(sum(1 for r in got if r["a"] == i) == 5 for i in range(0, 3000, 20))
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    good = 0
    for r in got:
        s = u @ u[r["a"]]
        s[r["a"]] = -9
        good += s[r["b"]] >= np.sort(s)[-5] - 1e-9
    assert good >= 0.9 * len(got)
    # with everything reranked the result is exact
    want = exact(list(range(3000)), x, 5, 0.9)
    assert {(r["a"], r["b"]) for r in P.nearest_to(rows, rows.where("id % 20 = 1").select("id"), 5, 1.0, 0.9).collect()} == {(a, b) for a, b in want if a % 20 == 1}
    assert P.nearest_to(rows.where("id < 0"), rows.where("id < 0").select("id"), 5).count() == 0


def test_blocks_of_long_files_lose_nothing(spark, monkeypatch):
    x = clustered(400, 8, 4)
    rows = [(i, "m", v.tolist(), 8) for i, v in enumerate(x)]
    whole = run(spark, rows, 5, 0.9)
    monkeypatch.setattr(P, "BLOCK", 20)
    assert set(run(spark, rows, 5, 0.9)) >= set(whole)


def test_rounding_loses_no_neighbour(spark):
    """A tight group, closer to each other than 16-bit numbers tell apart."""
    rng = np.random.default_rng(7)
    x = (np.ones((60, 48)) + 5e-3 * rng.standard_normal((60, 48))).astype(np.float32)
    got = run(spark, [(i, "m", v.tolist(), 48) for i, v in enumerate(x)], 3, 0.85)
    assert set(got) == exact(list(range(60)), x, 3, 0.85)


def test_copies_get_the_copies_of_lowest_id(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "m", [1.0, 2.0, 3.0], 3) for i in range(40)] + [(100 + i, "m", rng.standard_normal(3).astype(np.float32).tolist(), 3) for i in range(30)]
    got = run(spark, rows + rows[:5], 3, 0.9999)
    for i in range(40):
        assert {b for a, b in got if a == i} == {j for j in range(4) if j != i} - ({3} if i > 3 else set())


def test_invalid_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "m", [1.0, 0.0], 2), (2, "m", [2.0, 0.0], 2), (3, "m", [nan, 1.0], 2), (4, "m", [0.0, 0.0], 2), (5, "m", None, 2), (6, "m", [1.0], 2), (7, None, [1.0, 0.0], 2), (None, "m", [1.0, 0.0], 2), (8, "m", [inf, 0.0], 2), (9, "m", [1.0, 0.0], None)]
    assert set(run(spark, rows, 5, 0.5)) == {(1, 2), (2, 1)}
    assert run(spark, [], 5, 0.5) == {}


def test_footrule_equals_its_definition():
    rng = np.random.default_rng(6)
    perms = np.array([rng.permutation(30)[:10] for _ in range(60)], np.int16)
    shared = P.footrule_shared(perms[:10], perms)
    for i in range(10):
        for j in range(60):
            a, b = {p: k for k, p in enumerate(perms[i])}, {p: k for k, p in enumerate(perms[j])}
            foot = sum(abs(a.get(p, 10) - b.get(p, 10)) for p in a.keys() | b.keys())
            assert foot == 10 * 11 - 2 * int(shared[i, j])
