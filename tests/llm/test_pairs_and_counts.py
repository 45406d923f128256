import random

from pyspark.sql import functions as F

from notemill.llm import cooccur, setjoin


def brute_pairs(sets, t, least):
    ids = [i for i in sorted(sets) if len(sets[i]) >= least]
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def found_pairs(df, t, least):
    members, pairs = setjoin.similar_pairs(df, "id", "items", t, least)
    return [(r["a"], r["b"]) for r in setjoin.expanded(members, pairs).collect()]


def random_sets(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    sets = {}
    for i in range(n):
        if sets and rng.random() < 0.5:
            base = set(rng.choice(list(sets.values())))
            for _ in range(rng.randrange(3)):
                (base.discard if rng.random() < 0.5 else base.add)(rng.choice(words))
            sets[i] = base
        else:
            sets[i] = set(rng.choices(words, weights, k=rng.randrange(0, 14)))
    return sets


def test_pairs_equal_brute_force(spark):
    for seed, t, least in ((1, 0.6, 4), (2, 0.5, 1), (3, 0.9, 2)):
        sets = random_sets(220, seed)
        df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id bigint, items array<string>")
        got = found_pairs(df, t, least)
        assert len(got) == len(set(got)) and set(got) == brute_pairs(sets, t, least)


def test_long_lists_are_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 7)
    sets = {i: {"a", "b", "c", "d", f"x{i}"} for i in range(40)} | {100 + i: {"a", "b", "c", "d"} for i in range(5)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id bigint, items array<string>")
    got = found_pairs(df, 0.6, 4)
    assert len(got) == len(set(got)) and set(got) == brute_pairs(sets, 0.6, 4)


def test_odd_sets(spark):
    rows = [(1, ["a", None, "a", "b"]), (1, ["b", "a"]), (2, ["b", "a", "a"]), (3, None), (4, []), (None, ["a", "b"]), (5, ["ab", ""]), (6, ["a", "b" * 100_000])]
    df = spark.createDataFrame(rows, "id bigint, items array<string>").withColumn("class_id", F.lit(1)).withColumn("n", F.lit("x"))
    assert found_pairs(df, 0.5, 1) == [(1, 2)]
    assert found_pairs(df.where("id > 90"), 0.5, 1) == []


def test_levels_adapt_to_frequencies(spark):
    def level(rows):
        df = spark.createDataFrame(rows, "id bigint, items array<string>")
        return setjoin.choose_levels(setjoin._ordered(setjoin.classes(df, "id", "items").select("class_id", "tokens")), 0.6)

    rng = random.Random(9)
    # tokens that nobody shares need no combinations; tokens that a tenth of all hold do
    assert level([(i, [f"q{i}_{j}" for j in range(7)]) for i in range(300)]) == {7: 1}
    assert level([(i, rng.sample([f"c{j}" for j in range(70)], 7)) for i in range(600)])[7] > 1


def brute_counts(records):
    n, pairs = {}, {}
    for s in records:
        for a in s:
            n[a] = n.get(a, 0) + 1
            for b in s:
                if a < b:
                    pairs[a, b] = pairs.get((a, b), 0) + 1
    return n, pairs


def test_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "RUN", 500)  # many runs
    sets = list(random_sets(400, 7).values())
    n, pairs = brute_counts(sets)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id bigint, items array<string>")
    for small in (200_000, 0):  # broadcast and shuffled dictionary
        monkeypatch.setattr(cooccur, "BROADCAST_ITEMS", small)
        rows = cooccur.cooccurrence(df, "id", "items").collect()
        assert {(r["item_a"], r["item_b"]): r["n_ab"] for r in rows} == pairs
        r = max(rows, key=lambda r: r["n_ab"])
        a, b, ab, t = n[r["item_a"]], n[r["item_b"]], r["n_ab"], len(sets)
        assert r["total"] == t and abs(r["lift"] - ab * t / a / b) < 1e-9
        assert abs(r["odds_ratio"] - (ab + 0.5) * (t - a - b + ab + 0.5) / (a - ab + 0.5) / (b - ab + 0.5)) < 1e-9
    least = cooccur.cooccurrence(df, "id", "items", min_count=20, min_share=10).collect()
    assert {(r["item_a"], r["item_b"]) for r in least} == {p for p, c in pairs.items() if c >= 40}


def test_odd_records_and_code_point_order(spark):
    rows = [(1, ["￿", "\U0001f600", None, "￿"]), (2, None), (3, []), (4, ["x"]), (5, ["￿", "\U0001f600"])]
    df = spark.createDataFrame(rows, "id bigint, items array<string>").withColumn("item", F.lit(1)).withColumn("num", F.lit(2))
    r = cooccur.cooccurrence(df, "id", "items").collect()
    assert [(x["item_a"], x["item_b"], x["n_ab"], x["total"]) for x in r] == [("￿", "\U0001f600", 2, 5)]
    assert cooccur.cooccurrence(df.where("id > 9"), "id", "items").count() == 0


def test_one_huge_record(spark):
    df = spark.createDataFrame([(1, [f"i{k:05d}" for k in range(2100)])], "id bigint, items array<string>")
    assert cooccur.cooccurrence(df, "id", "items").count() == 2100 * 2099 // 2
