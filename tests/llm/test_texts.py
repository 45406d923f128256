import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notemill.llm import leaks, mix, spans, split, winnow


# ---- splitting --------------------------------------------------------------------------------------------------------
def size(text, unit):
    return {"chars": len(text), "utf8_bytes": len(text.encode()), "utf16_units": len(text.encode("utf-16-le")) // 2}[unit]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab. \n!é😀́"), max_size=300), st.sampled_from(split.UNITS), st.integers(5, 40), st.integers(0, 4))
def test_pieces_cover_overlap_and_fit(text, unit, limit, overlap):
    pieces = split.cut_text(text, unit, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (s, e), (s2, e2) in zip(pieces, pieces[1:], strict=False):
        assert s < s2 <= e < e2
        # the overlap gives way only where it does not fit beside one more character
        assert overlap <= size(text[s2:e], unit) <= overlap + 3 or s2 == s + 1 or overlap + 3 + size(text[e], unit) > limit
    assert all(size(text[s:e], unit) <= limit for s, e in pieces)


def test_cuts_prefer_natural_boundaries():
    text = "one two three.\n\nfour five. six seven eight nine ten"
    assert [text[s:e] for s, e in split.cut_text(text, "chars", 30, 0)] == ["one two three.\n\n", "four five. six seven eight ", "nine ten"]
    assert split.cut_text("x" * 10, "chars", 4, 1) == [(0, 4), (3, 7), (6, 10)]
    assert split.cut_text("", "chars", 4, 1) == [(0, 0)]
    with pytest.raises(ValueError):
        split.cut_text("abc", "chars", 2, 2)


def test_split_table(spark):
    long = "word " * 60_000
    rows = [(1, "abc def ghi", 5, "chars", 1), (2, None, 5, "chars", 1), (3, "", 5, "chars", 1), (4, "abcdef", None, "chars", 1), (5, "abcdef", 5, "pages", 1), (6, "éééé", 5, "utf8_bytes", 9), (7, long, 100, "utf16_units", None)]
    df = spark.createDataFrame(rows, "k bigint, text string, lim int, unit string, ov int").withColumn("size", F.lit("clash")).withColumn("piece", F.lit(0))
    out = split.split_oversized(df, ["k"], "text", "lim", "unit", "ov").collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["k"], r["piece_ix"])):
        by.setdefault(r["k"], []).append(r)
    assert [r["piece"] for r in by[1]] == ["abc ", " def ", " ghi"]
    assert 2 not in by and [r["piece"] for r in by[3]] == [""] and not by[4][0]["oversized"] and not by[5][0]["oversized"]
    assert by[6][0]["size"] == 8 and all(len(r["piece"].encode()) <= 5 for r in by[6])
    assert "".join(r["piece"] for r in by[7]) == long
    assert split.split_oversized(df.where("k > 9"), ["k"], "text", "lim", "unit", "ov").count() == 0


# ---- shared spans -----------------------------------------------------------------------------------------------------
def brute_spans(texts, n):
    windows = {i: {t[k : k + n] for k in range(len(t) - n + 1)} for i, t in texts.items() if t}
    ids = sorted(windows)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if windows[a] & windows[b]}


def brute_cover(texts, n):
    owners = {}
    for i, t in texts.items():
        for k in range(len(t or "") - n + 1):
            owners.setdefault(t[k : k + n], set()).add(i)
    out = {}
    for i, t in texts.items():
        covered = set()
        for k in range(len(t or "") - n + 1):
            if len(owners[t[k : k + n]]) > 1:
                covered.update(range(k, k + n))
        out[i] = len(covered)
    return out


def span_texts(seed, alphabet="abcdefgh é😀\n"):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [word(rng.randrange(15, 60)) for _ in range(6)]
    texts = {i: word(rng.randrange(0, 80)) + rng.choice(shared)[rng.randrange(5) :] + word(rng.randrange(0, 60)) for i in range(60)}
    return texts | {100: texts[0], 101: texts[0], 102: "", 103: None, 104: "a" * 300, 105: "b" + "a" * 200, 106: "ab" * 150}


@pytest.mark.parametrize("hot", [1000, 2])
def test_spans_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    n = 24
    texts = span_texts(3)
    df = spark.createDataFrame(list(texts.items()), "doc bigint, txt string").withColumn("win", F.lit(1)).withColumn("class", F.lit(2))
    members, pairs, covered = spans.shared_spans(df, "doc", "txt", n)
    rep = {}
    for r in members.orderBy("id").collect():
        rep.setdefault(bytes(r["class"]), []).append(r["id"])
    of = {v[0]: v for v in rep.values()}
    got = {(min(x, y), max(x, y)) for r in pairs.collect() for x in of[r["a"]] for y in of[r["b"]]} | {(x, y) for v in of.values() for x in v for y in v if x < y}
    assert got == brute_spans(texts, n)
    shared = {r["a"]: r["shared"] for r in spans.covered_chars(covered).collect()}
    want = brute_cover({v[0]: texts[v[0]] for v in of.values()}, n)
    assert {i: shared.get(i, 0) for i in want} == want


def test_no_spans(spark):
    df = spark.createDataFrame([(1, "short"), (2, None), (None, "x" * 50)], "doc bigint, txt string")
    members, pairs, covered = spans.shared_spans(df, "doc", "txt", 24)
    assert members.count() == pairs.count() == covered.count() == 0


def test_winnowing_keeps_shared_windows():
    rng = random.Random(1)
    common = "".join(rng.choice("ab") for _ in range(40))
    a, b = "xx" + common + "yyy" * 9, "zzzzzz" + common + "w"
    picks = []
    for t in (a, b):
        cp = winnow.code_points(t)
        picks.append(set(winnow.winnowed(cp, winnow.np.array([0, len(cp)]), 21, 20)[2].tolist()))
    assert picks[0] & picks[1]


# ---- leaks ------------------------------------------------------------------------------------------------------------
def edits_at(p, t):
    """The least edits between p and a stretch of t that ends at each place."""
    row, out = list(range(len(p) + 1)), []
    for w in t:
        prev, row = row, [0]
        for i, x in enumerate(p):
            row.append(min(prev[i] + (x != w), prev[i + 1] + 1, row[i] + 1))
        out.append(row[-1])
    return out


def test_myers_equals_dynamic_programming():
    rng = random.Random(5)
    for _ in range(300):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 40))]
        t = [rng.randrange(4) for _ in range(rng.randrange(0, 90))]
        half = rng.randrange(1, len(item) + 1)
        budget = rng.randrange(0, half)
        starts = range(rng.randrange(0, len(item) - half + 1), len(item) - half + 1)
        want = {i for s in starts for i, d in enumerate(edits_at(item[s : s + half], t)) if d <= budget}
        assert leaks.Stretches(item, half, budget, starts).ends(t) == sorted(want)


@pytest.mark.parametrize("errors", [0.15, 0.4])
def test_pieces_and_runs_lose_no_stretch(monkeypatch, errors):
    """What all stretches of all items find in whole documents, the matcher finds, at every length of items."""
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in "kmptw" for b in ("abo", "eno", "ozo", "uto")]
    items = [(n, [rng.choice(vocabulary) for _ in range(n)]) for n in range(1, 45)]
    m = leaks.Matcher([(i, " ".join(ws)) for i, ws in items], errors)
    for _ in range(6):
        words = [rng.choice(vocabulary) for _ in range(30)]
        for i, ws in rng.sample(items, 12):
            at = rng.randrange(len(ws) // 2 + 1)
            words += [w if rng.random() > errors else rng.choice([*vocabulary, "x"]) for w in ws[at : at + rng.randrange(len(ws) // 3, len(ws)) + 1]]
        doc = leaks.folded(" ".join(words))
        ids = leaks.np.array([m.vocabulary.get(w, 0) for w in doc])
        got = {}
        for length in m.runs:
            for n, lo, hi in m._regions(ids, length):
                got.setdefault(n, set()).update({lo + e for s in m._stretches(n) for e in s.ends(ids[lo:hi].tolist())})
        for n in range(len(m.ids)):
            half, budget, _ = m.size[n]
            item = m.numbers[n].tolist()
            want = {e for s in range(len(item) - half + 1) for e, d in enumerate(edits_at(item[s : s + half], ids.tolist())) if d <= budget}
            assert want <= got.get(n, set()), (n, half, budget)


@pytest.mark.parametrize("script", ["abcdefghijklmnoprstuvéäñ", "абвгдежзийклмнопрстуфхцчшыьэюя", "αβγδεζηθικλμνξοπρστυφχψωάέή", "ابتثجحخدذرزسشصضطظعغفقكلمن", "".join(map(chr, range(0x4E00, 0x5200)))])
def test_recall_by_script_and_length(script):
    rng = random.Random(4)
    han = len(script) > 100
    word = lambda: rng.choice(script) if han else "".join(rng.choice(script) for _ in range(rng.randrange(2, 9)))
    vocabulary = [word() for _ in range(2000)]
    some = lambda n: [vocabulary[int(2000 * rng.random() ** 2)] for _ in range(n)]
    space = "" if han else " "
    for low, high in ((5, 7), (8, 20), (21, 70)):
        items = [(i, some(rng.randrange(low, high + 1))) for i in range(60)]
        m = leaks.Matcher([(i, space.join(ws)) for i, ws in items])
        good = 0
        for i, ws in items:
            # words misread, replaced, left out or put in
            part = [{0: [w[:-1] + word()[0]], 1: some(1), 2: [], 3: [w, *some(1)]}[rng.randrange(4)] if rng.random() < 0.2 else [w] for w in ws]
            words = some(60) + [x for ws in part for x in ws] + some(60)
            text = "\n".join(f"{n}\n00:00:01,000 --> 00:00:02,000\n{space.join(words[n : n + 7])}\n" for n in range(0, len(words), 7))
            good += i in {d for d, _ in m.found(leaks.speech(text))}
        assert good >= 0.9 * len(items), (low, good)


def test_folding():
    assert leaks.folded("Größe café") == leaks.folded("GrÃ¶ÃŸe cafÃ©") == leaks.folded("Gr\u00f6\u00dfe cafe\u0301")
    assert leaks.folded("Привет, МИР!") == leaks.folded("привет мир".encode().decode("latin-1")) == leaks.folded("Приве\u0301т мир") != []
    assert len(leaks.folded("你好世界。")) == 4 and leaks.folded("ＡＢＣ") == leaks.folded("abc") and leaks.folded("♪ ™ «»") == []
    assert leaks.folded("приzвет") == leaks.folded("привет") and leaks.folded("talkжing") == leaks.folded("talking")
    assert leaks.speech("see more at some.example\nhello there.\n[x] mail me@some\nfine") == leaks.folded("hello there fine")


def test_a_damaged_word_at_the_end_counts():
    ws = [f"{a}{b}{c}" for a in "pqwt" for b in ("amo", "umo") for c in ("nat", "kor", "xul", "vez", "gam")]
    m = leaks.Matcher([(1, " ".join(ws))])
    half = ws[:20]
    noise = ["zzz"] * 30
    for damaged in ("tumogan", "tumogarn"):
        assert [i for i, _ in m.found(leaks.folded(" ".join(noise + half[:-1] + [damaged] + noise)))] == [1]
    assert m.found(leaks.folded(" ".join(noise + half[:14] + noise))) == []


def subtitle(words, rng, damage=0.0, roll=False):
    lines = [" ".join(words[i : i + 6]) for i in range(0, len(words), 6)]
    out = []
    for n, line in enumerate(lines):
        if rng.random() < damage:
            line = line.upper() if rng.random() < 0.3 else line.replace("m", "rn").replace("d", "cl")
        shown = [lines[n - 1], line] if roll and n else [line]
        out.append(f"{n + 1}\n00:00:{n % 60:02d},000 --> 00:00:{n % 60:02d},900\n" + "\n".join(shown) + ("\n[door creaks]" if n % 3 == 0 else "") + "\n")
    return "\n".join(out)


def test_planted_leaks_are_found_and_quotations_are_not(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["na", "vo", "di", "mor", "tel", "ku", "sel"]) for _ in range(rng.randrange(2, 4)))
    items = {i: [word() for _ in range(40)] for i in range(12)}
    docs, want = [], set()
    for d in range(60):
        noise = [word() for _ in range(80)]
        i = d % 12
        kind = d % 4
        if kind == 0:
            body = noise[:40] + items[i] + noise[40:]
        elif kind == 1:
            at = rng.randrange(0, 12)
            body = noise[:30] + [w if rng.random() > 0.1 else "uh" for w in items[i][at : at + 28]] + noise[30:]
        elif kind == 2:
            body = noise[:40] + items[i][5:15] + noise[40:]
        else:
            body = noise
        docs.append((d, subtitle(body, rng, 0.3, roll=d % 3 == 0)))
        if kind < 2:
            want.add((d, i))
    docs += [(100, None), (101, ""), (102, "x " * 100_000)]
    rows = [(i, " ".join(w).capitalize() + ".") for i, w in items.items()] + [(50, None), (51, ""), (52, "♪ ..."), (0, " ".join(items[0]).capitalize() + ".")]
    got = leaks.leaks(spark.createDataFrame(docs, "doc bigint, words string"), spark.createDataFrame(rows, "item bigint, t string"), "doc", "words", "item", "t")
    assert {(r["doc"], r["item"]) for r in got.collect()} == want
    none = spark.createDataFrame([], "item bigint, t string")
    assert leaks.leaks(spark.createDataFrame(docs, "doc bigint, words string"), none, "doc", "words", "item", "t").count() == 0


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEMS", 2)
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(500)}x" for _ in range(20))) for i in range(5)]
    docs = spark.createDataFrame([(i, "intro words\n" + t) for i, t in items], "doc bigint, t string")
    got = leaks.leaks(docs, spark.createDataFrame(items, "item bigint, t string"), "doc", "t", "item", "t")
    assert {(r["doc"], r["item"]) for r in got.collect()} == {(i, i) for i in range(5)}


# ---- mixes ------------------------------------------------------------------------------------------------------------
def test_plan_fills_up_to_caps():
    p = mix.plan(1000, {"a": 100, "b": 700, "c": 200}, {"a": (0.5, 2), "b": (0.3, 1), "c": (0.2, 4), "d": (0.0, 9)})
    assert p["a"].demand == 200 and p["b"].demand == pytest.approx(480) and p["c"].demand == pytest.approx(320) and p["d"].demand == 0
    short = mix.plan(1000, {"a": 100}, {"a": (1.0, 3)})
    assert short["a"].demand == 300


def test_schedules_keep_their_mean(spark):
    for shape in ([(0.0, 0.2), (1.0, 0.6)], [(0.0, 1.0), (0.5, 0.0), (1.0, 3.0)], [(0.0, 0.0), (1.0, 0.0)]):
        t = [r["t"] for r in spark.range(101).select(mix.inverse_time(F.col("id") / 100.0, shape).alias("t")).collect()]
        assert t == sorted(t) and t[0] == pytest.approx(0, abs=1e-9) and t[-1] == pytest.approx(1)
    mid = spark.range(1).select(mix.inverse_time(F.lit(0.5), [(0.0, 0.2), (1.0, 0.6)]).alias("t")).first()["t"]
    assert 0.2 * mid + 0.2 * mid * mid == pytest.approx(0.2)


def test_mix_reaches_its_shares(spark):
    rng = random.Random(4)
    docs = [(i, "abc"[0 if i % 3 == 0 else 1 if i % 3 == 1 else 2] if i < 900 else "rare", rng.randrange(5, 50)) for i in range(930)] + [(2000, None, 40), (2001, "other", 40), (2002, "a", 0), (None, "a", 7), (3, "a", 1)]
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 1), ("c", 0.1, 1), ("rare", 0.1, 2), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    counts = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint").withColumn("copy", F.lit("clash"))
    draw, report = mix.mixed(counts, targets)
    rows = draw.orderBy("start_token").collect()
    total = sum(t for i, _, t in docs if i is not None) - 1
    assert abs(sum(r["tokens"] for r in rows) - total) < 200
    at = 0
    for r in rows:
        assert r["start_token"] == at
        at += r["tokens"]
    seen = {(r["doc_id"], r["copy"]) for r in rows}
    assert len(seen) == len(rows) and not {2000, 2001, 2002} & {r["doc_id"] for r in rows}
    got = {r["source"]: r for r in report.collect()}
    assert got["rare"]["drawn_tokens"] == got["rare"]["available_tokens"] * 2 and got["rare"]["most_copies"] == 2
    assert got["absent"]["drawn_tokens"] == 0
    for s in "abc":
        assert got[s]["most_copies"] <= got[s]["max_repeats"] and abs(got[s]["drawn_tokens"] - got[s]["planned_tokens"]) <= 25
    again = [tuple(r) for r in mix.mixed(counts.repartition(5), targets)[0].orderBy("start_token").collect()]
    assert again == [tuple(r) for r in rows]


def test_empty_mix(spark):
    counts = spark.createDataFrame([], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    draw, report = mix.mixed(counts, targets)
    assert draw.count() == 0 and report.first()["drawn_tokens"] == 0


def test_token_counts(spark):
    tok = pytest.importorskip("public_tokenizers")
    import tiktoken

    df = spark.createDataFrame([(1, "Hello world <|endoftext|>", "s"), (2, None, None), (3, "", "s")], "doc_id bigint, text string, source string")
    path = tok.path("byte_bpe_50k.tiktoken")
    got = {r["doc_id"]: r["tokens"] for r in mix.token_counts(df, "doc_id", "text", ["source"], path, tok.PATTERN).collect()}
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == {1: len(enc.encode_ordinary("Hello world <|endoftext|>")), 2: 0, 3: 0}
