"""The most similar vectors for every vector: a permutation index.

A vector is represented by its ``LISTED`` nearest pivots in order of nearness (a truncated permutation), and posted in
the inverted file of each of them.  Within a file, the others are ranked by the footrule distance between
permutations (a pivot missing from one counts as the position after the last), and the best are reranked by cosine.

With the weight w = LISTED - position (0 if missing), the footrule of two permutations is LISTED * (LISTED + 1) minus twice
the sum over pivots of min(w_a, w_b), so the ranking needs only that sum.

Pivots are drawn from a bounded sample and grow with the square root of a space's vectors, so a file's length does as well
and the work of all files as N ** 1.5; every vector is indexed.  A space is a (model, dimension).  Copies of a vector beyond
the ``k + 1`` of lowest id are left out of the index and get their neighbours, which are the copies of lowest id, by a join; so
copies cannot flood an inverted file.  Files with more than ``BLOCK`` entries are cut into blocks and every pair of blocks is
compared in its own task, so no entry is dropped.

Postings carry their vectors as 16-bit integers with a scale.  Each cosine of such vectors comes with a bound of its error,
and what may be among the k best within that error is kept until the exact cosines decide: a file loses nobody by rounding.
What the index itself may miss, a partner that shares no pivot or ranks low in every file shared, :func:`nearest_to` with
``share=1`` finds: it compares all queries with all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions.keys import valid_vector
from notemill.llm.streams import fixed_rows, groups
from notemill.operators.skew import join_unique
from notemill.session import cut

#: Pivots per space: so many times the square root of its vectors, within these bounds.
MIN_PIVOTS, MAX_PIVOTS, PER_ROOT = 32, 1 << 17, 12
#: Spaces that one index may hold: models and dimensions, each with a sample on the driver.
MAX_SPACES = 1000
#: Length of the permutations; of a file's entries, so many and this share are reranked by cosine for each query.
LISTED, RERANKED, SHARE = 10, 96, 0.7
BLOCK = 4096
#: Steps of a component of the shipped vectors to either side.
STEPS = 32767


def prepared(vectors: DataFrame, id_col: str, space_cols: list[str], vec_col: str, dim_col: str) -> DataFrame:
    """(id, space, vec, copy): the valid vectors, once per id; vectors of one space and ``copy`` are equal in all values.

    Of rows that repeat an id with other values, the one with the greatest vector counts.
    """
    ok = vectors.where(F.col(id_col).isNotNull() & valid_vector(vec_col, dim_col))
    space = F.to_json(F.struct(*space_cols, dim_col))
    rows = ok.select(F.col(id_col).cast("bigint").alias("id"), space.alias("space"), F.col(vec_col).cast("array<float>").alias("vec"))
    rows = rows.groupBy("id").agg(F.max(F.struct("vec", "space")).alias("r")).select("id", "r.space", "r.vec")
    return rows.withColumn("copy", F.struct(F.xxhash64("space", "vec").alias("x"), F.hash("vec", "space").alias("y")))


def _without_copies(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with ``rank``, for the k + 1 copies of lowest id; Spark prunes the others before the shuffle."""
    w = Window.partitionBy("copy").orderBy("id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)


def fit_pivots(rows: DataFrame) -> dict[str, np.ndarray]:
    """Unit pivots of each space, the vectors of lowest hash; at most ``MAX_PIVOTS`` per space go to the driver."""
    sizes = {r["space"]: r["count"] for r in rows.groupBy("space").count().limit(MAX_SPACES + 1).collect()}
    if len(sizes) > MAX_SPACES:
        raise ValueError(f"more than {MAX_SPACES} models and dimensions")
    want = {s: int(min(MAX_PIVOTS, max(MIN_PIVOTS, PER_ROOT * n**0.5), n)) for s, n in sizes.items()}
    spark = rows.sparkSession
    if not want:
        return {}
    # a hash threshold that lets about twice as many pass, then the lowest of each space
    share = spark.createDataFrame([(s, min(1.0, 2 * want[s] / sizes[s] + 40 / sizes[s])) for s in want], "space string, share double")
    dice = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(2**31)) / F.lit(float(2**31))
    some = rows.join(F.broadcast(share), "space").withColumn("dice", dice).where("dice < share").select("space", "dice", "id", "vec").toArrow().combine_chunks()
    spaces, dice, ids = np.array(some.column("space").to_pylist(), object), some.column("dice").to_numpy(), some.column("id").to_numpy()
    out = {}
    for s, m in want.items():
        own = np.flatnonzero(spaces == s)
        own = own[np.lexsort((ids[own], dice[own]))][:m]
        vec = some.column("vec").take(pa.array(own))
        out[s] = _unit(vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec)
    return out


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    """The ``listed`` nearest pivots of each row, nearest first (fewer if there are fewer pivots)."""
    sims = x @ pivots.T
    listed = min(listed, len(pivots))
    if listed < len(pivots):
        near = np.argpartition(-sims, listed - 1, axis=1)[:, :listed]
    else:
        near = np.tile(np.arange(len(pivots)), (len(x), 1))
    order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable")
    return np.take_along_axis(near, order, 1).astype(np.int32)


def packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as 16-bit integers, and the length of one step for each."""
    step = (np.abs(x).max(axis=1) / STEPS).astype(np.float32)
    return np.rint(x / step[:, None]).clip(-STEPS, STEPS).astype(np.int16), step


def unpacked(x: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors again, and how far a cosine may be off for each of two: half a step in every component, and rounding."""
    return x.astype(np.float32) * step[:, None], (step * (x.shape[1] ** 0.5 / 2) + 2e-6).astype(np.float32)


def permutations(rows: DataFrame, pivots: dict[str, np.ndarray], listed: int = LISTED) -> DataFrame:
    """(id, space_ix, perm, ints, step): truncated permutations (int32) and packed unit vectors as binary."""
    spaces = sorted(pivots)
    index = {s: i for i, s in enumerate(spaces)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.array(b.column(1).to_pylist(), object)
            for s in dict.fromkeys(names):
                rows_at = np.flatnonzero(names == s)
                size = max(16, min(1024, (1 << 24) // len(pivots[s])))
                for at in range(0, len(rows_at), size):
                    ix = pa.array(rows_at[at : at + size])
                    x = _unit(b.column(2).take(ix))
                    perm = nearest_pivots(x, pivots[s], listed)
                    ints, step = packed(x)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(ix), pa.array(np.full(len(x), index[s], np.int32)), pa.array([p.tobytes() for p in perm], pa.binary()), pa.array([v.tobytes() for v in ints], pa.binary()), pa.array(step)],
                        ["id", "space_ix", "perm", "ints", "step"],
                    )

    return rows.select("id", "space", "vec").mapInArrow(run, "id bigint, space_ix int, perm binary, ints binary, step float")


def footrule_shared(perm: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Sum over pivots of min(w_a, w_b) for each row of ``perm`` and each of ``others``: the greater, the nearer."""
    listed = perm.shape[1]
    known, flat = np.unique(others, return_inverse=True)
    table = np.zeros((len(known) + 1, len(others)), np.uint8)  # the last row: pivots that no other has
    weights = np.arange(listed, 0, -1, dtype=np.uint8)
    table[flat.reshape(others.shape), np.arange(len(others))[:, None]] = weights
    at = np.minimum(np.searchsorted(known, perm), len(known) - 1)
    at[known[at] != perm] = len(known)
    out = np.zeros((len(perm), len(others)), np.uint8)
    for j in range(listed):
        out += np.minimum(table[at[:, j]], weights[j])
    return out


def _candidates(cos: np.ndarray, err: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Where a cosine (of a query per row) may be among the k best and at least ``least``, its error being at most ``err``."""
    low = cos - err
    if k < cos.shape[1]:
        least = np.maximum(np.partition(low, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k, None], least)
    return np.nonzero((cos + err >= least) & (cos > -8))


def _list_pairs(q: tuple, x: tuple, k: int, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, entry, cosine, error) of what may be the best k of ``x`` for each of ``q`` (ids, perms, vectors, errors):
    footrule first, cosine over the best."""
    (qi, qp, qv, qe), (xi, xp, xv, xe) = q, x
    step = max(1, 2_000_000 // max(1, len(xi)))
    c = min(max(RERANKED, int(SHARE * len(xi))), len(xi))
    for at in range(0, len(qi), step):
        rows = slice(at, at + step)
        near = footrule_shared(qp[rows], xp).astype(np.int16)
        near[qi[rows, None] == xi[None, :]] = -1
        # a product of matrices beats gathering most of a file; what ranks below the cut does not count (ties with it do)
        cos = qv[rows] @ xv.T
        cos[(near < np.partition(near, len(xi) - c, axis=1)[:, len(xi) - c, None]) | (near < 0)] = -9
        err = qe[rows, None] + xe[None, :]
        r, j = _candidates(cos, err, k, least)
        yield qi[rows][r], xi[j], cos[r, j], err[r, j]


def _near_batch(a: np.ndarray, b: np.ndarray, near: np.ndarray, err: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(near.astype(np.float32)), pa.array(err.astype(np.float32))], ["a", "b", "near", "err"])


_NEAR = "a bigint, b bigint, near float, err float"


def _members(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    vec, err = unpacked(fixed_rows(t.column("ints"), "int16"), t.column("step").to_numpy())
    return t.column("side").to_numpy(), t.column("id").to_numpy(), fixed_rows(t.column("perm"), "int32"), vec, err


def _search_lists(k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, ["file", "i", "j"]):
            side, *cols = _members(t)
            # side: 1 a query, 2 an entry, 3 both
            q, x = (side & 1) > 0, (side & 2) > 0
            if not q.any() or not x.any():
                continue
            for found in _list_pairs(tuple(c[q] for c in cols), tuple(c[x] for c in cols), k, least):
                yield _near_batch(*found)

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        lens = np.diff(b.column(2).offsets.to_numpy())
        for n in np.unique(lens):
            ix = pa.array(np.flatnonzero(lens == n))
            x, y = (b.column(c).take(ix).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ix), -1) for c in (2, 3))
            cos = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(ix), b.column(1).take(ix), pa.array(cos)], ["a", "b", "cos"])


def _exact(near: DataFrame, kept: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b, cos): the k best of each a among the candidates (a, b, near, err), by exact cosine, then by id."""
    best = near.groupBy("a", "b").agg(F.max("near").alias("near"), F.max("err").alias("err"))
    low = Window.partitionBy("a").orderBy(F.desc(F.col("near") - F.col("err")), "b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kth = F.nth_value(F.col("near") - F.col("err"), k).over(low)
    best = cut(best.withColumn("kth", kth).where(F.col("kth").isNull() | (F.col("near") + F.col("err") >= F.col("kth"))).select("a", "b"), "permindex-near")
    # one vector may be near to very many
    vec = kept.select("id", "vec")
    pairs = join_unique(best, vec.select(F.col("id").alias("b"), F.col("vec").alias("vb")), ["b"]).join(vec.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a")
    exact = pairs.select("a", "b", "va", "vb").mapInArrow(_cosines, "a bigint, b bigint, cos double").where(F.col("cos") >= least)
    w = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    return exact.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("a", "b", "cos")


def _of_copies(rows: DataFrame, k: int, asked: DataFrame | None = None) -> DataFrame:
    """(a, b, cos) of the copies left out of the index: their neighbours are the k copies of lowest id."""
    few = _without_copies(rows.select("id", "copy"), k)
    rest = rows.select("id", "copy")
    rest = (rest if asked is None else rest.join(asked, "id", "left_semi")).join(few.select("id"), "id", "left_anti")
    # k rows of each copy, as one list: a copy that a third of all rows are is a hot key of a unique table
    lists = few.where(F.col("rank") <= k).groupBy("copy").agg(F.collect_list("id").alias("bs"))
    rest = cut(rest.withColumns({"x": F.col("copy")["x"], "y": F.col("copy")["y"]}).drop("copy"), "permindex-copies")
    lists = lists.select(F.col("copy")["x"].alias("x"), F.col("copy")["y"].alias("y"), "bs")
    return join_unique(rest, lists, ["x", "y"]).select(F.col("id").alias("a"), F.explode("bs").alias("b"), F.lit(1.0).alias("cos"))


def nearest(rows: DataFrame, k: int, least: float = -2.0) -> DataFrame:
    """(a, b, cos): for every vector a of :func:`prepared` its k most similar others b with cosine >= least, best first by
    cosine, then by id.

    Approximate: a neighbour is found if it shares one of the ``LISTED`` nearest pivots with a and ranks within
    ``RERANKED`` or ``SHARE`` of the entries by footrule in such a file; :func:`nearest_to` with ``share=1`` is exact.  Copies are
    exact.  A space of one vector gives nothing.
    """
    rows = cut(rows, "permindex-vectors")
    kept = cut(_without_copies(rows, k).drop("rank"), "permindex-kept")
    spark = rows.sparkSession
    pivots = fit_pivots(kept)
    if not pivots:
        return spark.createDataFrame([], "a bigint, b bigint, cos double")
    perms = cut(permutations(kept, pivots), "permindex-perms")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [np.frombuffer(x.as_py(), np.int32).astype(np.int64) + int(s) * MAX_PIVOTS for x, s in zip(b.column(1), b.column(0).to_numpy(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.list_(pa.int64())), *b.columns[1:]], ["files", "perm", "id", "ints", "step"])

    held = ["id", "perm", "ints", "step"]
    posts = perms.select("space_ix", "perm", "id", "ints", "step").mapInArrow(listed, "files array<bigint>, perm binary, id bigint, ints binary, step float")
    posts = posts.select(F.explode("files").alias("file"), *held)
    # at most as many rows as pivots
    long = cut(posts.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "permindex-long")
    posts = posts.join(F.broadcast(long), "file", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    posts = posts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = lambda i, j, side: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"))
    cells = F.explode(F.when(F.col("own") == F.col("other"), F.array(cell("own", "own", 3))).otherwise(F.array(cell("own", "other", 1), cell("other", "own", 2))))
    posts = posts.withColumn("c", cells).select("file", "c.i", "c.j", "c.side", *held)
    near = posts.repartition("file", "i", "j").sortWithinPartitions("file", "i", "j").mapInArrow(_search_lists(k, least), _NEAR)
    top = _exact(near, kept, k, least)
    return top.unionByName(_of_copies(rows, k).where(F.lit(1.0) >= least))


#: Searches of a query set: pivots and length of the permutations, share of an index block that is reranked by cosine.
SEARCH_PIVOTS, SEARCH_LISTED, SEARCH_SHARE = 256, 64, 0.1
QUERY_BLOCK, INDEX_BLOCK = 1 << 16, 8192


def _search_blocks(k: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups(batches, ["space_ix", "i", "j"]):
            side, ids, perm, vec, err = _members(t)
            q, x = side == 1, side == 2
            if not q.any() or not x.any():
                continue
            listed = perm.shape[1]
            # the inverted files of this block: the weight of every entry by pivot
            files = np.zeros((SEARCH_PIVOTS, int(x.sum())), np.uint8)
            files[perm[x], np.arange(files.shape[1])[:, None]] = np.arange(listed, 0, -1, dtype=np.uint8)
            qi, qp, qv, qe, xi, xv, xe = ids[q], perm[q], vec[q], err[q], ids[x], vec[x], err[x]
            c = min(len(xi), max(RERANKED, -int(-share * len(xi) // 1)))
            for at in range(0, len(qi), 128):
                p = qp[at : at + 128]
                if c < len(xi):
                    near = np.zeros((len(p), len(xi)), np.uint16)
                    for n in range(listed):
                        near += np.minimum(files[p[:, n]], np.uint8(listed - n))
                    cand = np.argpartition(near, len(xi) - c, axis=1)[:, len(xi) - c :]
                    cos = np.einsum("qd,qcd->qc", qv[at : at + 128], xv[cand])
                else:
                    cand = np.tile(np.arange(len(xi)), (len(p), 1))
                    cos = qv[at : at + 128] @ xv.T
                cos[xi[cand] == qi[at : at + 128, None]] = -9
                e = qe[at : at + 128, None] + xe[cand]
                r, n = _candidates(cos, e, k, -2.0)
                yield _near_batch(qi[at + r], xi[cand[r, n]], cos[r, n], e[r, n])

    return run


def nearest_to(rows: DataFrame, queries: DataFrame, k: int, share: float = SEARCH_SHARE, least: float = -2.0) -> DataFrame:
    """(a, b, cos): for each query (id, a subset of the rows) its k most similar others among all rows of its space, with
    cosine >= least.

    Long permutations (``SEARCH_LISTED`` of ``SEARCH_PIVOTS`` pivots) rank every row by footrule, and ``share`` of each index
    block is reranked, so that neighbours are found also where none is close; with ``share=1`` the result is exact.  Queries and
    rows meet in blocks, each block of the index having its own inverted files; the index is copied once for every
    ``QUERY_BLOCK`` queries.
    """
    rows = cut(rows, "permindex-vectors")
    kept = cut(_without_copies(rows, k).drop("rank"), "permindex-kept")
    pivots = {s: p[:SEARCH_PIVOTS] for s, p in fit_pivots(kept).items()}
    spark = rows.sparkSession
    if not pivots:
        return spark.createDataFrame([], "a bigint, b bigint, cos double")
    perms = cut(permutations(kept, pivots, SEARCH_LISTED), "permindex-perms")
    wanted_ids = queries.select("id").distinct()
    asked = perms.join(wanted_ids, "id", "left_semi")
    # one row for each space
    sizes = {r["space_ix"]: r["count"] for r in perms.groupBy("space_ix").count().collect()}
    wanted = {r["space_ix"]: r["count"] for r in asked.groupBy("space_ix").count().collect()}

    def blocks(of: dict, size: int) -> F.Column:
        return F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for s in sizes for x in (s, -(-of.get(s, 0) // size) or 1)]), F.col("space_ix")), F.lit(1))

    nq, nx = blocks(wanted, QUERY_BLOCK), blocks(sizes, INDEX_BLOCK)
    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    q = asked.withColumn("i", own(nq, 1)).withColumn("j", F.explode(F.sequence(F.lit(0), nx - 1))).withColumn("side", F.lit(1))
    x = perms.withColumn("j", own(nx, 2)).withColumn("i", F.explode(F.sequence(F.lit(0), nq - 1))).withColumn("side", F.lit(2))
    cells = q.unionByName(x).select("space_ix", "i", "j", "side", "id", "perm", "ints", "step")
    near = cells.repartition("space_ix", "i", "j").sortWithinPartitions("space_ix", "i", "j").mapInArrow(_search_blocks(k, share), _NEAR)
    top = _exact(near, kept, k, least)
    return top.unionByName(_of_copies(rows, k, wanted_ids).where(F.lit(1.0) >= least))
