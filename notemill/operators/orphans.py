"""References to records that do not exist, kept up to date incrementally.

The state of the operator is a pair of tables:

* the **parent index**: one row per (space, key, owner) with its latest version, whether it is live, and when it arrived;
* the **reference store**: one row per reference with its key and its present ``reason``.  Rows with a reason are the
  pending orphans; those without are resolved, and stay in the store because a deletion may reopen them.

A batch of changes touches only the references that are new or whose key has a changed parent: new references probe
the parent index, arriving parents resolve orphans that wait for them, deletions reopen resolved ones.  All other
rows of the store pass through unread by any join but one semi-join against the batch's keys.

Defined results for odd input: a null key can have no parent and is ``missing``; a null reference id is no reference
and is left out; a null ``seen_at`` is never ``late`` and has a null month; repeated references and repeated parents
count once; a null version is the lowest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.operators.skew import join_unique
from notemill.session import cut

PARENT_COLUMNS = "space string, key string, owner string, version bigint, live boolean, arrived_at timestamp"
REF_COLUMNS = "ref_table string, ref_field string, ref_id bigint, space string, key string, seen_at timestamp"
STORE_COLUMNS = REF_COLUMNS + ", reason string"
_ID = ["ref_table", "ref_field", "ref_id"]


@dataclass
class OrphanState:
    """The parent index and the reference store."""

    parents: DataFrame
    refs: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> OrphanState:
        return OrphanState(spark.createDataFrame([], PARENT_COLUMNS), spark.createDataFrame([], STORE_COLUMNS))

    def saved(self) -> OrphanState:
        """The same state as tables in the shared folder, without lineage."""
        return OrphanState(cut(self.parents, "orphan-parents"), cut(self.refs, "orphan-refs"))


def _columns(df: DataFrame, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return df.select(*names)


def _latest(parents: DataFrame) -> DataFrame:
    """The row of the highest version of each (space, key, owner); a deletion wins among equals."""
    version = F.coalesce(F.col("version"), F.lit(-(2**63)))
    order = F.struct(version, ~F.coalesce(F.col("live"), F.lit(False)))
    return parents.groupBy("space", "key", "owner").agg(
        F.max("version").alias("version"), F.max_by(F.coalesce("live", F.lit(False)), order).alias("live"), F.min("arrived_at").alias("arrived_at")
    )


def _index(parents: DataFrame) -> DataFrame:
    """One row per key: live if any owner is, with the first arrival among the live owners."""
    return parents.groupBy("space", "key").agg(F.max("live").alias("_live"), F.min(F.when(F.col("live"), F.col("arrived_at"))).alias("_arrived"))


def _judged(refs: DataFrame, index: DataFrame) -> DataFrame:
    hit = join_unique(cut(refs, "orphan-probes"), index, ["space", "key"])
    reason = (
        F.when(F.col("_live").isNull(), "missing")
        .when(~F.col("_live"), "deleted")
        .when(F.col("_arrived") > F.col("seen_at"), "late")
    )
    return _columns(hit.withColumn("reason", reason), STORE_COLUMNS)


def advance(state: OrphanState, refs: DataFrame | None = None, parents: DataFrame | None = None, first: bool = False) -> OrphanState:
    """The state after a batch of new references and of parent arrivals, updates and deletions.

    Either side may be None.  The operator is idempotent: a batch that is delivered again changes nothing.  ``first``
    says that the state is empty, which spares the joins with it.
    """
    index_now = state.parents
    if parents is not None:
        parents = _columns(parents, PARENT_COLUMNS).where(F.col("owner").isNotNull() & F.col("key").isNotNull())
        index_now = _latest(parents if first else state.parents.unionByName(parents))
    probing = touched = None
    if refs is not None:
        probing = _columns(refs, REF_COLUMNS).where(F.col("ref_id").isNotNull()).dropDuplicates(_ID)
        if not first:
            probing = probing.join(state.refs.select(*_ID), _ID, "left_anti")
    store = state.refs
    if parents is not None and not first:
        # a changed key of a parent; the batch's keys are distinct, so the hot keys of the store meet one row each
        changed = parents.select("space", "key").distinct().withColumn("_changed", F.lit(True))
        marked = join_unique(store, changed, ["space", "key"])
        touched = _columns(marked.where("_changed"), REF_COLUMNS)
        store = _columns(marked.where("_changed IS NULL"), STORE_COLUMNS)
    todo = [x for x in (probing, touched) if x is not None]
    if todo:
        again = todo[0] if len(todo) == 1 else todo[0].unionByName(todo[1])
        judged = _judged(again, _index(index_now))
        store = judged if first else store.unionByName(judged)
    return OrphanState(index_now, store)


def replay(spark: SparkSession, batches: list[tuple[DataFrame | None, DataFrame | None]]) -> OrphanState:
    """The state after all batches of (references, parents) in turn; it is saved between two batches."""
    state = OrphanState.empty(spark)
    for i, (refs, parents) in enumerate(batches):
        if i:
            state = state.saved()
        state = advance(state, refs, parents, first=i == 0)
    return state


def orphans(state: OrphanState) -> DataFrame:
    """The pending orphans: one row per bad reference with its reason and the month in which it was seen."""
    return state.refs.where(F.col("reason").isNotNull()).select(*_ID, "reason", F.date_format("seen_at", "yyyy-MM").alias("seen_month"))


def snapshot(state: OrphanState) -> DataFrame:
    """Orphans and all references per table, field, reason and month."""
    month = F.date_format("seen_at", "yyyy-MM")
    return state.refs.groupBy("ref_table", "ref_field", month.alias("seen_month")).agg(
        F.count(F.lit(1)).alias("refs"),
        *[F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in ("missing", "deleted", "late")],
    )
