"""References to records that do not exist, as keyed state that batches advance.

Two tables are the state. ``log`` has the parents' arrivals and deletions, each once;
``state`` has each reference once, with its steps: when it was opened for want of a
living parent, when an arrival resolved it, when a deletion reopened it. A batch of
references probes the parents' lifetimes; a batch of arrivals or deletions looks up the
references of just its own keys, waiting ones and settled ones alike, and settles those
anew. As both tables are sets and steps depend on nothing else, batches may come in any
order and more than once. Both frames are plain tables that a ``foreachBatch`` can keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.tenancy import key_of

KEY = ("relation", "tenant_id", "ref_key")
REF = (*KEY, "child_id", "ref_at")
LOG = "relation string, tenant_id string, ref_key string, at timestamp_ntz, alive boolean"
STATE = "relation string, tenant_id string, ref_key string, child_id string, ref_at timestamp_ntz, steps array<struct<kind:string,at:timestamp_ntz>>"
_CHANGES = "array<struct<at:timestamp_ntz,alive:boolean>>"
_STEPS = "array<struct<kind:string,at:timestamp_ntz>>"


def references(rows: DataFrame, relation: str, child_id: str, key: str, at: str = "event_timestamp") -> DataFrame:
    """References of a child table. A null or blank key is no reference; rows without a tenant, id or time aren't judged."""
    refs = rows.select(F.lit(relation).alias("relation"), key_of("tenant_id").alias("tenant_id"), key_of(key).alias("ref_key"), F.col(child_id).alias("child_id"), F.col(at).alias("ref_at"))
    return refs.dropna()


def arrivals(rows: DataFrame, relation: str, key: str, at: str = "created_at") -> DataFrame:
    """When keys of a parent table come into being; (relation, tenant_id, ref_key, at)."""
    return rows.select(F.lit(relation).alias("relation"), key_of("tenant_id").alias("tenant_id"), key_of(key).alias("ref_key"), F.col(at).alias("at")).dropna()


def logged(came: DataFrame | None, went: DataFrame | None) -> DataFrame:
    """Arrivals and deletions, at least one of them, as rows of the log."""
    parts = [df.select(*KEY, "at", F.lit(alive).alias("alive")) for df, alive in ((came, True), (went, False)) if df is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _alternating(changes: Column, before: Column) -> Column:
    """Sorted changes without those that leave a key as it was; ``before`` is its state before the first."""
    return F.filter(changes, lambda c, i: ~c["alive"].eqNullSafe(F.coalesce(F.get(changes, i - 1)["alive"], before)))


def lifetimes(log: DataFrame, deletions: bool = True) -> DataFrame:
    """One row per key with its ``changes``, arrival and deletion in turn, by time; a deletion at the moment of an arrival counts for nothing.

    Changes are reduced per day and then per key, so a key with many arrivals is no long
    array. Where the log has no ``deletions``, the first arrival says all.
    """
    if not deletions:
        firsts = log.groupBy(*KEY).agg(F.min("at").alias("at"))
        return firsts.select(*KEY, F.array(F.struct("at", F.lit(True).alias("alive"))).cast(_CHANGES).alias("changes"))
    days = log.groupBy(*KEY, F.to_date("at").alias("day")).agg(F.sort_array(F.collect_set(F.struct("at", "alive"))).alias("c"))
    standing = F.filter("c", lambda x, i: x["alive"] | ~F.get("c", i + 1)["at"].eqNullSafe(x["at"]))
    days = days.select(*KEY, standing.alias("c")).select(*KEY, _alternating(F.col("c"), F.lit(None).cast("boolean")).alias("c"))
    whole = days.groupBy(*KEY).agg(F.sort_array(F.flatten(F.collect_list("c"))).alias("c"))
    return whole.select(*KEY, _alternating(F.col("c"), F.lit(False)).alias("changes"))


def probe(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """STATE of references: each is open whenever its parent isn't alive, from its own time on.

    The first step is ``opened``, be it at the reference or when the parent is deleted
    later; an arrival then is ``resolved`` and a further deletion ``reopened``. A
    reference whose parent never goes has no steps.

    ``lives`` has one row per key, so a hot key lies on the probing side only, which
    adaptive execution splits.
    """
    probed = refs.join(lives, list(KEY), "left").withColumn("changes", F.coalesce("changes", F.array().cast(_CHANGES)))
    earlier = F.filter("changes", lambda c: c["at"] <= F.col("ref_at"))
    probed = probed.withColumn("known", F.coalesce(F.get(earlier, F.size(earlier) - 1)["alive"], F.lit(False)))
    step = lambda kind, at: F.struct(kind.alias("kind"), at.alias("at"))
    later = F.transform(
        F.filter("changes", lambda c: c["at"] > F.col("ref_at")),
        lambda c, i: step(F.when(c["alive"], F.lit("resolved")).when(F.col("known") & (i == 0), F.lit("opened")).otherwise(F.lit("reopened")), c["at"]),
    )
    own = F.when(F.col("known"), F.array().cast(_STEPS)).otherwise(F.array(step(F.lit("opened"), F.col("ref_at"))))
    return probed.select(*REF, F.concat(own, later).cast(_STEPS).alias("steps"))


def advance(state: DataFrame | None, log: DataFrame | None, refs: DataFrame, came: DataFrame | None = None, went: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(state, log) after a batch of references, arrivals and deletions, any of which may be empty or known.

    References and changes count once however often they are repeated. Parents of other
    keys and references to them are neither read into the probe nor changed.
    """
    empty = lambda schema: refs.sparkSession.createDataFrame([], schema)
    work = refs.select(*REF).distinct()
    batch = logged(came, went) if came is not None or went is not None else empty(LOG)
    if state is None and log is None:
        return probe(work, lifetimes(batch, went is not None)), batch.distinct()
    state = empty(STATE) if state is None else state
    log = (batch if log is None else log.unionByName(batch)).distinct()
    touched = batch.select(*KEY).distinct()
    work = work.unionByName(state.join(touched, list(KEY), "left_semi").select(*REF)).distinct()
    settled = probe(work, lifetimes(log.join(work.select(*KEY).distinct(), list(KEY), "left_semi")))
    return state.join(work, list(REF), "left_anti").unionByName(settled), log


def unborn(state: DataFrame) -> DataFrame:
    """Each child that had no living parent at its own time in any of its rows, once."""
    first = F.get("steps", F.lit(0))
    return state.filter((first["kind"] == "opened") & (first["at"] == F.col("ref_at"))).select("relation", "tenant_id", "child_id").distinct()


def waiting(state: DataFrame) -> DataFrame:
    """References that are open now, with the time since when."""
    last = F.get("steps", F.size("steps") - 1)
    return state.filter(last["kind"].isin("opened", "reopened")).select(*REF, last["at"].alias("open_since"))


def open_counts(state: DataFrame, period: str = "day") -> DataFrame:
    """Snapshot per (relation, period): references opened, resolved and reopened in it, and left open at its end."""
    steps = state.select("relation", F.inline("steps"))
    n = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n_{kind}")
    per = steps.groupBy("relation", F.date_trunc(period, "at").cast("timestamp_ntz").alias("period")).agg(n("opened"), n("resolved"), n("reopened"))
    # a relation has one row per period, a few thousand in ten years
    running: Column = F.sum(F.col("n_opened") - F.col("n_resolved") + F.col("n_reopened")).over(Window.partitionBy("relation").orderBy("period").rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("n_open", running)
