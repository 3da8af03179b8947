"""A feed of inserts, updates and deletes, replayed in order into the current state.

Changes of a key are replayed by sequence (changed_at, event_id): placed by key, sorted
by sequence within the partition, folded by a state machine. The machine composes: an
upsert maps an inventory x to max(x + delta, 0), and functions max(x + add, floor) are
closed under composition, while a delete forgets what came before. So a key's changes
are replayed per segment (a day), all segments in parallel, and the segments' summaries
once more: a key that has a third of all rows is many tasks in the first replay and a
few rows in the second. It also means that a batch, however late, needs only the
segments it falls into replayed: the summaries of all others stay.

The fold needs no row-at-a-time code: with running sums S of the added amounts, the
composition of max(x + d, 0) over a stretch is max(x + S_n, S_n - min S_k), and that of
max(x + a, b) over summaries, from x = 0, is A_n + max(0, max(b_k - A_k)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import cut_lineage
from eventloom.tenancy import key_of

# The ways connectors write op.
UPSERTS = ("insert", "i", "c", "create", "update", "u", "upsert")
DELETES = ("delete", "d", "remove")
ATTRIBUTES = ("sku", "name", "category", "price", "active")
KEY = ("tenant_id", "product_id")
LOG = (
    "tenant_id string, product_id string, event_id string, segment string, at timestamp_ntz, no bigint, gone boolean, delta bigint, "
    "sku string, name string, category string, price decimal(14,2), active boolean"
)
SUMMARIES = (
    "tenant_id string, product_id string, segment string, at timestamp_ntz, event_id string, reset boolean, present boolean, add bigint, floor bigint, "
    "sku string, name string, category string, price decimal(14,2), active boolean, n_applied bigint"
)


def steps(changes: DataFrame, segment: str = "day") -> DataFrame:
    """Changes as steps of the state machine (LOG), each event_id once (its earliest changed_at, then arrival).

    A null inventory_delta is 0. Left out: rows without tenant, product, event_id or
    changed_at, and rows whose op is none of the known words.
    """
    op = F.lower(F.trim(F.col("op")))
    rows = changes.select(
        key_of("tenant_id").alias("tenant_id"),
        key_of("product_id").alias("product_id"),
        "event_id",
        F.struct(F.col("changed_at").alias("at"), F.col("change_no").alias("no"), op.isin(*DELETES).alias("gone"), F.coalesce("inventory_delta", F.lit(0)).cast("bigint").alias("delta"), *ATTRIBUTES).alias("c"),
    ).filter(op.isin(*UPSERTS, *DELETES) & F.col("changed_at").isNotNull())
    once = rows.dropna().groupBy(*KEY, "event_id").agg(F.min("c").alias("c"))
    kept: list[Column] = [F.when(~F.col("c.gone"), F.col(f"c.{a}")).alias(a) for a in ATTRIBUTES]
    return once.select(
        *KEY,
        "event_id",
        F.date_format(F.date_trunc(segment, "c.at"), "yyyy-MM-dd HH").alias("segment"),
        "c.at",
        "c.no",
        "c.gone",
        F.when(F.col("c.gone"), F.lit(0)).otherwise(F.col("c.delta")).cast("bigint").alias("delta"),
        *kept,
    )


def _last(name: str) -> Column:
    """The last non-null value of an attribute by sequence."""
    return F.max(F.when(F.col(name).isNotNull(), F.struct("at", "event_id", F.col(name).alias("v"))))["v"].alias(name)


def summaries(log: DataFrame) -> DataFrame:
    """SUMMARIES of each (key, segment): what its steps do to whatever was there before.

    One shuffle places the steps by key and segment and one sort orders them; the runs
    between deletes and the last of them are aggregated where they lie.
    """
    part = [*KEY, "segment"]
    upto = Window.partitionBy(*part).orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = log.withColumn("_life", F.sum(F.col("gone").cast("int")).over(upto)).withColumn("_sum", F.sum("delta").over(upto))
    lives = run.groupBy(*part, "_life").agg(
        F.max(F.struct("at", "event_id")).alias("_end"),
        F.max("gone").alias("reset"),
        F.max(~F.col("gone")).alias("present"),
        F.sum("delta").alias("add"),
        # the running sum begins before this life: what lies before it is taken off again
        (F.max_by("_sum", F.struct("at", "event_id")) - F.min(F.when(~F.col("gone"), F.col("_sum")))).alias("floor"),
        *[_last(a) for a in ATTRIBUTES],
        F.count("*").alias("n_applied"),
    )
    last = lives.groupBy(*part).agg(F.max_by(F.struct(*[c for c in lives.columns if c not in (*part, "_life", "n_applied")]), "_life").alias("l"), F.sum("n_applied").alias("n_applied"))
    return last.select(
        *part, "l._end.at", "l._end.event_id", "l.reset", "l.present", "l.add", F.coalesce("l.floor", F.lit(0)).cast("bigint").alias("floor"), *[f"l.{a}" for a in ATTRIBUTES], "n_applied"
    )


def fold(parts: DataFrame) -> DataFrame:
    """The table that summaries in order of their segments leave behind: keys that are there after the last.

    tenant_id, product_id, the attributes (a null in a change keeps what was there),
    inventory_on_hand (from 0, never below 0 after a change), last_event_id, updated_at
    and n_applied, the number of changes replayed for the key.
    """
    upto = Window.partitionBy(*KEY).orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = parts.withColumn("_life", F.sum(F.col("reset").cast("int")).over(upto)).withColumn("_sum", F.sum("add").over(upto))
    lives = run.groupBy(*KEY, "_life").agg(
        F.max(F.struct("at", "event_id")).alias("_end"),
        F.max("present").alias("present"),
        F.sum("add").alias("add"),
        F.max(F.col("floor") - F.col("_sum")).alias("lift"),
        F.max_by("_sum", F.struct("at", "event_id")).alias("upto"),
        *[_last(a) for a in ATTRIBUTES],
        F.sum("n_applied").alias("n_applied"),
    )
    last = lives.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in lives.columns if c not in (*KEY, "_life", "n_applied")]), "_life").alias("l"), F.sum("n_applied").alias("n_applied"))
    return last.filter("l.present").select(
        *KEY, *[f"l.{a}" for a in ATTRIBUTES], F.greatest(F.col("l.add"), F.col("l.lift") + F.col("l.upto")).alias("inventory_on_hand"), F.col("l._end.event_id").alias("last_event_id"), F.col("l._end.at").alias("updated_at"), "n_applied"
    )


def replay(changes: DataFrame, segment: str = "day") -> DataFrame:
    """The table that a whole feed leaves behind; columns as of :func:`fold`."""
    return fold(summaries(steps(changes, segment)))


def advance(log: DataFrame, parts: DataFrame, changes: DataFrame, segment: str = "day") -> tuple[DataFrame, DataFrame]:
    """(log, summaries) after a batch of changes in any order.

    Sequences that have been applied are skipped; an earlier copy of an applied event_id
    takes its place. Only the (key, segment)s the batch touches are replayed, from the
    log, which a table partitioned by segment prunes to those days.
    """
    fresh = steps(changes, segment)
    known = log.select(*KEY, "event_id", F.col("segment").alias("_was"), F.struct("at", "no").alias("_seq"))
    both = fresh.join(known, [*KEY, "event_id"], "left").filter(F.col("_seq").isNull() | (F.struct("at", "no") < F.col("_seq")))
    both = cut_lineage(both)  # the batch's own new steps: read for the log and for what they touch
    news = both.drop("_was", "_seq")
    log = log.join(news.select(*KEY, "event_id"), [*KEY, "event_id"], "left_anti").unionByName(news)
    touched = both.select(*KEY, F.explode(F.array_compact(F.array("segment", "_was"))).alias("segment")).distinct()
    part = [*KEY, "segment"]
    again = summaries(log.join(touched, part, "left_semi"))
    return log, parts.join(touched, part, "left_anti").unionByName(again)


def stale(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Keys whose stored row isn't in the rebuilt state, or that only one side has."""
    have = stored.select(key_of("tenant_id").alias("tenant_id"), key_of("product_id").alias("product_id"), F.struct(F.col("inventory_on_hand").cast("bigint").alias("n"), F.col("last_event_id").alias("e")).alias("have"))
    want = rebuilt.select(*KEY, F.struct(F.col("inventory_on_hand").cast("bigint").alias("n"), F.col("last_event_id").alias("e")).alias("want"))
    return have.join(want, list(KEY), "full_outer").filter(~F.col("have").eqNullSafe(F.col("want"))).select(*KEY).distinct()
