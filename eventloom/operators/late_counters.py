"""Per-period aggregates by event time, corrected while late records arrive.

Two tables are the state. ``arrivals`` knows of each (tenant, event) its first arrival;
``counters`` has one counter per (tenant, period, source), with a version: the number of
changes its source has counted in that period. A batch of records changes a counter
only where it brings an event that wasn't known, or an earlier copy of one that was:
the event is then counted where it belongs and, if it had been counted elsewhere, taken
off there. So the counts are a function of the first arrivals alone. The least arrival
is idempotent, commutative and associative, hence batches may come in any order, more
than once and with copies of each other's events.

Counter states merge by taking the greatest version per (tenant, period, source), and
the figure of a period is the sum over its sources: a snapshot of the counters that is
written again, delivered twice or overtaken by a newer one changes nothing either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.timeparts import micros
from eventloom.operators.firsts import first_arrivals
from eventloom.session import cut_lineage

KEY = ("tenant_id", "period", "source")
#: n_in_time: arrived before the period's end. n_corrections: arrived after it, within the
#: lateness cut-off. n_rejected: arrived after it, beyond the cut-off.
COUNTS = ("n_in_time", "n_corrections", "n_rejected")
COUNTERS = "tenant_id string, period timestamp_ntz, source string, version bigint, n_in_time bigint, n_corrections bigint, n_rejected bigint"
ARRIVALS = "tenant_id string, event_id string, event_timestamp timestamp_ntz, arrived_at timestamp_ntz, source string"


def arrivals(events: DataFrame) -> DataFrame:
    """First arrivals of a batch: an event counts for the source of its earliest copy (ties: the least).

    Left out: rows without tenant, event_id or event_timestamp. A null source counts as
    the source ''. An event without any ingested_at is known, but counts nowhere yet.
    """
    return first_arrivals(events, source=F.coalesce(F.col("source_service"), F.lit(""))).select("tenant_id", "event_id", "event_timestamp", "arrived_at", "source")


def _cell(at: Column, arrived: Column, source: Column, sign: int, cutoff_seconds: int) -> Column:
    """Where an event counts, and as what. Late means arrived at or after the hour's end;
    exactly ``cutoff_seconds`` after the event's own time is still within the cut-off."""
    period = F.date_trunc("hour", at).cast("timestamp_ntz")
    late = arrived >= period + F.expr("interval 1 hour")
    within = micros(arrived) - micros(at) <= cutoff_seconds * 1_000_000
    n = lambda c: F.when(c, F.lit(sign)).otherwise(F.lit(0)).cast("bigint")
    return F.struct(period.alias("period"), source.alias("source"), n(~late).alias(COUNTS[0]), n(late & within).alias(COUNTS[1]), n(late & ~within).alias(COUNTS[2]))


def count(first: DataFrame, cutoff_seconds: int = 600) -> DataFrame:
    """Counters of first arrivals, none of which has been counted before. Combines before its one shuffle."""
    there = first.filter("arrived_at is not null")
    cells = there.select("tenant_id", F.inline(F.array(_cell(F.col("event_timestamp"), F.col("arrived_at"), F.col("source"), 1, cutoff_seconds))))
    summed = cells.groupBy(*KEY).agg(F.count("*").alias("version"), *[F.sum(c).alias(c) for c in COUNTS])
    return summed.select(*KEY, "version", *COUNTS)


def merge(*states: DataFrame) -> DataFrame:
    """Join of counter states of one history: per (tenant, period, source) the greatest version."""
    every = states[0]
    for other in states[1:]:
        every = every.unionByName(other)
    newest = every.groupBy(*KEY).agg(F.max(F.struct("version", *COUNTS)).alias("newest"))
    return newest.select(*KEY, "newest.version", *[f"newest.{c}" for c in COUNTS])


def news(known: DataFrame, batch: DataFrame) -> DataFrame:
    """What a batch of first arrivals changes: events that ``known`` lacks or has later.

    ``known`` may be a log: several rows of an event mean their least. Result: ARRIVALS
    with what was known in ``was`` (null for an unknown event). Appending it to ``known``
    is the whole update of that table; a compaction (:func:`least`) may follow when it suits.
    """
    was = least(known).select("tenant_id", "event_id", F.struct("event_timestamp", "arrived_at", "source").alias("was"))
    both = batch.join(was, ["tenant_id", "event_id"], "left")
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    order = lambda arrived, source: F.struct(F.coalesce(arrived, far).alias("a"), source.alias("s"))
    earlier = order(F.col("arrived_at"), F.col("source")) < order(F.col("was.arrived_at"), F.col("was.source"))
    of = lambda c: F.when(F.col("was").isNull() | earlier, F.col(c)).otherwise(F.col(f"was.{c}"))
    at = F.least("event_timestamp", "was.event_timestamp")
    changed = F.col("was").isNull() | earlier | (F.col("event_timestamp") < F.col("was.event_timestamp"))
    return both.filter(changed).select("tenant_id", "event_id", at.alias("event_timestamp"), of("arrived_at").alias("arrived_at"), of("source").alias("source"), "was")


def least(known: DataFrame) -> DataFrame:
    """One row per event of a log of arrivals: its least event time and its first arrival."""
    far = F.coalesce("arrived_at", F.lit("9999-12-31").cast("timestamp_ntz"))
    return (
        known.groupBy("tenant_id", "event_id")
        .agg(F.min("event_timestamp").alias("event_timestamp"), F.min(F.struct(far.alias("far"), "arrived_at", "source")).alias("f"))
        .select("tenant_id", "event_id", "event_timestamp", "f.arrived_at", "f.source")
    )


def advance(counters: DataFrame, known: DataFrame, events: DataFrame, cutoff_seconds: int = 600, closed_before: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(counters, arrivals) after a batch of records, which may be applied before.

    Records of periods that end before ``closed_before`` are turned away, so that
    arrivals older than it need be kept no longer (:func:`forget`); without it every
    period stays open. Only the batch's events are looked up, and only counters that
    change are written anew, with the next version.
    """
    if closed_before is not None:
        events = events.filter(F.date_trunc("hour", "event_timestamp") >= F.date_trunc("hour", closed_before))
    changed = cut_lineage(news(known, arrivals(events)))
    plus = _cell(F.col("event_timestamp"), F.col("arrived_at"), F.col("source"), 1, cutoff_seconds)
    minus = _cell(F.col("was.event_timestamp"), F.col("was.arrived_at"), F.col("was.source"), -1, cutoff_seconds)
    cells = F.array_compact(F.array(F.when(F.col("arrived_at").isNotNull(), plus), F.when(F.col("was.arrived_at").isNotNull(), minus)))
    deltas = changed.select("tenant_id", F.inline(cells)).groupBy(*KEY).agg(F.count("*").alias("_v"), *[F.sum(c).alias(f"_{c}") for c in COUNTS])
    sums = [(F.coalesce(F.col(c), F.lit(0)) + F.col(f"_{c}")).alias(c) for c in COUNTS]
    newer = deltas.join(counters, list(KEY), "left").select(*KEY, (F.coalesce("version", F.lit(0)) + F.col("_v")).alias("version"), *sums)
    return merge(counters, newer), known.unionByName(changed.drop("was"))


def forget(known: DataFrame, closed_before: Column) -> DataFrame:
    """Arrivals without those of closed periods."""
    return known.filter(F.date_trunc("hour", "event_timestamp") >= F.date_trunc("hour", closed_before))


def totals(state: DataFrame) -> DataFrame:
    """Figures per tenant and hour: the sum over sources. n_accepted leaves out the rejected.

    An hour whose events have all moved elsewhere has no row.
    """
    summed = state.groupBy("tenant_id", "period").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return summed.filter(" or ".join(f"{c} > 0" for c in COUNTS)).withColumn("n_accepted", F.col("n_in_time") + F.col("n_corrections"))


def hourly(events: DataFrame, cutoff_seconds: int = 600) -> DataFrame:
    """Hourly figures of all events as one batch, by way of the counters."""
    return totals(merge(count(arrivals(events), cutoff_seconds)))
