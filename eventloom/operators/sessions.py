"""Sessions: each actor's events split at pauses.

Gaps and islands in two levels, so that no actor, however busy, is one task: within
an (actor, hour) the events are cut into fragments; then the fragments of an actor,
at most a few per hour, are joined where the pause between them is short enough. In
both levels a lag flags the pauses above the threshold, the running sum of the flags
numbers the pieces, and an aggregate summarises them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.jsontext import object_map
from eventloom.functions.once import once
from eventloom.functions.timeparts import micros
from eventloom.operators.firsts import first_arrivals
from eventloom.tenancy import key_of


def user_events(raw_events: DataFrame) -> DataFrame:
    """``user.*`` events, each once: tenant_id, actor, event_id, event_timestamp.

    The actor is payload.user_id, trimmed and in lower case; failing that ``anon:`` and
    payload.session_id. A payload that isn't valid JSON has neither. Events without an
    actor are left out; of copies the first arrival that names an actor decides.
    """
    user = key_of(F.element_at("_p", "user_id"))
    session = F.element_at("_p", "session_id")
    anon = F.when(F.trim(session) != "", F.concat(F.lit("anon:"), session))
    used = raw_events.filter(F.col("event_type").startswith("user.")).select("tenant_id", "event_id", "event_timestamp", "ingested_at", "payload")
    rows = once(used, _p=object_map("payload"))
    return first_arrivals(rows, actor=F.coalesce(user, anon)).filter("actor is not null")


def _pieces(df: DataFrame, key: list[str], start: str, end: str, order: list[str], gap_micros: int) -> DataFrame:
    """Number the islands of ``df`` per ``key``: a new one begins after a pause above the gap."""
    ordered = Window.partitionBy(*key).orderBy(*order)
    pause = micros(F.col(start)) - micros(F.lag(end).over(ordered))
    flagged = df.withColumn("_new", F.when(pause > gap_micros, 1).otherwise(0))
    return flagged.withColumn("_piece", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))


def sessions(events: DataFrame, gap_minutes: float = 30, bucket: str = "hour") -> DataFrame:
    """Sessions of ``events`` (tenant_id, actor, event_id, event_timestamp).

    A session ends where the next event is more than ``gap_minutes`` later; exactly
    that is the same session. Result: tenant_id, actor, session_no (from 1),
    first_event_id, last_event_id, started_at, ended_at, duration_seconds, n_events.
    Equal times are ordered by event_id. Rows with a null key or time are left out.
    """
    gap = int(gap_minutes * 60_000_000)
    who = ["tenant_id", "actor"]

    def ends(first: Column, last: Column) -> list[Column]:
        return [F.min(first).alias("first"), F.max(last).alias("last")]

    rows = events.select(*who, "event_id", "event_timestamp").dropna().withColumn("_bucket", F.date_trunc(bucket, "event_timestamp"))
    local = [*who, "_bucket"]
    fragments = (
        _pieces(rows, local, "event_timestamp", "event_timestamp", ["event_timestamp", "event_id"], gap)
        .groupBy(*local, "_piece")
        .agg(*ends(point := F.struct(F.col("event_timestamp").alias("at"), F.col("event_id").alias("id")), point), F.count("*").alias("n"))
        .select(*who, "first", "last", "n", F.col("first.at").alias("_start"), F.col("last.at").alias("_end"), F.col("first.id").alias("_id"))
    )
    joined = _pieces(fragments, who, "_start", "_end", ["_start", "_id"], gap).groupBy(*who, "_piece").agg(*ends(F.col("first"), F.col("last")), F.sum("n").alias("n"))
    return joined.select(
        *who,
        (F.col("_piece") + 1).alias("session_no"),
        F.col("first.id").alias("first_event_id"),
        F.col("last.id").alias("last_event_id"),
        F.col("first.at").alias("started_at"),
        F.col("last.at").alias("ended_at"),
        ((micros(F.col("last.at")) - micros(F.col("first.at"))) / F.lit(1_000_000.0)).alias("duration_seconds"),
        F.col("n").alias("n_events"),
    )


def previous(df: DataFrame, keys: list[str], at: str, tie: str, bucket: str = "hour") -> DataFrame:
    """Adds previous_at: the time of the row before, per key in order of (``at``, ``tie``); null for the first.

    In two levels, as sessions: a lag within each (key, hour), and for the first row of an
    hour the last time of the hour before it, so that a busy key is no single task.
    """
    rows = df.withColumn("_bucket", F.date_trunc(bucket, at))
    local = [*keys, "_bucket"]
    inner = rows.withColumn("_before", F.lag(at).over(Window.partitionBy(*local).orderBy(at, tie)))
    ends = rows.groupBy(*local).agg(F.max(at).alias("_last"))
    # null keys meet too: the pieces of a key are joined by what they are, not by an equality that null fails
    ends = ends.select(*local, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_end"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in local]
    joined = inner.alias("r").join(ends.alias("e"), same, "left")
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], F.coalesce("r._before", "e._end").alias("previous_at"))
