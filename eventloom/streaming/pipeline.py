"""The streaming job: the batch operators over a stream, each query with its checkpoint."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from eventloom.operators import envelopes, event_time
from eventloom.streaming import sinks
from eventloom.streaming.config import StreamConfig
from eventloom.tenancy import allowed, key_of

KEYS = ["tenant_id", "domain", "window_start", "window_end"]
DIMENSION = ("dim_tenant_name", "dim_plan", "dim_region", "tenant_missing")
AUDIT = ["tenant_id", "event_id", "event_type", "domain", "event_timestamp", "ingested_at", "lateness_seconds"]


def judged(records: DataFrame, config: StreamConfig) -> DataFrame:
    """Records parsed, validated and classified by lateness, before any state is kept,
    so that what a watermark would drop is still audited."""
    v = allowed(envelopes.validate(envelopes.parse(records)), config.tenants)
    v = v.withColumn("tenant_id", key_of("tenant_id"))
    return event_time.classify(v, F.col("ingested_at"), config.on_time_seconds, config.accept_seconds)


def metrics(events: DataFrame, config: StreamConfig, tenants: DataFrame | None = None) -> DataFrame:
    """Window metrics of valid events that aren't rejected, each event once; with the tenant's name, plan and region where there is a dimension."""
    kept = events.filter("is_valid and lateness <> 'late_rejected'")
    once = event_time.dedup_stream(event_time.watermarked(kept, config.watermark))
    if tenants is None:
        return event_time.windowed(once, config.window, config.slide)
    return event_time.windowed(event_time.enrich(once, tenants), config.window, config.slide, by=DIMENSION)


def rejected(events: DataFrame) -> DataFrame:
    """Invalid records and those beyond the cut-off, with their reason."""
    late = F.when(F.col("is_valid"), F.lit("event_time_watermark_exceeded")).otherwise(F.col("reason"))
    return events.filter("not is_valid or lateness = 'late_rejected'").withColumn("reason", late)


def batch_duplicates(batch: DataFrame) -> DataFrame:
    """Events of a batch that stand in it more than once: all rows but the first."""
    marked = event_time.mark_duplicates(batch.filter("is_valid"), [F.col("ingested_at").asc_nulls_last()])
    return marked.filter("is_duplicate").select(*AUDIT, F.lit("duplicate").alias("lateness"))


class Telemetry(StreamingQueryListener):
    """Progress of each micro-batch into the run log: rows read, engine watermark, duration."""

    def __init__(self, log: sinks.RunLog):
        self.log = log

    def onQueryStarted(self, event) -> None:
        self.log.add("query", str(event.name), query=event.name, query_id=str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        watermark = dict(p.eventTime or {}).get("watermark")
        self.log.add("progress", f"{p.name}-{p.batchId}", query=p.name, batch_id=p.batchId, rows=p.numInputRows, watermark=watermark, ms=dict(p.durationMs or {}).get("triggerExecution"))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.log.add("ended", str(event.id), query_id=str(event.id), error=event.exception)


@dataclasses.dataclass
class Job:
    """A started job: its queries, tables and log."""

    spark: SparkSession
    queries: list[StreamingQuery]
    window_metrics: sinks.KeyedTable
    late_events: sinks.KeyedTable
    log: sinks.RunLog
    listener: Telemetry

    def wait(self, seconds: int | None = None) -> None:
        """Until every query has ended (or ``seconds`` each); the run is logged as finished or failed."""
        status = "succeeded"
        try:
            for q in self.queries:
                q.awaitTermination(seconds) if seconds else q.awaitTermination()
                if q.exception() is not None:
                    status = "failed"
        except Exception:
            status = "failed"
            raise
        finally:
            self.log.finished(status)
            self.spark.streams.removeListener(self.listener)

    def stop(self) -> None:
        for q in self.queries:
            q.stop()
        self.log.finished("stopped")
        self.spark.streams.removeListener(self.listener)


def start(spark: SparkSession, records: DataFrame, config: StreamConfig, tenants: DataFrame | None = None, available_now: bool = False) -> Job:
    """Five queries: window metrics (upserted), late events and duplicates of a batch (audited, first wins),
    dead letters (appended, or sent to the dead-letter topic), records received per topic (appended)."""
    events = judged(records, config)
    root = config.output_root
    log = sinks.RunLog(spark, f"{root}/run_log", "event-stream", str(uuid.uuid4()))
    listener = Telemetry(log)
    spark.streams.addListener(listener)
    log.started(list(config.topics), ["window_metrics", "late_events", "dead_letters", "received"], dataclasses.asdict(config))
    window_metrics = sinks.KeyedTable(spark, f"{root}/window_metrics", KEYS, "window_start", compact_every=config.compact_every)
    late_events = sinks.KeyedTable(spark, f"{root}/late_events", ["tenant_id", "event_id", "lateness"], "event_timestamp", first_wins=True, compact_every=config.compact_every)
    # each query writes a table of its own; the duplicates' table is like the late events'
    duplicates = sinks.KeyedTable(spark, f"{root}/duplicates", ["tenant_id", "event_id"], "event_timestamp", first_wins=True, compact_every=config.compact_every)

    def run(df: DataFrame, name: str, mode: str, write: sinks.Write) -> StreamingQuery:
        out = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", config.checkpoint(name))
        out = out.trigger(availableNow=True) if available_now else out.trigger(processingTime=config.trigger)
        return out.foreachBatch(sinks.retrying(write, config.max_retries, config.backoff_seconds, lambda i, e: log.failure(name, i, e))).start()

    letters = sinks.kafka_sink(config.kafka_servers, config.dlq_topic) if config.kafka_servers else sinks.append_sink(f"{root}/dead_letters")
    received = sinks.append_sink(f"{root}/received")
    topic = F.col("topic") if "topic" in records.columns else F.lit("unknown")
    audited = events.filter("is_valid and lateness like 'late%'").select(*AUDIT, "lateness")
    queries = [
        run(metrics(events, config, tenants), "window_metrics", "update", window_metrics.write),
        run(audited, "late_events", "append", late_events.write),
        run(events.select(*AUDIT, "is_valid"), "duplicates", "append", lambda df, i: duplicates.write(batch_duplicates(df), i)),
        run(rejected(events), "dead_letters", "append", lambda df, i: letters(envelopes.dead_letters(df), i)),
        run(records.select(topic.alias("topic")), "received", "append", lambda df, i: received(df.groupBy("topic").agg(F.count("*").alias("n")), i)),
    ]
    return Job(spark, queries, window_metrics, late_events, log, listener)
