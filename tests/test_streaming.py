"""The streaming job over files: results as in batch, replays without effect, restart from the checkpoint."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eventloom.operators import envelopes, event_time
from eventloom.sources import generator
from eventloom.streaming import pipeline, sinks, sources
from eventloom.streaming.config import StreamConfig, seconds

T0 = dt.datetime(2024, 1, 1, 0, 0)


def record(i, late=0, **over):
    body = {
        "event_id": f"e{i}", "tenant_id": "t", "event_type": "order.created", "event_timestamp": (T0 + dt.timedelta(seconds=i)).strftime("%Y-%m-%dT%H:%M:%SZ"), "source_service": "s", "payload_version": 1, "trace_id": "tr",
        "payload": {"order_id": "o", "customer_id": "c", "product_id": "p", "quantity": 1, "unit_price": 2.5},
    }
    return (json.dumps(body | over), T0 + dt.timedelta(seconds=i + late))


def land(spark, folder, rows):
    spark.createDataFrame(rows, sources.RECORD).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, config, tenants=None):
    job = pipeline.start(spark, sources.records(spark, config, folder), config, tenants, available_now=True)
    job.wait(120)
    assert all(q.exception() is None for q in job.queries)
    return job


def test_stream_gives_the_batch_result_and_restarts(spark, tmp_path):
    folder = str(tmp_path / "in")
    config = StreamConfig(str(tmp_path / "cp"), str(tmp_path / "out"), compact_every=2)
    tenants = spark.createDataFrame([("T ", "Tee", "pro", "eu"), ("x", "Ex", "free", "us")], "tenant_id string, tenant_name string, plan string, region string")
    land(spark, folder, [record(1), record(2), record(2), record(400, late=136), record(500, late=736), record(3, payload_version=99), record(6, tenant_id="u"), ("{oops", T0)])
    run(spark, folder, config, tenants)
    land(spark, folder, [record(410), record(2)])
    run(spark, folder, config, tenants)
    job = run(spark, folder, config, tenants)  # nothing new
    got = job.window_metrics.current()
    batch = event_time.windowed(
        event_time.classify(envelopes.validate(envelopes.parse(spark.read.parquet(folder))), F.col("ingested_at"))
        .filter("is_valid and lateness <> 'late_rejected'")
        .dropDuplicates(["tenant_id", "event_id"])
    )
    key = lambda df: sorted((r.tenant_id, r.domain, r.window_start, r.event_count, r.revenue, r.late_accepted_count) for r in df.collect())
    assert key(got) == key(batch)
    assert {(r.tenant_id, r.dim_plan, r.tenant_missing) for r in got.collect()} == {("t", "pro", False), ("u", None, True)}
    late = {r.event_id: r.lateness for r in job.late_events.current().collect()}
    assert {"e400": "late_accepted", "e500": "late_rejected"}.items() <= late.items()
    dup = sinks.KeyedTable(spark, f"{config.output_root}/duplicates", ["tenant_id", "event_id"], "event_timestamp", first_wins=True).current()
    assert [(r.event_id, r.lateness) for r in dup.collect()] == [("e2", "duplicate")]
    dead = [json.loads(r.value) for r in spark.read.parquet(f"{config.output_root}/dead_letters").collect()]
    assert sorted(d["rejection_reason"] for d in dead) == ["event_time_watermark_exceeded", "malformed_json", "unsupported_payload_version"]
    assert sum(r.n for r in spark.read.parquet(f"{config.output_root}/received").collect()) == 10
    seen = spark.read.json(f"{config.output_root}/run_log").groupBy("kind").count().collect()
    kinds = {r.kind: r["count"] for r in seen}
    assert kinds["started"] == kinds["finished"] == 3 and kinds["query"] >= 5 and "failure" not in kinds
    progress = spark.read.json(f"{config.output_root}/run_log").filter("kind = 'progress' and query = 'window_metrics' and watermark is not null")
    assert progress.count() >= 1


def test_dedup_within_the_watermark_on_a_live_stream(spark, tmp_path):
    """Five cycling keys of a rate source come out five times, however long it runs."""
    ticks = sources.rate(spark, 50)
    events = ticks.select(F.lit("t").alias("tenant_id"), F.concat(F.lit("e"), (F.col("value") % 5).cast("string")).alias("event_id"), F.col("timestamp").alias("event_timestamp"))
    q = event_time.dedup_stream(event_time.watermarked(events)).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if (q.lastProgress and q.lastProgress["batchId"] >= 3):
                break
    finally:
        q.stop()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [f"e{i}" for i in range(5)]


def test_landing_files_are_read_line_by_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(record(1)[0] + "\n" + record(2)[0] + "\n")
    q = envelopes.parse(sources.jsonl(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "o"))
    assert sorted(r.event_id for r in got.collect()) == ["e1", "e2"] and got.filter("ingested_at is null").count() == 0


def test_kafka_settings():
    config = StreamConfig("c", "o", kafka_servers="b:9092", topics=("a", "b"), max_offsets_per_trigger=7, options={"startingOffsets": "earliest", "kafka.security.protocol": "SSL"})
    assert sources.kafka_options(config) == {"kafka.bootstrap.servers": "b:9092", "subscribe": "a,b", "startingOffsets": "earliest", "failOnDataLoss": "false", "maxOffsetsPerTrigger": "7", "kafka.security.protocol": "SSL"}
    with pytest.raises(ValueError):
        sources.kafka_options(StreamConfig("c", "o"))
    with pytest.raises(ValueError):
        sources.records(None, StreamConfig("c", "o"))


@pytest.mark.parametrize("first_wins", [False, True])
def test_keyed_table_in_batches_with_retries_and_compaction(spark, tmp_path, first_wins):
    make = lambda: sinks.KeyedTable(spark, str(tmp_path / "t"), ["k"], "d", first_wins, compact_every=2)
    day = lambda n: dt.date(2024, 1, n)
    rows = lambda *xs: spark.createDataFrame(list(xs), "k string, d date, v int")
    t = make()
    assert t.current() is None
    t.write(rows(("a", day(1), 1), ("b", day(2), 1), (None, day(2), 9)), 0)
    t.write(rows(("a", day(1), 2)), 1)  # compacted here
    t.write(rows(("a", day(1), 77)), 1)  # a batch that was folded in
    make().write(rows(("c", None, 5), ("a", day(1), 3)), 2)
    t.write(rows(("c", None, 6), ("a", day(1), 3)), 2)  # tried again
    want = {"a": 1 if first_wins else 3, "b": 1, "c": 6}
    assert {r.k: r.v for r in make().current().collect()} == want
    make().compact()
    assert {r.k: r.v for r in make().current().collect()} == want
    assert make()._manifest()["generations"] == {"2024-01-01": 2, "2024-01-02": 1, "none": 2}, "an untouched partition stays in its generation"
    (tmp_path / "t" / "changes" / "batch_9").mkdir(parents=True)  # a batch that broke off
    assert {r.k: r.v for r in make().current().collect()} == want
    sinks.stage(rows(("z", None, 1)), str(tmp_path / "s"))
    sinks.stage(rows(("y", None, 1)), str(tmp_path / "s"))
    assert [r.k for r in spark.read.parquet(str(tmp_path / "s")).collect()] == ["y"]


def test_retries_then_fails():
    calls = []

    def bad(df, i):
        calls.append(i)
        raise OSError("down")

    told = []
    with pytest.raises(sinks.SinkError):
        sinks.retrying(bad, 2, 0, lambda i, e: told.append((i, str(e))))(None, 5)
    assert calls == [5, 5, 5] and told == [(5, "down")]


def test_config_is_checked():
    assert seconds("10 minutes") == 600
    for bad in ({"accept_seconds": 1200}, {"on_time_seconds": 700}, {"slide": "1 hour"}, {"trigger": "soon"}, {"max_retries": -1}, {"compact_every": 0}):
        with pytest.raises(ValueError):
            StreamConfig("c", "o", **bad)


def test_generated_events_are_valid_and_repeatable(spark):
    made = generator.envelopes(spark, 2000, seed=5)
    v = envelopes.validate(envelopes.parse(made)).cache()
    assert v.filter("not is_valid").count() == 0
    shares = {r.tenant_id: r["count"] for r in v.groupBy("tenant_id").count().collect()}
    assert 800 < shares["alder"] < 1200 and sum(shares.values()) == 2000
    night, noon = v.filter("hour(event_timestamp) < 5").count(), v.filter("hour(event_timestamp) between 8 and 12").count()
    assert noon > 4 * night > 0
    value = lambda seed: sorted(r.value for r in generator.envelopes(spark, 50, seed=seed).repartition(7).collect())
    assert value(5) == value(5) != value(6)
