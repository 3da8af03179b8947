"""Sinks that may be called again with the same batch."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import upserts

Write = Callable[[DataFrame, int], None]


class SinkError(RuntimeError):
    """A batch that couldn't be written after all retries."""


def retrying(write: Write, retries: int, backoff: float, failed: Callable[[int, Exception], None] | None = None) -> Write:
    """``write`` with linear backoff; the batch fails, and is not committed, when all tries fail. ``failed`` is told of that."""

    def run(df: DataFrame, batch_id: int) -> None:
        for attempt in range(retries + 1):
            try:
                return write(df, batch_id)
            except Exception as e:
                if attempt == retries:
                    if failed:
                        failed(batch_id, e)
                    raise SinkError(f"batch {batch_id} failed after {attempt + 1} tries: {e}") from e
                time.sleep(backoff * (attempt + 1))

    return run


class Files:
    """Small files on the file system of a folder, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, sub: str = "") -> list[str]:
        at = self._path(f"{self.folder}/{sub}" if sub else self.folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written beside and renamed."""
        hidden = self._path(f"{self.folder}/.{name}.tmp")
        out = self._fs.create(hidden, True)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._path(f"{self.folder}/{name}")
        self._fs.delete(target, False)
        self._fs.rename(hidden, target)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}"))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)


class KeyedTable:
    """A keyed parquet table that batches write at the cost of the batch.

    A batch is one folder of changes, overwritten when it comes again; reading takes of
    each key the last (or, with ``first_wins``, the first) write over the compacted rows
    and the changes since. After ``compact_every`` batches the changes are folded in:
    only the partitions they touch are written anew, as a new generation, and a manifest
    names each partition's generation. It is written last and whole, so readers never
    see half a compaction. Rows with a null key are dropped.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], partition: str, first_wins: bool = False, compact_every: int = 20):
        self.spark, self.folder, self.keys, self.partition, self.first_wins, self.compact_every = spark, folder, keys, partition, first_wins, compact_every
        self.files = Files(spark, folder)
        self.manifests = Files(spark, f"{folder}/manifest")

    def _manifest(self) -> dict:
        """{"upto": last batch folded in, "generations": {partition value: generation}}"""
        done = [int(n[:-5]) for n in self.manifests.names() if n.endswith(".json") and not n.startswith(".")]
        return json.loads(self.manifests.read(f"{max(done)}.json")) if done else {"upto": -1, "generations": {}}

    def _batches(self, upto: int) -> list[int]:
        """Batches written to the end and not folded in yet."""
        return sorted(b for n in self.files.names("changes") if n.startswith("batch_") and (b := int(n[6:])) > upto and self.files.exists(f"changes/{n}/_SUCCESS"))

    def _settled(self, df: DataFrame) -> DataFrame:
        return (upserts.first if self.first_wins else upserts.last)(df, self.keys, ["_batch"])

    def _base(self, generations: dict[str, int], only: set[str] | None = None) -> DataFrame | None:
        out = None
        for g in sorted(set(generations.values())):
            parts = [p for p, x in generations.items() if x == g and (only is None or p in only)]
            if parts:
                df = self.spark.read.parquet(f"{self.folder}/base/generation_{g}").filter(F.col("_part").isin(parts)).drop("_part")
                out = df if out is None else out.unionByName(df)
        return out

    def _changes(self, batches: list[int]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.folder}/changes/batch_{b}" for b in batches]) if batches else None

    def current(self) -> DataFrame | None:
        """The table's rows now; None before the first batch."""
        m = self._manifest()
        base, changes = self._base(m["generations"]), self._changes(self._batches(m["upto"]))
        rows = changes if base is None else base if changes is None else base.unionByName(changes)
        return None if rows is None else self._settled(rows).drop("_batch")

    def write(self, df: DataFrame, batch_id: int) -> None:
        m = self._manifest()
        if batch_id <= m["upto"]:
            return  # folded in already
        rows = df.dropna(subset=self.keys).withColumn("_batch", F.lit(batch_id).cast("bigint"))
        self._settled(rows).write.mode("overwrite").parquet(f"{self.folder}/changes/batch_{batch_id}")
        if len(self._batches(m["upto"])) >= self.compact_every:
            self.compact()

    def compact(self) -> None:
        """Fold the changes in. They touch as few partitions as the watermark leaves open."""
        m = self._manifest()
        batches = self._batches(m["upto"])
        changes = self._changes(batches)
        if changes is None:
            return
        part = F.coalesce(F.col(self.partition).cast("date").cast("string"), F.lit("none"))
        touched = {r[0] for r in changes.select(part).distinct().collect()}
        base = self._base(m["generations"], touched)
        rows = self._settled(changes if base is None else base.unionByName(changes))
        upto = batches[-1]
        rows.withColumn("_part", part).write.mode("overwrite").partitionBy("_part").parquet(f"{self.folder}/base/generation_{upto}")
        now = m["generations"] | {p: upto for p in touched}
        self.manifests.write(f"{upto}.json", json.dumps({"upto": upto, "generations": now}))
        for b in batches:
            self.files.delete(f"changes/batch_{b}")
        # what neither this manifest nor the one before it names has no readers
        used = {f"generation_{g}" for g in (*now.values(), *m["generations"].values())}
        for name in self.files.names("base"):
            if name not in used:
                self.files.delete(f"base/{name}")
        for name in self.manifests.names():
            if name.endswith(".json") and int(name[:-5]) not in (upto, m["upto"]):
                self.manifests.delete(name)


def append_sink(folder: str) -> Write:
    """One folder a batch, overwritten when the batch is tried again."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return write


def kafka_sink(servers: str, topic: str) -> Write:
    """(key, value) records to a topic; consumers must expect repeats."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.selectExpr("cast(key as string) as key", "cast(value as string) as value").write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return write


def stage(df: DataFrame, folder: str) -> None:
    """A stage table, replaced as a whole."""
    df.write.mode("overwrite").parquet(folder)


class RunLog:
    """What a run did, as small JSON files: started, finished, failures, and each query's progress.

    Nothing here may stop a run: a line that can't be written is dropped.
    """

    def __init__(self, spark: SparkSession, folder: str, job: str, run_id: str):
        self.job, self.run_id = job, run_id
        self.files = Files(spark, folder)

    def add(self, kind: str, name: str, **values) -> None:
        line = {"kind": kind, "job": self.job, "run_id": self.run_id, "recorded_at": time.time()} | values
        try:
            self.files.write(f"{kind}-{self.run_id}-{name}.json", json.dumps(line, default=str) + "\n")
        except Exception:  # noqa: BLE001, S110
            pass

    def started(self, inputs: list[str], outputs: list[str], settings: dict) -> None:
        self.add("started", "run", inputs=inputs, outputs=outputs, settings=settings)

    def finished(self, status: str) -> None:
        self.add("finished", "run", status=status)

    def failure(self, query: str, batch_id: int, error: Exception) -> None:
        self.add("failure", f"{query}-{batch_id}", query=query, batch_id=batch_id, error=str(error)[:2000])
