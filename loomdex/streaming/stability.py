"""Files are let in only when two sightings of them agree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

SIGHTING = "path string, size_bytes long, digest string, at timestamp"
OUTCOME = "path string, status string, size_bytes long, digest string, first long, last long"
#: Groups of paths that are kept together.
BUCKETS = 1024
#: State of this kind lives in RocksDB, so it does not take an executor's memory.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def sight(spark: SparkSession, root: str, sightings: str, at: str | None = None, glob: str = "*") -> None:
    """Adds a row for each file under ``root`` (size and hash of its content as they are now) to the table of sightings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    now = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("digest"), now.alias("at")).write.mode("append").parquet(sightings)


def sighting_stream(spark: SparkSession, sightings: str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(SIGHTING)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(sightings)


class Settling(StatefulProcessor):
    """The pending sightings of a bucket of paths, one for each path; a timer for each time at which some of them are given up."""

    def __init__(self, wait_ms: int):
        self.wait = wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "path string, size_bytes long, digest string, at_ms long")

    def _held(self) -> dict:
        return {path: (size, digest, at) for path, size, digest, at in self.pending.get()} if self.pending.exists() else {}

    def handleInputRows(self, key, rows, timerValues):
        held, out = self._held(), []
        timers = {at for _, _, at in held.values()}
        # all of a bucket's rows: those of a path may lie in several frames
        frame = pd.concat(list(rows)).sort_values(["path", "at_ms"], kind="stable")
        for path, size, digest, at in zip(*(frame[c].tolist() for c in ("path", "size_bytes", "digest", "at_ms")), strict=True):
            had = held.get(path)
            if had is None:
                held[path] = (size, digest, at)
                continue
            same = had[:2] == (size, digest)
            out.append((path, "stable" if same else "changed", size, digest, had[2], at))
            # a file that changed is looked at again from how it is now
            if same:
                del held[path]
            else:
                held[path] = (size, digest, at)
        self._keep(held, timers)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._held()
        due = expiredTimerInfo.getExpiryTimeInMs() - self.wait
        out = [(path, "unconfirmed", size, digest, at, at) for path, (size, digest, at) in held.items() if at == due]
        self._keep({path: x for path, x in held.items() if x[2] != due}, {at for _, _, at in held.values()} - {due})
        yield _frame(out)

    def _keep(self, held: dict, timers: set) -> None:
        """``timers``: the times of pending sightings that have a timer."""
        now = {at for _, _, at in held.values()}
        for at in timers - now:
            self.handle.deleteTimer(at + self.wait)
        for at in now - timers:
            self.handle.registerTimer(at + self.wait)
        if held:
            self.pending.put([(path, *x) for path, x in held.items()])
        else:
            self.pending.clear()


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "status", "size_bytes", "digest", "first", "last"])


def settled(sightings: DataFrame, wait_minutes: int = 10, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """(path, status, size_bytes, digest, first, last) of a stream of ``SIGHTING`` rows.

    Two sightings of a path one after the other that agree in size and hash release it (stable); if they differ it fails (changed) and
    waits from its new content; a path that is seen only once within ``wait_minutes`` of the stream's time is given up (unconfirmed).
    A path that was released starts anew when it is seen again. Sightings without path, hash or time, and those later than ``late``
    behind, are left out. A path has one pending row as its state, however many sightings it has; paths are kept in ``buckets`` by hash,
    so a batch asks for state once a bucket, not once a path. A checkpoint keeps its number of buckets. The session must use ``STORE``.
    """
    good = sightings.where("path is not null and digest is not null and at is not null").select("path", F.coalesce("size_bytes", F.lit(-1)).cast("long").alias("size_bytes"), "digest", "at", F.unix_millis("at").alias("at_ms"))
    keyed = good.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets))).withWatermark("at", late).groupBy("bucket")
    out = keyed.transformWithStateInPandas(Settling(wait_minutes * 60000), OUTCOME, "Append", "EventTime")
    return out.withColumns({"first": F.timestamp_millis("first"), "last": F.timestamp_millis("last")})
