"""Status snapshots as streams: ingest without repeats, late rows counted, hourly occupancy beside an archive, episodes kept in state.

Each takes a `place`, a folder for its checkpoint and its output. A run with the same place goes on where the last one stopped:
nothing is read twice, and what it returns is all that has come out so far. Without one a run starts anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.exprs import slot_floor
from ..session import scratch

c = F.col


#: State lies in RocksDB, off the heap and written as changes; every batch's report is kept.
STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.numRecentProgressUpdates": "1000000",
}


def snapshots(spark: SparkSession, folder: str, schema, pattern: str | None = None, files: int | None = None) -> DataFrame:
    """A stream over a folder's Parquet files."""
    reader = spark.readStream.schema(schema)
    for key, value in (("pathGlobFilter", pattern), ("maxFilesPerTrigger", files)):
        reader = reader if value is None else reader.option(key, value)
    return reader.parquet(folder)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold inside; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drained(stream: DataFrame, handle: Callable[[DataFrame, int], None], place: str, mode: str = "append"):
    """Run a stream over all that is there now, batch by batch, from the checkpoint in place; its progress reports. A batch that is run
    again after a failure has its number again and overwrites what it wrote."""
    with settings(stream.sparkSession, STREAM):
        q = stream.writeStream.foreachBatch(handle).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint").start()
        q.awaitTermination()
        return q.recentProgress


def ingest(statuses: DataFrame, points: DataFrame, late: str = "10 minutes", place: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of known points, counts of unknown ones) of a stream of evse_id, datetime, status: one row for each slot and point, the
    first that comes. Rows that come later than the watermark allows are dropped, and counted: see `late_rows`."""
    spark = statuses.sparkSession
    place = place or scratch(spark, "ingest")
    rows, unknown = f"{place}/rows", f"{place}/unknown"
    own = statuses.withColumn("slot_ts", slot_floor(c("datetime"))).withWatermark("slot_ts", late).dropDuplicatesWithinWatermark(["slot_ts", "evse_id"])
    ids = points.select("evse_id")

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read twice; it is one micro-batch
        batch.join(ids, "evse_id", "left_semi").select("slot_ts", "evse_id", "status").write.mode("overwrite").parquet(f"{rows}/batch={number}")
        batch.join(ids, "evse_id", "left_anti").groupBy("slot_ts").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{unknown}/batch={number}")
        batch.unpersist()

    told = [(p.batchId, sum(s.numRowsDroppedByWatermark for s in p.stateOperators)) for p in drained(own, handle, place)]
    if any(n for _, n in told):  # a number for each batch of this run
        spark.createDataFrame([(b, n) for b, n in told if n], LATE).coalesce(1).write.mode("overwrite").parquet(f"{place}/late/from={told[0][0]}")
    return spark.read.parquet(rows).drop("batch"), spark.read.parquet(unknown).drop("batch")


LATE = "batch long, n_late long"


def late_rows(spark: SparkSession, place: str) -> DataFrame:
    """(batch, n_late) of the ingest at a place: rows that its batches dropped since they came behind the watermark."""
    names = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/late")
    if not names.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(names):
        return spark.createDataFrame([], LATE)
    return spark.read.schema(LATE).parquet(f"{place}/late").select("batch", "n_late")


HOURS = ["canton_code", "hour_utc", "n", "n_free", "n_occ"]


def live_occupancy(statuses: DataFrame, dim: DataFrame, late: str = "2 hours", place: str | None = None, archive: Callable[[], DataFrame] | None = None) -> DataFrame:
    """canton_code, hour_utc, n, n_free, n_occ by tumbling hours: each batch updates the hours it touches, the last update counts.

    archive: gives the hours (with the same columns) that are final by now. It is asked anew in every batch, whose rows of such hours are
    not written, and at the end, so that an hour archived after its live rows were written wins over them.
    """
    spark = statuses.sparkSession
    place = place or scratch(spark, "live")
    out = f"{place}/hours"
    hourly = (
        statuses.withWatermark("datetime", late)
        .join(dim.select("evse_id", "canton_code"), "evse_id")
        .groupBy(F.window("datetime", "1 hour"), "canton_code")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(c("status") == "Available").alias("n_free"), F.count_if(c("status") == "Occupied").alias("n_occ"))
    )

    def handle(batch: DataFrame, number: int) -> None:
        hours = batch.withColumn("hour_utc", c("window.start")).select(HOURS)
        hours = hours if archive is None else hours.join(archive().select("canton_code", "hour_utc"), ["canton_code", "hour_utc"], "left_anti")
        hours.write.mode("overwrite").parquet(f"{out}/batch={number}")

    drained(hourly, handle, place, "update")
    newest = F.row_number().over(Window.partitionBy("canton_code", "hour_utc").orderBy(F.desc("batch")))
    live = spark.read.parquet(out).withColumn("_n", newest).filter("_n = 1").select(HOURS)
    if archive is None:
        return live
    final = archive().select(HOURS)
    return live.join(final, ["canton_code", "hour_utc"], "left_anti").select(HOURS).unionByName(final)


EPISODE = "evse_id string, status string, first long, last long, n_slots int"
STATE = "status string, first long, last long, n int"


class EpisodeKeeper(StatefulProcessor):
    """A point's open episode as typed state, times in microseconds; a timer in event time closes it when nothing follows.

    The timer stands at the gap's end: a row there would still belong to the episode, but is late once the watermark has come so far.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self.open.get() if self.open.exists() else None
        before = now
        for at, status in sorted((r.at, r.status) for r in rows):  # one point's rows of one micro-batch
            if now is not None and now[0] == status and at - now[2] <= self.gap:
                now = (status, now[1], max(now[2], at), now[3] + 1)
                continue
            if now is not None:
                yield Row(evse_id=key[0], status=now[0], first=now[1], last=now[2], n_slots=now[3])
            now = (status, at, at, 1)
        self.open.update(now)
        if before is not None:
            self.handle.deleteTimer(self._due(before))
        self.handle.registerTimer(max(self._due(now), timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            now = self.open.get()
            if self._due(now) <= timerValues.getCurrentWatermarkInMs():
                yield Row(evse_id=key[0], status=now[0], first=now[1], last=now[2], n_slots=now[3])
                self.open.clear()

    def _due(self, now) -> int:
        return -(-(now[2] + self.gap) // 1000)


def _micros(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {interval}"))).first()[0]


def episodes(grid: DataFrame, gap: str = "10 minutes", slot: str = "5 minutes", late: str = "1 hour", place: str | None = None) -> DataFrame:
    """Closed episodes of a stream of evse_id, slot_ts, status: an episode closes at the first row of another status or after the gap,
    or when the watermark passes it by the gap. A point's open episode is its state."""
    spark = grid.sparkSession
    place = place or scratch(spark, "episodes")
    out = f"{place}/closed"
    own = grid.withWatermark("slot_ts", late).select("evse_id", "slot_ts", "status", F.unix_micros("slot_ts").alias("at"))
    closed = own.groupBy("evse_id").transformWithState(EpisodeKeeper(_micros(spark, gap)), EPISODE, "Append", "EventTime")
    drained(closed, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), place)
    times = F.timestamp_micros("first").alias("valid_from"), (F.timestamp_micros("last") + F.expr(f"interval {slot}")).alias("valid_to")
    return spark.read.parquet(out).select("evse_id", "status", *times, "n_slots")
