"""Streams that are stopped and go on: requests, episodes closed by timers, late rows, archived hours."""

from datetime import datetime as dt

from pyspark.sql import functions as F

from gridlake.operators import recommend
from gridlake.operators import status as S
from gridlake.plans import q_recommend
from gridlake.plans.registry import Views
from gridlake.session import staged
from gridlake.streaming import request_stream, status_stream

c = F.col


def at(h, m=0, day=1):
    return dt(2024, 1, day, h, m)


def test_requests_are_answered_once_with_what_is_known_then(spark, sf, tmp_path):
    v = Views(spark, sf)
    tables, chances = q_recommend.tables(v), tuple(staged(x, "chances") for x in q_recommend.chances(v))
    asked = v.fx_request.filter("request_id < 400")
    feed, place, newest = (str(tmp_path / x) for x in ("feed", "place", "newest"))
    points = v.fx_point.select("evse_id")

    def run(kind):
        points.withColumn("status", F.lit(kind)).write.mode("overwrite").parquet(newest)
        stream = status_stream.snapshots(spark, feed, asked.schema, files=1)
        found = request_stream.recommendations(stream, tables, chances, lambda: spark.read.parquet(newest), place=place)
        return {(r["request_id"], r["rank"]): (r["station_id"], round(r["total_min"], 6), r["n_free_now"]) for r in found.collect()}

    asked.filter("request_id % 3 <> 0").repartition(2).write.parquet(feed)
    first = run("Available")
    asked.filter("request_id % 3 = 0").coalesce(1).write.mode("append").parquet(feed)
    second = run("Occupied")
    assert {k: second[k] for k in first} == first and run("Reserved") == second
    want = {(r["request_id"], r["rank"]): (r["station_id"], round(r["total_min"], 6)) for r in recommend.recommend_batch(asked, tables, chances).collect()}
    assert {k: x[:2] for k, x in second.items()} == want
    assert all((x[2] > 0) == (k in first) for k, x in second.items()) and 0 < len(first) < len(second)


def episodes_of(spark, feed, place, *rows):
    kind = "evse_id string, slot_ts timestamp, status string"
    spark.createDataFrame(list(rows), kind).coalesce(1).write.mode("append").parquet(feed)
    return {tuple(r) for r in status_stream.episodes(status_stream.snapshots(spark, feed, spark.createDataFrame([], kind).schema), place=place).collect()}


def test_a_timer_closes_the_episode_of_a_point_that_fell_silent(spark, tmp_path):
    feed, place = str(tmp_path / "feed"), str(tmp_path / "place")
    assert episodes_of(spark, feed, place, ("a", at(1), "Available"), ("b", at(1), "Occupied"), ("b", at(1, 5), "Occupied")) == set()
    assert episodes_of(spark, feed, place, ("a", at(1, 10), "Available")) == set()  # the watermark is an hour behind
    silent = ("b", "Occupied", at(1), at(1, 10), 2)
    assert episodes_of(spark, feed, place, ("a", at(3), "Available")) == {("a", "Available", at(1), at(1, 15), 2), silent}
    # rows behind the watermark open nothing, and the point may come back
    again = episodes_of(spark, feed, place, ("b", at(1, 15), "Occupied"), ("b", at(3, 5), "Occupied"), ("a", at(3, 5), "Occupied"))
    assert silent in again and not any(e[0] == "b" and e[2] == at(1, 15) for e in again)


def test_streamed_episodes_are_those_of_the_grid(spark, sf, tmp_path):
    grid = S.status_grid(Views(spark, sf).fx_status_raw).select("evse_id", "slot_ts", "status")
    feed, place = str(tmp_path / "feed"), str(tmp_path / "place")
    days = grid.withColumn("day", F.to_date("slot_ts"))
    cuts = [r[0] for r in days.select("day").distinct().sort("day").collect()][::10]
    stream = lambda: status_stream.snapshots(spark, feed, grid.schema)
    for lo, hi in zip(cuts, [*cuts[1:], None]):
        days.filter((c("day") >= lo) & (F.lit(True) if hi is None else c("day") < hi)).select(grid.columns).coalesce(1).write.mode("append").parquet(feed)
        found = status_stream.episodes(stream(), gap="12 hours", place=place)
    whole = S.status_episodes(grid, gap="12 hours")
    got, want = {tuple(r) for r in found.collect()}, {tuple(r) for r in whole.select(found.columns).collect()}
    last = dict(whole.groupBy("evse_id").agg(F.max("valid_from")).collect())
    assert got <= want and all(e[2] == last[e[0]] for e in want - got)


def test_late_rows_are_counted_batch_by_batch(spark, tmp_path):
    feed, place, kind = str(tmp_path / "feed"), str(tmp_path / "place"), "evse_id string, datetime timestamp, status string"
    points = spark.createDataFrame([("a",), ("b",)], "evse_id string")

    def run(*rows):
        spark.createDataFrame([(e, t, "Available") for e, t in rows], kind).coalesce(1).write.mode("append").parquet(feed)
        found, _ = status_stream.ingest(status_stream.snapshots(spark, feed, spark.createDataFrame([], kind).schema), points, place=place)
        return found.count(), [r["n_late"] for r in status_stream.late_rows(spark, place).sort("batch").collect()]

    assert run(("a", at(5)), ("b", at(5)), ("a", at(5, 1))) == (2, [])
    assert run(("a", at(4)), ("b", at(4)), ("b", at(4)), ("a", at(5, 5))) == (3, [3])
    assert run(("a", at(3)), ("b", at(6))) == (4, [3, 1])


def test_an_hour_archived_later_wins(spark, tmp_path):
    feed, place, kind = str(tmp_path / "feed"), str(tmp_path / "place"), "evse_id string, datetime timestamp, status string"
    dim = spark.createDataFrame([("a", "ZH"), ("b", "BE")], "evse_id string, canton_code string")
    final = []

    def run(*rows):
        spark.createDataFrame(list(rows), kind).coalesce(1).write.mode("append").parquet(feed)
        archive = lambda: spark.createDataFrame(final, "canton_code string, hour_utc timestamp, n long, n_free long, n_occ long")
        return {tuple(r) for r in status_stream.live_occupancy(status_stream.snapshots(spark, feed, spark.createDataFrame([], kind).schema), dim, place=place, archive=archive).collect()}

    assert run(("a", at(1), "Available"), ("b", at(1, 5), "Occupied")) == {("ZH", at(1), 1, 1, 0), ("BE", at(1), 1, 0, 1)}
    final.append(("ZH", at(1), 12, 7, 5))
    assert run(("a", at(1, 30), "Occupied"), ("b", at(1, 30), "Occupied")) == {("ZH", at(1), 12, 7, 5), ("BE", at(1), 2, 0, 2)}
