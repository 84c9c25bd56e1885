"""Loads of snapshots, weather, vehicles and archive points; live occupancy; the run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import power_class
from .directory import LAT, LON
from .geo import resolve_canton
from .keyed import first_per_key, insert_ignore, replace_bridge, replace_range, upsert, upsert_with_priority
from .status import occupancy_hourly

#: Statuses a snapshot may hold; largest AC power of a car; weather bounds.
STATUSES = ("Available", "Occupied", "OutOfService", "Unknown", "Reserved", "EvseNotFound")
AC_CAP_KW, TEMPERATURE = 43.0, (-45.0, 45.0)


def apply_snapshot(rows: DataFrame, points: DataFrame, existing: DataFrame, examples: int = 20) -> tuple[DataFrame, DataFrame]:
    """(existing with the new slots' rows, one quarantine record for points the directory lacks). A known slot keeps its row."""
    ids = points.select("evse_id")
    known = rows.join(ids, "evse_id", "left_semi").filter(F.col("status").isin(*STATUSES))
    new = first_per_key(known, ["slot_ts", "evse_id"], [F.asc("status")])
    lost = rows.join(ids, "evse_id", "left_anti")
    count = lost.agg(F.count(F.lit(1)).alias("n"))
    some = lost.select("evse_id").distinct().orderBy("evse_id").limit(examples).agg(F.array_sort(F.collect_list("evse_id")).alias("examples"))
    record = count.join(F.broadcast(some)).filter("n > 0").select("n", "examples", F.lit("evse not in reference").alias("reason"))
    return insert_ignore(existing, new.select(existing.columns), ["slot_ts", "evse_id"]), record


def bad_weather() -> Column:
    """Out of bounds; a missing measure is not."""
    out = ~F.col("temperature_c").between(*TEMPERATURE) | (F.col("precipitation_mm") < 0)
    return F.coalesce(out, F.lit(False))


def apply_weather(rows: DataFrame, cantons: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(existing with the good rows of known cantons, the bad rows). Of one canton, hour and kind the least measure wins."""
    bad = rows.filter(bad_weather())
    good = rows.filter(~bad_weather()).join(cantons.select("canton_code"), "canton_code", "left_semi")
    new = first_per_key(good, ["canton_code", "hour_utc", "kind"], [F.asc("temperature_c"), F.asc("precipitation_mm")])
    return upsert(existing, new.select(existing.columns), ["canton_code", "hour_utc", "kind"]), bad


MODEL = ["brand", "model", "variant", "release_year"]


def apply_vehicles(rows: DataFrame, aliases: DataFrame, existing: DataFrame, plugs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vehicles, their plugs by model, rejected rows). Own ('manual') records win over others; AC power is capped; DC 0 is none."""
    rejected = F.coalesce(F.col("ac_max_kw") <= 0, F.lit(True)) | F.col("brand").isNull() | F.col("model").isNull()
    good = rows.filter(~rejected).withColumns({"variant": F.coalesce("variant", F.lit("")), "ac_max_kw": F.least("ac_max_kw", F.lit(AC_CAP_KW)), "dc_max_kw": F.nullif(F.col("dc_max_kw"), F.lit(0.0))})
    new = first_per_key(good, MODEL, [F.desc(F.col("source") == "manual"), F.asc("source"), F.desc("ac_max_kw"), F.desc("dc_max_kw")])
    cars = upsert_with_priority(existing, new.select(existing.columns), MODEL, "source", "manual")
    own = new.select(F.struct(*MODEL).alias("owner"), F.explode("plugs").alias("source_name")).join(aliases.select("source_name", "plug_code"), "source_name")
    return cars, replace_bridge(plugs, own.select("owner", "plug_code"), "owner"), rows.filter(rejected)


def archive_point_dim(points: DataFrame, details: DataFrame, localities: DataFrame) -> DataFrame:
    """evse_id, canton_code, power_class, power_kw, lat, lon, meta_source: the directory's points, and from the details those it lacks."""
    boxed = details.filter(F.col("evse_id").isNotNull() & F.col("lat").between(*LAT) & F.col("lon").between(*LON))
    best = first_per_key(boxed, ["evse_id"], [F.desc_nulls_last("power_kw"), F.asc("postal_code"), F.asc("lat"), F.asc("lon")])
    lacking = resolve_canton(best.join(points.select("evse_id"), "evse_id", "left_anti"), localities, key="evse_id")
    columns = ["evse_id", "canton_code", "power_class", "power_kw", "lat", "lon", "meta_source"]
    extra = lacking.withColumns({"power_class": power_class(F.col("power_type"), F.col("power_kw")), "power_kw": F.when(F.col("power_kw") > 0, F.col("power_kw")), "meta_source": F.lit("details_csv")})
    return points.withColumn("meta_source", F.lit("evse_data")).select(columns).unionByName(extra.select(columns))


def live_occupancy(snapshots: DataFrame, dim: DataFrame, since: Column, existing: DataFrame) -> DataFrame:
    """existing hourly rows with the live ones since the hour recomputed; hours of the archive stay as they are."""
    start = F.date_trunc("hour", since)
    fresh = occupancy_hourly(snapshots.filter(F.col("slot_ts") >= start), dim).withColumn("source", F.lit("live"))
    kept = replace_range(existing, existing.limit(0), (F.col("source") == "live") & (F.col("hour_utc") >= start))
    return insert_ignore(kept, fresh.select(existing.columns), ["canton_code", "power_class", "hour_utc"])


def stale_runs(runs: DataFrame, now: Column, max_hours: int = 6) -> DataFrame:
    """runs, those still running after max_hours marked failed, ended now."""
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"interval {max_hours} hours"))
    return runs.withColumns({"status": F.when(stale, "failed").otherwise(F.col("status")), "finished_at": F.when(stale, now).otherwise(F.col("finished_at"))})


def current_runs(events: DataFrame) -> DataFrame:
    """The latest event of each run: events are only appended (run_id, at, status, rows)."""
    return events.groupBy("run_id").agg(F.max(F.struct("at", "status", "rows")).alias("e")).select("run_id", "e.*")


def unprocessed(manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """Files whose (source, sha) no good run has loaded."""
    done = runs.filter(F.col("status").isin("success", "partial")).select("source", "sha")
    return manifest.join(done, ["source", "sha"], "left_anti")


def window_plan(have: DataFrame, end: Column, most_days: int = 366) -> DataFrame:
    """(key, start, stop) dates to fetch for each key: from after its last hour to `end`, in pieces of at most most_days."""
    last = have.groupBy("key").agg((F.max("hour_utc") + F.expr("interval 1 hour")).cast("date").alias("first"))
    starts = last.filter(F.col("first") <= end)
    pieces = starts.withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor(F.date_diff(end, F.col("first")) / most_days).cast("int"))))
    start = F.date_add(F.col("first"), F.col("_i") * most_days)
    return pieces.select("key", start.alias("start"), F.least(F.date_add(start, most_days - 1), end).alias("stop"))
