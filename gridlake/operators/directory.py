"""Point directory: one record a point, quarantine, stations, versions, deactivation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import station_key
from .geo import resolve_canton
from .keyed import first_per_key, replace_bridge, upsert, upsert_if_changed

#: The country's box.
LAT, LON = (45.5, 48.0), (5.5, 11.0)


def latest_records(payload: DataFrame) -> DataFrame:
    """The newest record of each point: last_update (nulls last), then the last in the payload (stg_id)."""
    return first_per_key(payload.filter("evse_id is not null"), ["evse_id"], [F.desc_nulls_last("last_update"), F.desc("stg_id")])


def reject_reason() -> Column:
    """Why a record can't be used, the first that holds; null if it can."""
    outside = ~(F.col("lat").between(*LAT) & F.col("lon").between(*LON))
    return (
        F.when(F.col("evse_id").isNull(), "missing evse_id")
        .when(F.col("operator_id").isNull(), "missing operator")
        .when(F.col("lat").isNull() | F.col("lon").isNull(), "missing coordinates")
        .when(outside, "coordinates out of range")
    )


def stations_of(points: DataFrame) -> DataFrame:
    """One row for each station_key: modal name, street, postal code and city (the least on a tie), mean place, open if any is."""
    modal = lambda x: F.mode(x, True).alias(x)
    return points.groupBy("station_key").agg(
        modal("station_name"), modal("street"), modal("postal_code"), modal("city"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("operator_id").alias("operator_id"), F.bool_or("is_open_24h").alias("is_open_24h")
    )


def operator_gaps(active: DataFrame, incoming: DataFrame, least: float = 0.5) -> DataFrame:
    """operator_id, n_active, n_incoming of operators of whose active points less than a share came."""
    came = active.join(incoming.select("evse_id", F.lit(1).alias("came")), "evse_id", "left")
    return came.groupBy("operator_id").agg(F.count(F.lit(1)).alias("n_active"), F.count("came").alias("n_incoming")).filter(F.col("n_incoming") < F.col("n_active") * least)


def to_deactivate(active: DataFrame, incoming: DataFrame, run_ts: Column, grace: str = "7 days", least: float = 0.5) -> DataFrame:
    """evse_id of active points to close: missing from the payload, unless their operator's feed is incomplete and they were seen
    within the grace period. Nothing at all if the payload has less than a share of the active points. active: evse_id,
    operator_id, last_seen."""
    sizes = active.agg(F.count(F.lit(1)).alias("_a")).join(incoming.agg(F.count(F.lit(1)).alias("_i")))  # one row
    gone = active.join(incoming.select("evse_id"), "evse_id", "left_anti").join(operator_gaps(active, incoming, least).select("operator_id", F.lit(True).alias("_gap")), "operator_id", "left")
    closes = F.col("_gap").isNull() | (F.col("last_seen") < run_ts - F.expr(f"interval {grace}"))
    return gone.filter(closes).join(F.broadcast(sizes.filter(F.col("_i") >= F.col("_a") * least))).select("evse_id")


def scd2_apply(history: DataFrame, old: DataFrame, new: DataFrame, run_ts: Column, tracked: tuple[str, ...] = ("row_hash", "station_id")) -> DataFrame:
    """history with the versions that the step from old to new opens and closes.

    history: evse_id, tracked columns, is_active, valid_from, valid_to, change_type. A version opens on insert, deactivation,
    reactivation, or a change of a tracked column; other changes open none. Exactly one version of a point is open.
    """
    columns = history.columns
    o = old.select("evse_id", F.struct(*tracked, "is_active").alias("o"))
    n = new.select("evse_id", F.struct(*tracked, "is_active").alias("n"))
    both = n.join(o, "evse_id", "left")
    differs = F.lit(False)
    for t in tracked:
        differs = differs | ~F.col(f"o.{t}").eqNullSafe(F.col(f"n.{t}"))
    kind = (
        F.when(F.col("o").isNull(), "insert")
        .when(F.col("o.is_active") & ~F.col("n.is_active"), "deactivate")
        .when(~F.col("o.is_active") & F.col("n.is_active"), "reactivate")
        .when(differs, "update")
    )
    opened = both.withColumn("change_type", kind).filter("change_type is not null").select("evse_id", "n.*", run_ts.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), "change_type")
    touched = opened.select("evse_id", F.lit(True).alias("_t"))
    closed = history.join(touched, "evse_id", "left").withColumn("valid_to", F.when(F.col("_t") & F.col("valid_to").isNull(), run_ts).otherwise(F.col("valid_to")))
    return closed.select(columns).unionByName(opened.select(columns))


def apply_directory(payload: DataFrame, current: dict[str, DataFrame], aliases: DataFrame, localities: DataFrame, run_ts: Column) -> dict[str, DataFrame]:
    """New versions of the tables operators, stations, points, plugs and history, and quarantine, from one payload.

    payload: stg_id, evse_id, operator_id, operator_name, station_name, street, postal_code, city, lat, lon, is_open_24h,
    power_kw, power_type, plugs (array), record_hash, last_update. Applying a payload twice is applying it once.
    """
    reason = reject_reason()
    lost = payload.filter("evse_id is null").unionByName(latest_records(payload))
    good = latest_records(payload).filter(reason.isNull())
    good = good.withColumn("station_key", station_key(F.col("operator_id"), F.col("street"), F.col("postal_code"), F.col("lat"), F.col("lon")))
    bad = lost.withColumn("reason", reason).filter("reason is not null").select(F.to_json(F.struct(*payload.columns)).alias("record"), "reason")
    named = good.select("plugs", "evse_id", F.explode("plugs").alias("source_name")).join(aliases.select("source_name", "plug_code"), "source_name", "left")
    plugs = named.filter("plug_code is not null").select("evse_id", "plug_code").distinct()
    unknown = named.filter("plug_code is null").groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))
    bad = bad.unionByName(unknown.select(F.to_json(F.struct(F.col("source_name").alias("plug"), F.col("n").alias("evse_count"))).alias("record"), F.lit("unknown plug type").alias("reason")))

    operators = good.groupBy("operator_id").agg(F.coalesce(F.min("operator_name"), F.col("operator_id")).alias("name"))
    stations = resolve_canton(stations_of(good), localities, key="station_key")
    before = current["stations"].select("station_key", F.col("canton_code").alias("_kept"))
    stations = stations.join(before, "station_key", "left").withColumn("canton_code", F.coalesce("_kept", "canton_code")).select(current["stations"].columns)
    points = good.select("evse_id", F.col("station_key").alias("station_id"), "operator_id", "power_kw", "power_type", F.lit(True).alias("is_active"), F.col("record_hash").alias("row_hash"), run_ts.alias("last_seen")).select(current["points"].columns)
    old = current["points"]
    gone = to_deactivate(old.filter("is_active"), good, run_ts)
    merged = upsert_if_changed(old, points, ["evse_id"], "row_hash", "is_active")
    seen = merged.join(good.select("evse_id", F.lit(True).alias("_seen")), "evse_id", "left").join(gone.withColumn("_gone", F.lit(True)), "evse_id", "left")
    seen = seen.withColumns({"last_seen": F.when(F.col("_seen"), F.greatest("last_seen", run_ts)).otherwise(F.col("last_seen")), "is_active": F.col("is_active") & F.col("_gone").isNull()}).select(old.columns)
    gaps = operator_gaps(old.filter("is_active"), good).select(F.to_json(F.struct("*")).alias("record"), F.lit("operator feed incomplete: deactivation postponed").alias("reason"))
    return {
        "operators": upsert(current["operators"], operators, ["operator_id"]),
        "stations": upsert(current["stations"], stations, ["station_key"]),
        "points": seen,
        "plugs": replace_bridge(current["plugs"], plugs, "evse_id"),
        "history": scd2_apply(current["history"], old, seen, run_ts),
        "quarantine": bad.unionByName(gaps),
    }
