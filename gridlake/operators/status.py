"""Status archive: five-minute grid, episodes, hourly occupancy, profiles, coverage, training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ZONE, hash_bucket, local_dow, local_hour, slot_round

#: Statuses that say something about use, and those a sample may start from.
TELLING = ("Available", "Occupied", "OutOfService", "Reserved")
ORIGINS = (*TELLING, "Unknown")


def status_grid(raw: DataFrame, slot_seconds: int = 300) -> DataFrame:
    """evse_id, slot_ts, status, operator_id: the latest status of each point in each slot.

    raw: EvseID, datetime, EVSEStatus, OperatorID. Rows without id or status don't count; at one source time the greater
    status, then operator, wins. One shuffle on the point and slot, with map-side partials.
    """
    known = raw.filter(F.col("EvseID").isNotNull() & F.col("EVSEStatus").isNotNull())
    return (
        known.groupBy(F.trim("EvseID").alias("evse_id"), slot_round(F.col("datetime"), slot_seconds).alias("slot_ts"))
        .agg(F.max(F.struct("datetime", F.col("EVSEStatus").alias("status"))).alias("s"), F.max(F.when(F.col("OperatorID").isNotNull(), F.struct("datetime", "OperatorID"))).alias("o"))
        .select("evse_id", "slot_ts", "s.status", F.col("o.OperatorID").alias("operator_id"))
    )


def status_episodes(grid: DataFrame, gap: str = "10 minutes", slot: str = "5 minutes", split_by: str | None = None) -> DataFrame:
    """evse_id, status, valid_from, valid_to, n_slots: maximal runs of one status without a gap longer than `gap`.

    split_by: a truncation unit ('month') at which runs are cut. Both windows and the aggregate share one shuffle; a run has one status,
    which is a key, so that what is aggregated are times and counts, in a hash table.
    """
    own = ["evse_id"]
    if split_by:
        grid = grid.withColumn("_part", F.date_trunc(split_by, "slot_ts"))
        own.append("_part")
    order = Window.partitionBy(*own).orderBy("slot_ts")
    before, last = F.lag("status").over(order), F.lag("slot_ts").over(order)
    opens = ~before.eqNullSafe(F.col("status")) | F.coalesce(F.col("slot_ts") > last + F.expr(f"interval {gap}"), F.lit(False))
    numbered = grid.withColumn("_opens", opens.cast("int")).withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy(*own, "_run", "status")
        .agg(F.min("slot_ts").alias("valid_from"), F.max("slot_ts").alias("last"), F.count(F.lit(1)).cast("int").alias("n_slots"))
        .select("evse_id", "status", "valid_from", (F.col("last") + F.expr(f"interval {slot}")).alias("valid_to"), "n_slots")
    )


def carried(grid: DataFrame, slot_seconds: int = 300) -> DataFrame:
    """evse_id, status, valid_from, valid_to: the dense grid as runs. A slot's status holds up to the point's next one, the last up to the
    end of the last slot of all. One row for each row of the grid, however long it holds."""
    end = grid.agg(F.max("slot_ts").alias("_last"))  # one row
    after = F.lead("slot_ts").over(Window.partitionBy("evse_id").orderBy("slot_ts"))
    last = F.timestamp_seconds(F.unix_seconds("_last") + slot_seconds)
    return grid.select("evse_id", "status", F.col("slot_ts").alias("valid_from"), after.alias("_next")).join(F.broadcast(end)).select("evse_id", "status", "valid_from", F.coalesce("_next", last).alias("valid_to"))


def latest_of(runs: DataFrame) -> DataFrame:
    """evse_id, status of the last slot that runs (see carried) stand for."""
    end = runs.agg(F.max("valid_to").alias("valid_to"))  # one row
    return runs.join(F.broadcast(end), "valid_to").select("evse_id", "status")


def slot_counts(grid: DataFrame, dim: DataFrame) -> DataFrame:
    """Points by state for each canton, power class and slot. dim: evse_id, canton_code, power_class, one row a point."""
    known = dim.filter(F.col("canton_code").isNotNull() & F.col("power_class").isNotNull()).select("evse_id", "canton_code", "power_class")
    is_ = lambda s: F.count_if(F.col("status") == s)
    return grid.join(known, "evse_id").groupBy("canton_code", "power_class", "slot_ts").agg(
        F.count(F.lit(1)).alias("n_evse"),
        is_("Available").alias("n_av"),
        is_("Occupied").alias("n_oc"),
        is_("OutOfService").alias("n_oos"),
        F.count_if(~F.col("status").isin("Available", "Occupied", "OutOfService")).alias("n_unk"),
    )


def occupancy_hourly(grid: DataFrame, dim: DataFrame) -> DataFrame:
    """Hourly means of the slot counts, and occupancy and out-of-service rates as ratios of sums (null over nothing).

    After the first level a slot is a row, so slots are counted without a distinct.
    """
    share = lambda a, b: F.sum(a) / F.nullif(F.sum(b), F.lit(0))
    return slot_counts(grid, dim).groupBy("canton_code", "power_class", F.date_trunc("hour", "slot_ts").alias("hour_utc")).agg(
        F.max("n_evse").cast("int").alias("n_evse"),
        F.avg("n_av").alias("avg_available"),
        F.avg("n_oc").alias("avg_occupied"),
        F.avg("n_oos").alias("avg_out_of_service"),
        F.avg("n_unk").alias("avg_unknown"),
        share(F.col("n_oc"), F.col("n_av") + F.col("n_oc")).alias("occupancy_rate"),
        share(F.col("n_oos"), F.col("n_evse")).alias("oos_rate"),
        F.count(F.lit(1)).cast("int").alias("slots_observed"),
    )


def profile_parts(grid: DataFrame, zone: str = ZONE, by: list[str] | None = None) -> DataFrame:
    """Partial sums for each point, weekday (Monday 0) and local hour: n_free, n_occ, n_obs of telling statuses."""
    told = grid.filter(F.col("status").isin(*TELLING))
    return told.groupBy(*(by or []), "evse_id", local_dow(F.col("slot_ts"), zone).alias("dow"), local_hour(F.col("slot_ts"), zone).alias("hour_local")).agg(
        F.count_if(F.col("status") == "Available").alias("n_free"), F.count_if(F.col("status") == "Occupied").alias("n_occ"), F.count(F.lit(1)).alias("n_obs")
    )


def profile_of_runs(runs: DataFrame, zone: str = ZONE, piece: int = 900, slot_seconds: int = 300) -> DataFrame:
    """profile_parts of the slots that runs (see carried) stand for. A run is cut into pieces that lie in one local hour, and a piece counts
    its slots at once. piece: seconds, by multiples of which all local hours begin; a quarter hour does in any zone, 3600 where the zone is
    whole hours from UTC. Runs are dealt by point, and what is counted needs no further shuffle."""
    told = runs.filter(F.col("status").isin(*TELLING)).select("evse_id", "status", F.unix_seconds("valid_from").alias("_from"), F.unix_seconds("valid_to").alias("_to")).filter("_from < _to").repartition("evse_id")
    cut = told.withColumn("_at", F.explode(F.sequence((F.floor(F.col("_from") / piece) * piece).cast("long"), F.col("_to") - 1, F.lit(piece).cast("long"))))
    at = F.timestamp_seconds("_at")
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    slots = ((F.least("_to", F.col("_at") + piece) - F.greatest("_from", "_at")) / slot_seconds).cast("long")
    of = lambda status: zero(F.sum(F.when(F.col("status") == status, slots)))
    return cut.groupBy("evse_id", local_dow(at, zone).alias("dow"), local_hour(at, zone).alias("hour_local")).agg(of("Available").alias("n_free"), of("Occupied").alias("n_occ"), F.sum(slots).alias("n_obs"))


def evse_profile(parts: DataFrame, min_obs: int = 12) -> DataFrame:
    """p_free and n_obs of each point, weekday and hour that was seen often enough."""
    sums = parts.groupBy("evse_id", "dow", "hour_local").agg(F.sum("n_free").alias("f"), F.sum("n_obs").alias("n_obs"))
    return sums.filter(F.col("n_obs") >= min_obs).select("evse_id", "dow", "hour_local", (F.col("f") / F.col("n_obs")).alias("p_free"), "n_obs")


def profile_group(parts: DataFrame, dim: DataFrame) -> DataFrame:
    """p_free, p_occ and n_obs of each canton, power class, weekday and hour; p_occ is 0 where nothing was free or in use."""
    known = dim.filter(F.col("canton_code").isNotNull() & F.col("power_class").isNotNull()).select("evse_id", "canton_code", "power_class")
    both = F.sum(F.col("n_free") + F.col("n_occ"))
    return parts.join(known, "evse_id").groupBy("canton_code", "power_class", "dow", "hour_local").agg(
        (F.sum("n_free") / F.sum("n_obs")).alias("p_free"), F.coalesce(F.sum("n_occ") / F.nullif(both, F.lit(0)), F.lit(0.0)).alias("p_occ"), F.sum("n_obs").alias("n_obs")
    )


def archive_coverage(grid: DataFrame, dim: DataFrame, months: DataFrame | None = None, per_day: int = 288) -> DataFrame:
    """For each month: rows, slots, points, share of points with a canton, share of statuses that tell nothing, slots expected.

    Distinct slots and points come from two aggregates, each by its own key, instead of an expanded one. months
    (a column `month`, first day): those without data get a row too.
    """
    own = grid.withColumn("month", F.trunc("slot_ts", "month"))
    slots = own.groupBy("month", "slot_ts").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin("Unknown", "EvseNotFound")).alias("u"))
    slots = slots.groupBy("month").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_slots"), F.sum("u").alias("u"))
    points = own.select("month", "evse_id").distinct().join(dim.select("evse_id", "canton_code"), "evse_id", "left")
    points = points.groupBy("month").agg(F.count(F.lit(1)).alias("n_evse"), F.count("canton_code").alias("g"))
    both = slots.join(points, "month")
    if months is not None:
        both = months.select("month").join(both, "month", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select(
        "month", zero("n_rows"), zero("n_slots"), zero("n_evse"), (F.col("g") / F.col("n_evse")).alias("share_with_geo"), (F.col("u") / F.col("n_rows")).alias("share_unknown"), (F.day(F.last_day("month")) * per_day).cast("int").alias("expected_slots")
    )


def availability_sample(runs: DataFrame, dim: DataFrame, share_bp: int = 100, deltas: tuple[int, ...] = tuple(range(5, 65, 5))) -> DataFrame:
    """evse_id, t0, delta_min, status_now, y, n_total_other, n_free_other: whether a point is free `delta_min` after t0.

    runs: evse_id, status, valid_from, valid_to (see carried), which lie on five-minute slots. t0 are quarter hours, chosen by a hash,
    share_bp of 10 000; they are chosen where the run is, so that no slot travels but these. The points known and free at the same place
    are sums of what begins and ends there before t0, the later status is that of the last run that began before it: two windows, by
    place and by point, over the runs and the sample. dim: evse_id, lat, lon.
    """
    place = F.concat_ws("_", F.round("lat", 4).cast("decimal(9,4)"), F.round("lon", 4).cast("decimal(9,4)"))
    own = runs.join(dim.select("evse_id", place.alias("grp")), "evse_id").select("evse_id", "status", "grp", F.unix_seconds("valid_from").alias("_from"), F.unix_seconds("valid_to").alias("_to")).filter("_from < _to")
    quarters = F.sequence((F.ceil(F.col("_from") / 900) * 900).cast("long"), F.col("_to") - 1, F.lit(900).cast("long"))
    some = own.filter(F.col("status").isin(*ORIGINS) & (F.ceil(F.col("_from") / 900) * 900 < F.col("_to")))
    seconds = F.col("_at").cast("string")
    origins = some.select("evse_id", "grp", F.col("status").alias("status_now"), F.explode(quarters).alias("_at")).filter(hash_bucket(F.concat(seconds, F.lit("@"), "evse_id"), 10000) < share_bp)
    at = hash_bucket(F.concat("evse_id", F.lit("#"), seconds), len(deltas)).cast("int")
    origins = origins.withColumn("delta_min", F.get(F.array(*map(F.lit, deltas)), at))
    free = (F.col("status") == "Available").cast("long")
    ends = F.explode(F.array(F.struct(F.col("_from").alias("_at"), F.lit(1).alias("_s")), F.struct(F.col("_to").alias("_at"), F.lit(-1).alias("_s"))))
    changes = own.select("grp", free.alias("_free"), ends.alias("_e")).groupBy("grp", "_e._at").agg(F.sum("_e._s").alias("_n"), F.sum(F.col("_e._s") * F.col("_free")).alias("_f"))
    by_place = Window.partitionBy("grp").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    both = origins.unionByName(changes, allowMissingColumns=True)
    there = both.withColumns({"_n": F.sum("_n").over(by_place), "_f": F.sum("_f").over(by_place)}).filter("evse_id is not null").drop("grp")
    asked = there.withColumns({"_t0": F.col("_at"), "_at": F.col("_at") + F.col("delta_min") * 60})
    known = own.select("evse_id", F.col("_from").alias("_at"), F.struct("status", "_to").alias("_run"))
    by_point = Window.partitionBy("evse_id").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    then = asked.unionByName(known, allowMissingColumns=True).withColumn("_then", F.max(F.when(F.col("_run").isNotNull(), F.struct("_at", "_run"))).over(by_point)["_run"]).filter("_t0 is not null")
    return then.filter((F.col("_at") < F.col("_then._to")) & F.col("_then.status").isNotNull()).select(
        "evse_id", F.timestamp_seconds("_t0").alias("t0"), "delta_min", "status_now", (F.col("_then.status") == "Available").cast("int").alias("y"), (F.col("_n") - 1).alias("n_total_other"), (F.col("_f") - (F.col("status_now") == "Available").cast("int")).alias("n_free_other")
    )
