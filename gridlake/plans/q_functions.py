"""Scalar functions and predicates, each on whole views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import sql
from ..session import scratch
from ..sources import sinks
from .q_status import rounded
from .registry import SHARED, query

c = F.col
_HAV = "2 * 6371.0088 * asin(sqrt(power(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * power(sin(radians({3} - {1}) / 2), 2)))"
SHARED["near_req"] = "select r.request_id, r.lat as rlat, r.lon as rlon, s.station_id, s.lat, s.lon from {fx_request} r join {fx_station} s on s.station_id = r.request_id % 50 + 1"


def _near(v):
    r = v.fx_request.select("request_id", c("lat").alias("rlat"), c("lon").alias("rlon"), (c("request_id") % 50 + 1).alias("station_id"))
    return r.join(v.fx_station.select("station_id", "lat", "lon"), "station_id")


@query("fn_haversine_km", f"select request_id, station_id, round({_HAV.format('rlat', 'rlon', 'lat', 'lon')}, 6) as km from {{near_req}}")
def _(v):
    return rounded(_near(v).select("request_id", "station_id", X.haversine_km(c("rlat"), c("rlon"), c("lat"), c("lon")).alias("km")))


@query(
    "fn_station_key",
    "select station_id, md5(case when station_id % 7 <> 0 then concat(operator_id, '|', lower(regexp_replace(translate(concat('Zürich-', street), 'ÄÖÜäöüéèàâç', 'AOUaoueeaac'), '[^a-zA-Z0-9]+', '', 'g')), '|', trim(postal_code)) else concat(operator_id, '|geo|', cast(cast(round(lat, 4) as decimal(9,4)) as varchar), '|', cast(cast(round(lon, 4) as decimal(9,4)) as varchar)) end) as station_key from {fx_station}",
)
def _(v):
    street = F.when(c("station_id") % 7 != 0, F.concat(F.lit("Zürich-"), "street"))
    return v.fx_station.select("station_id", X.station_key(c("operator_id"), street, c("postal_code"), c("lat"), c("lon")).alias("station_key"))


@query(
    "fn_effective_power",
    "select evse_id, vehicle_id, case when power_kw is null then null when power_class = 'DC' and dc_max_kw is not null then least(power_kw, dc_max_kw) when power_class = 'AC' then least(power_kw, ac_max_kw) end as effective_kw from {fx_point} join {fx_vehicle} on vehicle_id = k % 200 + 1",
)
def _(v):
    both = v.fx_point.withColumn("vehicle_id", c("k") % 200 + 1).join(v.fx_vehicle, "vehicle_id")
    return both.select("evse_id", "vehicle_id", X.effective_power(c("power_kw"), c("power_class"), c("ac_max_kw"), c("dc_max_kw")).alias("effective_kw"))


_KM = _HAV.format("rlat", "rlon", "lat", "lon")


@query("fn_eta_minutes", f"select request_id, round(case when 1.3 * km <= 5 then 1.3 * km / 35 else 1.3 * km / 60 end * 60, 6) as eta from (select request_id, {_KM} as km from {{near_req}}) x")
def _(v):
    return rounded(_near(v).select("request_id", X.eta_minutes(X.haversine_km(c("rlat"), c("rlon"), c("lat"), c("lon"))).alias("eta")))


@query("fn_slots", "select event_id, make_timestamp(cast(epoch_us(ts) // 300000000 * 300000000 as bigint)) as slot_floor, make_timestamp(cast(round(epoch_us(ts) / 300000000.0) * 300000000 as bigint)) as slot_round from {events}")
def _(v):
    return v.events.select("event_id", X.slot_floor(c("ts")).alias("slot_floor"), X.slot_round(c("ts")).alias("slot_round"))


@query("fn_local_calendar", "select o_orderkey, cast((dayofweek(lt) + 6) % 7 as int) as dow, cast(hour(lt) as int) as hour_local from (select o_orderkey, timezone('Europe/Zurich', timezone('UTC', o_orderdate + interval '1' hour * (o_orderkey % 24))) as lt from {orders}) x")
def _(v):
    ts = F.timestamp_seconds(F.unix_seconds("o_orderdate") + c("o_orderkey") % 24 * 3600)
    return v.orders.select("o_orderkey", X.local_dow(ts).cast("int").alias("dow"), X.local_hour(ts).alias("hour_local"))


@query("fn_weekend_holiday", "select o_orderkey, cast((dayofweek(o_orderdate) + 6) % 7 >= 5 as int) as is_weekend, cast((month(o_orderdate), day(o_orderdate)) in ((1, 1), (8, 1), (12, 25)) as int) as is_holiday from {orders}")
def _(v):
    days = v.spark.createDataFrame([(1, 1), (8, 1), (12, 25)], "m int, d int")  # a holiday table; here the fixed dates of the whole country
    rows = v.orders.withColumns({"m": F.month("o_orderdate"), "d": F.day("o_orderdate")}).join(days.withColumn("hit", F.lit(1)), ["m", "d"], "left")
    return rows.select("o_orderkey", (F.weekday("o_orderdate") >= 5).cast("int").alias("is_weekend"), F.coalesce("hit", F.lit(0)).alias("is_holiday"))


@query("fn_date_parts", "select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as month, last_day(cast(o_orderdate as date)) as month_end, cast(day(last_day(cast(o_orderdate as date))) * 288 as int) as slots_expected from {orders}")
def _(v):
    return v.orders.select("o_orderkey", F.trunc("o_orderdate", "month").alias("month"), F.last_day("o_orderdate").alias("month_end"), X.expected_slots(c("o_orderdate")).cast("int").alias("slots_expected"))


@query("fn_interval_ops", "select o_orderkey, o_orderdate + interval '1' minute * (o_orderkey % 60) as later, round(epoch(timestamp '2001-08-01' - o_orderdate) / 3600, 6) as age_h from {orders}")
def _(v):
    now = F.lit("2001-08-01").cast("timestamp")
    return rounded(v.orders.select("o_orderkey", F.expr("o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 60 as int), 0)").alias("later"), ((F.unix_seconds(now) - F.unix_seconds("o_orderdate")) / 3600).alias("age_h")))


@query("fn_age_label", "select event_id, case when m < 60 then concat(cast(m as int), ' min') when m < 2880 then concat(cast(floor(m / 60) as int), ' h') else concat(cast(floor(m / 1440) as int), ' d') end as label from (select event_id, event_id % 6000 as m from {events}) e")
def _(v):
    return v.events.select("event_id", X.age_label(c("event_id") % 6000).alias("label"))


@query("fn_string_ops", "select c_custkey, trim(concat('  ', c_name, ' ')) as trimmed, split_part(c_name, '#', 2) as part2, left(c_mktsegment, 4) as four, replace(c_name, 'Customer', 'C') as swapped, upper(c_name) as up, regexp_replace(c_name, '[0-9]+', 'N', 'g') as masked from {customer}")
def _(v):
    name = c("c_name")
    return v.customer.select("c_custkey", F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"), F.split_part(name, F.lit("#"), F.lit(2)).alias("part2"), F.left("c_mktsegment", F.lit(4)).alias("four"), F.replace(name, F.lit("Customer"), F.lit("C")).alias("swapped"), F.upper(name).alias("up"), F.regexp_replace(name, "[0-9]+", "N").alias("masked"))


@query("fn_array_ops", "select vehicle_id, array_to_string(list_sort(list_distinct(list_concat(p, ['CCS2', 'SCHUKO']))), ',') as united, list_has_any(p, ['CHADEMO']) as fast, coalesce(list_position(list_sort(p), 'TYPE2_SOCKET'), 0) as place from (select vehicle_id, list(plug_code) as p from {fx_vehicle_plug} group by 1) x")
def _(v):
    p = v.fx_vehicle_plug.groupBy("vehicle_id").agg(F.collect_list("plug_code").alias("p"))
    more = F.array(F.lit("CCS2"), F.lit("SCHUKO"))
    return p.select("vehicle_id", F.array_join(F.array_sort(F.array_union("p", more)), ",").alias("united"), F.arrays_overlap("p", F.array(F.lit("CHADEMO"))).alias("fast"), F.array_position(F.array_sort("p"), "TYPE2_SOCKET").cast("int").alias("place"))


@query("fn_json_ops", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, concat('{{\"id\":', event_id, ',\"type\":\"', event_type, '\"}}') as record, 2 as n from {events}")
def _(v):
    record = F.to_json(F.struct(c("event_id").alias("id"), c("event_type").alias("type")))
    return v.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), record.alias("record"), F.json_array_length(F.to_json(F.array("event_id", "user_id"))).alias("n"))


@query("fn_null_ops", "select k, coalesce(power_kw, 0) as kw, nullif(power_class, 'AC') as not_ac, greatest(coalesce(power_kw, 0), 15) as at_least, least(power_kw, 50) as at_most, coalesce(nullif(trim(case when k % 2 = 0 then ' ' else station_name end), ''), operator_id) as label from {fx_point}")
def _(v):
    return v.fx_point.select("k", F.coalesce("power_kw", F.lit(0.0)).alias("kw"), F.nullif(c("power_class"), F.lit("AC")).alias("not_ac"), F.greatest(F.coalesce("power_kw", F.lit(0.0)), F.lit(15.0)).alias("at_least"), F.least("power_kw", F.lit(50.0)).alias("at_most"), X.first_filled(F.when(c("k") % 2 == 0, " ").otherwise(c("station_name")), c("operator_id")).alias("label"))


@query("fn_hash_bucket", "select evse_id, cast('0x' || substr(md5(evse_id), 1, 8) as bigint) % 16 as bucket from {fx_point}")
def _(v):
    return v.fx_point.select("evse_id", X.hash_bucket(c("evse_id"), 16).alias("bucket"))


@query("fn_cast_round", "select c_custkey, round(c_acctbal, 1) as one, cast(floor(c_acctbal) as bigint) as whole, try_cast(case when c_custkey % 3 = 0 then 'n/a' else cast(c_custkey as varchar) end as bigint) as parsed from {customer}")
def _(v):
    text = F.when(c("c_custkey") % 3 == 0, "n/a").otherwise(c("c_custkey").cast("string"))
    return v.customer.select("c_custkey", F.round("c_acctbal", 1).alias("one"), F.floor("c_acctbal").alias("whole"), text.try_cast("long").alias("parsed"))


@query("fn_coarsen_location", "select request_id, cast(round(cast(lat as decimal(12, 6)), 2) as double) as lat, cast(round(cast(lon as decimal(12, 6)), 2) as double) as lon from {fx_request}")
def _(v):
    return v.fx_request.select("request_id", X.coarse(c("lat")).alias("lat"), X.coarse(c("lon")).alias("lon"))


@query("fn_power_class", "select k, case when t = 'DC' then 'DC' when t like 'AC%' then 'AC' end as declared, case when t = 'DC' then 'DC' when t like 'AC%' then 'AC' when power_kw > 22 then 'DC' end as derived from (select k, power_kw, case k % 4 when 0 then 'DC' when 1 then 'AC_1_PHASE' when 2 then 'AC_3_PHASE' end as t from {fx_point}) x")
def _(v):
    t = F.when(c("k") % 4 == 0, "dc").when(c("k") % 4 == 1, "AC_1_PHASE").when(c("k") % 4 == 2, "ac_3_phase")
    return v.fx_point.select("k", X.power_class(t).alias("declared"), X.power_class(t, c("power_kw")).alias("derived"))


@query("fn_arrival_delta", f"select request_id, cast(least(greatest(ceil(eta / 5) * 5, 5), 60) as int) as delta_min from (select request_id, case when 1.3 * km <= 5 then 1.3 * km / 35 else 1.3 * km / 60 end * 60 as eta from (select request_id, {_KM} as km from {{near_req}}) x) y")
def _(v):
    return _near(v).select("request_id", X.arrival_delta(X.eta_minutes(X.haversine_km(c("rlat"), c("rlon"), c("lat"), c("lon")))).alias("delta_min"))


# filters


@query("range_quarantine", "select canton_code, hour_utc, kind from {fx_weather} where temperature_c > 25 or temperature_c < -8")
def _(v):
    out = F.coalesce(~c("temperature_c").between(-8, 25), F.lit(False))
    return v.fx_weather.filter(out).select("canton_code", "hour_utc", "kind")


@query("regex_validity", "select station_id, postal_code from {fx_station} where not regexp_full_match(postal_code, '[0-9]{{4}}')")
def _(v):
    return v.fx_station.filter(~c("postal_code").rlike("^[0-9]{4}$")).select("station_id", "postal_code")


@query("prefix_match_ci", "select station_id, city from {fx_station} where city ilike 'cItY 1%'")
def _(v):
    return v.fx_station.filter(c("city").ilike("cItY 1%")).select("station_id", "city")


@query("in_list_param", "select evse_id, status from {fx_status_dense} where evse_id in (select evse_id from {fx_point} where k in (3, 6, 9)) and minute(slot_ts) = 0")
def _(v):
    wanted = v.fx_point.filter(c("k").isin(3, 6, 9)).select("evse_id")
    return v.fx_status_dense.filter(F.minute("slot_ts") == 0).join(wanted, "evse_id", "left_semi").select("evse_id", "status")


@query("bounding_box", "select station_id, lat, lon from {fx_station} where lat between 46.9 - 30 / 111.0 and 46.9 + 30 / 111.0 and lon between 7.4 - 30 / (111.0 * cos(radians(46.9))) and 7.4 + 30 / (111.0 * cos(radians(46.9)))")
def _(v):
    from ..operators.geo import in_box

    return v.fx_station.filter(in_box(c("lat"), c("lon"), F.lit(46.9), F.lit(7.4), 30.0)).select("station_id", "lat", "lon")


@query("null_safe_compare", "select a.k, a.power_class is not distinct from b.power_class as same_class, (a.power_class is not distinct from b.power_class and a.power_kw is not distinct from b.power_kw) as same_row from {fx_point} a join {fx_point} b on b.k = a.k + 29")
def _(v):
    a, b = v.fx_point.alias("a"), v.fx_point.withColumn("k0", c("k") - 29).alias("b")
    row = lambda s: F.struct(c(f"{s}.power_class"), c(f"{s}.power_kw"))
    return a.join(b, c("a.k") == c("b.k0")).select(c("a.k").alias("k"), c("a.power_class").eqNullSafe(c("b.power_class")).alias("same_class"), row("a").eqNullSafe(row("b")).alias("same_row"))


# sorts and sets


@query("topk_nulls_last", "select k, power_kw from {fx_point} order by power_kw desc nulls last, k limit 20")
def _(v):
    return v.fx_point.select("k", "power_kw").orderBy(F.desc_nulls_last("power_kw"), "k").limit(20)


@query("custom_order", "select * from (select model, n, row_number() over (order by list_position(['R', 'A', 'N'], model)) as place from (select model, count(*) as n from {fx_metric} group by 1) x) y")
def _(v):
    from pyspark.sql import Window

    n = v.fx_metric.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    at = F.array_position(F.array(*map(F.lit, "RAN")), c("model"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(at)))  # a few rows by now


@query("physical_cluster_sort", "select evse_id, count(*) as n_rows, 1 as n_files, true as in_order, min(slot_ts) as first_slot, max(slot_ts) as last_slot from {grid_raw} group by 1")
def _(v):
    """The grid in buckets, read again: each point lies in one file, whose rows stand in the order of point and slot."""
    from pyspark.sql import Window

    from ..operators.status import status_grid

    table = v.spark.table(sinks.write_bucketed(status_grid(v.fx_status_raw), scratch(v.spark, "buckets"), int(v.spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = table.select("evse_id", "slot_ts", c("_metadata.file_path").alias("file"), c("_metadata.row_index").alias("at"))
    along = Window.partitionBy("file").orderBy("at")  # a bucket is a task's work
    rows = rows.withColumn("ok", F.coalesce(F.struct(F.lag("evse_id").over(along), F.lag("slot_ts").over(along)) <= F.struct("evse_id", "slot_ts"), F.lit(True)))
    rows = rows.withColumn("ok", c("ok") | F.lag("evse_id").over(along).isNull())
    return rows.groupBy("evse_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("file").cast("int").alias("n_files"), F.bool_and("ok").alias("in_order"), F.min("slot_ts").alias("first_slot"), F.max("slot_ts").alias("last_slot"))


def registered(v):
    """The session's SQL with the domain's functions, and views of the tables they are called on."""
    sql.register(v.spark, {"charging_point": v.fx_point, "charging_point_plug": v.fx_point_plug, "charging_vehicle": v.fx_vehicle, "charging_vehicle_plug": v.fx_vehicle_plug})
    v.fx_station.createOrReplaceTempView("charging_station")
    return v.spark.sql


_AT = _HAV.format("46.5", "7.5", "p.lat", "p.lon")


@query(
    "sql_scalar_functions",
    f"""select evse_id, round(km, 6) as km, round(case when km * 1.3 <= 5 then km * 1.3 / 35 else km * 1.3 / 60 end * 60, 6) as eta, station_key, kw from (select p.evse_id, {_AT} as km,
      md5(concat(p.operator_id, '|', lower(regexp_replace(s.street, '[^a-zA-Z0-9]+', '', 'g')), '|', trim(s.postal_code))) as station_key,
      case when power_kw is null then null when power_class = 'DC' then least(power_kw, 100.0) when power_class = 'AC' then least(power_kw, 11.0) end as kw
    from {{fx_point}} p join {{fx_station}} s using (station_id)) x""",
)
def _(v):
    return rounded(
        registered(v)("""
        select p.evse_id, haversine_km(46.5d, 7.5d, p.lat, p.lon) as km, eta_minutes(haversine_km(46.5d, 7.5d, p.lat, p.lon)) as eta,
          station_key(p.operator_id, s.street, s.postal_code, p.lat, p.lon) as station_key, effective_power(p.power_kw, p.power_class, 11d, 100d) as kw
        from charging_point p join charging_station s using (station_id)""")
    )


@query(
    "sql_compatible_points",
    f"""select evse_id, any_value(station_id) as station_id, round(any_value(km), 6) as distance_km, array_to_string(list_sort(list(distinct plug_code)), ',') as plug_codes, any_value(power_class) as power_class, any_value(kw) as effective_kw
    from (select p.evse_id, p.station_id, {_AT} as km, a.plug_code, p.power_class, case when power_kw is null then null when power_class = 'DC' then least(power_kw, dc_max_kw) else least(power_kw, ac_max_kw) end as kw
      from {{fx_point}} p join {{fx_point_plug}} a using (evse_id) join {{fx_vehicle_plug}} b using (plug_code) join {{fx_vehicle}} v using (vehicle_id) where vehicle_id = 7 and is_active and (power_class = 'AC' or dc_max_kw is not null)) x
    where km <= 50 group by 1""",
)
def _(v):
    return rounded(registered(v)("select evse_id, station_id, distance_km, array_join(plug_codes, ',') as plug_codes, power_class, effective_kw from compatible_points(7, 46.5d, 7.5d, 50d)"))


@query("append_union", "select evse_id, 'dc' as part from {fx_point} where power_class = 'DC' union all select evse_id, 'ac' as part from {fx_point} where power_class = 'AC'")
def _(v):
    part = lambda p, name: v.fx_point.filter(c("power_class") == p).select("evse_id", F.lit(name).alias("part"))
    return part("DC", "dc").unionByName(part("AC", "ac"))
