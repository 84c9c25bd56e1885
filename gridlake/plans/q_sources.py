"""Readers, sinks and streams, on files that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import status
from ..session import scratch
from ..sources import readers, schemas, sinks
from ..streaming import status_stream
from .q_status import rounded
from .q_tables import ts
from .registry import SHARED, query

c = F.col


def written(df, kind: str, **options) -> str:
    path = scratch(df.sparkSession, kind)
    df.write.format(kind).options(**options).save(path)
    return path


@query("read_status_archive", "select EvseID, datetime, EVSEStatus, OperatorID from {fx_status_raw}")
def _(v):
    return readers.read_status_archive(v.spark, written(v.fx_status_raw, "parquet"))


@query("archive_structure_gate", "select 1 as month, false as complete union all select 2, true")
def _(v):
    raw = v.fx_status_raw
    found = [(i, readers.read_status_archive(v.spark, written(x, "parquet")) is not None) for i, x in ((1, raw.drop("OperatorID")), (2, raw))]
    return raw.limit(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("month"), F.lit(ok).alias("complete")) for i, ok in found])).alias("m")).select("m.*")


SHARED["dir_src"] = "select *, case when k % 4 = 0 then concat(lat, ' ', lon) when k % 4 = 1 then concat(lat, ',', lon) when k % 4 = 2 then 'None None' end as google from {fx_point}"


#: Keys of points that a page of the feed spans: more points make more pages, not larger ones.
PAGE = 1000


def directory(v):
    """A directory payload, nested as its feed has it."""
    google = F.when(c("k") % 4 == 0, F.concat_ws(" ", "lat", "lon")).when(c("k") % 4 == 1, F.concat_ws(",", "lat", "lon")).when(c("k") % 4 == 2, "None None")
    text = lambda x: x.cast("string")
    record = F.struct(
        c("evse_id").alias("EvseID"), c("evse_id").alias("ChargingStationId"), F.array(F.lit("Type 2 Outlet")).alias("Plugs"), c("is_active").alias("IsOpen24Hours"), F.lit("Free publicly accessible").alias("Accessibility"),
        F.struct(F.lit("Bern").alias("City"), (1000 + c("k") % 900).cast("string").alias("PostalCode"), F.lit("Main").alias("Street")).alias("Address"),
        F.struct(google.alias("Google"), F.struct(text(c("lat")).alias("Latitude"), text(c("lon")).alias("Longitude")).alias("DecimalDegree")).alias("GeoCoordinates"),
        F.array(F.struct(F.when(c("k") % 5 == 0, text(c("power_kw") * 1000)).otherwise(text(c("power_kw"))).alias("power"), F.when(c("power_class") == "DC", "DC").otherwise("odd").alias("powertype")), F.struct(F.lit("3").alias("power"), F.lit("AC_3_PHASE").alias("powertype"))).alias("ChargingFacilities"),
        F.array(F.struct(F.lit("en").alias("lang"), c("station_name").alias("value")), F.struct(F.lit("de").alias("lang"), F.when(c("k") % 3 == 0, F.concat(F.lit("DE "), "station_name")).otherwise(" ").alias("value"))).alias("ChargingStationNames"),
        F.lit("2026-01-01T00:00:00Z").alias("lastUpdate"),
    )
    ops = v.fx_point.groupBy(c("operator_id").alias("OperatorID"), F.floor(c("k") / PAGE).alias("page")).agg(F.collect_list(record).alias("EVSEDataRecord"))  # pages of a feed
    return ops.select(F.array(F.struct("OperatorID", c("OperatorID").alias("OperatorName"), "EVSEDataRecord")).alias("EVSEData"))


@query(
    "flatten_directory_json",
    "select evse_id, operator_id, case when k % 4 = 2 then null else round(lat, 6) end as lat, case when k % 4 = 2 then null else round(lon, 6) end as lon, coalesce(power_kw, 3.0) as power_kw, case when power_kw is not null and power_class = 'DC' then 'DC' when power_class = 'DC' then 'AC_3_PHASE' else 'AC_3_PHASE' end as power_type, case when k % 3 = 0 then concat('DE ', station_name) else station_name end as station_name, cast(1000 + k % 900 as varchar) as postal_code from {fx_point}",
)
def _(v):
    flat = readers.read_directory(v.spark, written(directory(v), "json"), multi_line=False)
    return flat.select("evse_id", "operator_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "power_kw", "power_type", "station_name", "postal_code")


@query("parse_coordinates", "select k, case when k % 4 = 2 then null when k % 4 = 3 then null else round(lat, 6) end as lat, case when k % 4 in (2, 3) then null else round(lon, 6) end as lon from {dir_src}")
def _(v):
    google = F.when(c("k") % 4 == 0, F.concat_ws(" ", "lat", "lon")).when(c("k") % 4 == 1, F.concat_ws(",", "lat", "lon")).when(c("k") % 4 == 2, "None None")
    p = readers.parse_coordinates(google)
    return v.fx_point.select("k", F.round(p["lat"], 6).alias("lat"), F.round(p["lon"], 6).alias("lon"))


@query("max_facility_power", "select k, case when power_kw is null then 2.5 else power_kw end as power_kw, case when power_kw is null then 'AC_1_PHASE' when power_class = 'DC' then 'DC' else 'AC_1_PHASE' end as power_type from {fx_point}")
def _(v):
    f = F.array(F.struct(F.lit("2.5").alias("power"), F.lit("AC_1_PHASE").alias("powertype")), F.struct((c("power_kw") * 1000).cast("string").alias("power"), F.when(c("power_class") == "DC", "dc").otherwise("?").alias("powertype")))
    p = readers.max_facility_power(f)
    return v.fx_point.select("k", p["power_kw"].alias("power_kw"), p["power_type"].alias("power_type"))


@query("localized_name", "select k, case when k % 3 = 0 then 'de name' when k % 2 = 0 then 'it name' else station_name end as name from {fx_point}")
def _(v):
    names = F.array(F.struct(F.lit("en").alias("lang"), c("station_name").alias("value")), F.struct(F.lit("it").alias("lang"), F.when(c("k") % 2 == 0, "it name").otherwise("").alias("value")), F.struct(F.lit("DE").alias("lang"), F.when(c("k") % 3 == 0, " de name ").alias("value")))
    return v.fx_point.select("k", readers.localized_name(names).alias("name"))


@query("record_hash", "select count(*) as records, count(distinct concat_ws('|', operator_id, station_name, lat, lon, coalesce(power_kw, -1), coalesce(power_class, '?'))) as digests from {fx_point}")
def _(v):
    h = readers.record_hash(c("operator_id"), c("station_name"), F.lit("Main"), c("lat"), c("lon"), F.array(F.lit("b"), F.lit("a")), c("power_kw"), c("power_class"), F.lit("free"), F.lit(True))
    per = v.fx_point.groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("digests"))


@query("unpivot_columnar_weather", "select canton_code, hour_utc, 'actual' as kind, round(temperature_c, 6) as temperature_c, case when row_number() over (partition by canton_code order by hour_utc) <= 100 then round(precipitation_mm, 6) end as precipitation_mm from {fx_weather} where kind = 'actual'")
def _(v):
    rows = v.fx_weather.filter("kind = 'actual'").groupBy("canton_code").agg(F.array_sort(F.collect_list(F.struct("hour_utc", "temperature_c", "precipitation_mm"))).alias("r"))  # a month of one canton
    none = F.array().cast("array<double>")
    hourly = F.struct(F.transform("r", lambda x: F.date_format(x["hour_utc"], "yyyy-MM-dd'T'HH:mm")).alias("time"), F.transform("r", lambda x: x["temperature_c"]).alias("temperature_2m"), F.slice(F.transform("r", lambda x: x["precipitation_mm"]), 1, 100).alias("precipitation"), none.alias("snowfall"), none.alias("wind_speed_10m"))
    path = written(rows.select("canton_code", hourly.alias("hourly")), "json")
    df = v.spark.read.schema("canton_code string, hourly struct<time:array<string>,temperature_2m:array<double>,precipitation:array<double>,snowfall:array<double>,wind_speed_10m:array<double>>").json(path)
    return rounded(readers.unpivot_weather(df, "actual").drop("snowfall_cm", "wind_kmh"))


@query("read_vehicle_catalog", "select brand, model, release_year, ac_max_kw, dc_max_kw, case when vehicle_id % 2 = 0 then 'ccs,type2' else 'type2' end as ports from {fx_vehicle} where vehicle_id % 5 <> 1")
def _(v):
    ac = F.struct(F.array(F.lit("type2")).alias("ports"), c("ac_max_kw").alias("max_power"))
    dc = F.struct(F.when(c("vehicle_id") % 2 == 0, F.array(F.lit("type2"), F.lit("ccs"))).otherwise(F.array().cast("array<string>")).alias("ports"), c("dc_max_kw").alias("max_power"))
    car = F.struct("brand", "model", "variant", "release_year", F.when(c("vehicle_id") % 5 == 1, "motorbike").alias("vehicle_type"), F.lit(50.0).alias("usable_battery_size"), ac.alias("ac_charger"), dc.alias("dc_charger"))
    path = written(v.fx_vehicle.groupBy("brand", (c("vehicle_id") % 20).alias("page")).agg(F.collect_list(car).alias("data")).select("data"), "json")
    return readers.read_vehicle_catalog(v.spark, path, multi_line=False).select("brand", "model", "release_year", "ac_max_kw", "dc_max_kw", F.array_join("ports", ",").alias("ports"))


@query("read_manual_catalog", "select brand, model, case when vehicle_id % 3 = 0 then null else release_year end as release_year, ac_max_kw, dc_max_kw, case when vehicle_id % 2 = 0 then 'ccs,type2' else '' end as ports from {fx_vehicle}")
def _(v):
    blank = lambda ok, x: F.when(ok, x.cast("string")).otherwise(F.lit(" "))
    rows = v.fx_vehicle.select("brand", "model", "variant", blank(c("vehicle_id") % 3 != 0, c("release_year")).alias("release_year"), F.lit(" ").alias("battery_kwh"), "ac_max_kw", "dc_max_kw", F.when(c("vehicle_id") % 2 == 0, "ccs|type2").otherwise(" ").alias("ports"))
    return readers.read_manual_catalog(v.spark, written(rows, "csv", header=True)).select("brand", "model", "release_year", "ac_max_kw", "dc_max_kw", F.array_join("ports", ",").alias("ports"))


def postal(v):
    rows = v.fx_locality.select(c("zip_id").alias("ZIP_ID"), c("postal_code").alias("PLZ4"), F.concat(F.lit("Ort "), "zip_id").alias("Ortschaftsname"), c("canton_code").alias("Kantonskürzel"), F.concat("address_share", F.lit("%")).alias("Adressenanteil"), c("lon").alias("E"), c("lat").alias("N"))
    return readers.read_postal_directory(v.spark, written(rows, "csv", header=True, sep=";"), v.nation.filter("n_nationkey < 20").select(c("n_name").alias("canton_code")))


@query("read_postal_directory", "select zip_id, postal_code, canton_code, address_share from {fx_locality} join {nation} on n_name = canton_code where n_nationkey < 20")
def _(v):
    return postal(v)[0].select("zip_id", "postal_code", "canton_code", "address_share")


@query("postal_rejects", "select canton_code, count(*) as n from {fx_locality} join {nation} on n_name = canton_code where n_nationkey >= 20 group by 1")
def _(v):
    return postal(v)[1].groupBy("canton_code").agg(F.count(F.lit(1)).alias("n"))


@query("read_point_details", "select evse_id, case when k % 6 = 0 then null else round(lat, 6) end as lat, case when k % 6 = 0 then null else round(lon, 6) end as lon, case when k % 5 = 0 then null else power_kw end as power_kw from {fx_point}")
def _(v):
    rows = v.fx_point.select(c("evse_id").alias("EvseID"), F.when(c("k") % 6 == 0, "n/a n/a").otherwise(F.concat_ws(" ", "lat", "lon")).alias("GeoCoordinates"), F.lit("3000").alias("PostalCode"), F.when(c("k") % 5 == 0, "0").otherwise(c("power_kw").cast("string")).alias("ChargingFacility_power"), F.lit("DC").alias("ChargingFacility_powertype"))
    return readers.read_point_details(v.spark, written(rows, "csv", header=True)).select("evse_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "power_kw")


@query("raw_manifest")
def _(v):
    path = written(v.events.select("event_id", "event_type").repartition(4, "event_id"), "json")
    return readers.raw_manifest(v.spark, path).filter(c("path").endswith(".json")).select("size", "sha")


@query("schema_fingerprint", "select 'events' as source, 'event_id,event_type,props,ts,user_id,value' as fields, sha256('event_id,event_type,props,ts,user_id,value') as fields_hash")
def _(v):
    feed = v.spark.read.json(written(v.events, "json"))  # the schema is that of the rows, all of them read
    return readers.schema_fingerprint(feed, "events")


@query("schema_drift", "select 'events' as source, sha256('event_id,event_type,extra,props,ts,user_id,value') as fields_hash")
def _(v):
    known = readers.schema_fingerprint(v.spark.read.json(written(v.events, "json")), "events")
    later = v.spark.read.json(written(v.events.withColumn("extra", F.when(c("event_id") % 97 == 5, 1)), "json"))  # a field that few rows have
    return readers.schema_drift(readers.schema_fingerprint(later, "events").unionByName(known), known).select("source", "fields_hash")


_FIELDS = "select string_agg(f, ',' order by f) as fields from (select column_name as f from (describe {{events}}){0}) x"


@query(
    "schema_registry",
    "select 'events' as source, fields, sha256(fields) as fields_hash, first_seen, last_seen from ("
    f"select *, timestamp '2024-02-01' as first_seen, timestamp '2024-02-03' as last_seen from ({_FIELDS.format('')}) a union all select *, timestamp '2024-02-02', timestamp '2024-02-02' from ({_FIELDS.format(chr(32) + 'union all select ' + repr('extra'))}) b) c",
)
def _(v):
    """Three loads of a feed: as it is, with a field more, and as it was."""
    table = schemas.registry(v.spark, scratch(v.spark, "schemas"))
    more = F.when(c("event_id") % 97 == 5, 1)
    for day, rows in (("2024-02-01", v.events), ("2024-02-02", v.events.withColumn("extra", more)), ("2024-02-03", v.events)):
        schemas.note(table, schemas.feed_fingerprint(v.spark.read.text(written(rows, "json")), "events", day))
    return table.read()


@query("write_month_partition", "select o_orderkey as evse_id, strftime(o_orderdate, '%Y-%m') as month, case when o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1996-03-01' then 2 else 1 end as version from {orders}")
def _(v):
    path = scratch(v.spark, "months")
    rows = v.orders.select(c("o_orderkey").alias("evse_id"), c("o_orderdate").alias("slot_ts"), F.lit(1).alias("version"))
    again = rows.filter("slot_ts >= timestamp '1996-01-01' and slot_ts < timestamp '1996-03-01'").withColumn("version", F.lit(2))
    sinks.write_month_partition(rows, path)
    for _ in range(2):  # twice is once
        sinks.write_month_partition(again, path)
    return v.spark.read.parquet(path).select("evse_id", c("month").cast("string").alias("month"), "version")


# streams


def stream(v):
    """The events table as a stream of statuses."""
    path = v.sf_dir
    schema = v.spark.read.parquet(f"{path}/events.parquet").schema
    raw = status_stream.snapshots(v.spark, path, schema, pattern="events.parquet")
    kind = F.when(c("event_type") == "view", "Available").when(c("event_type") == "click", "Occupied").when(c("event_type") == "purchase", "Reserved").when(c("event_type") == "error", "OutOfService").otherwise("Unknown")
    operator = F.floor(c("user_id") / 3) % 7
    return raw.select(F.concat(F.lit("CH*OP"), operator, F.lit("*E"), "user_id").alias("evse_id"), c("ts").cast("timestamp").alias("datetime"), kind.alias("status"))


SHARED["floor_slots"] = "select distinct EvseID as evse_id, make_timestamp(cast(epoch_us(datetime) // 300000000 * 300000000 as bigint)) as slot_ts from {fx_status_raw}"


@query("stream_status_ingest", "select evse_id, slot_ts from {floor_slots} semi join (select evse_id from {fx_point} where k % 4 <> 0) p using (evse_id)")
def _(v):
    return status_stream.ingest(stream(v), v.fx_point.filter("k % 4 <> 0"))[0].select("evse_id", "slot_ts")


@query("stream_status_unknown", "select slot_ts, count(*) as n from {floor_slots} where evse_id not in (select evse_id from {fx_point} where k % 4 <> 0) group by 1")
def _(v):
    return status_stream.ingest(stream(v), v.fx_point.filter("k % 4 <> 0"))[1]


@query("stream_live_occupancy", "select canton_code, date_trunc('hour', datetime) as hour_utc, count(*) as n, count(*) filter (EVSEStatus = 'Available') as n_free, count(*) filter (EVSEStatus = 'Occupied') as n_occ from {fx_status_raw} join {fx_point} on evse_id = EvseID group by 1, 2")
def _(v):
    return status_stream.live_occupancy(stream(v), v.fx_point).select("canton_code", "hour_utc", "n", "n_free", "n_occ")


SHARED["ep12"] = "select evse_id, any_value(status) as status, min(slot_ts) as valid_from, max(slot_ts) + interval '5 minutes' as valid_to, cast(count(*) as int) as n_slots from (select *, sum(o) over (partition by evse_id order by slot_ts) as i from (select *, case when lag(status) over (partition by evse_id order by slot_ts) is distinct from status or slot_ts - lag(slot_ts) over (partition by evse_id order by slot_ts) > interval '12 hours' then 1 else 0 end as o from {grid_raw}) x) y group by evse_id, i"


@query("stream_episodes", "select * from {ep12} e where valid_to < (select max(slot_ts) from {grid_raw}) - interval '14 hours' or exists (select 1 from {ep12} l where l.evse_id = e.evse_id and l.valid_from > e.valid_from)")
def _(v):
    grid = status.status_grid(v.fx_status_raw).select("evse_id", "slot_ts", "status")
    path = written(grid.repartition(4, "evse_id"), "parquet")
    found = status_stream.episodes(status_stream.snapshots(v.spark, path, grid.schema), gap="12 hours")
    last = F.broadcast(grid.agg(F.max("slot_ts").alias("_end")))
    ends = grid.groupBy("evse_id").agg(F.max("slot_ts").alias("_last"))
    kept = found.join(ends, "evse_id").join(last).filter((c("_last") > c("valid_to") - F.expr("interval 5 minutes")) | (c("valid_to") < c("_end") - F.expr("interval 14 hours")))
    return kept.select("evse_id", "status", "valid_from", "valid_to", "n_slots")


SHARED["archived"] = "select canton_code, date_trunc('hour', slot_ts) as hour_utc, count(*) as n, count(*) filter (status = 'Available') as n_free, count(*) filter (status = 'Occupied') as n_occ from {fx_status_dense} join {fx_point} using (evse_id) where slot_ts < timestamp '2024-01-08' group by 1, 2"


@query("stream_archive_hours", "select * from {archived} union all select canton_code, date_trunc('hour', datetime) as hour_utc, count(*) as n, count(*) filter (EVSEStatus = 'Available') as n_free, count(*) filter (EVSEStatus = 'Occupied') as n_occ from {fx_status_raw} join {fx_point} p on evse_id = EvseID where not exists (select 1 from {archived} a where a.canton_code = p.canton_code and a.hour_utc = date_trunc('hour', datetime)) group by 1, 2")
def _(v):
    """Live hours beside archived ones, which win."""
    told = v.fx_status_dense.filter("slot_ts < timestamp '2024-01-08'").join(v.fx_point.select("evse_id", "canton_code"), "evse_id")
    final = told.groupBy("canton_code", F.date_trunc("hour", "slot_ts").alias("hour_utc")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("status") == "Available").alias("n_free"), F.count_if(c("status") == "Occupied").alias("n_occ"))
    path = written(final, "parquet")
    return status_stream.live_occupancy(stream(v), v.fx_point, archive=lambda: v.spark.read.schema(final.schema).parquet(path))


@query("late_data_policy", "select (select count(*) from {floor_slots} where slot_ts >= timestamp '2024-01-16') as kept, (select count(*) from {fx_status_raw} where datetime < timestamp '2024-01-16') as n_late")
def _(v):
    rows = v.fx_status_raw.select(c("EvseID").alias("evse_id"), "datetime", c("EVSEStatus").alias("status"))
    path, place = scratch(v.spark, "late"), scratch(v.spark, "late-run")
    for part in ("datetime >= timestamp '2024-01-16' and datetime < timestamp '2024-01-29'", "datetime >= timestamp '2024-01-29'", "datetime < timestamp '2024-01-16'"):  # the oldest come last, when the watermark has passed them
        rows.filter(part).write.mode("append").parquet(path)
        # each run goes on where the last one stopped
        found = status_stream.ingest(status_stream.snapshots(v.spark, path, rows.schema), rows.select("evse_id").distinct(), place=place)[0]
    late = status_stream.late_rows(v.spark, place).agg(F.coalesce(F.sum("n_late"), F.lit(0)).alias("n_late"))  # one row
    return found.agg(F.count(F.lit(1)).alias("kept")).join(F.broadcast(late))
