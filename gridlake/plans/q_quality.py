"""Every check of the catalogue, the runner and the constraint audits, on views with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality, status
from ..session import staged
from .q_analytics import _KM, NOW, RUN_NOW
from .q_status import occupancy, rounded
from .q_tables import payload, run_events, ts
from .registry import SHARED, Views, query

c = F.col

# faulty versions of the views
SHARED["b_station"] = "select station_id, operator_id, name, postal_code, case when station_id % 37 = 0 then null else canton_code end as canton_code, case when station_id % 43 = 0 then lat + 1.5 else lat end as lat, lon from {fx_station} union all select station_id + 100000, operator_id, name, postal_code, canton_code, lat + 0.0001, lon + 0.0002 from {fx_station} where station_id % 5 = 0"
SHARED["b_point"] = "select case when k % 47 = 0 then concat('bad ', k) else evse_id end as evse_id, station_id, case when k % 59 = 0 then 500.0 else power_kw end as power_kw, power_class, is_active from {fx_point}"
SHARED["b_plug"] = "select evse_id, plug_code from {fx_point_plug} where hash_k % 9 <> 0".replace("hash_k", "cast('0x' || substr(md5(evse_id), 1, 8) as bigint)")
SHARED["b_canton"] = "select n_name as canton_code, 46.6 as lat, 8.2 as lon from {nation}"
SHARED["b_occ"] = "select * from {occ}"


def tables(v: Views) -> quality.Tables:
    from ..functions.exprs import hash_bucket

    s = v.fx_station
    base = s.select("station_id", "operator_id", "name", "postal_code", F.when(c("station_id") % 37 != 0, c("canton_code")).alias("canton_code"), F.when(c("station_id") % 43 == 0, c("lat") + 1.5).otherwise(c("lat")).alias("lat"), "lon")
    twins = s.filter("station_id % 5 = 0").select((c("station_id") + 100000).alias("station_id"), "operator_id", "name", "postal_code", "canton_code", (c("lat") + 0.0001).alias("lat"), (c("lon") + 0.0002).alias("lon"))
    grid = status.status_grid(v.fx_status_raw)
    return {
        "station": base.unionByName(twins),
        "point": v.fx_point.select(F.when(c("k") % 47 == 0, F.concat(F.lit("bad "), "k")).otherwise(c("evse_id")).alias("evse_id"), "station_id", F.when(c("k") % 59 == 0, 500.0).otherwise(c("power_kw")).alias("power_kw"), "power_class", "is_active"),
        "point_plug": v.fx_point_plug.filter(hash_bucket(c("evse_id"), 9) != 0),
        "canton": v.nation.select(c("n_name").alias("canton_code"), F.lit(46.6).alias("lat"), F.lit(8.2).alias("lon")),
        "weather": v.fx_weather,
        "payload": payload(v),
        "quarantine": v.fx_quarantine,
        "occupancy": occupancy(v).filter("minute(hour_utc) = 0"),
        "unknown": unknown(v),
        "coverage": status.archive_coverage(grid, v.fx_point.filter("k % 3 = 0").select("evse_id", "canton_code")),
        "vehicle": v.fx_vehicle,
        "vehicle_plug": v.fx_vehicle_plug.filter("vehicle_id % 11 <> 0"),
        "run": v.fx_run,
    }


def unknown(v: Views) -> DataFrame:
    return v.events.filter("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("count")).select(F.to_json(F.struct("count", F.array("user_id").alias("examples"))).alias("record"))


_AT = {"completeness_weather_actual": NOW, "freshness_weather_actual": "2024-02-10 00:00:00"}
_DIST = _KM.replace("p.", "b.").replace("r.", "a.")
ORACLE = {
    "completeness_station_canton": "select station_id, name, postal_code from {b_station} where canton_code is null",
    "completeness_evse_power": "select evse_id, power_kw, power_class from {b_point} where is_active and (power_kw is null or power_class is null)",
    "completeness_evse_plugs": "select evse_id from (select evse_id, count(*) over () as bare from {b_point} p where is_active and not exists (select 1 from {b_plug} l where l.evse_id = p.evse_id)) x where bare > 0.02 * (select count(*) from {b_point} where is_active)",
    "completeness_weather_actual": "select n_name as canton_code, h.hour_utc from {nation}, (select unnest(generate_series(timestamp '2023-12-28', timestamp '2024-01-26 23:00:00', interval '1 hour')) as hour_utc) h where (n_name, h.hour_utc) not in (select (canton_code, hour_utc) from {fx_weather} where kind = 'actual')",
    "uniqueness_evse_in_payload": "select evse_id, count(*) as n from {payload} group by 1 having count(*) > 1",
    "uniqueness_station_location": f"select a.station_id, b.station_id as other_station_id, round(1000 * {_DIST}, 1) as distance_m from {{b_station}} a join {{b_station}} b on b.operator_id = a.operator_id and b.station_id > a.station_id and abs(b.lat - a.lat) <= 0.0003 and abs(b.lon - a.lon) <= 0.0005 where {_DIST} < 0.03",
    "validity_evse_id_format": "select evse_id from {b_point} where not regexp_matches(evse_id, '" + quality.POINT_ID.replace("{", "{{").replace("}", "}}") + "')",
    "validity_quarantine_recent": "select table_name, reason, count(*) as n from {fx_quarantine} where created_at > timestamp '2001-07-31' group by 1, 2",
    "type_postal_code": "select station_id, postal_code from {b_station} where not regexp_full_match(postal_code, '[0-9][0-9][0-9][0-9]')",
    "range_evse_power": "select evse_id, power_class, power_kw from {b_point} where is_active and (power_class = 'AC' and (power_kw < 1 or power_kw > 43) or power_class = 'DC' and (power_kw < 5 or power_kw > 400))",
    "range_station_canton_distance": f"select station_id, canton_code, round({_DIST}, 1) as km from {{b_station}} a join {{b_canton}} b using (canton_code) where {_DIST} > 80",
    "range_hour_coverage": "select canton_code, power_class, hour_utc, slots_observed from {occ} where slots_observed < 6",
    "referential_status_unknown_evse": "select count(*) as n, concat('[', user_id, ']') as examples from {events} where event_type = 'error' group by user_id",
    "referential_archive_geo": "select month, round(s, 6) as share_with_geo from (select cast(date_trunc('month', slot_ts) as date) as month, count(distinct evse_id) filter (k % 3 = 0) / count(distinct evse_id) as s from {grid_raw} left join {fx_point} using (evse_id) group by 1) x where s < 0.6",
    "referential_vehicle_plugs": "select vehicle_id, brand, model from {fx_vehicle} where vehicle_id % 11 = 0",
    "freshness_evse_data": "select * from (select round(epoch(timestamp '2001-08-01' - max(finished_at)) / 3600, 6) as age_h from {fx_run} where source = '2-HIGH' and status in ('success', 'partial')) x where age_h > 168",
    "freshness_weather_actual": "select max(hour_utc) as last_hour from {fx_weather} where kind = 'actual' having max(hour_utc) < timestamp '2024-02-05'",
    "freshness_archive_months": "select cast(date_trunc('month', slot_ts) as date) as month, count(distinct slot_ts) as n_slots, cast(any_value(day(last_day(slot_ts))) * 288 as int) as expected_slots from {grid_raw} group by 1 having count(distinct slot_ts) < 0.9 * any_value(day(last_day(slot_ts))) * 288",
}


def _register(check_id: str) -> None:
    @query(f"dq_{check_id}" if check_id in () else check_id, ORACLE[check_id])
    def _(v):
        out = rounded(quality.CATALOGUE[check_id].find(tables(v), ts(_AT.get(check_id, RUN_NOW))))
        return out.withColumn("month", c("month").cast("date")) if "month" in out.columns else out


for _id in quality.CATALOGUE:
    _register(_id)

#: The runner's checks whose "now" is that of the run log.
_RUN = [k for k in quality.CATALOGUE if k not in _AT]


@query("dq_run", " union all ".join(f"select '{k}' as check_id, '{quality.CATALOGUE[k].severity}' as severity, count(*) = 0 as passed, count(*) as failed_rows from ({ORACLE[k]}) x" for k in _RUN))
def _(v):
    shared = tables(v)
    shared |= {x: staged(shared[x], x) for x in ("occupancy", "coverage")}  # several checks read them
    return quality.run_checks(shared, ts(RUN_NOW), v.spark, only=_RUN).select("check_id", "severity", "passed", "failed_rows")


@query(
    "constraint_audit",
    "select 'lineitem key' as audit, concat(l_orderkey, '|', l_linenumber) as row_key from {lineitem} group by l_orderkey, l_linenumber having count(*) > 1 "
    "union all select distinct 'lineitem without supplier', cast(l_suppkey as varchar) from {lineitem} where l_suppkey not in (select s_suppkey from {supplier} where s_suppkey % 7 <> 0) "
    "union all select 'customer balance', cast(c_custkey as varchar) from {customer} where not c_acctbal >= 0 "
    "union all select distinct 'reopened run', cast(run_id as varchar) from {fx_run} where status <> 'running' and run_id % 9 = 0 and epoch(finished_at - started_at) < 3600 "
    "union all select 'open versions', cast(evse_k as varchar) from {hist} where change_type = 'update' group by evse_k having count(*) > 1",
)
def _(v):
    from .q_analytics import history

    again = v.fx_run.filter("run_id % 9 = 0").select("run_id", (c("started_at") + F.expr("interval 60 minutes")).alias("at"), F.lit("running").alias("status"), F.lit(0).cast("long").alias("rows"))
    parts = [
        quality.duplicate_keys(v.lineitem, ["l_orderkey", "l_linenumber"], "lineitem key"),
        quality.orphans(v.lineitem.select(c("l_suppkey").alias("s_suppkey")), v.supplier.filter("s_suppkey % 7 <> 0"), "s_suppkey", "lineitem without supplier"),
        quality.refused(v.customer, "c_custkey", c("c_acctbal") >= 0, "customer balance"),
        quality.reopened_runs(run_events(v).unionByName(again)),
        quality.many_open(history(v), "evse_k", c("change_type") == "update", "open versions"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("global_share_guard", ORACLE["completeness_evse_plugs"].replace("0.02", "0.05"))
def _(v):
    return quality.CATALOGUE["completeness_evse_plugs"].find(tables(v), ts(RUN_NOW))


@query("incompatible_recommendations", "select 'incompatible station' as audit, concat(r.request_id, '|', s.station_id) as row_key from {fx_request} r join {fx_station} s on s.station_id = r.request_id % 200 where not exists (select 1 from {fx_vehicle_plug} a join {fx_point_plug} b on b.plug_code = a.plug_code join {fx_point} p on p.evse_id = b.evse_id and p.is_active where a.vehicle_id = r.vehicle_id and p.station_id = s.station_id)")
def _(v):
    items = v.fx_request.select("request_id", (c("request_id") % 200).alias("station_id")).join(v.fx_station.select("station_id"), "station_id", "left_semi")
    return quality.incompatible_items(items, v.fx_request, v.fx_point, v.fx_point_plug, v.fx_vehicle_plug)
