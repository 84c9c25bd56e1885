"""Write disciplines, loads and the directory, on views of old and new versions of one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import directory, keyed, loads
from ..session import scratch
from ..sources.versioned import VersionedTable
from .q_analytics import NOW, RUN_NOW
from .q_status import rounded
from .registry import SHARED, Views, query

c = F.col
ts = lambda x: F.lit(x).cast("timestamp")

# old and new versions of a keyed table
SHARED["t_old"] = "select k, power_kw as kw, k % 7 as h, k % 11 <> 0 as active, case when k % 4 = 0 then 'manual' else 'feed' end as source from {fx_point} where k % 13 <> 0"
SHARED["t_new"] = "select k, power_kw + 10 as kw, case when k % 10 = 0 then k % 7 + 1 else k % 7 end as h, true as active, case when k % 6 = 0 then 'manual' else 'feed' end as source from {fx_point} where k % 13 <> 1 and k % 3 <> 2"


def table_of(rows: DataFrame, part: str) -> VersionedTable:
    """A versioned table that holds rows, in the shared folder."""
    table = VersionedTable(rows.sparkSession, scratch(rows.sparkSession, "table"), part)
    table.replace(rows)
    return table


def old(v: Views) -> DataFrame:
    return v.fx_point.filter("k % 13 <> 0").select("k", c("power_kw").alias("kw"), (c("k") % 7).alias("h"), (c("k") % 11 != 0).alias("active"), F.when(c("k") % 4 == 0, "manual").otherwise("feed").alias("source"))


def new(v: Views) -> DataFrame:
    h = F.when(c("k") % 10 == 0, c("k") % 7 + 1).otherwise(c("k") % 7)
    return v.fx_point.filter("k % 13 <> 1 and k % 3 <> 2").select("k", (c("power_kw") + 10).alias("kw"), h.alias("h"), F.lit(True).alias("active"), F.when(c("k") % 6 == 0, "manual").otherwise("feed").alias("source"))


def _merged(take: str) -> str:
    cols = ", ".join(f"case when {take} then n.{x} else o.{x} end as {x}" for x in ("kw", "h", "active", "source"))
    return f"select coalesce(o.k, n.k) as k, {cols} from {{t_old}} o full join {{t_new}} n on n.k = o.k"


@query("upsert", _merged("n.k is not null"))
def _(v):
    table = table_of(old(v), "pmod(k, 8)")
    for _ in range(2):  # twice is once
        table.merge(new(v), ["k"], moves=False, writer="feed", number=1)
    return table.read()


@query("upsert_if_changed", _merged("n.k is not null and (o.k is null or o.h is distinct from n.h or not o.active)"))
def _(v):
    return keyed.upsert_if_changed(old(v), new(v), ["k"], "h", "active")


@query("upsert_with_priority", _merged("n.k is not null and (o.k is null or o.source = n.source or n.source = 'manual')"))
def _(v):
    return keyed.upsert_with_priority(old(v), new(v), ["k"], "source", "manual")


@query("insert_ignore", "select * from {t_old} union all select * from {t_new} n where not exists (select 1 from {t_old} o where o.k = n.k)")
def _(v):
    return keyed.insert_ignore(old(v), new(v), ["k"])


@query("replace_bridge", "select evse_id, plug_code from {fx_point_plug} where evse_id not in (select evse_id from {fx_point} where k % 4 = 0) union all select evse_id, 'CCS2' from {fx_point} where k % 4 = 0")
def _(v):
    table = table_of(v.fx_point_plug, "pmod(xxhash64(evse_id), 8)")
    table.merge(v.fx_point.filter("k % 4 = 0").select("evse_id", F.lit("CCS2").alias("plug_code")), ["evse_id"], lambda o, n: keyed.replace_bridge(o, n, "evse_id"), moves=False)
    return table.read()


@query("replace_range", "select event_id, value, 'old' as version from {events} where not (ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12' and event_type = 'click') union all select event_id, value + 1, 'new' from {events} where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12' and event_type = 'click'")
def _(v):
    inside = (c("ts") >= ts("2024-01-10")) & (c("ts") < ts("2024-01-12")) & (c("event_type") == "click")
    fresh = v.events.filter(inside).withColumns({"value": c("value") + 1, "version": F.lit("new")})
    table = table_of(v.events.withColumn("version", F.lit("old")), "date_format(ts, 'yyyy-MM-dd')")
    table.replace_range(fresh, inside)  # two days are written, the others named again
    return table.read().select("event_id", "value", "version")


@query("load_partial_aggregates", "select evse_id, cast(dow as int) as dow, cast(hour_local as int) as hour_local, n_free, n_occ, n_obs from {parts}")
def _(v):
    from ..operators.status import profile_parts

    daily = profile_parts(v.fx_status_dense.withColumn("day", F.to_date("slot_ts")), by=["day"])  # kept by day, merged later
    return daily.groupBy("evse_id", c("dow").cast("int").alias("dow"), "hour_local").agg(*[F.sum(x).alias(x) for x in ("n_free", "n_occ", "n_obs")])


SHARED["run_events"] = "select run_id, started_at as \"at\", 'running' as status, cast(0 as bigint) as rows from {fx_run} union all select run_id, finished_at, status, rows_received from {fx_run} where status <> 'running'"


def run_events(v: Views) -> DataFrame:
    opened = v.fx_run.select("run_id", c("started_at").alias("at"), F.lit("running").alias("status"), F.lit(0).cast("long").alias("rows"))
    return opened.unionByName(v.fx_run.filter("status <> 'running'").select("run_id", c("finished_at").alias("at"), "status", c("rows_received").alias("rows")))


@query("append_run_event", "select run_id, \"at\", status, rows from (select *, row_number() over (partition by run_id order by \"at\" desc, status desc, rows desc) as n from {run_events}) x where n = 1")
def _(v):
    return loads.current_runs(run_events(v))


@query("recover_stale_runs", "select run_id, case when status = 'running' and started_at < timestamp '2001-08-01' - interval '6 hours' then 'failed' else status end as status, case when status = 'running' and started_at < timestamp '2001-08-01' - interval '6 hours' then timestamp '2001-08-01' else finished_at end as finished_at from {fx_run}")
def _(v):
    return loads.stale_runs(v.fx_run, ts(RUN_NOW)).select("run_id", "status", "finished_at")


@query("unprocessed_inputs", "select source, sha, run_id from (select source, md5(cast(run_id % 5000 as varchar)) as sha, run_id from {fx_run}) m where not exists (select 1 from {fx_run} r where r.source = m.source and md5(cast(r.run_id % 5000 as varchar)) = m.sha and r.status in ('success', 'partial'))")
def _(v):
    rows = v.fx_run.withColumn("sha", F.md5((c("run_id") % 5000).cast("string")))
    return loads.unprocessed(rows.select("source", "sha", "run_id"), rows)


@query("incremental_window_plan", "select canton_code as key, cast(first + cast(i * 10 as int) as date) as start, least(cast(first + cast(i * 10 + 9 as int) as date), date '2024-03-10') as stop from (select canton_code, cast(max(hour_utc) + interval '1 hour' as date) as first from {fx_weather} where hour_utc < timestamp '2024-01-20' group by 1) x, range(6) t(i) where first + cast(i * 10 as int) <= date '2024-03-10'")
def _(v):
    have = v.fx_weather.filter("hour_utc < timestamp '2024-01-20'").select(c("canton_code").alias("key"), "hour_utc")
    return loads.window_plan(have, F.lit("2024-03-10").cast("date"), 10)


@query("freshness_guard", "select kind, max(hour_utc) as newest, max(hour_utc) >= timestamp '2024-01-30 23:55:00' - interval '60 minutes' as fresh from {fx_weather} group by 1")
def _(v):
    newest = v.fx_weather.groupBy("kind").agg(F.max("hour_utc").alias("newest"))
    return newest.withColumn("fresh", c("newest") >= ts(NOW) - F.expr("interval 60 minutes"))


# the directory

SHARED["payload"] = """
    select k + copy * 1000000 as stg_id, case when k % 101 = 0 then null else evse_id end as evse_id, case when operator_id = 'CH*OP3' then null when k % 53 = 0 then null else operator_id end as operator_id,
      station_name, street, postal_code, city, case when k % 97 = 0 then 50.0 when k % 89 = 0 then null else p.lat end as lat, p.lon as lon, k % 2 = 0 as is_open_24h, case when k % 10 = 0 then power_kw + 10 else power_kw end as power_kw,
      power_class as power_type, k, copy, timestamp '2024-01-01 00:00:00' - interval '1' hour * copy as last_update
    from (select *, cast((k - k % 3) / 3 as bigint) as s from {fx_point}) p join (select station_id as sid, street, postal_code, city from {fx_station}) s on s.sid = p.station_id, (values (0), (1)) t(copy) where k % 13 <> 1 and (copy = 0 or k % 7 = 0)"""


def payload(v: Views) -> DataFrame:
    """A directory payload: repeats, missing ids, operators and places, places abroad, changed powers."""
    p = v.fx_point.filter("k % 13 <> 1").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).filter("copy = 0 or k % 7 = 0")
    p = p.join(v.fx_station.select("station_id", "street", "postal_code", "city"), "station_id")
    kw = F.when(c("k") % 10 == 0, c("power_kw") + 10).otherwise(c("power_kw"))
    return p.select(
        (c("k") + c("copy") * 1000000).alias("stg_id"),
        F.when(c("k") % 101 != 0, c("evse_id")).alias("evse_id"),
        F.when((c("operator_id") != "CH*OP3") & (c("k") % 53 != 0), c("operator_id")).alias("operator_id"),
        c("operator_id").alias("operator_name"),
        "station_name",
        "street",
        "postal_code",
        "city",
        F.when(c("k") % 97 == 0, 50.0).when(c("k") % 89 == 0, None).otherwise(c("lat")).alias("lat"),
        "lon",
        (c("k") % 2 == 0).alias("is_open_24h"),
        kw.alias("power_kw"),
        c("power_class").alias("power_type"),
        F.when(c("power_class") == "DC", F.array(F.lit("CCS"), F.lit("Chademo"))).otherwise(F.array(F.lit("Type 2"), F.lit("Schuko"))).alias("plugs"),
        F.sha2(F.concat_ws("|", "operator_id", kw, "power_class"), 256).alias("record_hash"),
        (ts("2024-01-01 00:00:00") - F.make_dt_interval(F.lit(0), c("copy"))).alias("last_update"),
        "k",
    )


SHARED["latest_rec"] = "select * from (select *, row_number() over (partition by evse_id order by last_update desc nulls last, stg_id desc) as n from {payload} where evse_id is not null) x where n = 1"
_REASON = "case when evse_id is null then 'missing evse_id' when operator_id is null then 'missing operator' when lat is null or lon is null then 'missing coordinates' when lat not between 45.5 and 48.0 or lon not between 5.5 and 11.0 then 'coordinates out of range' end"
SHARED["good_rec"] = f"select * from {{latest_rec}} where {_REASON} is null"


@query("dedup_latest_record", "select evse_id, stg_id, last_update from {latest_rec}")
def _(v):
    return directory.latest_records(payload(v)).select("evse_id", "stg_id", "last_update")


@query("duplicate_count", "select (select count(*) from {payload} where evse_id is not null) - (select count(*) from {latest_rec}) as duplicates")
def _(v):
    per = payload(v).filter("evse_id is not null").groupBy("evse_id").agg((F.count(F.lit(1)) - 1).alias("more"))
    return per.agg(F.sum("more").alias("duplicates"))


@query("classify_reject_reason", f"select stg_id, {_REASON} as reason from {{payload}} where {_REASON} is not null")
def _(v):
    return payload(v).withColumn("reason", directory.reject_reason()).filter("reason is not null").select("stg_id", "reason")


_MODE = "(select x from (select {0} as x, count(*) as n from {{good_rec}} g2 where g2.operator_id = g.operator_id and g2.street = g.street and g2.postal_code = g.postal_code and {0} is not null group by 1) y order by n desc, x limit 1)"


@query("modal_value", "select operator_id, power_type as modal from (select operator_id, power_type, row_number() over (partition by operator_id order by count(*) desc, power_type) as n from {good_rec} where power_type is not null group by 1, 2) x where n = 1")
def _(v):
    good = directory.latest_records(payload(v)).filter(directory.reject_reason().isNull())
    return good.groupBy("operator_id").agg(F.mode("power_type", True).alias("modal"))


@query("bool_or_min_avg", "select station_key, min(operator_id) as operator_id, bool_or(is_open_24h) as is_open_24h, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, count(*) as points from (select *, md5(concat(operator_id, '|', lower(regexp_replace(street, '[^a-zA-Z0-9]+', '', 'g')), '|', trim(postal_code))) as station_key from {good_rec}) x group by 1")
def _(v):
    from ..functions.exprs import station_key

    good = directory.latest_records(payload(v)).filter(directory.reject_reason().isNull())
    good = good.withColumn("station_key", station_key(c("operator_id"), c("street"), c("postal_code"), c("lat"), c("lon")))
    st = directory.stations_of(good).select("station_key", "operator_id", "is_open_24h", "lat", "lon")
    return rounded(st.join(good.groupBy("station_key").agg(F.count(F.lit(1)).alias("points")), "station_key"))


SHARED["active_pt"] = "select evse_id, operator_id, timestamp '2023-12-20 00:00:00' + interval '1' day * (k % 12) as last_seen from {fx_point} where is_active"


def active_points(v: Views) -> DataFrame:
    return v.fx_point.filter("is_active").select("evse_id", "operator_id", (ts("2023-12-20 00:00:00") + F.make_dt_interval((c("k") % 12).cast("int"))).alias("last_seen"))


_GAPS = "select operator_id, count(*) as n_active, count(g.evse_id) as n_incoming from {active_pt} a left join {good_rec2} g on g.evse_id = a.evse_id group by 1 having count(g.evse_id) < count(*) * 0.5"
SHARED["good_rec2"] = "select evse_id from {good_rec}"
SHARED["op_gaps"] = "select a.operator_id, count(*) as n_active, count(g.evse_id) as n_incoming from {active_pt} a left join {good_rec2} g on g.evse_id = a.evse_id group by 1 having count(g.evse_id) < count(*) * 0.5"


def good_records(v: Views) -> DataFrame:
    return directory.latest_records(payload(v)).filter(directory.reject_reason().isNull())


@query("operator_gap_detect", "select * from {op_gaps}")
def _(v):
    return directory.operator_gaps(active_points(v), good_records(v))


@query("deactivation_guard", "select a.evse_id from {active_pt} a where a.evse_id not in (select evse_id from {good_rec2}) and (a.operator_id not in (select operator_id from {op_gaps}) or a.last_seen < timestamp '2024-01-02' - interval '7 days') and (select count(*) from {good_rec2}) >= 0.5 * (select count(*) from {active_pt})")
def _(v):
    return directory.to_deactivate(active_points(v), good_records(v), ts("2024-01-02 00:00:00"))


@query("unnest_alias_join", "select evse_id, plug_code from (select evse_id, unnest(case when power_type = 'DC' then ['CCS', 'Chademo'] else ['Type 2', 'Schuko'] end) as source_name from {good_rec}) x join (values ('CCS', 'CCS2'), ('Type 2', 'TYPE2_CABLE'), ('Type 2', 'TYPE2_SOCKET'), ('Chademo', 'CHADEMO')) a(source_name, plug_code) using (source_name)")
def _(v):
    return good_records(v).select("evse_id", F.explode("plugs").alias("source_name")).join(aliases(v), "source_name").select("evse_id", "plug_code")


def aliases(v: Views) -> DataFrame:
    """Plug names of the sources; one name may stand for two plugs. Fixed values."""
    return v.spark.createDataFrame([("CCS", "CCS2"), ("Type 2", "TYPE2_CABLE"), ("Type 2", "TYPE2_SOCKET"), ("Chademo", "CHADEMO")], "source_name string, plug_code string")


def current_tables(v: Views) -> dict[str, DataFrame]:
    """The directory before the payload: points by key but for those new in it."""
    p = v.fx_point.filter("k % 13 <> 0")
    points = p.select("evse_id", F.md5("station_name").alias("station_id"), "operator_id", "power_kw", c("power_class").alias("power_type"), "is_active", F.sha2(F.concat_ws("|", "operator_id", "power_kw", "power_class"), 256).alias("row_hash"), (ts("2023-12-20 00:00:00") + F.make_dt_interval((c("k") % 12).cast("int"))).alias("last_seen"))
    st = v.fx_station.limit(0).select(F.lit("").alias("station_key"), c("name").alias("station_name"), "street", "postal_code", "city", "lat", "lon", "operator_id", F.lit(True).alias("is_open_24h"), "canton_code")
    return {
        "operators": p.select("operator_id", c("operator_id").alias("name")).distinct(),
        "stations": st,
        "points": points,
        "plugs": v.fx_point_plug,
        "history": points.select("evse_id", "row_hash", "station_id", "is_active", ts("2023-12-01 00:00:00").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit("insert").alias("change_type")),
    }


@query("apply_directory", "select is_active, known, n from (select is_active, known, count(*) as n from (select case when g.evse_id is not null then true when o.evse_id is null then null else o.is_active and (o.operator_id in (select operator_id from gaps) and o.last_seen >= timestamp '2024-01-02' - interval '7 days') end as is_active, g.evse_id is not null as known from (select *, timestamp '2023-12-20 00:00:00' + interval '1' day * (k % 12) as last_seen from {fx_point} where k % 13 <> 0) o full join {good_rec} g on g.evse_id = o.evse_id, (select 1) one) y group by 1, 2) z".replace("(select operator_id from gaps)", "(select o2.operator_id from (select * from {fx_point} where k % 13 <> 0 and is_active) o2 left join {good_rec2} g2 on g2.evse_id = o2.evse_id group by 1 having count(g2.evse_id) < count(*) * 0.5)"))
def _(v):
    out = directory.apply_directory(payload(v), current_tables(v), aliases(v), v.fx_locality, ts("2024-01-02 00:00:00"))
    seen = out["points"].join(good_records(v).select("evse_id", F.lit(True).alias("known")), "evse_id", "left")
    return seen.groupBy("is_active", F.coalesce("known", F.lit(False)).alias("known")).agg(F.count(F.lit(1)).alias("n"))


SHARED["scd_old"] = "select evse_id, k % 7 as row_hash, station_id, is_active from {fx_point} where k % 13 <> 0"
SHARED["scd_new"] = "select evse_id, case when k % 10 = 0 then k % 7 + 1 else k % 7 end as row_hash, case when k % 31 = 0 then station_id + 1 else station_id end as station_id, k % 17 <> 0 as is_active from {fx_point}"
_KIND = "case when o.evse_id is null then 'insert' when o.is_active and not n.is_active then 'deactivate' when not o.is_active and n.is_active then 'reactivate' when o.row_hash <> n.row_hash or o.station_id <> n.station_id then 'update' end"
SHARED["scd_kind"] = f"select n.*, {_KIND} as change_type from {{scd_new}} n left join {{scd_old}} o on o.evse_id = n.evse_id"


@query("scd2_apply", "select o.evse_id, o.row_hash, o.station_id, o.is_active, timestamp '2024-01-01' as valid_from, case when k.change_type is not null then timestamp '2024-01-02' end as valid_to, 'insert' as change_type from {scd_old} o left join {scd_kind} k on k.evse_id = o.evse_id union all select evse_id, row_hash, station_id, is_active, timestamp '2024-01-02', null, change_type from {scd_kind} where change_type is not null")
def _(v):
    was = v.fx_point.filter("k % 13 <> 0").select("evse_id", (c("k") % 7).alias("row_hash"), "station_id", "is_active")
    now = v.fx_point.select("evse_id", F.when(c("k") % 10 == 0, c("k") % 7 + 1).otherwise(c("k") % 7).alias("row_hash"), F.when(c("k") % 31 == 0, c("station_id") + 1).otherwise(c("station_id")).alias("station_id"), (c("k") % 17 != 0).alias("is_active"))
    history = was.select("*", ts("2024-01-01").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit("insert").alias("change_type"))
    return directory.scd2_apply(history, was, now, ts("2024-01-02"))


# loads


@query("apply_snapshot", "select evse_id, slot_ts, status from {grid_raw} semi join (select evse_id from {fx_point} where k % 4 <> 0) p using (evse_id)")
def _(v):
    from ..operators.status import status_grid

    grid = status_grid(v.fx_status_raw).select("slot_ts", "evse_id", "status")
    have = grid.join(v.fx_point.filter("k % 4 <> 0").select("evse_id"), "evse_id", "left_semi").filter("minute(slot_ts) = 30").select("slot_ts", "evse_id", "status")
    return loads.apply_snapshot(grid, v.fx_point.filter("k % 4 <> 0"), have)[0]


@query("apply_snapshot_unknown", "select count(*) as n, (select string_agg(e, ',' order by e) from (select distinct evse_id as e from {grid_raw} where evse_id not in (select evse_id from {fx_point} where k % 4 <> 0) order by 1 limit 20) x) as examples, 'evse not in reference' as reason from {grid_raw} where evse_id not in (select evse_id from {fx_point} where k % 4 <> 0)")
def _(v):
    from ..operators.status import status_grid

    grid = status_grid(v.fx_status_raw).select("slot_ts", "evse_id", "status")
    return loads.apply_snapshot(grid, v.fx_point.filter("k % 4 <> 0"), grid.limit(0))[1].withColumn("examples", F.array_join("examples", ","))


@query("flatten_status_snapshot", "select operator_id, evse_id, status, timestamp '2024-01-30 23:55:00' as slot_ts from {grid_raw} where slot_ts > timestamp '2024-01-30'")
def _(v):
    from ..operators.status import status_grid
    from ..sources.readers import flatten_status_snapshot

    rows = status_grid(v.fx_status_raw).filter("slot_ts > timestamp '2024-01-30'")
    one = F.struct(c("evse_id").alias("EvseID"), c("status").alias("EVSEStatus"))
    nested = rows.groupBy(c("operator_id").alias("OperatorID")).agg(F.collect_list(one).alias("EVSEStatusRecord"))  # a feed's own nesting
    feed = nested.select(F.array(F.struct("OperatorID", "EVSEStatusRecord")).alias("EVSEStatuses"))
    return flatten_status_snapshot(feed, ts(NOW))


_W = "temperature_c * 6"


@query("apply_weather", "select canton_code, hour_utc, kind, round(t, 6) as temperature_c from (select canton_code, hour_utc, kind, temperature_c * 2 as t from {fx_weather} where temperature_c * 2 between -45 and 45 and canton_code <> 'NATION_9' union all select canton_code, hour_utc, kind, temperature_c from {fx_weather} where hour(hour_utc) = 3 and not (temperature_c * 2 between -45 and 45 and canton_code <> 'NATION_9')) x")
def _(v):
    rows = v.fx_weather.withColumn("temperature_c", c("temperature_c") * 2)
    cantons = v.nation.filter("n_name <> 'NATION_9'").select(c("n_name").alias("canton_code"))
    return rounded(loads.apply_weather(rows, cantons, v.fx_weather.filter("hour(hour_utc) = 3"))[0].select("canton_code", "hour_utc", "kind", "temperature_c"))


SHARED["car_rows"] = "select case when vehicle_id % 41 = 0 then null else brand end as brand, concat('M', vehicle_id % 300) as model, case when p_size % 2 = 0 then null else 'long' end as variant, release_year, case when vehicle_id % 37 = 0 then 0 else ac_max_kw * 3 end as ac_max_kw, coalesce(dc_max_kw, 0) as dc_max_kw, case when vehicle_id % 3 = 0 then 'manual' else 'feed' end as source, vehicle_id from {fx_vehicle}"


def car_rows(v: Views) -> DataFrame:
    return v.fx_vehicle.select(
        F.when(c("vehicle_id") % 41 != 0, c("brand")).alias("brand"), F.concat(F.lit("M"), c("vehicle_id") % 300).alias("model"), F.when(c("p_size") % 2 != 0, "long").alias("variant"), "release_year",
        F.when(c("vehicle_id") % 37 == 0, 0.0).otherwise(c("ac_max_kw") * 3).alias("ac_max_kw"), F.coalesce("dc_max_kw", F.lit(0.0)).alias("dc_max_kw"), F.when(c("vehicle_id") % 3 == 0, "manual").otherwise("feed").alias("source"),
        F.array(F.lit("Type 2"), F.lit("CCS")).alias("plugs"),
    )


@query("apply_vehicles", "select brand, model, variant, release_year, round(least(ac_max_kw, 43), 6) as ac_max_kw, nullif(dc_max_kw, 0) as dc_max_kw, source from (select *, coalesce(variant, '') as v2, row_number() over (partition by brand, model, coalesce(variant, ''), release_year order by source = 'manual' desc, source, least(ac_max_kw, 43) desc, nullif(dc_max_kw, 0) desc nulls last) as n from {car_rows} where ac_max_kw > 0 and brand is not null) x where n = 1".replace("select brand, model, variant, release_year, round", "select brand, model, v2 as variant, release_year, round"))
def _(v):
    rows = car_rows(v)
    empty = rows.limit(0).drop("plugs")
    plugs = v.fx_vehicle_plug.limit(0).select(F.struct(F.lit("").alias("brand"), F.lit("").alias("model"), F.lit("").alias("variant"), F.lit(0).alias("release_year")).alias("owner"), "plug_code")
    return rounded(loads.apply_vehicles(rows, aliases(v), empty, plugs)[0])


SHARED["details"] = "select evse_id, k, concat('X', k) as postal_code, case when k % 19 = 0 then 60.0 else lat end as lat, lon, case when k % 5 = 0 then 0 else power_kw end as power_kw, case when k % 2 = 0 then 'dc' when k % 3 = 0 then 'AC_3_PHASE' end as power_type from {fx_point} where k % 2 = 0 or k % 3 = 0"


@query("archive_point_dim", "select evse_id, power_class, power_kw, 'evse_data' as meta_source from {fx_point} where k % 4 <> 0 union all select evse_id, case when upper(power_type) = 'DC' then 'DC' when upper(power_type) like 'AC%' then 'AC' when power_kw > 22 then 'DC' end, case when power_kw > 0 then power_kw end, 'details_csv' from {details} where k % 4 = 0 and lat between 45.5 and 48.0 and lon between 5.5 and 11.0")
def _(v):
    d = v.fx_point.filter("k % 2 = 0 or k % 3 = 0").select("evse_id", F.concat(F.lit("X"), "k").alias("postal_code"), F.when(c("k") % 19 == 0, 60.0).otherwise(c("lat")).alias("lat"), "lon", F.when(c("k") % 5 == 0, 0.0).otherwise(c("power_kw")).alias("power_kw"), F.when(c("k") % 2 == 0, "dc").when(c("k") % 3 == 0, "AC_3_PHASE").alias("power_type"))
    return loads.archive_point_dim(v.fx_point.filter("k % 4 <> 0"), d, v.fx_locality).select("evse_id", "power_class", "power_kw", "meta_source")


@query("live_occupancy", "select canton_code, power_class, hour_utc, n_evse, case when hour_utc < timestamp '2024-01-02 12:00:00' then 'archive' else 'live' end as source from {occ} where hour_utc < timestamp '2024-01-02 12:00:00' or hour_utc >= timestamp '2024-01-02 06:00:00'")
def _(v):
    from .q_status import occupancy

    archive = occupancy(v).filter("hour_utc < timestamp '2024-01-02 12:00:00'").withColumn("source", F.lit("archive"))
    live = loads.live_occupancy(v.fx_status_dense, v.fx_point, ts("2024-01-02 06:20:00"), archive)
    return live.select("canton_code", "power_class", "hour_utc", "n_evse", "source")
