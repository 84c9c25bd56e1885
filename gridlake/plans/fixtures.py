"""Charging-network views over the generic tables, in SQL that Spark and DuckDB both read.

{name} in a text stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "fx_status_raw": """
        select concat('CH*OP', cast((user_id - user_id % 3)/3 as bigint) % 7, '*E', user_id) as EvseID, ts as datetime,
          case event_type when 'view' then 'Available' when 'click' then 'Occupied' when 'purchase' then 'Reserved' when 'error' then 'OutOfService' else 'Unknown' end as EVSEStatus,
          concat('CH*OP', cast((user_id - user_id % 3)/3 as bigint) % 7) as OperatorID
        from {events}""",
    "fx_point": """
        select concat('CH*OP', st % 7, '*E', k) as evse_id, st as station_id, concat('CH*OP', st % 7) as operator_id,
          n.n_name as canton_code, case when k % 29 = 0 then null when k % 3 = 0 then 'DC' else 'AC' end as power_class,
          case when k % 17 = 0 then null when k % 3 = 0 then cast(50 + (k % 6) * 50 as double) when k % 2 = 0 then cast(22 as double) else cast(11 as double) end as power_kw,
          46 + cast(st * 37 % 1500 as double) / 1000 as lat, 6.2 + cast(st * 91 % 4000 as double) / 1000 as lon, k % 11 <> 0 as is_active, c_name as station_name, k as k
        from (select c_custkey as k, cast((c_custkey - c_custkey % 3)/3 as bigint) as st, c_name from {customer}) c join {nation} n on n.n_nationkey = c.st % 25""",
    "fx_station": """
        select station_id, min(operator_id) as operator_id, min(canton_code) as canton_code, min(lat) as lat, min(lon) as lon, min(station_name) as name,
          concat('Street ', station_id % 40) as street, case when station_id % 31 = 0 then concat('X', station_id) else cast(1000 + station_id % 900 as varchar(10)) end as postal_code,
          concat('City ', station_id % 20) as city
        from {fx_point} group by station_id""",
    "fx_point_plug": """
        select evse_id, 'CCS2' as plug_code from {fx_point} where power_class = 'DC'
        union all select evse_id, 'CHADEMO' as plug_code from {fx_point} where power_class = 'DC' and k % 2 = 0
        union all select evse_id, case when k % 2 = 0 then 'TYPE2_CABLE' else 'TYPE2_SOCKET' end as plug_code from {fx_point} where power_class = 'AC'""",
    "fx_vehicle": """
        select p_partkey as vehicle_id, p_brand as brand, p_name as model, p_type as variant, 2010 + p_size % 16 as release_year,
          case p_size % 3 when 0 then cast(7.4 as double) when 1 then cast(11 as double) else cast(22 as double) end as ac_max_kw,
          case when p_partkey % 5 = 0 then null else cast(50 + p_size * 4 as double) end as dc_max_kw, p_size
        from {part}""",
    "fx_vehicle_plug": """
        select vehicle_id, 'TYPE2_CABLE' as plug_code from {fx_vehicle}
        union all select vehicle_id, 'TYPE2_SOCKET' as plug_code from {fx_vehicle}
        union all select vehicle_id, 'CCS2' as plug_code from {fx_vehicle} where dc_max_kw is not null
        union all select vehicle_id, 'CHADEMO' as plug_code from {fx_vehicle} where p_size % 10 = 0""",
    "fx_request": """
        select o_orderkey as request_id, o_orderkey % 200 as vehicle_id, 46 + cast(o_custkey * 53 % 1500 as double) / 1000 as lat,
          6.2 + cast(o_custkey * 71 % 4000 as double) / 1000 as lon, case when o_orderpriority = '1-URGENT' then 40 when o_orderstatus = 'P' then 10 else 20 end as energy_kwh,
          timestamp '2024-01-02 00:00:00' + interval '1' minute * (o_orderkey * 15 % 38880) as t0
        from {orders}""",
    "fx_run": """
        select o_orderkey as run_id, o_orderpriority as source, o_orderdate as started_at,
          case o_orderstatus when 'O' then 'running' when 'F' then 'success' else 'partial' end as status,
          case when o_orderstatus = 'O' then null else o_orderdate + interval '1' minute * (o_orderkey % 90) end as finished_at, cast(floor(o_totalprice) as bigint) as rows_received
        from {orders}""",
    "fx_locality": """
        select c_custkey as zip_id, cast(1000 + c_custkey % 900 as varchar(10)) as postal_code, n.n_name as canton_code,
          46 + cast(st * 37 % 1500 as double) / 1000 + 0.003 as lat, 6.2 + cast(st * 91 % 4000 as double) / 1000 + 0.002 as lon, cast(c_custkey % 100 as double) as address_share
        from (select c_custkey, cast((c_custkey - c_custkey % 3)/3 as bigint) as st from {customer}) c join {nation} n on n.n_nationkey = c.st % 25""",
    "fx_quarantine": """
        select o_orderkey as quarantine_id, case o_orderstatus when 'O' then 'stg.points' when 'F' then 'stg.status' else 'stg.weather' end as table_name,
          case o_orderpriority when '1-URGENT' then 'missing operator' when '2-HIGH' then 'missing coordinates' else 'value out of range' end as reason, o_orderdate as created_at
        from {orders}""",
    "fx_metric": """
        select l_returnflag as model, l_linenumber as fold, case l_linestatus when 'F' then 'mae' else 'rmse' end as metric,
          case l_linenumber % 3 when 0 then 'all' when 1 then 'h=6' else 'h=24' end as slice, l_discount as value
        from {lineitem}""",
    "fx_check": """
        select concat('check', l_linenumber) as check_id, case when l_linenumber % 3 = 0 then 'error' else 'warn' end as severity, l_shipdate as checked_at,
          l_orderkey as run_id, l_quantity < 25 as passed, cast(l_quantity as bigint) as failed_rows
        from {lineitem}""",
}

#: Every status carried forward on a full five-minute grid up to the last slot of the data: the two engines generate series differently.
_DENSE = """
    with s as (select EvseID as evse_id, EVSEStatus as status, datetime, {slot} as slot_ts from {{fx_status_raw}}),
    g as (select evse_id, slot_ts, max(struct_pack_) as last from (select evse_id, slot_ts, {pack} as struct_pack_ from s) x group by evse_id, slot_ts),
    e as (select max(slot_ts) + interval '5' minute as end_ts from s),
    n as (select evse_id, slot_ts, last.status as status, coalesce(lead(slot_ts) over (partition by evse_id order by slot_ts), end_ts) as next_ts from g cross join e)
    select evse_id, {series} as slot_ts, status from n"""
_ENGINE = {
    "spark": {
        "fx_status_dense": _DENSE.format(
            slot="cast(round(unix_micros(datetime) / 300000000.0) * 300 as timestamp)",
            pack="named_struct('datetime', datetime, 'status', status)",
            series="explode(sequence(slot_ts, next_ts - interval '5' minute, interval '5' minute))",
        ),
        "fx_weather": """
            select n_name as canton_code, hour_utc, kind, cast(((n_nationkey * 7 + i * 3) % 400) as double) / 10 - 10 + add as temperature_c, cast(i % 5 as double) / 10 as precipitation_mm
            from {nation}, (select explode(sequence(0, 743)) as i) h, (values ('actual', 0.0), ('hist_forecast', 0.5), ('forecast', 1.0)) k(kind, add)
            lateral view explode(array(timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, i, 0, 0))) t as hour_utc where (i + n_nationkey) % 37 <> 0""",
    },
    "duck": {
        "fx_status_dense": _DENSE.format(
            slot="make_timestamp(cast(round(epoch_us(datetime) / 300000000.0) * 300000000 as bigint))",
            pack="{{'datetime': datetime, 'status': status}}",
            series="unnest(generate_series(slot_ts, next_ts - interval '5' minute, interval '5' minute))",
        ),
        "fx_weather": """
            select n_name as canton_code, timestamp '2024-01-01 00:00:00' + interval '1' hour * i as hour_utc, kind,
              cast(((n_nationkey * 7 + i * 3) % 400) as double) / 10 - 10 + add as temperature_c, cast(i % 5 as double) / 10 as precipitation_mm
            from {nation}, range(744) h(i), (values ('actual', 0.0), ('hist_forecast', 0.5), ('forecast', 1.0)) k(kind, add) where (i + n_nationkey) % 37 <> 0""",
    },
}


def _text(name: str, engine: str) -> str | None:
    return _ENGINE[engine].get(name) or VIEWS.get(name)


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, its zoneless times read as UTC, or a view."""
    text = _text(name, "spark")
    if text is not None:
        return spark.sql(text, **{n: frame(spark, sf_dir, n) for n in _names(text)})
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"})


def oracle(text: str, shared: dict[str, str] | None = None) -> str:
    """DuckDB SQL for a text over tables and views, these as common table expressions. shared: further named texts."""
    shared, order = shared or {}, []

    def need(name: str) -> None:
        if name in order or name in TABLES:
            return
        body = shared.get(name) or _text(name, "duck")
        for n in _names(body):
            need(n)
        order.append(name)

    for n in _names(text):
        need(n)
    plain = lambda t: re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", t).replace("{{", "{").replace("}}", "}")
    if not order:
        return plain(text)
    return "with " + ",\n".join(f"{n} as ({plain(shared.get(n) or _text(n, 'duck'))})" for n in order) + "\n" + plain(text)
