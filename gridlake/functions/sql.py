"""The domain's rules as functions of Spark SQL: expressions that the optimizer sees through, and a table function on views.

Bodies are SQL that says what the columns of `exprs` say; tests hold both against each other.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .exprs import ACCENTED, EARTH_KM, FOLDED

_PLACE = "cast(cast(round({0}, 4) as decimal(9, 4)) as string)"

#: Name and arguments, result, body.
SCALARS = {
    "haversine_km(lat1 double, lon1 double, lat2 double, lon2 double)": (
        "double",
        f"2 * {EARTH_KM}d * asin(sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2)))",
    ),
    "station_key(operator string, street string, postal string, lat double, lon double)": (
        "string",
        f"""md5(case when trim(coalesce(street, '')) <> '' and trim(coalesce(postal, '')) <> ''
            then concat(operator, '|', lower(regexp_replace(translate(street, '{ACCENTED}', '{FOLDED}'), '[^a-zA-Z0-9]+', '')), '|', trim(postal))
            else concat(operator, '|geo|', {_PLACE.format("lat")}, '|', {_PLACE.format("lon")}) end)""",
    ),
    "effective_power(power_kw double, power_class string, ac_max double, dc_max double)": (
        "double",
        "case when power_kw is null then null when power_class = 'DC' and dc_max is not null then least(power_kw, dc_max) when power_class = 'AC' then least(power_kw, ac_max) end",
    ),
    "eta_minutes(distance_km double)": ("double", "distance_km * 1.3d / case when distance_km * 1.3d <= 5 then 35d else 60d end * 60"),
}

#: The views that compatible_points reads, with the columns it needs.
VIEWS = ("charging_point", "charging_point_plug", "charging_vehicle", "charging_vehicle_plug")

TABLES = {
    "compatible_points(vehicle bigint, at_lat double, at_lon double, radius_km double)": (
        "evse_id string, station_id bigint, distance_km double, plug_codes array<string>, power_class string, power_kw double, effective_kw double",
        """select evse_id, max(station_id), max(km), array_sort(collect_set(plug_code)), max(power_class), max(power_kw), max(kw) from (
             select p.evse_id, p.station_id, haversine_km(at_lat, at_lon, p.lat, p.lon) as km, a.plug_code, p.power_class, p.power_kw, effective_power(p.power_kw, p.power_class, v.ac_max_kw, v.dc_max_kw) as kw
             from charging_point p join charging_point_plug a on a.evse_id = p.evse_id join charging_vehicle_plug b on b.plug_code = a.plug_code join charging_vehicle v on v.vehicle_id = b.vehicle_id
             where v.vehicle_id = vehicle and p.is_active and (p.power_class = 'AC' or v.dc_max_kw is not null)
               and p.lat between at_lat - radius_km / 111 and at_lat + radius_km / 111
           ) where km <= radius_km group by evse_id""",
    ),
}


def register(spark: SparkSession, tables: dict | None = None) -> None:
    """Make the functions known to a session's SQL. tables: frames for VIEWS by name; with them the table function too, which answers
    one request; `operators.geo.compatible_points` answers a table of them."""
    for head, (result, body) in SCALARS.items():
        spark.sql(f"create or replace temporary function {head} returns {result} return {body}")
    if tables is not None:
        for name in VIEWS:
            tables[name].createOrReplaceTempView(name)
        for head, (result, body) in TABLES.items():
            spark.sql(f"create or replace temporary function {head} returns table ({result}) return {body}")
