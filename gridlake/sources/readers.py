"""Source files to frames: directory and snapshot feeds, weather, vehicles, postal codes, archives, manifests, schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns an archive month must have; order of languages; known facility types.
ARCHIVE_COLUMNS = ("datetime", "EvseID", "EVSEStatus", "OperatorID")
LANGUAGES = ("de", "fr", "it", "en")
POWER_TYPES = ("AC_1_PHASE", "AC_3_PHASE", "DC")


def read_status_archive(spark: SparkSession, path: str) -> DataFrame | None:
    """The month's statuses, or None if a file can't be read or lacks a column, or there is none: the month is then partial.

    The footer of each of the month's files is read by tasks, empty files too; then each file's columns are looked at.
    """
    try:
        month = spark.read.option("mergeSchema", "true").parquet(path)
        files = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()]
        if any(not set(ARCHIVE_COLUMNS) <= set(spark.read.parquet(f).columns) for f in files):
            return None
    except Exception as e:  # noqa: BLE001  an unreadable or empty file is a finding, not a fault
        if any(k in str(e) for k in ("UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "PATH_NOT_FOUND", "is not a Parquet file")):
            return None
        raise
    return month.select(*ARCHIVE_COLUMNS) if set(ARCHIVE_COLUMNS) <= set(month.columns) else None


def parse_coordinates(google: Column, lat: Column | None = None, lon: Column | None = None) -> Column:
    """struct(lat, lon) from "lat lon" or "lat,lon", else from the two numbers; unreadable is null for both."""
    parts = F.split(F.trim(F.translate(google, ",", " ")), r"\s+")
    a, b = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    ok = a.isNotNull() & b.isNotNull()
    other = F.lit(None).cast("double")
    la, lo = (lat.try_cast("double") if lat is not None else other), (lon.try_cast("double") if lon is not None else other)
    given = F.coalesce(F.trim(google), F.lit("")) != ""
    return F.when(given, F.struct(F.when(ok, a).alias("lat"), F.when(ok, b).alias("lon"))).otherwise(F.struct(F.when(lo.isNotNull(), la).alias("lat"), F.when(la.isNotNull(), lo).alias("lon")))


def max_facility_power(facilities: Column) -> Column:
    """struct(power_kw, power_type): the strongest facility; over 1000 is watts; 0 is none; a weaker one may name a missing type."""
    start = F.struct(F.lit(None).cast("double").alias("kw"), F.lit(None).cast("string").alias("kind"))

    def step(best: Column, f: Column) -> Column:
        raw = f["power"].try_cast("double")
        kw = F.nullif(F.when(raw > 1000, raw / 1000).otherwise(raw), F.lit(0.0))
        kind = F.when(F.upper(f["powertype"]).isin(*POWER_TYPES), F.upper(f["powertype"]))
        wins = kw.isNotNull() & (best["kw"].isNull() | (kw > best["kw"]))
        return F.struct(F.when(wins, kw).otherwise(best["kw"]).alias("kw"), F.when(wins & kind.isNotNull(), kind).otherwise(F.coalesce(best["kind"], kind)).alias("kind"))

    return F.aggregate(F.coalesce(facilities, F.array().cast("array<struct<power:string,powertype:string>>")), start, step, lambda b: F.struct(b["kw"].alias("power_kw"), b["kind"].alias("power_type")))


def localized_name(names: Column) -> Column:
    """The first filled name by the order of languages; names: array of (lang, value)."""
    of = lambda lang: F.nullif(F.trim(F.get(F.filter(names, lambda n: F.lower(n["lang"]) == lang), F.lit(0))["value"]), F.lit(""))
    return F.coalesce(*[of(x) for x in LANGUAGES])


def record_hash(operator: Column, station: Column, address: Column, lat: Column, lon: Column, plugs: Column, kw: Column, kind: Column, access: Column, open_24h: Column) -> Column:
    """Digest of what matters in a record: coordinates to six places (0 is none), plugs in order; the update time is left out."""
    place = lambda x: F.round(F.nullif(x, F.lit(0.0)), 6)
    fields = F.struct(operator.alias("op"), station.alias("station"), address.alias("address"), place(lat).alias("lat"), place(lon).alias("lon"), F.array_sort(plugs).alias("plugs"), kw.alias("kw"), kind.alias("kind"), access.alias("access"), open_24h.alias("open"))
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


DIRECTORY = """EVSEData array<struct<OperatorID:string,OperatorName:string,EVSEDataRecord:array<struct<EvseID:string,ChargingStationId:string,Plugs:array<string>,IsOpen24Hours:boolean,Accessibility:string,
Address:struct<City:string,PostalCode:string,Street:string>,GeoCoordinates:struct<Google:string,DecimalDegree:struct<Latitude:string,Longitude:string>>,
ChargingFacilities:array<struct<power:string,powertype:string>>,ChargingStationNames:array<struct<lang:string,value:string>>,lastUpdate:string>>>>"""


def read_directory(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return flatten_directory_json(spark.read.schema(DIRECTORY).json(path, multiLine=multi_line))


def flatten_directory_json(payload: DataFrame) -> DataFrame:
    """One row for each point of a nested directory payload."""
    r = payload.select(F.explode("EVSEData").alias("o")).select("o.OperatorID", "o.OperatorName", F.posexplode("o.EVSEDataRecord").alias("pos", "r"))
    place = parse_coordinates(F.col("r.GeoCoordinates.Google"), F.col("r.GeoCoordinates.DecimalDegree.Latitude"), F.col("r.GeoCoordinates.DecimalDegree.Longitude"))
    flat = r.select(
        F.col("OperatorID").alias("operator_id"), F.col("OperatorName").alias("operator_name"), F.col("r.EvseID").alias("evse_id"), F.col("r.Address.Street").alias("street"), F.col("r.Address.PostalCode").alias("postal_code"),
        F.col("r.Address.City").alias("city"), place.alias("place"), F.array_sort("r.Plugs").alias("plugs"), max_facility_power(F.col("r.ChargingFacilities")).alias("power"), localized_name(F.col("r.ChargingStationNames")).alias("station_name"),
        F.col("r.IsOpen24Hours").alias("is_open_24h"), F.col("r.Accessibility").alias("accessibility"), F.to_timestamp("r.lastUpdate").alias("last_update"), "pos",
    ).select("*", "place.lat", "place.lon", "power.power_kw", "power.power_type").drop("place", "power")
    digest = record_hash(F.col("operator_id"), F.col("station_name"), F.concat_ws("|", "street", "postal_code", "city"), F.col("lat"), F.col("lon"), F.col("plugs"), F.col("power_kw"), F.col("power_type"), F.col("accessibility"), F.col("is_open_24h"))
    return flat.withColumn("record_hash", digest)


def flatten_status_snapshot(payload: DataFrame, slot: Column) -> DataFrame:
    """operator_id, evse_id, status, slot_ts for each record of a nested snapshot."""
    o = payload.select(F.explode("EVSEStatuses").alias("o"))
    r = o.select(F.col("o.OperatorID").alias("operator_id"), F.explode("o.EVSEStatusRecord").alias("r"))
    return r.select("operator_id", F.col("r.EvseID").alias("evse_id"), F.col("r.EVSEStatus").alias("status"), slot.alias("slot_ts"))


def unpivot_weather(df: DataFrame, kind: str) -> DataFrame:
    """canton_code, hour_utc, kind and measures for each hour of parallel arrays under `hourly`; short arrays leave nulls."""
    zipped = F.arrays_zip("hourly.time", "hourly.temperature_2m", "hourly.precipitation", "hourly.snowfall", "hourly.wind_speed_10m")
    r = df.select("canton_code", F.explode(zipped).alias("h"))
    return r.select("canton_code", F.to_timestamp("h.time").alias("hour_utc"), F.lit(kind).alias("kind"), F.col("h.temperature_2m").alias("temperature_c"), F.col("h.precipitation").alias("precipitation_mm"), F.col("h.snowfall").alias("snowfall_cm"), F.col("h.wind_speed_10m").alias("wind_kmh"))


def vehicles_of(catalog: DataFrame) -> DataFrame:
    """Cars of a nested catalogue (`data`), with the sorted union of their AC and DC ports."""
    d = catalog.select(F.explode("data").alias("d")).filter(F.coalesce("d.vehicle_type", F.lit("car")) == "car")
    none = F.array().cast("array<string>")
    ports = F.array_sort(F.array_union(F.coalesce("d.ac_charger.ports", none), F.coalesce("d.dc_charger.ports", none)))
    return d.select("d.brand", "d.model", "d.variant", F.col("d.release_year").cast("int").alias("release_year"), F.col("d.usable_battery_size").cast("double").alias("battery_kwh"), F.col("d.ac_charger.max_power").cast("double").alias("ac_max_kw"), F.col("d.dc_charger.max_power").cast("double").alias("dc_max_kw"), ports.alias("ports"))


def read_vehicle_catalog(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return vehicles_of(spark.read.json(path, multiLine=multi_line))


def ports_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda p: F.trim(p) != "")


def read_manual_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of cars: ports parted by |, blanks null."""
    raw = spark.read.csv(path, header=True)
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    number = lambda x: blank(x).try_cast("double").alias(x)
    return raw.select("brand", "model", blank("variant").alias("variant"), blank("release_year").try_cast("int").alias("release_year"), number("battery_kwh"), number("ac_max_kw"), number("dc_max_kw"), ports_of(F.col("ports")).alias("ports"))


def postal_rows(raw: DataFrame, cantons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of known cantons, the others); the share loses its percent sign."""
    share = F.replace("Adressenanteil", F.lit("%"), F.lit("")).try_cast("double")
    rows = raw.select(F.col("ZIP_ID").cast("long").alias("zip_id"), F.col("PLZ4").alias("postal_code"), F.col("Ortschaftsname").alias("locality"), F.trim(F.col("Kantonskürzel")).alias("canton_code"), share.alias("address_share"), F.col("N").try_cast("double").alias("lat"), F.col("E").try_cast("double").alias("lon"))
    known = F.broadcast(cantons.select("canton_code"))  # a country's cantons
    return rows.join(known, "canton_code", "left_semi"), rows.join(known, "canton_code", "left_anti")


def read_postal_directory(spark: SparkSession, path: str, cantons: DataFrame) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.csv(path, header=True, sep=";", encoding="UTF-8")
    return postal_rows(raw.toDF(*[x.lstrip("﻿") for x in raw.columns]), cantons)


def point_details(raw: DataFrame) -> DataFrame:
    """evse_id, postal_code, lat, lon, power_kw, power_type of a details CSV; what isn't a number is null, 0 kW too."""
    place = parse_coordinates(F.col("GeoCoordinates"))
    kw = F.nullif(F.col("ChargingFacility_power").try_cast("double"), F.lit(0.0))
    return raw.select(F.trim("EvseID").alias("evse_id"), F.col("PostalCode").alias("postal_code"), place["lat"].alias("lat"), place["lon"].alias("lon"), kw.alias("power_kw"), F.col("ChargingFacility_powertype").alias("power_type"))


def read_point_details(spark: SparkSession, path: str) -> DataFrame:
    return point_details(spark.read.csv(path, header=True))


def raw_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of each file below a folder, but for empty ones, which Spark's scans leave out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha"))


def field_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """Paths of a type's fields: a.b for structs, a[].b for arrays."""
    if isinstance(kind, T.StructType):
        return set().union(*[{f"{prefix}{f.name}"} | field_paths(f.dataType, f"{prefix}{f.name}.") for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix[:-1] + "[].")
    return set()


def schema_fingerprint(df: DataFrame, source: str) -> DataFrame:
    """source, fields, fields_hash: of the schema alone, no row is read."""
    fields = F.array_sort(F.array(*[F.lit(p) for p in sorted(field_paths(df.schema))]))
    return df.sparkSession.range(1).select(F.lit(source).alias("source"), F.array_join(fields, ",").alias("fields"), F.sha2(F.array_join(fields, ","), 256).alias("fields_hash"))


def schema_drift(current: DataFrame, registry: DataFrame) -> DataFrame:
    """Fingerprints that a known source hasn't had before."""
    new = current.join(registry.select("source", "fields_hash"), ["source", "fields_hash"], "left_anti")
    return new.join(registry.select("source"), "source", "left_semi")
