"""Data quality: a catalogue of checks that return offending rows, and one that runs them all."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException, PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import haversine_km
from .geo import near_duplicate_stations
from .keyed import first_per_key

c = F.col
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Check:
    check_id: str
    severity: str
    kind: str
    find: Callable[[Tables, Column], DataFrame]


CATALOGUE: dict[str, Check] = {}

#: Form of a point id and of a postal code, plausible powers, limits of shares, distances and ages.
POINT_ID, POSTAL = r"^[A-Z]{2}\*?[A-Z0-9]{3}\*?E[A-Za-z0-9*_-]+$", r"^[0-9]{4}$"
AC_KW, DC_KW = (1, 43), (5, 400)
NO_PLUG_SHARE, CANTON_KM, LEAST_SLOTS, LEAST_GEO, LEAST_MONTH = 0.02, 80, 6, 0.6, 0.9


def check(check_id: str, kind: str, severity: str = "warn"):
    def keep(find):
        CATALOGUE[check_id] = Check(check_id, severity, kind, find)
        return find

    return keep


def _last_run(t: Tables, source: str, good: tuple[str, ...] = ("success", "partial")) -> DataFrame:
    runs = t["run"].filter((c("source") == source) & c("status").isin(*good))
    return runs.orderBy(F.desc("started_at"), "run_id").limit(1).select("run_id")


@check("completeness_station_canton", "completeness")
def _(t, now):
    return t["station"].filter("canton_code is null").select("station_id", "name", "postal_code")


@check("completeness_evse_power", "completeness")
def _(t, now):
    return t["point"].filter("is_active and (power_kw is null or power_class is null)").select("evse_id", "power_kw", "power_class")


@check("completeness_evse_plugs", "completeness", "error")
def _(t, now):
    active = t["point"].filter("is_active").select("evse_id")
    bare = active.join(t["point_plug"].select("evse_id"), "evse_id", "left_anti")
    sizes = active.agg(F.count(F.lit(1)).alias("_all")).join(bare.agg(F.count(F.lit(1)).alias("_bare")))  # one row
    return bare.join(F.broadcast(sizes.filter(c("_bare") > NO_PLUG_SHARE * c("_all")))).select("evse_id")


@check("completeness_weather_actual", "completeness")
def _(t, now):
    day = F.date_trunc("day", now)
    hours = F.explode(F.sequence(day - F.expr("interval 33 days"), day - F.expr("interval 73 hours"), F.expr("interval 1 hour")))
    have = t["weather"].filter("kind = 'actual'").select("canton_code", "hour_utc")
    return t["canton"].select("canton_code", hours.alias("hour_utc")).join(have, ["canton_code", "hour_utc"], "left_anti")


@check("uniqueness_evse_in_payload", "uniqueness")
def _(t, now):
    own = t["payload"]
    if "run_id" in own.columns:  # of many payloads the last good one counts
        own = own.join(F.broadcast(_last_run(t, "evse_data")), "run_id")
    return own.groupBy("evse_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@check("uniqueness_station_location", "uniqueness")
def _(t, now):
    return near_duplicate_stations(t["station"]).withColumn("distance_m", F.round("distance_m", 1))


@check("validity_evse_id_format", "validity")
def _(t, now):
    return t["point"].filter(~c("evse_id").rlike(POINT_ID)).select("evse_id")


@check("validity_quarantine_recent", "validity")
def _(t, now):
    return t["quarantine"].filter(c("created_at") > now - F.expr("interval 24 hours")).groupBy("table_name", "reason").agg(F.count(F.lit(1)).alias("n"))


@check("type_postal_code", "type")
def _(t, now):
    return t["station"].filter(~c("postal_code").rlike(POSTAL)).select("station_id", "postal_code")


@check("range_evse_power", "range")
def _(t, now):
    odd = ((c("power_class") == "AC") & ~c("power_kw").between(*AC_KW)) | ((c("power_class") == "DC") & ~c("power_kw").between(*DC_KW))
    return t["point"].filter(c("is_active") & odd).select("evse_id", "power_class", "power_kw")


@check("range_station_canton_distance", "range")
def _(t, now):
    centre = t["canton"].select("canton_code", c("lat").alias("clat"), c("lon").alias("clon"))
    far = t["station"].join(centre, "canton_code").withColumn("km", haversine_km(c("lat"), c("lon"), c("clat"), c("clon")))
    return far.filter(c("km") > CANTON_KM).select("station_id", "canton_code", F.round("km", 1).alias("km"))


@check("range_hour_coverage", "range")
def _(t, now):
    return t["occupancy"].filter(c("slots_observed") < LEAST_SLOTS).select("canton_code", "power_class", "hour_utc", "slots_observed")


@check("referential_status_unknown_evse", "referential")
def _(t, now):
    return t["unknown"].select(F.get_json_object("record", "$.count").cast("long").alias("n"), F.get_json_object("record", "$.examples").alias("examples"))


@check("referential_archive_geo", "referential")
def _(t, now):
    return t["coverage"].filter((c("n_rows") > 0) & (c("share_with_geo") < LEAST_GEO)).select("month", "share_with_geo")


@check("referential_vehicle_plugs", "referential", "error")
def _(t, now):
    return t["vehicle"].join(t["vehicle_plug"].select("vehicle_id"), "vehicle_id", "left_anti").select("vehicle_id", "brand", "model")


@check("freshness_evse_data", "freshness")
def _(t, now):
    good = t["run"].filter((c("source") == "2-HIGH") & c("status").isin("success", "partial"))
    age = good.agg(((F.unix_seconds(now) - F.unix_seconds(F.max("finished_at"))) / 3600).alias("age_h"))
    return age.filter(F.coalesce("age_h", F.lit(1e9)) > 168)


@check("freshness_weather_actual", "freshness")
def _(t, now):
    newest = t["weather"].filter("kind = 'actual'").agg(F.max("hour_utc").alias("last_hour"))
    return newest.filter(c("last_hour").isNull() | (c("last_hour") < now - F.expr("interval 5 days")))


@check("freshness_archive_months", "freshness")
def _(t, now):
    return t["coverage"].filter(c("n_slots") < LEAST_MONTH * c("expected_slots")).select("month", "n_slots", "expected_slots")


def counted(found: DataFrame, samples: int = 5) -> DataFrame:
    """One row: how many rows there are, and up to `samples` of them as JSON, in order.

    A row falls in a slot by its hash, and the least of each slot is kept, beside the least and the greatest of all: partial
    aggregates of bounded size, however many rows offend.
    """
    record = F.to_json(F.struct(*[c(x) for x in sorted(found.columns)]))
    told = found.select(record.alias("r"))
    kept = [F.min("r"), F.max("r"), *[F.min(F.when(F.pmod(F.xxhash64("r"), F.lit(samples)) == i, c("r"))) for i in range(samples)]]
    some = F.slice(F.array_sort(F.array_distinct(F.array_compact(F.array(*kept)))), 1, samples)
    return told.agg(F.count(F.lit(1)).alias("n"), some.alias("sample"))


def own_failure(e: Exception) -> bool:
    """Whether an error is the check's: a table or column it lacks, or an error that Spark names. A lost cluster is neither."""
    return isinstance(e, (KeyError, PythonException)) or isinstance(e, PySparkException) and e.getCondition() is not None


def run_checks(tables: Tables, now: Column, spark, samples: int = 5, only: list[str] | None = None, at_once: int = 4) -> DataFrame:
    """check_id, severity, passed, failed_rows, sample (JSON of some offending rows) of every check.

    Each check is one job, of which `at_once` run side by side, and gives one row. One that can't be planned, or fails on an executor,
    fails with one row and doesn't stop the others; errors that aren't a check's own are raised.
    """

    def run(k: Check) -> tuple:
        try:
            n, some = counted(k.find(tables, now), samples).first()
            return k.check_id, k.severity, n == 0, n, some
        except Exception as e:
            if not own_failure(e):
                raise
            return k.check_id, k.severity, False, 1, [str(e)[:200]]

    wanted = [k for k in CATALOGUE.values() if only is None or k.check_id in only]
    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(run), wanted))
    return spark.createDataFrame(rows, "check_id string, severity string, passed boolean, failed_rows long, sample array<string>")


def blocked(results: DataFrame) -> DataFrame:
    """The failed checks that stop marts and training."""
    return results.filter("severity = 'error' and not passed")


# constraints: each an audit of offending rows


def duplicate_keys(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(name).alias("audit"), F.concat_ws("|", *keys).alias("row_key"))


def orphans(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    return child.filter(c(key).isNotNull()).join(parent.select(key), key, "left_anti").select(F.lit(name).alias("audit"), c(key).cast("string").alias("row_key")).distinct()


def refused(df: DataFrame, key: str, rule: Column, name: str) -> DataFrame:
    """Rows for which the rule is false; unknown passes, as in a CHECK."""
    return df.filter(~rule).select(F.lit(name).alias("audit"), c(key).cast("string").alias("row_key"))


def reopened_runs(events: DataFrame) -> DataFrame:
    """Runs with a running event after a closing one. events: run_id, at, status."""
    closed = events.filter("status <> 'running'").groupBy("run_id").agg(F.min("at").alias("closed_at"))
    return events.filter("status = 'running'").join(closed, "run_id").filter(c("at") > c("closed_at")).select(F.lit("reopened run").alias("audit"), c("run_id").cast("string").alias("row_key")).distinct()


def many_open(df: DataFrame, key: str, is_open: Column, name: str) -> DataFrame:
    """Keys with more than one open row: versions of a point, active models of a task."""
    return df.filter(is_open).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(name).alias("audit"), c(key).cast("string").alias("row_key"))


def incompatible_items(items: DataFrame, requests: DataFrame, points: DataFrame, plugs: DataFrame, vehicle_plugs: DataFrame) -> DataFrame:
    """Recommended stations without an active point that the request's vehicle can use."""
    usable = points.filter("is_active").select("evse_id", "station_id").join(plugs.select("evse_id", "plug_code"), "evse_id").select("station_id", "plug_code").distinct()
    asked = items.select("request_id", "station_id").join(requests.select("request_id", "vehicle_id"), "request_id")
    fits = asked.join(vehicle_plugs.select("vehicle_id", "plug_code"), "vehicle_id").join(usable, ["station_id", "plug_code"], "left_semi").select("request_id", "station_id").distinct()
    return asked.join(fits, ["request_id", "station_id"], "left_anti").select(F.lit("incompatible station").alias("audit"), F.concat_ws("|", "request_id", "station_id").alias("row_key")).distinct()


def latest_results(results: DataFrame) -> DataFrame:
    return first_per_key(results, ["check_id"], [F.desc("checked_at"), F.desc("run_id")])
