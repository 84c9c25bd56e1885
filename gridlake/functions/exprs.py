"""Scalar rules of the charging domain as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in km; local time zone; folding of accented letters in street names.
EARTH_KM = 6371.0088
ZONE = "Europe/Zurich"
ACCENTED, FOLDED = "ÄÖÜäöüéèàâç", "AOUaoueeaac"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if any argument is."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)))


def station_key(operator: Column, street: Column, postal: Column, lat: Column, lon: Column) -> Column:
    """Digest that names a station: operator, folded street and postal code; without an address the rounded place."""
    place = lambda x: F.round(x, 4).cast("decimal(9,4)").cast("string")
    folded = F.lower(F.regexp_replace(F.translate(street, ACCENTED, FOLDED), "[^a-zA-Z0-9]+", ""))
    addressed = (F.trim(F.coalesce(street, F.lit(""))) != "") & (F.trim(F.coalesce(postal, F.lit(""))) != "")
    sep = F.lit("|")
    return F.md5(F.when(addressed, F.concat(operator, sep, folded, sep, F.trim(postal))).otherwise(F.concat(operator, F.lit("|geo|"), place(lat), sep, place(lon))))


def effective_power(power_kw: Column, power_class: Column, ac_max: Column, dc_max: Column) -> Column:
    """What a car can draw at a point; null where the point's power is unknown or the car lacks the current."""
    own = F.when((power_class == "DC") & dc_max.isNotNull(), F.least(power_kw, dc_max)).when(power_class == "AC", F.least(power_kw, ac_max))
    return F.when(power_kw.isNotNull(), own)


def eta_minutes(distance_km: Column, detour: float = 1.3, near_km: float = 5.0, near_kmh: float = 35.0, far_kmh: float = 60.0) -> Column:
    """Driving minutes over the road distance, slower if that is short."""
    road = distance_km * detour
    return road / F.when(road <= near_km, near_kmh).otherwise(far_kmh) * 60


def slot_floor(ts: Column, seconds: int = 300) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / (seconds * 1_000_000)) * seconds)


def slot_round(ts: Column, seconds: int = 300) -> Column:
    """The nearest slot; sources stamp a second or two beside it."""
    return F.timestamp_seconds(F.round(F.unix_micros(ts) / (seconds * 1_000_000)).cast("long") * seconds)


def local_time(ts: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_dow(ts: Column, zone: str = ZONE) -> Column:
    """Monday is 0."""
    return F.weekday(local_time(ts, zone))


def local_hour(ts: Column, zone: str = ZONE) -> Column:
    return F.hour(local_time(ts, zone))


def expected_slots(month_start: Column, per_day: int = 288) -> Column:
    return F.day(F.last_day(month_start)) * per_day


def age_label(minutes: Column) -> Column:
    return F.when(minutes < 60, F.format_string("%d min", minutes.cast("int"))).when(minutes < 48 * 60, F.format_string("%d h", F.floor(minutes / 60).cast("int"))).otherwise(F.format_string("%d d", F.floor(minutes / 1440).cast("int")))


def power_class(power_type: Column, power_kw: Column | None = None) -> Column:
    """DC or AC from the type's name; with power_kw, over 22 kW counts as DC where the type is unknown."""
    kind = F.upper(power_type)
    known = F.when(kind == "DC", "DC").when(kind.startswith("AC"), "AC")
    return known if power_kw is None else known.when(power_kw > 22, "DC")


def arrival_delta(eta: Column, step: int = 5, most: int = 60) -> Column:
    """Minutes to arrival, up to the next step, between one step and `most`."""
    return F.least(F.greatest(F.ceil(eta / step) * step, F.lit(step)), F.lit(most)).cast("int")


def hash_bucket(key: Column, buckets: int) -> Column:
    """A bucket that other engines find too: the first 32 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % buckets


def coarse(x: Column) -> Column:
    return F.round(x, 2)


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])
