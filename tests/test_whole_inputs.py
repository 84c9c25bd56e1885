"""Parts, runs and statuses are taken whole; their SQL, whole too, is held against them in test_queries."""

from gridlake.plans.registry import Views
from test_queries import QUERIES


def test_lineage_starts_from_every_part(spark, sf):
    assert QUERIES["q13_lineage_ancestors"](spark, sf).select("start").distinct().count() == Views(spark, sf).part.count()


def test_ordered_lists_have_every_run(spark, sf):
    want = {}
    for r in sorted(Views(spark, sf).fx_run.collect(), key=lambda r: (r["started_at"], r["run_id"])):
        want.setdefault(r["source"], []).append(r["status"])
    assert {r["source"]: r["runs"].split(",") for r in QUERIES["ordered_string_agg"](spark, sf).collect()} == want


def test_grid_has_every_day(spark, sf):
    v = Views(spark, sf)
    days = v.fx_status_dense.selectExpr("count(distinct cast(slot_ts as date)) as n", "max(slot_ts) as last").first()
    raw = v.fx_status_raw.selectExpr("count(distinct cast(datetime as date)) as n").first()
    assert days["n"] >= raw["n"] > 20


def test_pages_of_a_directory_do_not_grow(spark):
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    from gridlake.plans import q_sources

    points = spark.range(400_000).selectExpr("id as k", "concat('e', id) as evse_id", "concat('o', id div 3 % 7) as operator_id", "true as is_active", "46.5d as lat", "7.5d as lon", "11.0d as power_kw", "'AC' as power_class", "'n' as station_name")
    size = F.size(F.col("EVSEData")[0]["EVSEDataRecord"]).alias("n")
    most, rows = q_sources.directory(SimpleNamespace(fx_point=points)).select(size).agg(F.max("n"), F.sum("n")).first()
    assert most <= 1000 and rows == 400_000


def test_localities_in_one_spot_meet_a_place_once(spark, monkeypatch):
    """Many stations and localities in a few spots: one row each goes into the choice, and ties go to the least zip_id."""
    from gridlake.operators import geo

    met, plain = [], geo.first_per_key

    def first_per_key(df, keys, order):
        met.append(df.count())
        return plain(df, keys, order)

    monkeypatch.setattr(geo, "first_per_key", first_per_key)
    places = spark.range(500).selectExpr("id as station_id", "case when id % 5 = 0 then 'X' when id % 5 = 1 then null else ' 1000' end as postal_code", "if(id % 5 = 4, null, 46.0d + id % 2 * 0.05d) as lat", "7.0d as lon", "'old' as canton_code")
    town = spark.range(600).selectExpr("id as zip_id", "if(id % 2 = 0, '1000 ', '2000') as postal_code", "concat('C', id % 4) as canton_code", "46.0d + id % 4 * 0.02d as lat", "7.0d as lon", "if(id < 300, 1.0d, cast(null as double)) as address_share")
    got = {r["station_id"]: r["canton_code"] for r in geo.resolve_canton(places, town).collect()}
    assert len(got) == 500 and max(met) <= 16
    # with the code: spots 46.00 (C0) and 46.04 (C2); without: of all four spots the nearest, and none without a place
    assert [got[i] for i in (2, 3, 4, 0, 5, 1, 6)] == ["C0", "C2", "C0", "C0", "C2", "C2", "C0"]
