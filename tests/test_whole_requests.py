"""Requests are answered whole; their SQL, whole too, is held against them in test_queries."""

import math

from gridlake.plans.registry import Views
from test_queries import QUERIES


def test_log_has_a_row_for_every_request(spark, sf):
    assert QUERIES["rec_log"](spark, sf).count() == Views(spark, sf).fx_request.count()


def test_candidates_are_brute_force(spark, sf):
    v = Views(spark, sf)
    asked = [r for r in v.fx_request.collect() if r["request_id"] % 100][:200]
    points, cars = [r for r in v.fx_point.collect() if r["is_active"]], {r["vehicle_id"]: r for r in v.fx_vehicle.collect()}
    offered, taken = {}, {}
    for r in v.fx_point_plug.collect():
        offered.setdefault(r["evse_id"], set()).add(r["plug_code"])
    for r in v.fx_vehicle_plug.collect():
        taken.setdefault(r["vehicle_id"], set()).add(r["plug_code"])

    def km(a, b):
        x, y = math.radians(a["lat"]), math.radians(b["lat"])
        h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    want = set()
    for a in asked:
        car = cars.get(a["vehicle_id"])
        for p in points if car else ():
            dc, plugs = p["power_class"] == "DC", offered.get(p["evse_id"], set()) & taken.get(a["vehicle_id"], set())
            if plugs and (not dc or car["dc_max_kw"] is not None and p["power_kw"] is not None) and p["power_class"] and km(a, p) <= 50:
                want.add((a["request_id"], p["evse_id"], ",".join(sorted(plugs))))
    ids = {a["request_id"] for a in asked}
    got = {(r[0], r[1], r[2]) for r in QUERIES["rec_candidates"](spark, sf).select("request_id", "evse_id", "plugs").collect() if r[0] in ids}
    assert got == want and len(want) > 1000


def test_places_meet_once_however_many_requests(spark, monkeypatch):
    """Requests of a few places: what is looked for around places has rows for these, and every request its stations, nearest first."""
    from gridlake.operators import geo, recommend

    asking, plain = [], geo.within_radius

    def within_radius(asks, places, radius_km, *more, **named):
        asking.append((asks.count(), places.count()))
        return plain(asks, places, radius_km, *more, **named)

    monkeypatch.setattr(geo, "within_radius", within_radius)
    points = spark.range(3000).selectExpr("concat('e', id) as evse_id", "id div 2 as station_id", "true as is_active", "if(id % 2 = 0, 'AC', 'DC') as power_class", "if(id % 7 = 0, null, 50.0d) as power_kw", "46.0d + (id div 2 % 40) * 0.004d as lat", "7.0d as lon")
    plugs = points.selectExpr("evse_id", "if(power_class = 'AC', 'T2', 'CCS') as plug_code")
    cars = spark.sql("select 1L as vehicle_id, 11.0d as ac_max_kw, cast(null as double) as dc_max_kw union all select 2L, 11.0d, 100.0d")
    taken = spark.sql("select 1L as vehicle_id, 'T2' as plug_code union all select 2L, 'T2' union all select 2L, 'CCS'")
    requests = spark.range(600).selectExpr("id as request_id", "1 + id % 2 as vehicle_id", "46.0d + (id % 3) * 0.05d as lat", "7.0d as lon", "20 as energy_kwh", "timestamp '2024-01-02 00:00:00' as t0")
    none = spark.createDataFrame([], "evse_id string, dow int, hour_local int, p_free double"), spark.createDataFrame([], "evse_id string, p_free double")
    tables = {"point": points, "point_plug": plugs, "vehicle": cars, "vehicle_plug": taken}
    got = recommend.recommend_batch(requests, tables, none).collect()
    assert asking == [(3, 40)] and len(got) == 3000 and {r["rank"] for r in got} == {1, 2, 3, 4, 5}
    found = {r["request_id"]: [] for r in got}
    for r in got:
        found[r["request_id"]].append((r["rank"], r["station_id"]))
    # of place 0 and the car without DC: the first place's stations are nearest, and of those the first whose power is known
    want = [s for s in range(0, 1500, 40) if 2 * s % 7 or s == 0][:6]
    known = [s for s in want if 2 * s % 7][:5]
    assert [s for _, s in sorted(found[0])] == known
    assert recommend.points_needed(requests, tables).filter("request_id = 0").first()["points"] == sum(1 for s in range(1500) if s % 40 * 0.004 * 111.195 <= 15)
    first = geo.strongest_points(requests, points, plugs, taken, cars, 15.0, 5).filter("request_id = 0").collect()
    assert {r["evse_id"] for r in first} == set(sorted(f"e{2 * s}" for s in range(0, 1500, 40) if 2 * s % 7)[:5])


def test_answers_hold_the_state_and_are_not_dealt_by_station_or_car(spark, sf):
    from gridlake.operators import recommend
    from gridlake.plans import q_recommend

    v = Views(spark, sf)
    state = recommend.station_state(v.fx_point, v.fx_status_dense.filter("slot_ts = timestamp '2024-01-10 12:00:00'").select("evse_id", "status")).persist()
    asked, tables, chances = v.fx_request.limit(40), q_recommend.tables(v), q_recommend.chances(v)
    items = recommend.recommend_batch(asked, tables, chances, state=state)
    text = recommend.explained(items, v.fx_vehicle, state)
    plain = recommend.explained(recommend.recommend_batch(asked, tables, chances).drop("ac_max_kw", "dc_max_kw"), v.fx_vehicle, state)
    columns = ["request_id", "rank", "station_id", "explanation"]
    assert sorted(map(tuple, text.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))
    assert text.filter("explanation like '%Now % of %'").count()
    joins = lambda df: df._jdf.queryExecution().analyzed().toString().count("Join")
    assert joins(text) == joins(items) < joins(plain)
