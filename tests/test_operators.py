"""The rules on small frames: each case is stated with the result it must have."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridlake.functions import exprs as X
from gridlake.operators import directory, features, geo, keyed, lineage, loads, quality, recommend, status
from gridlake.plans.registry import Views
from gridlake.sources import readers

c = F.col


def one(df):
    (row,) = df.collect()
    return row


def test_slots_and_calendar(spark):
    r = one(spark.sql("select timestamp '2026-10-02 13:47:31' as t, timestamp '2025-08-01 10:00:00' as s").select(X.slot_floor(c("t")), X.slot_round(c("t")), X.local_hour(c("s")), X.local_dow(c("s"))))
    assert (r[0], r[1], r[2], r[3]) == (dt(2026, 10, 2, 13, 45), dt(2026, 10, 2, 13, 50), 12, 4)


def test_holidays(spark):
    days = spark.sql("select date '2025-08-01' as day, cast(null as string) as canton_code")
    rows = spark.sql("select timestamp '2025-08-01 10:00:00' as t, 'BE' as canton_code union all select timestamp '2025-08-04 10:00:00', 'BE'")
    got = features.with_calendar(rows, "t", days).orderBy("t").select("is_holiday").collect()
    assert [r[0] for r in got] == [1, 0]


def test_facility_power(spark):
    rows = spark.sql("""select array(named_struct('power', '150000', 'powertype', 'DC')) as f, 1 as i union all select array(named_struct('power', '22.0', 'powertype', 'AC_3_PHASE')), 2
        union all select array(named_struct('power', '0', 'powertype', 'DC')), 3 union all select cast(array() as array<struct<power:string,powertype:string>>), 4
        union all select array(named_struct('power', '50', 'powertype', 'odd'), named_struct('power', '11', 'powertype', 'dc')), 5""")
    p = readers.max_facility_power(c("f"))
    got = {r[0]: (r[1], r[2]) for r in rows.select("i", p["power_kw"], p["power_type"]).collect()}
    assert got[1] == (150.0, "DC") and got[2] == (22.0, "AC_3_PHASE") and got[3] == (None, "DC") and got[4] == (None, None) and got[5] == (50.0, "DC")


def test_coordinates(spark):
    rows = spark.createDataFrame([("46.23432 6.055602",), ("46.2,6.0",), ("None None",), (None,), ("",)], "g string")
    p = readers.parse_coordinates(c("g"))
    assert [tuple(r) for r in rows.select(p["lat"], p["lon"]).collect()] == [(46.23432, 6.055602), (46.2, 6.0), (None, None), (None, None), (None, None)]


def test_record_hash_ignores_order_of_plugs_only(spark):
    h = lambda plugs, kw: readers.record_hash(F.lit("o"), F.lit("s"), F.lit("a"), F.lit(46.0), F.lit(6.0), F.array(*map(F.lit, plugs)), F.lit(kw), F.lit("DC"), F.lit("x"), F.lit(True))
    r = one(spark.range(1).select(h("ab", 1.0), h("ba", 1.0), h("abc", 1.0), h("ab", 2.0)))
    assert r[0] == r[1] and len({r[0], r[2], r[3]}) == 3 and len(r[0]) == 64


def test_regression_and_classification(spark):
    r = one(features.regression_metrics(spark.createDataFrame([(y, y + 0.01, y + 0.02) for y in (0.1, 0.2, 0.3)], "y double, p double, n double"), "y", "p", "n"))
    assert r["mae"] == pytest.approx(0.01) and r["mase"] == pytest.approx(0.5)
    rows = [(0, 0.0, 0.5)] * 50 + [(1, 1.0, 0.5)] * 50
    df = spark.createDataFrame(rows, "y int, p double, half double")
    assert one(features.classification_metrics(df, "y", "p"))["auc"] == pytest.approx(1.0)
    half = one(features.classification_metrics(df, "y", "half"))
    assert half["brier"] == pytest.approx(0.25) and half["auc"] == pytest.approx(0.5)


def test_effective_power_unknown_is_null(spark):
    e = X.effective_power
    r = one(spark.range(1).select(e(F.lit(None).cast("double"), F.lit("DC"), F.lit(11.0), F.lit(100.0)), e(F.lit(50.0), F.lit("DC"), F.lit(11.0), F.lit(None).cast("double")), e(F.lit(22.0), F.lit("AC"), F.lit(11.0), F.lit(100.0))))
    assert tuple(r) == (None, None, 11.0)


def test_episodes_cover_the_grid(spark, sf):
    from gridlake.plans.registry import Views

    grid = Views(spark, sf).fx_status_dense
    ep = status.status_episodes(grid)
    assert ep.agg(F.sum("n_slots")).first()[0] == grid.count()
    w = ep.withColumn("next", F.lead("valid_from").over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("evse_id").orderBy("valid_from")))
    assert w.filter("next < valid_to").count() == 0


def test_grid_drops_null_and_takes_latest(spark):
    rows = [(" A ", dt(2024, 1, 1, 0, 4, 59), "Occupied", "o"), ("A", dt(2024, 1, 1, 0, 5, 1), "Available", None), (None, dt(2024, 1, 1), "Available", "o"), ("B", dt(2024, 1, 1), None, "o")]
    got = status.status_grid(spark.createDataFrame(rows, "EvseID string, datetime timestamp, EVSEStatus string, OperatorID string")).collect()
    assert [tuple(r) for r in got] == [("A", dt(2024, 1, 1, 0, 5), "Available", "o")]


def test_profiles_by_parts_equal_whole(spark, sf):
    from gridlake.plans.registry import Views

    grid = Views(spark, sf).fx_status_dense
    parts = status.profile_parts(grid.withColumn("d", F.to_date("slot_ts")), by=["d"])
    a = sorted(map(tuple, status.evse_profile(parts).collect()))
    b = sorted(map(tuple, status.evse_profile(status.profile_parts(grid)).collect()))
    assert a == b and a


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "h1", True, "feed"), (2, "b", "h2", False, "manual")], "k int, v string, h string, act boolean, source string")
    new = spark.createDataFrame([(1, "x", "h1", True, "manual"), (2, "y", "h2", True, "feed"), (3, "z", "h3", True, "feed")], "k int, v string, h string, act boolean, source string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    once = keyed.upsert(old, new, ["k"])
    assert rows(once) == rows(keyed.upsert(once, new, ["k"])) == rows(new)
    changed = rows(keyed.upsert_if_changed(old, new, ["k"], "h", "act"))
    assert [r[1] for r in changed] == ["a", "y", "z"]
    strong = rows(keyed.upsert_with_priority(old, new, ["k"], "source", "manual"))
    assert [r[1] for r in strong] == ["x", "b", "z"]
    assert [r[1] for r in rows(keyed.insert_ignore(old, new, ["k"]))] == ["a", "b", "z"]


def history(spark):
    return spark.sql("select 'p' as evse_id, 'h1' as row_hash, 's' as station_id, true as is_active, timestamp '2024-01-01' as valid_from, cast(null as timestamp) as valid_to, 'insert' as change_type")


@pytest.mark.parametrize("h, active, kind", [("h2", True, "update"), ("h1", False, "deactivate"), ("h1", True, None)])
def test_scd2_versions(spark, h, active, kind):
    old = spark.createDataFrame([("p", "h1", "s", True)], "evse_id string, row_hash string, station_id string, is_active boolean")
    new = spark.createDataFrame([("p", h, "s", active)], old.schema)
    out = directory.scd2_apply(history(spark), old, new, F.lit("2024-02-01").cast("timestamp")).collect()
    assert sum(r["valid_to"] is None for r in out) == 1
    assert [r["change_type"] for r in out if r["valid_to"] is None] == [kind or "insert"]
    if kind:
        assert {r["valid_to"] for r in out} == {None, dt(2024, 2, 1)}


def test_operator_outage_keeps_points(spark):
    active = spark.createDataFrame([(f"a{i}", "A", dt(2024, 1, 31)) for i in range(4)] + [(f"b{i}", "B", dt(2024, 1, 31)) for i in range(4)] + [("c0", "C", dt(2024, 1, 1)), ("c1", "C", dt(2024, 1, 31))], "evse_id string, operator_id string, last_seen timestamp")
    incoming = spark.createDataFrame([(f"a{i}",) for i in range(3)] + [(f"n{i}",) for i in range(5)], "evse_id string")
    now = F.lit("2024-02-01").cast("timestamp")
    assert sorted(r[0] for r in directory.to_deactivate(active, incoming, now).collect()) == ["a3", "c0"]
    assert directory.to_deactivate(active, incoming.limit(2), now).count() == 0
    assert sorted(r[0] for r in directory.operator_gaps(active, incoming).collect()) == ["B", "C"]


def test_weather_twice_is_once(spark):
    rows = spark.createDataFrame([("BE", dt(2024, 1, 1), "actual", 1.0, 0.0), ("BE", dt(2024, 1, 1), "actual", 1.0, 0.0), ("BE", dt(2024, 1, 1, 1), "actual", 99.0, 0.0), ("BE", dt(2024, 1, 1, 2), "actual", None, 0.0), ("XX", dt(2024, 1, 1), "actual", 1.0, 0.0)], "canton_code string, hour_utc timestamp, kind string, temperature_c double, precipitation_mm double")
    cantons = spark.createDataFrame([("BE",)], "canton_code string")
    out, bad = loads.apply_weather(rows, cantons, rows.limit(0))
    again, _ = loads.apply_weather(rows, cantons, out)
    assert out.count() == again.count() == 2 and bad.count() == 1


def test_lineage_golden_diamond(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "from_node string, to_node string")
    got = lineage.ancestors(e, spark.createDataFrame([("d",)], "start string"))
    assert sorted((r["node"], r["depth"]) for r in got.collect()) == [("a", 2), ("b", 1), ("c", 1), ("d", 0)]
    assert lineage.upstream_edges(e, spark.createDataFrame([("d",)], "start string")).count() == 4


def test_radius_join_is_brute_force(spark, sf):
    from gridlake.plans.registry import Views

    v = Views(spark, sf)
    asked = v.fx_request.limit(50).select("request_id", c("lat").alias("alat"), c("lon").alias("alon"))
    places = v.fx_station.select("station_id", "lat", "lon")
    got = {(r[0], r[1]) for r in geo.within_radius(asked, places, 20.0).select("request_id", "station_id").collect()}
    import math

    def km(a, b, x, y):
        p = math.radians
        return 2 * 6371.0088 * math.asin(math.sqrt(math.sin(p(x - a) / 2) ** 2 + math.cos(p(a)) * math.cos(p(x)) * math.sin(p(y - b) / 2) ** 2))

    want = {(a[0], s[0]) for a in asked.collect() for s in places.collect() if km(a[1], a[2], s[1], s[2]) <= 20.0}
    assert got == want and got


def test_check_catalogue(spark):
    assert len(quality.CATALOGUE) == 18 and {k.severity for k in quality.CATALOGUE.values()} == {"warn", "error"} and len({k.kind for k in quality.CATALOGUE.values()}) == 7
    out = {r["check_id"]: r for r in quality.run_checks({}, F.lit("2024-01-01").cast("timestamp"), spark, only=["type_postal_code"]).collect()}
    assert not out["type_postal_code"]["passed"] and out["type_postal_code"]["failed_rows"] == 1  # a broken check is one violation


def test_relational_division_of_nothing(spark, sf):
    from gridlake.plans.q_analytics import fits_all
    from gridlake.plans.registry import Views

    v = Views(spark, sf)
    assert fits_all(v, -1).count() == v.fx_vehicle.filter("dc_max_kw is not null").count()


def test_any_free_with_certainty(spark):
    found = spark.createDataFrame([(1, "e", 1, 1.0, "DC", 50.0, 50.0, ["CCS2"], 1.0), (1, "f", 1, 1.0, "DC", None, None, ["CCS2"], 0.2)], "request_id int, evse_id string, station_id int, distance_km double, power_class string, power_kw double, effective_kw double, plug_codes array<string>, p_free double")
    req = spark.createDataFrame([(1, 7, 20.0)], "request_id int, vehicle_id int, energy_kwh double")
    r = one(recommend.score(found, req))
    assert r["p_station"] == 1.0 and r["charge_min"] == pytest.approx(24.0) and r["n_compatible"] == 2


def test_window_plan(spark):
    have = spark.createDataFrame([("BE", dt(2024, 1, 1, 23)), ("ZH", dt(2024, 3, 1, 5))], "key string, hour_utc timestamp")
    got = sorted(map(tuple, loads.window_plan(have, F.lit("2024-01-20").cast("date"), 10).collect()))
    assert [(k, str(a), str(b)) for k, a, b in got] == [("BE", "2024-01-02", "2024-01-11"), ("BE", "2024-01-12", "2024-01-20")]


def test_checks_fail_alone(spark):
    """A check that can't be planned, and one that fails on an executor, are findings; the others run."""
    from gridlake.operators import quality

    tables = {"station": spark.createDataFrame([(1, "a", "1000", None)], "station_id long, name string, postal_code string, canton_code string")}
    broken = spark.range(3).select(F.col("id").alias("station_id"), F.lit("n").alias("name"), F.lit("1").alias("postal_code"), F.expr("cast(raise_error('no such cell') as string)").alias("canton_code"))
    ok = quality.run_checks(tables, F.lit("2024-01-01").cast("timestamp"), spark, only=["completeness_station_canton", "completeness_evse_power"]).collect()
    assert {r["check_id"]: (r["passed"], r["failed_rows"]) for r in ok} == {"completeness_station_canton": (False, 1), "completeness_evse_power": (False, 1)}
    both = quality.run_checks({"station": broken, "point": spark.createDataFrame([("x", 11.0, "AC", True)], "evse_id string, power_kw double, power_class string, is_active boolean")}, F.lit("2024-01-01").cast("timestamp"), spark, only=["completeness_station_canton", "completeness_evse_power"]).collect()
    told = {r["check_id"]: r for r in both}
    assert not told["completeness_station_canton"]["passed"] and told["completeness_evse_power"]["passed"]


def test_a_check_counts_all_and_shows_some(spark):
    from gridlake.operators import quality

    n, some = quality.counted(spark.range(1000).select("id", (c("id") * 2).alias("twice"))).first()
    assert n == 1000 and len(some) == 5 and some == sorted(set(some)) and all(x.startswith('{"id":') for x in some)
    assert tuple(quality.counted(spark.range(1)).first()) == (1, ['{"id":0}']) and tuple(quality.counted(spark.range(0)).first()) == (0, [])


def test_an_error_that_is_no_check_s_own_is_raised(spark, monkeypatch):
    from gridlake.operators import quality

    def lost(tables, now):
        raise ConnectionError("the cluster is gone")

    monkeypatch.setitem(quality.CATALOGUE, "lost", quality.Check("lost", "error", "validity", lost))
    with pytest.raises(ConnectionError):
        quality.run_checks({}, F.lit("2024-01-01").cast("timestamp"), spark, only=["lost"])


def test_explanations_say_what_the_figures_say(spark):
    items = spark.createDataFrame(
        [(1, 7, 10, "DC", 150.0, 100.0, ["CCS2", "CHADEMO"], 0.854, 12.34, 12.4, 20, 12.0, 30.6), (2, 7, 11, "AC", None, None, ["TYPE2_CABLE"], 0.5, 3.0, 4.2, 10, 162.0, 176.2), (3, 7, 12, "AC", 22.0, 11.0, ["TYPE2_SOCKET"], 1.0, 0.5, 1.0, 40, 218.0, 219.0)],
        "request_id long, vehicle_id long, station_id long, power_class string, power_kw double, effective_kw double, plugs array<string>, p_station double, distance_km double, eta_min double, energy_kwh int, charge_min double, total_min double",
    )
    cars = spark.createDataFrame([(7, 11.0, 100.0)], "vehicle_id long, ac_max_kw double, dc_max_kw double")
    state = spark.createDataFrame([(10, 3, 2, 3), (11, 4, 0, 0)], "station_id long, n_total long, n_free_now long, n_known long")
    told = {r["request_id"]: r["explanation"] for r in recommend.explained(items, cars, state, cold=c("request_id") != 3).collect()}
    assert told[1] == "Plug CCS2, CHADEMO. Point 150 kW, car up to 100 kW: about 100 kW. 12.3 km, 12 min away. Now 2 of 3 free; one free on arrival: 85%. 20 kWh in 12 min, in all 31 min. Fast charging is slower in the cold."
    assert told[2] == "Plug TYPE2_CABLE. Point power unknown; time estimated from the least usual. 3.0 km, 4 min away. State unknown; by history one free: 50%. 10 kWh in 162 min, in all 176 min."
    assert told[3].startswith("Plug TYPE2_SOCKET. Point 22 kW, car up to 11 kW: about 11 kW.") and "State unknown" in told[3]


def test_a_month_with_a_bad_file_is_partial(spark, tmp_path):
    from gridlake.sources import readers

    good = spark.createDataFrame([("2024-01-01", "a", "Available", "o")], "datetime string, EvseID string, EVSEStatus string, OperatorID string")
    path = str(tmp_path / "month")
    good.write.parquet(path)
    assert readers.read_status_archive(spark, path).count() == 1
    good.drop("OperatorID").write.mode("append").parquet(path)
    assert readers.read_status_archive(spark, path) is None
    other = tmp_path / "other"
    good.write.parquet(str(other))
    (other / "empty.parquet").write_bytes(b"")
    assert readers.read_status_archive(spark, str(other)) is None
    assert readers.read_status_archive(spark, str(tmp_path / "none")) is None


def test_radius_at_any_latitude(spark):
    import math
    import random

    from gridlake.operators import geo

    rng = random.Random(3)
    for north in (0, 47, 60, 75):
        a = [(i, north + rng.uniform(-2, 2), 10 + rng.uniform(-3, 3)) for i in range(60)]
        b = [(i, north + rng.uniform(-2, 2), 10 + rng.uniform(-3, 3)) for i in range(200)]

        def km(x, y):
            p, q = math.radians(x[1]), math.radians(y[1])
            h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(y[2] - x[2]) / 2) ** 2
            return 2 * 6371.0088 * math.asin(math.sqrt(h))

        want = {(x[0], y[0]) for x in a for y in b if km(x, y) <= 40}
        asking, places = spark.createDataFrame(a, "q long, alat double, alon double"), spark.createDataFrame(b, "p long, lat double, lon double")
        got = [(r["q"], r["p"]) for r in geo.within_radius(asking, places, 40.0).select("q", "p").collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_lineage_says_when_paths_do_not_end(spark):
    import pytest

    from gridlake.operators import lineage

    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "from_node string, to_node string")
    with pytest.raises(ValueError):
        lineage.ancestors(ring, spark.createDataFrame([("a",)], "start string"), most=5)


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    from gridlake.streaming import status_stream

    kind = "evse_id string, slot_ts timestamp, status string"
    feed, place = str(tmp_path / "feed"), str(tmp_path / "place")
    at = lambda h, m=0: dt(2024, 1, 1, h, m)

    def more(*rows):
        spark.createDataFrame(list(rows), kind).coalesce(1).write.mode("append").parquet(feed)
        return {tuple(r) for r in status_stream.episodes(status_stream.snapshots(spark, feed, spark.createDataFrame([], kind).schema), place=place).collect()}

    assert more(("a", at(1), "Available"), ("a", at(1, 5), "Available")) == set()  # open, in the state
    got = more(("a", at(1, 10), "Available"), ("a", at(1, 15), "Occupied"), ("b", at(1, 15), "Occupied"))
    assert got == {("a", "Available", at(1), at(1, 15), 3)}  # its slots came in two runs
    got = more(("a", at(9), "Available"), ("b", at(9), "Available"), ("a", at(9, 5), "Occupied"))
    assert got == {("a", "Available", at(1), at(1, 15), 3), ("a", "Occupied", at(1, 15), at(1, 20), 1), ("b", "Occupied", at(1, 15), at(1, 20), 1), ("a", "Available", at(9), at(9, 5), 1)}

    rows = spark.createDataFrame([("a", at(1)), ("zz", at(1))], "evse_id string, datetime timestamp").withColumn("status", F.lit("Available"))
    known, raw, run = spark.createDataFrame([("a",)], "evse_id string"), str(tmp_path / "raw"), str(tmp_path / "run")
    for turn in (1, 2, 3):  # the third finds nothing new
        if turn < 3:
            rows.withColumn("datetime", c("datetime") + F.make_interval(hours=F.lit(turn))).write.mode("append").parquet(raw)
        found, unknown = status_stream.ingest(status_stream.snapshots(spark, raw, rows.schema), known, place=run)
        assert found.count() == unknown.count() == min(turn, 2)


def test_bucketed_grid_needs_no_exchange(spark, sf, tmp_path):
    from gridlake.operators import status as S
    from gridlake.sources import sinks
    from gridlake.streaming.status_stream import settings

    grid = S.status_grid(Views(spark, sf).fx_status_raw)
    table = spark.table(sinks.write_bucketed(grid, str(tmp_path / "grid"), 4))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", **sinks.CO_LOCATED}):
        episodes = S.status_episodes(table)
        assert "Exchange" not in plan(episodes)
        parts = S.profile_parts(table)
        assert "Exchange" not in plan(parts)
        later = table.select("evse_id", (c("slot_ts") - F.expr("interval 5 minutes")).alias("slot_ts"), c("status").alias("then"))
        shifted = table.join(later, ["evse_id", "slot_ts"])
        assert "Exchange" not in plan(shifted)
        assert {tuple(r) for r in episodes.collect()} == {tuple(r) for r in S.status_episodes(grid).collect()}
        assert {tuple(r) for r in parts.collect()} == {tuple(r) for r in S.profile_parts(grid).collect()} and shifted.count() >= 0


def test_sql_functions_equal_the_columns_and_stay_in_the_engine(spark, sf):
    from gridlake.functions import exprs as X
    from gridlake.functions import sql
    from gridlake.operators import geo

    v = Views(spark, sf)
    sql.register(spark, {"charging_point": v.fx_point, "charging_point_plug": v.fx_point_plug, "charging_vehicle": v.fx_vehicle, "charging_vehicle_plug": v.fx_vehicle_plug})
    rows = v.fx_point.join(v.fx_station.select("station_id", "street", "postal_code"), "station_id").withColumn("street", F.when(c("k") % 5 != 0, F.concat(F.lit("Übere-"), "street")))
    rows.createOrReplaceTempView("placed")
    by_sql = spark.sql("select evse_id, haversine_km(46.9d, 7.4d, lat, lon) as km, eta_minutes(haversine_km(46.9d, 7.4d, lat, lon)) as eta, station_key(operator_id, street, postal_code, lat, lon) as key, effective_power(power_kw, power_class, 11d, null) as kw from placed")
    km = X.haversine_km(F.lit(46.9), F.lit(7.4), c("lat"), c("lon"))
    by_column = rows.select("evse_id", km.alias("km"), X.eta_minutes(km).alias("eta"), X.station_key(c("operator_id"), c("street"), c("postal_code"), c("lat"), c("lon")).alias("key"), X.effective_power(c("power_kw"), c("power_class"), F.lit(11.0), F.lit(None).cast("double")).alias("kw"))
    close = lambda df: {(r["evse_id"], round(r["km"], 9), round(r["eta"], 9), r["key"], r["kw"]) for r in df.collect()}
    assert close(by_sql) == close(by_column) and "Python" not in by_sql._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([(1, 7, 46.5, 7.5)], "request_id long, vehicle_id long, lat double, lon double")
    want = {(r["evse_id"], round(r["distance_km"], 9), tuple(r["plug_codes"]), r["effective_kw"]) for r in geo.compatible_points(asked, v.fx_point, v.fx_point_plug, v.fx_vehicle_plug, v.fx_vehicle, 50.0).collect()}
    found = spark.sql("select * from compatible_points(7, 46.5d, 7.5d, 50d)")
    assert {(r["evse_id"], round(r["distance_km"], 9), tuple(r["plug_codes"]), r["effective_kw"]) for r in found.collect()} == want and want
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_fingerprint_tells_content_not_order(spark, sf):
    rows = Views(spark, sf).lineitem.limit(500).persist()
    first = features.frame_fingerprint(rows).first()
    assert tuple(features.frame_fingerprint(rows.repartition(7)).first()) == tuple(first) and first["n"] == 500
    assert tuple(features.frame_fingerprint(rows.withColumn("l_quantity", F.when(c("l_orderkey") == rows.first()["l_orderkey"], -1).otherwise(c("l_quantity")))).first()) != tuple(first)
    assert tuple(features.frame_fingerprint(rows.union(rows)).first()) != tuple(first)


def test_manifest_is_what_the_files_are(spark, tmp_path):
    import hashlib

    (tmp_path / "deep").mkdir()
    held = {"a.json": b"{}", "deep/b.bin": bytes(range(256)) * 5000, "deep/empty": b""}
    for name, data in held.items():
        (tmp_path / name).write_bytes(data)
    found = {r["path"].split(tmp_path.name + "/")[1]: (r["size"], r["sha"]) for r in readers.raw_manifest(spark, str(tmp_path)).collect()}
    assert found == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in held.items() if data}


def test_runs_stand_for_the_slots_of_the_dense_grid(spark, sf):
    v = Views(spark, sf)
    runs = status.carried(status.status_grid(v.fx_status_raw)).persist()
    slots = runs.selectExpr("evse_id", "explode(sequence(valid_from, valid_to - interval '5' minute, interval '5' minute)) as slot_ts", "status")
    grid = v.fx_status_dense.persist()
    assert grid.count() == slots.count() and not grid.exceptAll(slots.select(grid.columns)).limit(1).count()
    want = {tuple(r) for r in status.profile_parts(grid).collect()}
    assert all({tuple(r) for r in status.profile_of_runs(runs, piece=p).collect()} == want for p in (900, 3600))


def test_a_sample_moves_runs_and_not_slots(spark):
    """A status that holds for years is one row, and no window or join takes its slots."""
    runs = spark.sql("""select concat('p', id % 3) as evse_id, if(id < 3, 'Available', 'Occupied') as status, if(id < 3, timestamp '2020-01-01 00:00:00', timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, int(5 * id), 0)) as valid_from,
        if(id < 3, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, int(5 * id + 15), 0), timestamp '2024-01-01 03:00:00') as valid_to from range(6)""")
    dim = spark.sql("select concat('p', id) as evse_id, 46.5d as lat, if(id < 2, 7.5d, 8.0d) as lon from range(3)")
    sample = status.availability_sample(runs, dim, share_bp=10000).persist()
    last = {r["evse_id"]: r for r in sample.filter("t0 = timestamp '2024-01-01 00:15:00'").collect()}
    assert [(last[f"p{i}"]["status_now"], last[f"p{i}"]["n_total_other"], last[f"p{i}"]["n_free_other"]) for i in range(3)] == [("Occupied", 1, 1), ("Available", 1, 0), ("Available", 0, 0)]
    assert sample.filter("t0 < timestamp '2023-12-31 00:00:00'").agg(F.min("y"), F.max("n_free_other")).first()[:] == (1, 1)
    assert sample.filter("t0 + make_interval(0, 0, 0, 0, 0, delta_min, 0) >= timestamp '2024-01-01 03:00:00'").count() == 0 < sample.filter("t0 >= timestamp '2024-01-01 02:00:00'").count()
    few = status.availability_sample(runs, dim, share_bp=5)
    few.collect()
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and sample.count() > 300_000 > 100 * few.count()
