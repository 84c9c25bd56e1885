"""Fitted models: better than the baselines on held-out rows, chances in range and in order, nothing later than the cut, saved and loaded."""

import pytest
from pyspark.sql import functions as F

from gridlake.operators import features as M
from gridlake.operators.model_store import ModelStore
from gridlake.plans import q_models as Q
from gridlake.plans.registry import Views
from gridlake.session import staged

c = F.col
CUT, LATE = "2024-01-19 12:00:00", "2024-01-25 00:00:00"


@pytest.fixture(scope="module")
def v(spark, sf):
    return Views(spark, sf.replace("sf0.001", "sf0.01"))


@pytest.fixture(scope="module")
def availability(v):
    """(model, held-out rows, training rows): free if a point was free and time is short, so that there is something to learn."""
    rows = staged(Q.feature_rows(v), "features")
    rows = M.predict_markov(rows, M.fit_markov(rows.filter(c("t0") < CUT), 10))
    train, calib, test = rows.filter(c("t0") < CUT), rows.filter((c("t0") >= CUT) & (c("t0") < LATE)), rows.filter(c("t0") >= LATE)
    return M.fit_gbt_availability(train, calib, 10), staged(test, "test"), staged(train, "train")


def test_no_training_row_is_later_than_the_cut(v, availability):
    assert availability[2].agg(F.max("t0")).first()[0].isoformat(" ") < CUT
    train, test = Q.forecast_parts(v)
    assert train.filter(c("target_utc") > F.lit(Q.TRAIN_TO).cast("timestamp")).count() == 0
    assert test.agg(F.min("origin_utc")).first()[0] > train.agg(F.max("target_utc")).first()[0]


def test_availability_beats_the_baselines(availability):
    model, test, _ = availability
    told = M.score_availability(test, model).withColumns({"b0": M.persistence(), "b1": M.profile_probability(), "b2": c("p_markov")})
    brier = {p: M.classification_metrics(told, "y", p).first()["brier"] for p in ("b0", "b1", "b2", "p_free")}
    assert brier["p_free"] <= 1.02 * min(brier["b0"], brier["b1"], brier["b2"]), brier
    low, high, n = told.agg(F.min("p_free"), F.max("p_free"), F.count_distinct("p_free")).first()
    assert 0.001 <= low < high <= 0.999 and n > 1
    steps = model[2].predictions.toArray()
    assert all(a <= b for a, b in zip(steps, steps[1:]))
    assert {r["feature"] for r in M.importance(test.sparkSession, model).collect()} == set(M.AVAILABILITY + M.AVAILABILITY_CATEGORIES)


def test_forecast_beats_the_seasonal_one_where_there_is_a_course_of_the_day(spark, v):
    """Four series with a daily course and noise: last week's value carries its own noise."""
    hours = spark.range(24 * 30).select(F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + c("id") * 3600).alias("hour_utc"), "id")
    kinds = spark.createDataFrame([("NATION_1", "AC", 0.4), ("NATION_1", "DC", 0.5), ("NATION_2", "AC", 0.6), ("NATION_2", "DC", 0.45)], "canton_code string, power_class string, level double")
    noise = (F.pmod(F.xxhash64("canton_code", "power_class", "id"), F.lit(1000)) / 1000 - 0.5) * 0.2
    series = hours.join(F.broadcast(kinds)).select(*M.SERIES, "hour_utc", (c("level") + 0.25 * F.sin(c("id") % 24 * 0.2618) + noise).alias("y"))
    rows = M.add_weather(M.add_profile(M.forecast_dataset(series), series, F.lit(Q.TRAIN_TO).cast("timestamp")), v.fx_weather, "actual")
    train, test = rows.filter(c("target_utc") <= F.lit(Q.TRAIN_TO).cast("timestamp")), rows.filter("origin_utc >= timestamp '2024-01-22'")
    told = M.forecast(test, M.fit_gbt_forecast(train, Q.TAIL_DAYS, 10)).withColumn("a0", M.seasonal_naive()).filter("a0 is not null")
    own, naive = (M.regression_metrics(told, "y", p, "a0").first() for p in ("p", "a0"))
    assert own["mae"] < naive["mae"] and own["mase"] < 1 and naive["mase"] == pytest.approx(1.0)
    assert told.filter("p < 0 or p > 1 or p is null").count() == 0


def test_a_loaded_model_scores_as_the_fitted_one_and_registration_alone_hands_over(spark, availability, tmp_path):
    model, test, train = availability
    store = ModelStore(spark, str(tmp_path / "store"))
    with pytest.raises(LookupError):
        store.active("availability")
    first = store.save(model, "availability", train, "2024-02-01 00:00:00", name="first")
    score = lambda df: {(r["evse_id"], r["t0"], r["delta_min"]): round(r["p_free"], 12) for r in df.collect()}
    fitted = score(M.score_availability(test, model))
    loaded = ModelStore(spark, str(tmp_path / "store")).score(test)
    assert score(loaded) == fitted and {r[0] for r in loaded.select("model").distinct().collect()} == {first}
    entry = store.active("availability")
    assert (entry["n_rows"], entry["total"], entry["parity"]) == tuple(M.frame_fingerprint(train).first()) and entry["categories"] == model[0]
    other = M.fit_gbt_availability(train.limit(400), train.limit(300), 2)
    store.save(other, "availability", train, "2024-01-31 00:00:00", name="older")
    assert store.active("availability")["model"] == "first"
    store.save(other, "availability", train, "2024-02-02 00:00:00", name="second")
    assert store.active("availability")["model"] == "second" and score(store.score(test)) == score(M.score_availability(test, other)) != fitted
    with pytest.raises(ValueError, match="other features"):
        store.load(type(entry)(**(entry.asDict() | {"features": ["x"]})))


def test_the_least_brier_score_is_chosen(spark):
    scores = spark.createDataFrame([("b0", 0.3), ("b1", 0.2), ("b3", 0.2)], "model string, brier double")
    assert M.select_model(scores).first().asDict() == {"selected": "b1", "brier": 0.2}
