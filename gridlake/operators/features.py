"""Time-safe features, baselines, transition tables and metrics for occupancy and availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ZONE, local_dow, local_hour
from .ranks import with_ranks

c = F.col

#: Forecast horizons in hours; codes of statuses; what is assumed without any history.
HORIZONS = (1, 2, 3, 6, 12, 24)
STATUS_CODES = {"Available": 0, "Occupied": 1, "OutOfService": 2, "Reserved": 3, "Unknown": 4}
UNKNOWN_CODE, DEFAULT_FREE = 4, 0.75
MEASURES = {"temperature_c": "temp_c", "precipitation_mm": "precip_mm", "snowfall_cm": "snow_cm", "wind_kmh": "wind_kmh"}
SERIES = ["canton_code", "power_class"]


def hourly_series(occ: DataFrame, min_slots: int = 6) -> DataFrame:
    """canton_code, power_class, hour_utc, y of hours seen often enough."""
    return occ.filter(c("occupancy_rate").isNotNull() & (c("slots_observed") >= min_slots)).select(*SERIES, "hour_utc", c("occupancy_rate").alias("y"))


def with_calendar(df: DataFrame, at: str, holidays: DataFrame | None = None, zone: str = ZONE) -> DataFrame:
    """df with dow (Monday 0), hour_local, is_weekend and is_holiday of a UTC time. holidays: day, canton_code (null: all)."""
    out = df.withColumns({"dow": local_dow(c(at), zone), "hour_local": local_hour(c(at), zone), "is_weekend": (local_dow(c(at), zone) >= 5).cast("int")})
    if holidays is None:
        return out.withColumn("is_holiday", F.lit(0))
    day = F.to_date(F.from_utc_timestamp(c(at), zone))
    everywhere = holidays.filter("canton_code is null").select(c("day").alias("_d"), F.lit(1).alias("_a")).distinct()
    own = holidays.filter("canton_code is not null").select(c("day").alias("_d"), "canton_code", F.lit(1).alias("_b")).distinct()
    out = out.withColumn("_d", day).join(everywhere, "_d", "left").join(own, ["_d", "canton_code"], "left")
    return out.withColumn("is_holiday", F.coalesce("_a", "_b", F.lit(0))).drop("_d", "_a", "_b")


def dense_series(series: DataFrame) -> DataFrame:
    """Each series on every hour between the first and last of all; y is null where it wasn't seen. pos counts the hours."""
    ends = series.agg(F.min("hour_utc").alias("lo"), F.max("hour_utc").alias("hi"))  # one row
    grid = series.select(*SERIES).distinct().join(F.broadcast(ends)).select(*SERIES, F.posexplode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("pos", "hour_utc"))
    return grid.join(series, [*SERIES, "hour_utc"], "left")


def forecast_dataset(series: DataFrame, horizons: tuple[int, ...] = HORIZONS, every: int = 6, history: int = 168) -> DataFrame:
    """A row for each series, origin and horizon, with what is known at the origin: lag0..2, mean24, and y a day and a week before the target.

    On the dense grid a lag of n rows is n hours, so a missing hour gives null and not an earlier one. All windows share one
    partitioning and order; the target is a lead.
    """
    w = Window.partitionBy(*SERIES).orderBy("pos")
    day = w.rowsBetween(-23, 0)
    known = dense_series(series).withColumns(
        {"lag1": F.lag("y", 1).over(w), "lag2": F.lag("y", 2).over(w), "mean24": F.when(F.count("y").over(day) >= 12, F.avg("y").over(day))}
        | {f"_t{h}": F.struct(F.lead("hour_utc", h).over(w).alias("at"), F.lead("y", h).over(w).alias("y"), (F.lag("y", 24 - h).over(w) if h < 24 else c("y")).alias("d"), F.lag("y", 168 - h).over(w).alias("w")) for h in horizons}
    )
    origins = known.filter((F.hour("hour_utc") % every == 0) & c("y").isNotNull() & (c("pos") >= history))
    told = origins.withColumn("t", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), c(f"_t{h}").alias("v")) for h in horizons]))).filter("t.v.y is not null")
    return told.select(
        *SERIES, c("hour_utc").alias("origin_utc"), c("t.v.at").alias("target_utc"), c("t.h").alias("h"), c("y").alias("lag0"), "lag1", "lag2", "mean24", c("t.v.d").alias("y_tm24"), c("t.v.w").alias("y_tm168"), c("t.v.y").alias("y")
    )


def add_profile(df: DataFrame, series: DataFrame, train_to: Column, at: str = "target_utc") -> DataFrame:
    """df with profile: the mean of its canton, class, weekday and local hour over the series up to train_to only."""
    keys = [*SERIES, "dow", "hour_local"]
    means = with_calendar(series.filter(c("hour_utc") <= train_to), "hour_utc").groupBy(*keys).agg(F.avg("y").alias("profile"))
    return with_calendar(df, at).join(means, keys, "left")


def add_weather(df: DataFrame, weather: DataFrame, kind: str, at: str = "target_utc") -> DataFrame:
    """df with temperature, rain, snow and wind of its canton at the hour, of one kind of weather; a measure it lacks is null."""
    measures = [(c(x) if x in weather.columns else F.lit(None).cast("double")).alias(into) for x, into in MEASURES.items()]
    own = weather.filter(c("kind") == kind).select("canton_code", c("hour_utc").alias("_hour"), *measures)
    return df.withColumn("_hour", F.date_trunc("hour", at)).join(F.broadcast(own), ["canton_code", "_hour"], "left").drop("_hour")  # cantons x hours of one kind


def fold_parts(df: DataFrame, folds: DataFrame) -> DataFrame:
    """df for each fold with part 'train' (targets up to train_to) or 'test' (origin from test_from, target up to test_to)."""
    part = F.when(c("target_utc") <= c("train_to"), "train").when((c("origin_utc") >= c("test_from")) & (c("target_utc") <= c("test_to")), "test")
    return df.join(F.broadcast(folds)).withColumn("part", part).filter("part is not null").drop("train_to", "test_from", "test_to")  # a few folds


def seasonal_naive() -> Column:
    return F.coalesce("y_tm168", "profile")


def profile_forecast() -> Column:
    return F.coalesce("profile", "lag0")


def regression_metrics(df: DataFrame, y: str, p: str, naive: str, by: list[str] | None = None) -> DataFrame:
    """mae, rmse, mase (against the naive forecast) and n, over all or by groups."""
    mae = lambda x: F.avg(F.abs(c(x) - c(y)))
    return df.groupBy(*(by or [])).agg(mae(p).alias("mae"), F.sqrt(F.avg(F.pow(c(p) - c(y), 2))).alias("rmse"), (mae(p) / F.nullif(mae(naive), F.lit(0.0))).alias("mase"), F.count(F.lit(1)).alias("n"))


def availability_features(df: DataFrame, points: DataFrame, own: DataFrame, group: DataFrame, weather: DataFrame, kind: str, holidays: DataFrame | None = None) -> DataFrame:
    """Samples with features of the moment of arrival; the same for training and scoring.

    df: evse_id, t0, delta_min, status_now, n_total_other, n_free_other (more is carried). own: p_free by point, weekday and
    hour; group: by canton, class, weekday and hour.
    """
    code = F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS_CODES.items() for x in kv])[c("status_now")], F.lit(UNKNOWN_CODE))
    out = df.join(points.select("evse_id", "canton_code", "power_class", "power_kw"), "evse_id").withColumn("arrival_utc", F.timestamp_seconds(F.unix_seconds("t0") + c("delta_min") * 60))
    out = with_calendar(out, "arrival_utc", holidays).withColumns(
        {"status_code": code, "class_dc": (F.coalesce("power_class", F.lit("")) == "DC").cast("int"), "share_free_other": F.when(c("n_total_other") > 0, c("n_free_other") / c("n_total_other"))}
    )
    # a point's profile as one row, at most 168 numbers by hour of the week: samples dealt by their point meet it there
    week = own.groupBy("evse_id").agg(F.map_from_entries(F.collect_list(F.struct((c("dow") * 24 + c("hour_local")).alias("k"), c("p_free").alias("v")))).alias("_week"))
    out = out.join(week, "evse_id", "left").withColumn("p_free_evse", c("_week")[c("dow") * 24 + c("hour_local")]).drop("_week")
    out = out.join(F.broadcast(group.select(*SERIES, "dow", "hour_local", c("p_free").alias("p_free_group"))), [*SERIES, "dow", "hour_local"], "left")  # cantons x classes x 168
    return add_weather(out, weather, kind, "arrival_utc")


def persistence() -> Column:
    return F.when(c("status_code") == 0, 0.95).otherwise(0.05)


def profile_probability() -> Column:
    return F.coalesce("p_free_evse", "p_free_group", F.lit(DEFAULT_FREE))


#: What the finer transition table is keyed by.
_FULL = ["status_code", "class_dc", "hour_bucket", "delta_min"]


def fit_markov(train: DataFrame, min_count: int = 50) -> tuple[DataFrame, DataFrame]:
    """(by status, class, four-hour bucket and delta where seen often enough; by status and delta): probabilities of being free."""
    own = train.withColumn("hour_bucket", F.floor(c("hour_local") / 4).cast("int"))
    full = own.groupBy(*_FULL).agg(F.avg("y").alias("p_full"), F.count(F.lit(1)).alias("_n")).filter(c("_n") >= min_count).drop("_n")
    return full, own.groupBy("status_code", "delta_min").agg(F.avg("y").alias("p_coarse"))


def predict_markov(df: DataFrame, table: tuple[DataFrame, DataFrame]) -> DataFrame:
    """df with p_markov. The tables have at most statuses x classes x buckets x deltas rows."""
    out = df.withColumn("hour_bucket", F.floor(c("hour_local") / 4).cast("int")).join(F.broadcast(table[0]), _FULL, "left").join(F.broadcast(table[1]), ["status_code", "delta_min"], "left")
    return out.withColumn("p_markov", F.coalesce("p_full", "p_coarse", F.lit(DEFAULT_FREE))).drop("p_full", "p_coarse", "hour_bucket")


def bins_of(p: Column, bins: int = 10) -> Column:
    """Equal bins from 0; 1 falls in the last."""
    return F.least(F.greatest(F.floor(p * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def calibration_table(df: DataFrame, y: str, p: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), bins_of(c(p), bins).alias("bin")).agg(F.avg(p).alias("p_mean"), F.avg(y).alias("y_mean"), F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """brier, logloss, auc, base_rate, n and ece by groups, with p held within 1e-4 of 0 and 1.

    Rows are reduced to one for each group and score, these to bins, and the bins to groups. The exact AUC comes from rank sums with
    ties shared; ranks of a group's distinct scores are worked out range by range (see `with_ranks`), so that a group may be the whole table.
    """
    by = by or []
    held = F.greatest(F.least(c(p), F.lit(1 - 1e-4)), F.lit(1e-4))
    score = df.groupBy(*by, held.alias("_p")).agg(F.sum(y).alias("_y"), F.count(F.lit(1)).alias("_n"))
    ranked = with_ranks(score, by, "_p").withColumn("_r", c("_before") + (c("_n") + 1) / 2)
    no = c("_n") - c("_y")
    binned = ranked.groupBy(*by, bins_of(c("_p"), bins).alias("_bin")).agg(
        F.sum("_n").alias("_n"), F.sum("_y").alias("_y"), F.sum(c("_n") * c("_p")).alias("_s"), F.sum(c("_r") * c("_y")).alias("_ry"),
        F.sum(c("_y") * F.pow(c("_p") - 1, 2) + no * F.pow("_p", 2)).alias("_b"), F.sum(-(c("_y") * F.log("_p") + no * F.log(1 - c("_p")))).alias("_l"),
    )
    n, pos = F.sum("_n"), F.sum("_y")
    return binned.groupBy(*by).agg(
        (F.sum("_b") / n).alias("brier"), (F.sum("_l") / n).alias("logloss"), ((F.sum("_ry") - pos * (pos + 1) / 2) / F.nullif(pos * (n - pos), F.lit(0))).alias("auc"),
        (pos / n).alias("base_rate"), n.alias("n"), (F.sum(F.abs(c("_s") - c("_y"))) / n).alias("ece"),
    )


def select_model(scores: DataFrame) -> DataFrame:
    """The model with the least Brier score. scores: model, brier."""
    return scores.agg(F.min_by("model", F.struct("brier", "model")).alias("selected"), F.min("brier").alias("brier"))


def active_models(registry: DataFrame) -> DataFrame:
    """The newest registered model of each task. registry: task, model, registered_at."""
    return registry.groupBy("task").agg(F.max(F.struct("registered_at", "model")).alias("_m")).select("task", "_m.model", "_m.registered_at")


def frame_fingerprint(df: DataFrame) -> DataFrame:
    """One row that tells a frame's content, whatever the order of its rows: count, sum and xor of row hashes."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(h).alias("parity"))


#: Names of the features, numbers first, then categories.
NUMERIC = ["lag0", "lag1", "lag2", "mean24", "y_tm24", "y_tm168", "profile", "h", "hour_local", "dow", "is_weekend", "is_holiday", "temp_c", "precip_mm", "snow_cm", "wind_kmh"]
NUMERIC_CATEGORIES = ["canton_code", "power_class"]
AVAILABILITY = ["status_code", "delta_min", "hour_local", "dow", "is_weekend", "is_holiday", "class_dc", "power_kw", "n_total_other", "n_free_other", "share_free_other", "p_free_evse", "p_free_group", "temp_c", "precip_mm", "snow_cm", "p_markov"]
AVAILABILITY_CATEGORIES = ["canton_code"]


def categories(train: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """The values of each column in order, by which they are numbered: cantons and classes, a few dozen."""
    return {x: sorted(r[0] for r in train.select(x).filter(c(x).isNotNull()).distinct().collect()) for x in columns}


def vectors(df: DataFrame, columns: list[str], known: dict[str, list[str]] | None = None, label: str = "y") -> DataFrame:
    """df with features and label; a missing value is 0 with a mark of its own, since trees take no gaps. known: values of categories,
    numbered from 1; a value that training hasn't seen is 0."""
    from pyspark.ml.feature import VectorAssembler

    filled = df.withColumns({f"_v_{x}": F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in columns} | {f"_m_{x}": c(x).isNull().cast("double") for x in columns}).withColumn("label", c(label).cast("double"))
    number = {f"_c_{x}": F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]).cast("array<string>"), c(x)), F.lit(0)).cast("double") for x, values in (known or {}).items()}
    names = [f"_v_{x}" for x in columns] + [f"_m_{x}" for x in columns] + list(number)
    return VectorAssembler(inputCols=names, outputCol="features").transform(filled.withColumns(number) if number else filled).drop(*names)


def fit_gbt_forecast(train: DataFrame, tail_days: int = 28, rounds: int = 50, seed: int = 42):
    """(values of the categories, boosted trees whose last days of targets decide when to stop)."""
    from pyspark.ml.regression import GBTRegressor

    known = categories(train, NUMERIC_CATEGORIES)
    last = train.agg(F.max("target_utc").alias("_last"))  # one row
    marked = train.join(F.broadcast(last)).withColumn("_valid", c("target_utc") > c("_last") - F.make_dt_interval(F.lit(tail_days)))
    return known, GBTRegressor(maxIter=rounds, maxDepth=4, seed=seed, validationIndicatorCol="_valid").fit(vectors(marked, NUMERIC, known))


def forecast(df: DataFrame, model) -> DataFrame:
    """df with p, held within 0 and 1."""
    known, trees = model
    return trees.transform(vectors(df, NUMERIC, known)).withColumn("p", F.greatest(F.least("prediction", F.lit(1.0)), F.lit(0.0))).drop("features", "prediction", "label")


def fit_gbt_availability(train: DataFrame, calib: DataFrame, rounds: int = 50, seed: int = 42):
    """(values of the categories, boosted trees that stop when the held-out rows gain no more, isotonic calibration on these rows)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    known = categories(train, AVAILABILITY_CATEGORIES)
    both = train.withColumn("_valid", F.lit(False)).unionByName(calib.withColumn("_valid", F.lit(True)))
    trees = GBTClassifier(maxIter=rounds, maxDepth=4, seed=seed, validationIndicatorCol="_valid").fit(vectors(both, AVAILABILITY, known))
    raw = trees.transform(vectors(calib, AVAILABILITY, known)).withColumn("raw", vector_to_array("probability")[1])
    return known, trees, IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw.select("raw", "label"))


def score_availability(df: DataFrame, model) -> DataFrame:
    """df with p_free of the calibrated trees, held within 0.001 and 0.999."""
    from pyspark.ml.functions import vector_to_array

    known, trees, isotonic = model
    raw = trees.transform(vectors(df, AVAILABILITY, known)).withColumn("raw", vector_to_array("probability")[1]).drop("prediction", "probability", "rawPrediction", "features")
    out = isotonic.transform(raw)
    return out.withColumn("p_free", F.greatest(F.least("prediction", F.lit(0.999)), F.lit(0.001))).drop("raw", "prediction", "label")


def importance(spark, model) -> DataFrame:
    """(feature, importance) of the boosted availability model: a value's, its mark's and its category's added up."""
    known, trees, _ = model
    names = AVAILABILITY * 2 + list(known)
    sums: dict[str, float] = {}
    for name, x in zip(names, trees.featureImportances.toArray().tolist()):
        sums[name] = sums.get(name, 0.0) + x
    return spark.createDataFrame(sorted(sums.items(), key=lambda kv: (-kv[1], kv[0])), "feature string, importance double")
