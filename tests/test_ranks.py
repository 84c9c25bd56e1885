"""Ranks by ranges against plain ones, and metrics of one group with a million distinct scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.operators import features, ranks


def test_ranks_and_medians_of_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(rng.integers(0, 40)) / 4) for g, n in (("a", 400), ("b", 7), (None, 50), ("c", 1)) for _ in range(n)] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    counts = df.filter("x is not null").groupBy("g", "x").agg(F.count(F.lit(1)).alias("_n"))
    of = {}
    for g, x in rows:
        if x is not None:
            of.setdefault(g, []).append(x)
    for r in ranks.with_ranks(counts, ["g"], "x").collect():
        assert (r["_before"], r["_all"]) == (sum(x < r["x"] for x in of[r["g"]]), len(of[r["g"]]))
    assert {r["g"]: r["median"] for r in ranks.medians(df, ["g"], "x").collect()} == {g: pytest.approx(float(np.median(x))) for g, x in of.items()}
    assert ranks.medians(df, [], "x").first()[0] == pytest.approx(float(np.median([x for _, x in rows if x is not None])))
    assert ranks.medians(df.limit(0), ["g"], "x").count() == 0


def test_auc_of_a_million_distinct_scores_in_one_group(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("pmod(id * 7919, 1000003) / 1000003d as p", "cast(pmod(hash(id), 1000) < 1000 * (pmod(id * 7919, 1000003) / 1000003d) as int) as y")
    found = features.classification_metrics(df, "y", "p")
    windows = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in line]
    assert windows and all("[_range#" in line for line in windows if "_p#" in line)  # the other is over one row for each range
    rows = df.toPandas()
    p, y = rows["p"].clip(1e-4, 1 - 1e-4).to_numpy(), rows["y"].to_numpy()
    values, where, count = np.unique(p, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count + (count + 1) / 2)[where]
    pos = y.sum()
    r = found.first()
    assert r["n"] == n and r["auc"] == pytest.approx((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos)), abs=1e-9)
    assert r["brier"] == pytest.approx(((p - y) ** 2).mean(), abs=1e-9)
