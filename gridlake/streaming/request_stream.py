"""Recommendations for requests as they come: each micro-batch against the points' tables and the newest statuses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import recommend
from ..session import scratch
from .status_stream import drained


def recommendations(requests: DataFrame, tables: dict[str, DataFrame], chances: tuple[DataFrame, DataFrame], newest: Callable[[], DataFrame], top_n: int = recommend.TOP, place: str | None = None) -> DataFrame:
    """The ranked stations of a stream of requests, as recommend_batch gives them, with n_total, n_free_now and n_known of each.

    newest: gives (evse_id, status) of the newest slot. It is asked once in every micro-batch, so that answers tell what is known
    when they are given. A batch is run again as a whole after a failure and overwrites what it wrote; with the same place a
    later run goes on with the requests that are not answered.
    """
    spark = requests.sparkSession
    place = place or scratch(spark, "answers")
    out = f"{place}/answers"

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # looked at for its number and for each radius; it is one micro-batch
        state = recommend.station_state(tables["point"], newest())
        recommend.recommend_batch(batch, tables, chances, top_n, state).drop("ac_max_kw", "dc_max_kw").write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.unpersist()

    drained(requests, handle, place)
    return spark.read.parquet(out).drop("batch").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("n_total", "n_free_now", "n_known")})
