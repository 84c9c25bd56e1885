"""Writing month partitions, each replaced as a whole, and bucketed tables; rows in order of point and time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_month_partition(df: DataFrame, path: str, at: str = "slot_ts", key: str = "evse_id") -> None:
    """Write df by month; months it holds replace those below the path, others stay. Writing twice is writing once."""
    rows = df.withColumn("month", F.date_format(at, "yyyy-MM"))
    rows.repartition("month", key).sortWithinPartitions("month", key, at).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


#: Joins and windows on the point and more then take the buckets as they are.
CO_LOCATED = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def write_bucketed(df: DataFrame, path: str, buckets: int, key: str = "evse_id", at: str = "slot_ts", name: str | None = None) -> str:
    """A table at `path` in buckets of the key, each one file in the order of key and time; the table's name.

    What groups, windows or joins its rows by the key needs no exchange: episodes and profiles by point, and, with CO_LOCATED, joins of
    a point's slots with later ones. Buckets should be so many that one is a task's work.
    """
    name = name or f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).sortWithinPartitions(key, at).write.bucketBy(buckets, key).sortBy(key, at).format("parquet").option("path", path).mode("overwrite").saveAsTable(name)
    return name
