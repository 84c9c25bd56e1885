"""Disciplines for keyed tables: first row per key, upserts, bridges, quarantine splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; the order must tell all rows of a key apart."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def _paired(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key with structs `o` and `n`, null where a side has none; null keys are equal."""
    o = old.select(F.struct(*[F.col(k) for k in keys]).alias("_ok"), F.struct("*").alias("o"))
    n = new.select(F.struct(*[F.col(k) for k in keys]).alias("_nk"), F.struct("*").alias("n"))
    return o.join(n, F.col("_ok").eqNullSafe(F.col("_nk")), "full_outer")


def _unpacked(pairs: DataFrame, take_new: Column, columns: list[str]) -> DataFrame:
    return pairs.select(*[F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with their key."""
    return _unpacked(_paired(old, new, keys), F.col("n").isNotNull(), old.columns)


def upsert_if_changed(old: DataFrame, new: DataFrame, keys: list[str], digest: str, active: str) -> DataFrame:
    """As upsert, but a row stays as it is if its digest is the same and it is active."""
    changed = F.col("o").isNull() | ~F.col(f"o.{digest}").eqNullSafe(F.col(f"n.{digest}")) | ~F.coalesce(F.col(f"o.{active}"), F.lit(False))
    return _unpacked(_paired(old, new, keys), F.col("n").isNotNull() & changed, old.columns)


def upsert_with_priority(old: DataFrame, new: DataFrame, keys: list[str], source: str, strong: str) -> DataFrame:
    """As upsert, but a row of another source only gives way to the strong source."""
    may = F.col("o").isNull() | F.col(f"o.{source}").eqNullSafe(F.col(f"n.{source}")) | (F.col(f"n.{source}") == strong)
    return _unpacked(_paired(old, new, keys), F.col("n").isNotNull() & may, old.columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(old.columns))


def replace_bridge(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """For owners that new speaks of, exactly its rows; all other rows stay."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new.select(old.columns).distinct())


def replace_range(old: DataFrame, new: DataFrame, inside: Column) -> DataFrame:
    """old without the rows inside the range, and new."""
    return old.filter(~F.coalesce(inside, F.lit(False))).unionByName(new.select(old.columns))


def split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, quarantine records: the row as JSON and the reason)."""
    told = df.withColumn("_reason", reason)
    bad = told.filter("_reason is not null").select(F.to_json(F.struct(*df.columns)).alias("record"), F.col("_reason").alias("reason"))
    return told.filter("_reason is null").drop("_reason"), bad
