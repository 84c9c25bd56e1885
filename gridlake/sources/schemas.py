"""What fields a feed of JSON records has, and since when: fingerprints of the records themselves, kept in a registry."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import field_paths
from .versioned import VersionedTable

REGISTRY = "source string, fields string, fields_hash string, first_seen timestamp, last_seen timestamp"


def feed_fingerprint(lines: DataFrame, source: str, seen_at: str, column: str = "value") -> DataFrame:
    """One row of REGISTRY for a load of JSON records, one a line, seen at a time.

    Records become variants, whose shapes are merged by partial aggregates: what travels is a shape for each task, and no schema is
    inferred before. A field that any record has counts, if null too; lines that are no JSON, or null, have none.
    """
    shape = lines.agg(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).first()["s"] or "VOID"
    kind = T.DataType.fromDDL(re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], shape))
    fields = ",".join(sorted(field_paths(kind)))
    row = lines.sparkSession.range(1).select(F.lit(source).alias("source"), F.lit(fields).alias("fields"), F.sha2(F.lit(fields), 256).alias("fields_hash"))
    return row.withColumns({"first_seen": F.lit(seen_at).cast("timestamp"), "last_seen": F.lit(seen_at).cast("timestamp")})


def registry(spark, path: str) -> VersionedTable:
    return VersionedTable(spark, path, "source")


def note(table: VersionedTable, found: DataFrame) -> bool:
    """Fold fingerprints into the registry: of one that is there, the times widen. Whether any is new to a source that is known."""

    def how(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy("source", "fields", "fields_hash").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))

    known = table.read() if table.version() else found.limit(0)
    fresh = found.join(known.select("source", "fields_hash"), ["source", "fields_hash"], "left_anti")
    drifted = bool(fresh.join(known.select("source"), "source", "left_semi").limit(1).count())
    table.merge(found, ["source"], how, moves=False)
    return drifted
