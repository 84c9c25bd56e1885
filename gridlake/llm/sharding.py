"""Hierarchical weighted hash tree: place rows by weighted draws at region, rack and shard level.

At each level every child draws an exponential waiting time from a hash of the row's key and the child's name,
divided by the child's weight; the shortest wait wins. A child's draw depends on no other child, so a changed
weight moves rows only into or out of that child's subtree. New capacity joins as a region of its own: then all
other regions keep their draws and weights, and rows move only into the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


@dataclass(frozen=True)
class Node:
    """A subtree; leaves carry a shard number."""

    name: str
    weight: float
    shard: int | None = None
    children: tuple["Node", ...] = field(default=())


def tree_of(shards: int, built: int = 24, racks: int = 3, per_rack: int = 4) -> Node:
    """The topology for a number of shards: up to `built` of them in racks and regions, later ones each a region."""

    def leaf(s: int) -> Node:
        return Node(f"shard{s}", 1.0, s)

    def inner(name: str, kids: list[Node]) -> Node:
        return Node(name, sum(k.weight for k in kids), None, tuple(kids))

    first = [leaf(s) for s in range(min(built, shards))]
    rack = [inner(f"rack{i // per_rack}", first[i : i + per_rack]) for i in range(0, len(first), per_rack)]
    regions = [inner(f"region{i // racks}", rack[i : i + racks]) for i in range(0, len(rack), racks)]
    regions += [inner(f"grown{s}", [inner(f"grownrack{s}", [leaf(s)])]) for s in range(built, shards)]
    return inner("root", regions)


def wait(key: Column, name: Column, weight: Column) -> Column:
    """-ln(u)/weight, u in (0, 1) from 52 bits of the MD5 of the child's name and the key."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", name, key)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / weight


def descended(key: Column, parents: list[Node], at: Column) -> tuple[Column, list[Node]]:
    """One level down from parents[at]: the place of the winning child in the next level's list, and that list."""
    below = [c for p in parents for c in p.children]
    number = {id(c): i for i, c in enumerate(below)}
    rows = [F.array(*[F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight"), F.lit(number[id(c)]).alias("at")) for c in p.children]) for p in parents]
    draws = F.transform(F.array(*rows).getItem(at), lambda c: F.struct(wait(key, c["name"], c["weight"]).alias("wait"), c["at"].alias("at")))
    return F.array_min(draws).getField("at"), below


def place(df: DataFrame, shards: int = 24, key: str = "doc_id", into: str = "shard") -> DataFrame:
    """df with the column `into`, the shard of each row's key. A null key is placed as the text `null`. On equal waits the first child wins."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    level, out = [tree_of(shards)], df.withColumn(into, F.lit(0))
    while level[0].children:
        at, level = descended(name, level, F.col(into))
        out = out.withColumn(into, at)
    return out.withColumn(into, F.array(*[F.lit(n.shard) for n in level]).getItem(F.col(into)).cast("int"))


def shard_documents(docs: DataFrame, shards: int = 24, slot_buckets: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of documents.

    Law `key`: doc_id and the number of shards decide; with one more shard a row stays or goes to the new one.
    Slots are gapless within a shard: rows are numbered within (shard, bucket of doc_id), and a small table of bucket
    counts, of at most shards x slot_buckets rows, gives each bucket's first slot. That table is made from doc_id alone.
    Null text: size 8, checksum 0. Null doc_id: placed as `null`. Repeated rows each get a slot of their own. No rows: no rows.
    A text is only measured and summed, however long.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    bucket = (F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("long") % slot_buckets).cast("int")
    counts = place(docs.select("doc_id"), shards).groupBy("shard", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))

    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        bucket.alias("bucket"),
    )
    rows = place(place(rows, shards), shards + 1, into="grown_shard")
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("rank", F.row_number().over(within) - 1)
    # firsts has at most shards * slot_buckets rows of three numbers, whatever the input
    return numbered.join(F.broadcast(firsts), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"), "grown_shard"
    )
