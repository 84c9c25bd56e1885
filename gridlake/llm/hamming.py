"""Exact top-k search in Hamming space by incremental multi-index hashing.

Codes are cut into segments; each segment's value is a key of the index. At segment radius r a query looks up all values
within r flips of its own segments. A code at distance d differs in at most d // segments bits of some segment, so after
radius r all codes at distances up to segments * (r + 1) - 1 have been met, and a query is done when its kth verified
distance is within that. Only queries that aren't done go on.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, staged

BITS = 64


def sign_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code): bit i of the code is set if component i of the first 64 is above 0. Rows without a vector have no code."""
    bits = [F.when(F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0)) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(BITS)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    return vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), code.alias("code"))


def segment_bits(codes: int) -> int:
    """About log2 of the number of codes, between 8 and 16 bits and a divisor of 64."""
    return 8 if codes < 1 << 12 else 16


def _segments(width: int):
    """Columns of the (segment, value) pairs of a code."""
    mask = (1 << width) - 1
    return F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned("code", i * width).bitwiseAND(F.lit(mask).cast("long")).cast("int").alias("value")) for i in range(BITS // width)])).alias("s")


def _probes(batches, width: int, radius: int):
    """Each query's (segment, value) at exactly `radius` flips."""
    masks = np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)
    for batch in batches:
        qid, code = batch.column("qid"), batch.column("code").to_numpy().view(np.uint64)
        for a in range(0, len(code), 256):
            own = code[a : a + 256]
            for seg in range(BITS // width):
                value = ((own >> np.uint64(seg * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
                n = len(masks)
                rows = np.repeat(np.arange(len(own)), n)
                yield pa.RecordBatch.from_arrays(
                    [qid.slice(a, 256).take(pa.array(rows)), pa.array(own[rows].view(np.int64)), pa.array(np.full(len(rows), seg, np.int32)), pa.array((value[:, None] ^ masks[None, :]).reshape(-1).astype(np.int32))],
                    names=["qid", "qcode", "seg", "value"],
                )


def top_k(vectors: DataFrame, k: int = 10, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k rows nearest to each row whose id is divisible by `every`, itself not among them.

    Ties go to the smaller id. Equal codes are searched once: of each code the k + 1 least ids can be among any query's answer,
    and only these are kept. Fewer than k other rows: all of them. Rows without a vector neither ask nor answer; repeated ids
    answer once. No rows: no rows.
    """
    rows = sign_codes(vectors, key, vector).groupBy("id").agg(F.min("code").alias("code"))
    rows = staged(rows, "codes")
    least = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    members = rows.withColumn("place", least).filter(F.col("place") <= k + 1).drop("place")
    sized = rows.groupBy("code").agg(F.count(F.lit(1)).alias("rows"))
    sized = staged(sized, "distinct-codes")
    n = sized.count()
    width = segment_bits(n)
    index = staged(sized.select("code", "rows", _segments(width)).select("code", "rows", "s.seg", "s.value"), "index")
    queries = rows.filter(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("code"))
    asking = staged(queries.select("code").distinct().select(F.col("code").alias("qid"), "code"), "asking")  # equal queries ask once
    met, done = None, None
    segments = BITS // width
    for radius in range(width + 1):
        found = (
            asking.transform(mapped, lambda b, r=radius: _probes(b, width, r), "qid long, qcode long, seg int, value int")
            .join(index.hint("merge"), ["seg", "value"])
            .select("qid", "code", "rows", F.bit_count(F.col("qcode").bitwiseXOR(F.col("code"))).cast("int").alias("distance"))
            .distinct()
        )
        now = found if met is None else met.join(asking.select("qid").hint("merge"), "qid", "left_semi").unionByName(found).distinct()
        # a code is needed if fewer than k + 1 rows are nearer: the query's own row is one of them
        nearer = F.coalesce(F.sum("rows").over(Window.partitionBy("qid").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        now = staged(now.withColumn("nearer", nearer).filter(F.col("nearer") <= k).drop("nearer"), "met")
        covered = segments * (radius + 1) - 1
        enough = now.filter(F.col("distance") <= covered).groupBy("qid").agg(F.sum("rows").alias("sure")).filter(F.col("sure") > k).select("qid")
        if radius == width:
            enough = asking.select("qid")
        ready = now.join(enough.hint("merge"), "qid", "left_semi")
        done = ready if done is None else done.unionByName(ready)
        asking = staged(asking.join(enough.hint("merge"), "qid", "left_anti"), "asking")
        met = now
        if not asking.limit(1).count():
            break
    pairs = done.select(F.col("qid").alias("asked"), "code", "distance").join(members.hint("merge"), "code")
    ranked = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    # equal query codes share one list; a list has k + 1 rows and those tied with the last by distance before members' cut
    lists = pairs.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy("distance", "id"))).filter(F.col("place") <= k + 1).drop("place")
    answers = queries.select(F.col("qid").alias("query_id"), F.col("code").alias("asked")).join(lists.hint("merge"), "asked").filter("query_id <> id")
    return (
        answers.select("query_id", F.col("id").alias("neighbour_id"), "distance")
        .withColumn("rank", F.row_number().over(ranked).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "neighbour_id", "distance")
    )
