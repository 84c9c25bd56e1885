"""What each of five filters removes under every order in which they may be applied.

A document is no more than the mask of the filters it fails. Orders stand in lexicographic order, numbered by their Lehmer code; those
that share a prefix are an interval of numbers. The documents of a mask leave at the step whose filter is the first of the mask, so
for every prefix without a letter of the mask, followed by one of it, they leave over one interval. Counts are added where intervals
begin, taken off where they end, and running sums over the 120 numbers give every order at once.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

LETTERS = "ABCDE"
STEPS = len(LETTERS)
ORDERS = factorial(STEPS)

#: Fixed limits: words at least, percent of distinct words at least, percent of capitals at most; signs that no text may hold.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 50, 65, 5, "[#$%&*|]"


def order_at(rank: int) -> str:
    """The order whose Lehmer code has this value: its digits in the factorial base choose among the letters left."""
    left, out = list(LETTERS), ""
    for size in range(STEPS - 1, -1, -1):
        digit, rank = divmod(rank, factorial(size))
        out += left.pop(digit)
    return out


def rank_of(order: str) -> int:
    """The Lehmer code's value: at each place, the letters after it that are smaller, times the orders of the places after it."""
    return sum(sum(b < a for b in order[i + 1 :]) * factorial(STEPS - 1 - i) for i, a in enumerate(order))


def removal_intervals(mask: int) -> list[tuple[int, int, int]]:
    """(step, first rank, rank after the last) at which documents of this mask leave; intervals of a step that touch are one."""
    found: list[tuple[int, int, int]] = []

    def descend(prefix: str, left: str) -> None:
        for letter in left:
            rest = left.replace(letter, "")
            if mask >> LETTERS.index(letter) & 1:
                first = rank_of(prefix + letter + rest)
                found.append((len(prefix) + 1, first, first + factorial(len(rest))))
            else:
                descend(prefix + letter, rest)

    descend("", LETTERS)
    merged: list[tuple[int, int, int]] = []
    for step, first, end in sorted(found):
        if merged and merged[-1][0] == step and merged[-1][2] == first:
            first = merged.pop()[1]
        merged.append((step, first, end))
    return merged


def own_failures(text: Column) -> Column:
    """The mask of filters A to D: bit i for the i-th letter."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    fails = [n < LEAST_WORDS, 100 * kinds < LEAST_DISTINCT * n, 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"), text.rlike(SIGNS)]
    mask = F.lit(0)
    for i, failed in enumerate(fails):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    return mask


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, and those labelled so.

    Rows are grouped before every join, so that no text, source or id may weigh on one task: the first of equal texts is looked up by
    (text's SHA-256, id), labels by id, of which a part has no more than 32 rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("string")
    narrow = staged(docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), own_failures(F.col("text")).alias("own")), "filter-masks")
    first = narrow.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("is_first")).filter(F.col("doc_id").isNotNull())
    rows = narrow.filter(F.col("doc_id").isNotNull()).groupBy("doc_id", "sha", "part", "own").agg(F.count(F.lit(1)).alias("n"))
    mask = (F.col("own") + F.when(F.col("is_first"), 0).otherwise(1 << LETTERS.index("E"))).alias("mask")
    masked = rows.join(first, ["doc_id", "sha"], "left").groupBy("doc_id", "part", mask).agg(F.sum("n").alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = masked.join(marks, "doc_id", "left").select("part", "mask", "n", (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    nameless = narrow.filter(F.col("doc_id").isNull()).groupBy("part", F.col("own").alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    both = known.unionByName(nameless.select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic")))
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit_orders(masks: DataFrame) -> DataFrame:
    """One row per part, order and step, from (part, mask, n, good, toxic)."""
    spark = masks.sparkSession
    # fixed tables: the 587 intervals of the 31 masks that fail something, and the 120 orders
    ends = [(m, step, rank, sign) for m in range(1, 1 << STEPS) for step, first, end in removal_intervals(m) for rank, sign in ((first, 1), (end, -1))]
    ends = F.broadcast(spark.createDataFrame(ends, "mask int, step int, rank int, sign int"))
    orders = F.broadcast(spark.createDataFrame([(rank, s + 1, order_at(rank), letter) for rank in range(ORDERS) for s, letter in enumerate(order_at(rank))], "rank int, step int, filter_order string, letter string"))
    bit = lambda i: F.col("mask").bitwiseAND(1 << i) > 0
    of_letter = lambda name, test: F.map_from_arrays(F.array(*map(F.lit, LETTERS)), F.array(*[F.sum(F.when(test(i), F.col("n")).otherwise(0)) for i in range(STEPS)])).alias(name)
    parts = masks.groupBy("part").agg(F.sum("n").alias("total"), of_letter("failing", bit), of_letter("alone", lambda i: F.col("mask") == 1 << i))
    every = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("rank"))
    none = every.select("part", "step", "rank", *[F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")])
    changes = masks.join(ends, "mask").filter(F.col("rank") < ORDERS).select("part", "step", "rank", *[(F.col("sign") * F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    edges = changes.unionByName(none).repartition("part").groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # 120 rows
    gone = edges.select("part", "step", "rank", F.sum("n").over(along).alias("removed"), F.sum("good").over(along).alias("good_lost"), F.sum("toxic").over(along).alias("toxic_lost"))
    named = gone.join(orders, ["rank", "step"])
    steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # 5 rows
    sums = named.withColumn("out", F.sum("removed").over(steps)).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))
    return sums.join(parts, "part").select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.col("out")).alias("kept"),
        "removed",
        (F.col("failing")[F.col("letter")] - F.col("removed")).alias("redundant"),
        F.col("alone")[F.col("letter")].alias("unique_fails"),
        "good_lost",
        "toxic_lost",
        "shapley",
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each source.

    Null and empty texts are one text, which fails A and, after its first document, E. A text fails E if a row of any part has the same
    text and a smaller doc_id: rows that share the smallest id all pass, and a null id is neither smaller nor larger, so it passes and
    has no label. A document is good (toxic) if any label of its id says so; null labels say nothing. Null and empty sources are one
    part. Repeated rows count one by one; no rows: no rows. A very long text is looked at whole. Other columns are not read.
    """
    return audit_orders(staged(mask_counts(docs, labels), "filter-counts"))
