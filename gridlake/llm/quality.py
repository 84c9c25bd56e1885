"""Quality scores: n-gram indicators scaled by class log-count ratios, and a linear model fitted by dual coordinate descent.

Tokens are runs of word bytes and runs of signs; features are the tokens, their pairs, and that a token follows itself, told by hash,
once a document. Each is scaled by the log of how much more of the good documents' features it is than of the others', and rows are
brought to length 1. The hinge loss is minimized in its dual: a row's own variable is set to its optimum given all others, row after
row. Blocks of rows do so side by side from the same weights, each as if all blocks moved as it does, so that their changes may be
added; a round is one pass. Rows stream through a block: it holds weights, and no rows but those of a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, NOT_SPACE, chunks, flat_text, in_test_part, least_hashed, mapped, mixed, prefix_sums, schema_with, span_hashes, staged

#: Parameters of the fit: labelled documents at most, added counts, cost of a row of either class on average, passes, blocks of a pass.
SAMPLE_DOCS, ADDED, COST, ROUNDS, BLOCKS = 40_000, 1.0, 1.0, 12, 6
#: Features are told by so many bits of their hash.
BITS = 21
#: One in so many labelled rows is not fitted but used to turn margins into chances.
CALIBRATED = 5
#: The hash of a token that follows itself, whichever it is.
AGAIN = np.uint64(0x5BD1E9955BD1E995)
GOOD = 0.7

_KIND = np.zeros(256, np.uint8)
_KIND[NOT_SPACE] = 2
_KIND[ALNUM[LOWER]] = 1

FEATURES = "row long, label int, features binary"


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratio of each feature
    weight: np.ndarray  # of the scaled feature
    bias: float
    slope: float  # of the chance's logit by the margin
    shift: float

    def margins(self, features: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        scaled = self.ratio[features]
        size = np.sqrt(np.bincount(rows, weights=scaled * scaled, minlength=n))
        return np.bincount(rows, weights=scaled * self.weight[features], minlength=n) / np.where(size > 0, size, 1.0) + self.bias

    def chances(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def features_of(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each row, and their rows, in order."""
    kind = _KIND[flat]
    begins = np.ones(len(flat), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[offsets[:-1][offsets[:-1] < len(flat)]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(flat))
    token = kind[starts] > 0
    starts, ends = starts[token], ends[token]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    code = span_hashes(prefix_sums(flat), starts, ends)
    pair = mixed(code[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[1:])
    together = rows[:-1] == rows[1:]
    again = together & (code[:-1] == code[1:])
    place = np.concatenate([code, pair[together], np.full(int(again.sum()), AGAIN)]) >> np.uint64(64 - BITS)
    key = np.unique((np.concatenate([rows, rows[:-1][together], rows[:-1][again]]) << BITS) | place.astype(np.int64))
    return key & ((1 << BITS) - 1), key >> BITS


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """row, label, text of at most `sample` documents: those with the least hashes of doc_id among the ids with a label 0 or 1
    outside the held-out part (crc32 of doc_id modulo 4 is 2). Ids with both labels are left out; of rows that share an id, one is
    taken; null texts are empty."""
    ids = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_test_part(F.col("doc_id"), 4, 2))
    ids = ids.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).filter("label = other").select("doc_id", "label")
    chosen = F.broadcast(least_hashed(ids, sample, "doc_id").select("doc_id", "label"))  # at most `sample`, and ties of the last hash
    found = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(chosen, "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").cast("int").alias("label")).select(F.xxhash64("doc_id").alias("row"), "label", "text")


def _featured(batches):
    for batch in batches:
        for part, flat, offsets in chunks(batch):
            value, rows = features_of(flat, offsets)
            to = np.searchsorted(rows, np.arange(len(part) + 1)).astype(np.int32) * 4
            packed = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(to.tobytes()), pa.py_buffer(value.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("label"), packed], names=["row", "label", "features"])


TOLD = "kind string, at binary, value binary"


#: How places and numbers of each kind travel: features are counted and weighed in four bytes.
WIDE, NARROW = ("<i8", "<f8"), ("<i4", "<f4")
KINDS = {"good": NARROW, "bad": NARROW, "weight": NARROW, "bias": WIDE, "dual": WIDE}


def _told(kind: str, at: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """One row: numbers by their places, as bytes."""
    packed = [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip((at, value), KINDS[kind])]
    return pa.RecordBatch.from_arrays([pa.array([kind]), *packed], names=["kind", "at", "value"])


def _gathered(told: DataFrame):
    """(kind, places, numbers) of each block; no more than the features' number or the sample's rows from each."""
    for r in told.collect():
        yield r["kind"], *[np.frombuffer(r[x], t) for x, t in zip(("at", "value"), KINDS[r["kind"]])]


def _row_features(batch: pa.RecordBatch):
    flat, offsets = flat_text(batch.column(batch.schema.get_field_index("features")))
    return flat.view("<u4"), offsets // 4


def log_count_ratios(rows: DataFrame) -> np.ndarray:
    """Of each feature: log of its share among the good rows' features over that among the others'; 0 for one never seen."""

    def count(batches):
        good, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for batch in batches:
            value, offsets = _row_features(batch)
            label = np.repeat(batch.column(batch.schema.get_field_index("label")).to_numpy(), np.diff(offsets))
            np.add.at(good, value[label == 1], 1.0)
            np.add.at(bad, value[label == 0], 1.0)
        for kind, counts in (("good", good), ("bad", bad)):
            at = np.flatnonzero(counts)
            yield _told(kind, at, counts[at])

    sums = {"good": np.zeros(1 << BITS), "bad": np.zeros(1 << BITS)}
    for kind, at, counts in _gathered(rows.coalesce(BLOCKS).transform(mapped, count, TOLD)):
        sums[kind][at] += counts
    good, bad = sums["good"], sums["bad"]
    seen = good + bad > 0
    kinds = max(1, int(seen.sum()))
    ratio = np.log((good + ADDED) / (good.sum() + ADDED * kinds)) - np.log((bad + ADDED) / (bad.sum() + ADDED * kinds))
    return np.where(seen, ratio, 0.0).astype(np.float32)


def _pass(batches, ratio: np.ndarray, weight: np.ndarray, bias: float, known: np.ndarray, dual: np.ndarray, cost: dict[int, float], blocks: int):
    """One pass of coordinate descent over a block's rows: their new variables, and what the weights change by."""
    own, own_bias = weight.astype(np.float64), bias
    numbers, values = [], []
    for batch in batches:
        flat, offsets = _row_features(batch)
        row = batch.column(batch.schema.get_field_index("row")).to_numpy()
        label = batch.column(batch.schema.get_field_index("label")).to_numpy()
        at = np.minimum(np.searchsorted(known, row), max(0, len(known) - 1))
        start = np.where(known[at] == row, dual[at], 0.0) if len(known) else np.zeros(len(row))
        for i in range(len(row)):
            f = flat[offsets[i] : offsets[i + 1]]
            x = ratio[f].astype(np.float64)
            size = np.sqrt(x @ x)
            x = x / size if size > 0 else x
            y = 1.0 if label[i] == 1 else -1.0
            slope = y * (own[f] @ x + own_bias) - 1.0
            new = min(max(start[i] - slope / (blocks * (1.0 + (size > 0))), 0.0), cost[int(label[i])])
            step = blocks * (new - start[i]) * y
            if step:
                own[f] += step * x
                own_bias += step
            values.append(new)
        numbers.append(row)
    own = (own - weight) / blocks
    at = np.flatnonzero(own)
    yield _told("weight", at, own[at])
    yield _told("bias", np.zeros(1), np.array([(own_bias - bias) / blocks]))
    if numbers:
        yield _told("dual", np.concatenate(numbers), np.array(values))


def descend(rows: DataFrame, ratio: np.ndarray, sizes: dict[int, int], rounds: int = ROUNDS, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the bias, after `rounds` passes. Both classes weigh the same."""
    sc = rows.sparkSession.sparkContext
    total = sum(sizes.values())
    costs = {label: cost * total / (2 * n) for label, n in sizes.items()}
    ratios, weight, bias = sc.broadcast(ratio), np.zeros(1 << BITS), 0.0
    known, dual = np.zeros(0, np.int64), np.zeros(0)
    blocks = rows.coalesce(BLOCKS)
    for _ in range(rounds):
        now = sc.broadcast((weight.astype(np.float32), bias, known, dual))
        duals = []
        for kind, at, value in _gathered(blocks.transform(mapped, lambda b: _pass(b, ratios.value, *now.value, costs, BLOCKS), TOLD)):
            if kind == "weight":
                weight[at] += value
            elif kind == "bias":
                bias += float(value[0])
            else:
                duals.append((at, value))
        known, dual = (np.concatenate(x) for x in zip(*duals)) if duals else (known, dual)
        order = np.argsort(known)
        known, dual = known[order], dual[order]
        now.destroy()
    return weight.astype(np.float32), float(bias)


def calibrated(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through smoothed labels, by Newton's method."""
    good = int(label.sum())
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (len(label) - good + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        w, d = p * (1 - p) + 1e-9, p - target
        haa, hab, hbb = (w * margin * margin).sum() + 1e-6, (w * margin).sum(), w.sum() + 1e-6
        ga, gb = (d * margin).sum(), d.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        length = max(1.0, abs(da) / 5, abs(db) / 5)
        a, b = a - da / length, b - db / length
        if abs(da) + abs(db) < 1e-9:
            break
    return (a, b) if a > 0 else (0.0, float(np.log((good + 1) / (len(label) - good + 1))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model:
    """The model of at most `sample` labelled documents (see `labelled`). Without documents of both classes every text gets the
    share of good ones among those there are, smoothed."""
    rows = staged(labelled(docs, labels, sample).repartition(BLOCKS, "row").sortWithinPartitions("row").transform(mapped, _featured, FEATURES), "quality-features")
    part = F.when(F.pmod("row", F.lit(CALIBRATED)) == 0, "curve").otherwise("fit")
    sizes = {(r["part"], r["label"]): r["count"] for r in rows.groupBy(part.alias("part"), "label").count().collect()}
    n = lambda which, label: sizes.get((which, label), 0)
    good, bad = (n("fit", k) + n("curve", k) for k in (1, 0))
    if not n("fit", 1) or not n("fit", 0):
        none = np.zeros(1 << BITS, np.float32)
        return Model(none, none, 0.0, 0.0, float(np.log((good + 1) / (bad + 1))))
    fitted = rows.filter(part == "fit")
    ratio = log_count_ratios(fitted)
    weight, bias = descend(fitted, ratio, {k: n("fit", k) for k in (0, 1)}, rounds)
    model = Model(ratio, weight, bias, 1.0, 0.0)
    judged = rows.filter(part == "curve") if n("curve", 1) and n("curve", 0) else rows
    held = rows.sparkSession.sparkContext.broadcast(model)

    def margins(batches):
        for batch in batches:
            flat, offsets = _row_features(batch)
            of = np.repeat(np.arange(len(batch)), np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("label")), pa.array(held.value.margins(flat, of, len(batch)))], names=["label", "margin"])

    seen = judged.transform(mapped, margins, "label int, margin double").toArrow()  # numbers for the rows of the sample
    model.slope, model.shift = calibrated(seen.column("margin").to_numpy(), seen.column("label").to_numpy())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns, score (0 to 1, higher: good is likelier) and predicted (1 from GOOD on).

    Null, empty and blank texts have no features and get the score of the bias. Only text is looked at: equal texts have equal scores;
    no rows: no rows. A column of docs with the name of a result (in any case) is not carried. A very long text is worked on whole, in
    memory of some tens of bytes for each of its own.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    held = docs.sparkSession.sparkContext.broadcast(model)  # two numbers for each of 2 ** BITS features

    def run(batches):
        for batch in batches:
            for part, flat, offsets in chunks(batch):
                value = held.value.chances(held.value.margins(*features_of(flat, offsets), len(part)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(value), pa.array((value >= GOOD).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.select([F.col(f"`{c}`") for c in kept]).transform(mapped, run, schema_with(docs, kept, "score double, predicted int"))
