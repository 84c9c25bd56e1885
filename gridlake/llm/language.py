"""Language ID with n-gram filters that answer for all languages at once.

A bit-sliced Bloom filter is one array of 64-bit words: bit L of a slot belongs to language L's filter. An n-gram's
slots, combined by AND, give the set of all languages that hold it. A text's n-grams are counted for each language, the share
that the filter's false positives account for is taken off, and the largest rest decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, aside, chunks, in_test_part, least_hashed, mapped, mixed, put_back, schema_with, staged

#: Bytes of an n-gram; slots of the filter (a power of two) and probes for each n-gram.
GRAM, SLOTS, PROBES = 4, 1 << 20, 3

#: Parameters of the fit: labelled documents at most, and n-grams kept for each language.
SAMPLE_DOCS, GRAMS_KEPT = 40_000, 30_000

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # uint64 masks: a row of SLOTS for every 64 languages
    false_rate: np.ndarray  # of each language
    usual: int  # the most frequent language


def grams(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram inside a row as a number, and its row."""
    if len(flat) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    low = LOWER[flat].astype(np.uint32)
    n = len(low) - GRAM + 1
    value = low[:n].copy()
    for k in range(1, GRAM):
        value |= low[k : k + n] << np.uint32(8 * k)
    size = np.diff(offsets)
    rows = np.repeat(np.arange(len(size)), size)[:n]
    inside = np.arange(n) + GRAM <= offsets[1:][rows]
    return value[inside], rows[inside]


def probes(value: np.ndarray):
    h = mixed(value.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield ((h + np.uint64(k) * step) & np.uint64(SLOTS - 1)).astype(np.int64)


def sample_of(docs: DataFrame, label: str = "lang", sample: int = SAMPLE_DOCS) -> DataFrame:
    """lang, text of the labelled documents to learn from: outside the held-out part (crc32 of doc_id modulo 4 is 2), those with
    the `sample` least hashes of doc_id, all if there are fewer. Of rows that share an id (or have none) one is taken."""
    known = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull() & ~in_test_part(F.col("doc_id"), 4, 2))
    chosen = least_hashed(known.select("doc_id", F.col(label).cast("string").alias("lang"), "text"), sample, "doc_id")
    return chosen.groupBy("_h").agg(F.min(F.struct("lang", "text")).alias("one")).select("one.*")


def fit(docs: DataFrame, label: str = "lang", sample: int = SAMPLE_DOCS, kept: int = GRAMS_KEPT) -> Filters:
    """Filters from at most `sample` labelled documents (see sample_of), whose n-grams are counted by a shuffle.

    A language's filter gets the `kept` n-grams it has most often, without those more than twice as frequent elsewhere.
    """

    def count(batches):
        for batch in batches:
            for part, flat, offsets in chunks(batch):
                names, code = np.unique(np.array(part.column("lang").to_pylist(), dtype=str), return_inverse=True)
                value, rows = grams(flat, offsets)
                key, n = np.unique(value.astype(np.uint64) | (code[rows].astype(np.uint64) << np.uint64(32)), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[(key >> np.uint64(32)).astype(np.int64)], pa.string()), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )

    counts = sample_of(docs, label, sample).transform(mapped, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = staged(counts, "gram-counts")
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    totals = counts.sparkSession.createDataFrame(list(sizes.items()), "lang string, all long")
    rated = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("all"))
    most = F.max("rate").over(Window.partitionBy("gram"))
    own = rated.withColumn("most", most).filter("rate * 2 >= most and n > 1")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = own.withColumn("place", place).filter(F.col("place") <= kept).select("lang", "gram").toArrow()  # at most `kept` a language
    slots = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), np.uint64)
    names = np.array(best.column("lang").to_pylist(), dtype=object)
    value = best.column("gram").to_numpy().astype(np.uint32)
    false_rate = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        own_slots, bit = slots[i // 64], np.uint64(i % 64)
        for at in probes(value[names == lang]):
            np.bitwise_or.at(own_slots, at, np.uint64(1) << bit)
        false_rate[i] = np.mean((own_slots >> bit) & np.uint64(1)) ** PROBES
    usual = max(range(len(languages)), key=lambda i: (sizes[languages[i]], languages[i])) if languages else -1
    return Filters(languages, slots, false_rate, usual)


def decide(flat: np.ndarray, offsets: np.ndarray, f: Filters) -> tuple[list[str], np.ndarray]:
    n = len(offsets) - 1
    letters = np.zeros(n, bool)
    plain = ((LOWER[flat] >= 97) & (LOWER[flat] <= 122)).astype(np.int64)
    sums = np.concatenate(([0], np.cumsum(plain)))
    letters |= (sums[offsets[1:]] - sums[offsets[:-1]]) > 0
    for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)).tolist():
        letters[i] = _LETTER.search(flat[offsets[i] : offsets[i + 1]].tobytes().decode()) is not None
    if not f.languages:
        return ["und"] * n, np.zeros(n)
    value, rows = grams(flat, offsets)
    masks = np.full((len(f.slots), len(value)), np.uint64(2**64 - 1))
    for at in probes(value):
        masks &= f.slots[:, at]
    total = np.maximum(1, np.bincount(rows, minlength=n))
    rest = np.zeros((n, len(f.languages)))
    for i in range(len(f.languages)):
        found = np.bincount(rows, weights=((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.float64), minlength=n)
        rest[:, i] = np.clip((found / total - f.false_rate[i]) / (1 - f.false_rate[i]), 0, 1)
    best = np.where(rest.max(1) > 0, rest.argmax(1), f.usual)
    score = rest[np.arange(n), best] / np.maximum(rest.sum(1), 1e-12)
    names = [f.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())]
    return names, np.where(letters, np.clip(score, 0, 1), 0.0)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs' columns, lang_pred and score. `und`, score 0: null text, or no letter, or nothing learned.

    A text with letters but no n-gram of any language gets the most frequent language and score 0; on equal shares the
    first language by name wins. A column of docs with the name of a result (in any case) is not carried. Only text is
    looked at; equal rows are each told; no rows: no rows. A very long text is worked on whole.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    held = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS words of 8 bytes for every 64 languages

    def run(batches):
        f = held.value
        for batch in batches:
            for part, flat, offsets in chunks(batch):
                names, score = decide(flat, offsets, f)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(names, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return docs.select([F.col(f"`{c}`") for c in kept]).transform(mapped, run, schema_with(docs, kept, "lang_pred string, score double"))


def keep_known(docs: DataFrame) -> DataFrame:
    """docs, with all their columns as they are, without the rows that get no language: null texts, texts without a letter, and
    texts none of whose n-grams belong to a language beyond the share of false positives (a text too short for an n-gram stays).

    Learns from docs' own lang. Equal rows stay or go together; columns named lang_pred or score are carried; no rows: no rows.
    """
    found = identify(aside(docs, ["text"]), fit(docs.select("doc_id", "text", "lang")))
    strange = (F.col("score") == 0) & (F.octet_length("text") >= GRAM)
    return found.filter((F.col("lang_pred") != "und") & ~strange).select(put_back(found, docs.columns, ["text"]))
