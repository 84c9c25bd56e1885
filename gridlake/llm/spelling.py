"""Words that differ by one code point, found in the sorted rotations of terminator-marked words.

Take a word as `a c b`, with c one code point. Its rotation from behind c is `b $ a c`; those of the words that have another code point
there begin alike, with `b $ a`, and the rotation `b $ a` of the word without c is that beginning itself. So every rotation is sorted
by what it has before its last code point, every word's whole rotations lie among them, and the words of one beginning are
near each other. There are no more of them than the alphabet has signs, and one: no group grows with the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import flat_text, mapped, staged

#: The signs of a run, code points of a word at least, occurrences at least, and how much more frequent a form is.
SIGNS, LEAST_LENGTH, LEAST_COUNT, TIMES = "A-Za-zÀ-ÿ", 7, 2, 10
#: One in so many occurrences loses a code point.
ONE_IN = 31
END = "$"
#: Code points up to which a word's rotations are written out; longer ones are told by sums modulo a prime, one for each base.
SPELT, PRIME = 64, (1 << 31) - 1
BASES = (1103515245, 69069, 1664525, 22695477)

ROTATION = "key binary, edited boolean, last boolean, id long, n long"


def occurrences(docs: DataFrame) -> DataFrame:
    """(word): every run of docs' texts that may become a word, A-Z in lower case, one code point less where its hash says so."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"([{SIGNS}]{{{LEAST_LENGTH},}})"), F.lit(1))).alias("run"))
    capitals = "".join(map(chr, range(65, 91)))
    runs = runs.select("doc", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", capitals, capitals.lower())).otherwise(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return hashed.select(F.when(F.col("h") % ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(id, word, n): the words, with ids that rise in the words' code-point order."""
    counts = occurrences(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = staged(counts.filter((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LENGTH)), "word-counts")
    return staged(words.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "words")


def _spelt_rotations(words: DataFrame) -> DataFrame:
    """The rotations of words, each without its last code point where that is the one edited, else whole."""
    size = F.length("word")
    from_ = lambda i: F.concat(F.substr("word", i), F.lit(END))
    sign = lambda i: F.substr("word", i, F.lit(1))
    edited = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(F.concat(from_(i + 1), F.substr("word", F.lit(1), i - 1)).alias("key"), F.lit(True).alias("edited"), (sign(i) != sign(i + 1)).alias("last")))
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.concat(from_(i + 1), F.substr("word", F.lit(1), i)).alias("key"), F.lit(False).alias("edited"), F.lit(False).alias("last")))
    rows = words.select("id", "n", F.explode(F.concat(edited, whole)).alias("r"))
    return rows.select(F.col("r.key").cast("binary").alias("key"), "r.edited", "r.last", "id", "n")


def _powers(base: int, n: int) -> np.ndarray:
    out, size = np.ones(max(n, 1), np.uint64), 1
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * np.uint64(pow(base, size, PRIME)) % np.uint64(PRIME)
        size += more
    return out


def rotation_sums(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a word of m code points: m keys of (before i, after i) and m+1 keys of (before i, from i on), each a row of bytes.

    A key is the length and, for each base, the sums of both sides with powers of the base, modulo PRIME, so that keys of different
    sides are equal with a chance of about (m / PRIME) ** 4. All of them take time in proportion to m.
    """
    m, p = len(code), np.uint64(PRIME)
    edited, whole = np.empty((m, 9), "<u4"), np.empty((m + 1, 9), "<u4")
    edited[:, 8], whole[:, 8] = m - 1, m
    for k, base in enumerate(BASES):
        up, down = _powers(base, m + 1), _powers(pow(base, -1, PRIME), m + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[:m] % p, dtype=np.uint64) % p))
        after = (sums[-1] + p - sums) % p * down % p
        edited[:, 2 * k], edited[:, 2 * k + 1] = sums[:-1], after[1:]
        whole[:, 2 * k], whole[:, 2 * k + 1] = sums, after
    return edited, whole


def _summed_rotations(batches, spelt: int):
    for batch in batches:
        flat, offsets = flat_text(batch.column(batch.schema.get_field_index("word")))
        for i, (number, n) in enumerate(zip(batch.column(batch.schema.get_field_index("id")).to_pylist(), batch.column(batch.schema.get_field_index("n")).to_pylist())):
            code = np.frombuffer(flat[offsets[i] : offsets[i + 1]].tobytes().decode().encode("utf-32-le"), np.uint32)
            edited, whole = rotation_sums(code)
            if len(code) == spelt:
                code, edited = code[:0], edited[:0]
            last = np.concatenate([code[1:] != code[:-1], np.ones(min(1, len(code)), bool), np.zeros(len(whole), bool)])
            keys, is_edited = np.concatenate([edited, whole]), np.arange(len(last)) < len(edited)
            for a in range(0, len(keys), 1 << 16):
                part = keys[a : a + (1 << 16)]
                own = pa.Array.from_buffers(pa.binary(36), len(part), [None, pa.py_buffer(np.ascontiguousarray(part).tobytes())]).cast(pa.binary())
                size = len(part)
                yield pa.RecordBatch.from_arrays([own, pa.array(is_edited[a : a + size]), pa.array(last[a : a + size]), pa.array(np.full(size, number)), pa.array(np.full(size, n))], names=["key", "edited", "last", "id", "n"])


def rotations(words: DataFrame) -> DataFrame:
    """(key, edited, last, id, n): for each word and code point the key without it, and for each place the key of the word whole.

    `last` is whether an edited code point differs from the next: of a run of equal ones, only the last is taken for inserted.
    Words of SPELT code points have whole keys of both kinds, so that they meet those with one more.
    """
    spelt, size = SPELT, F.length("word")
    return _spelt_rotations(words.filter(size <= spelt)).union(words.filter(size >= spelt).transform(mapped, lambda b: _summed_rotations(b, spelt), ROTATION))


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are near, and the most frequent of them as (less, id) with less = -n; words that have any.

    Two words with different code points at one place meet in one group only, as do a word and the same with one code point more, the
    latter by its `last` key. A group is looked at in order of frequency: each row needs its best other.
    """
    ranked = Window.partitionBy("key").orderBy(F.desc("edited"), F.desc("n"), "id")
    group = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct((-F.col("n")).alias("less"), "id")
    scanned = (
        rotations(words)
        .withColumn("n_edited", F.sum(F.col("edited").cast("long")).over(group))
        .withColumn("n_all", F.count(F.lit(1)).over(group))
        .withColumn("place", F.row_number().over(ranked))
        .withColumn("first", F.first(F.when(F.col("edited"), one)).over(ranked))
        .withColumn("next", F.lead(F.when(F.col("edited"), one)).over(ranked))
        .withColumn("whole", F.max(F.when(~F.col("edited"), one)).over(group))
        .withColumn("n_longer", F.sum(F.col("last").cast("long")).over(group))
        .withColumn("longer", F.min(F.when(F.col("last"), one)).over(group))
        .filter("n_all > 1")
    )
    shorter = F.col("last") & F.col("whole").isNotNull()
    other = F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("first"))
    best = F.when(F.col("edited"), F.least(other, F.when(shorter, F.col("whole")))).otherwise(F.col("longer"))
    n = F.when(F.col("edited"), F.col("n_edited") - 1 + F.when(shorter, 1).otherwise(0)).otherwise(F.col("n_longer"))
    told = scanned.select("id", n.alias("n_near"), best.alias("best")).filter("n_near > 0")
    return told.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs' texts.

    Null and empty texts have no words. A null doc_id hashes as an empty one. Repeated rows count one by one, ties of n go to the
    smaller word, no rows: no rows. Texts and words may be very long: rotations of long words are told by sums instead of spelt. Other
    columns than doc_id and text are not read. A form is TIMES as frequent as its word, so chains are short and pointers are doubled
    as often as the largest n allows.
    """
    words = vocabulary(docs)
    near = staged(words.join(near_words(words), "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= TIMES * F.col("n"), F.col("best.id")).alias("form_id")), "near-words")
    most = near.agg(F.max("n")).first()[0] or 1
    links = near.filter(F.col("form_id").isNotNull()).select("id", F.col("form_id").alias("to"))
    for _ in range(math.ceil(math.log2(max(1, math.floor(math.log10(most)))))):
        ahead = links.select(F.col("id").alias("to"), F.col("to").alias("further"))
        links = staged(links.join(ahead, "to", "left").select("id", F.coalesce("further", "to").alias("to")), "word-links")
    named = lambda own, name, *more: words.select(F.col("id").alias(own), F.col("word").alias(name), *more)
    whole = near.join(links.withColumnRenamed("to", "root_id"), "id", "left").join(named("form_id", "form", F.col("n").alias("form_n")), "form_id", "left").join(named("root_id", "root"), "root_id", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
