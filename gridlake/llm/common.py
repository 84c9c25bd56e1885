"""What the text operators share: reading, staged tables, flat views of Arrow text, byte-level words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that a task works on at a time; numpy needs some tens of bytes for each.
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one, on a local master only."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps restart from the table, not from df's lineage.

    Tables of one application lie together, in a folder named by its id, which may go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the tables of staged frames that nothing reads any more: what was made of them is staged itself."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def aside(docs: DataFrame, own: list[str], **made: Column) -> DataFrame:
    """The columns `own` of docs, those made from docs, and all other columns of docs in one struct, `_rest`.

    So no name that an operator makes can meet a name of the user's; `put_back` undoes it.
    """
    others = [c for c in docs.columns if c not in own]
    rest = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("_rest")] if others else []
    return docs.select(*own, *rest, *[c.alias(name) for name, c in made.items()])


def put_back(df: DataFrame, columns: list[str], own: list[str]) -> list[Column]:
    """The user's columns in their order, from a frame that `aside` has made or one that comes of it."""
    return [F.col(c) if c in own else F.col(f"_rest.`{c}`").alias(c) for c in columns]


def schema_with(df: DataFrame, kept: list[str], more: str) -> StructType:
    """The fields `kept` of df and those of a list of names and types."""
    return StructType([df.schema[c] for c in kept] + StructType.fromDDL(more).fields)


def least_hashed(rows: DataFrame, n: int, by: str) -> DataFrame:
    """The rows whose hash of column `by` is among the n least, with the hash as `_h`: a sample that has n rows where there are
    so many, however large the table is.

    First the share of hashes that should hold 4 n rows is looked at, and more until it does hold n, so that no task sorts more.
    """
    rows = rows.withColumn("_h", F.xxhash64(by))
    total = rows.count()
    if total <= n:
        return rows
    share = 4 * n / total
    while share < 1:
        low = rows.filter(F.col("_h") <= int(share * 2.0**64) - 2**63)
        if low.count() >= n:
            break
        share *= 64
    else:
        low = rows
    edge = low.select("_h").orderBy("_h").limit(n).agg(F.max("_h")).first()[0]
    return rows.filter(F.col("_h") <= edge)


#: Rows that a worker gets at a time: documents may be long, and a batch is held on both sides.
BATCH_ROWS = 1000


def mapped(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """df.mapInArrow in batches of at most BATCH_ROWS rows: a session that allows larger ones is set to that, once."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def tasks_for(df_count: int, per_task: int, least: int = 12) -> int:
    return max(least, -(-int(df_count) // per_task))


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the rows' offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of about limit bytes each; a longer row stands alone, whole."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES):
    """(rows of the batch, their flat text, offsets) for pieces of bounded size."""
    flat, offsets = flat_text(batch.column(batch.schema.get_field_index(text)))
    for a, b in slices(offsets, limit):
        yield batch.slice(a, b - a), flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word for `[^\x20\x09-\x0D]+`; every byte of a code point over 127 counts.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of a word for `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def words_of(flat: np.ndarray, offsets: np.ndarray, member: np.ndarray):
    """Starts, ends and rows of the maximal runs of member bytes; no run crosses two rows."""
    if not len(flat):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = member[flat]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(flat))]
    begins[inner] = inside[inner]
    stops[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_UNBASE = pow(_BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "down" if inverse else "up"
    if len(_POWERS.get(key, ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        steps = np.full(size, _UNBASE if inverse else _BASE, np.uint64)
        steps[0] = 1
        _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[key][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def prefix_sums(flat: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[flat] * _powers(len(flat)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes and length, the same wherever the span stands."""
    raw = (sums[ends] - sums[starts]) * _powers(len(sums), inverse=True)[starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Masks of the lowest n bytes of eight.
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _eights(flat: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there on as a number; zeros after the end. A view of a padded copy, one byte from number to
    number."""
    return np.ndarray((len(flat) + 1,), "<u8", buffer=np.concatenate((flat, np.zeros(8, np.uint8))), strides=(1,))


def spans_differ(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether the bytes of each span of flat are others than those of its span of other."""
    size = ends - starts
    out = size != other_ends - other_starts
    same = np.flatnonzero(~out & (size > 0))
    if flat is other:
        same = same[starts[same] != other_starts[same]]
    # eight bytes at a time: the first of every span, the last of longer ones, and what lies between byte by byte
    mine = _eights(flat)
    theirs = mine if flat is other else _eights(other)
    long = size[same] > 8
    part = same[~long]
    out[part] = ((mine[starts[part]] ^ theirs[other_starts[part]]) & _LOW_BYTES[size[part]]) != 0
    part = same[long]
    out[part] = (mine[starts[part]] != theirs[other_starts[part]]) | (mine[ends[part] - 8] != theirs[other_ends[part] - 8])
    same = part[~out[part] & (size[part] > 16)]
    for a, b in slices(np.concatenate(([0], np.cumsum(size[same])))):
        part = same[a:b]
        unlike = flat[ragged(starts[part], size[part])] != other[ragged(other_starts[part], size[part])]
        if unlike.any():
            out[part] = np.logical_or.reduceat(unlike, np.cumsum(size[part]) - size[part])
    return out


def distinct_spans(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each kind, and each span's kind. Hashes sort the spans, bytes decide: different spans with one hash are two kinds."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, one, which = np.unique(span_hashes(prefix_sums(flat), starts, ends), return_index=True, return_inverse=True)
    unlike = np.flatnonzero(spans_differ(flat, starts, ends, flat, starts[one][which], ends[one][which]))
    if len(unlike):
        more: dict[bytes, int] = {}
        which = which.copy()
        for i in unlike.tolist():
            which[i] = len(one) + more.setdefault(flat[starts[i] : ends[i]].tobytes(), len(more))
        first = np.full(len(more), len(starts))
        np.minimum.at(first, which[unlike] - len(one), unlike)
        one = np.concatenate((one, first))
    return one, which


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of each piece, end to end."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(firsts - starts, counts)


def in_test_part(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves that remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))
