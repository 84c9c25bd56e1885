"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of a run of documents form a small corpus of byte symbols. An inverted index holds, for every
token that a neighbouring pair would form, the (word, place) positions of such pairs. Merges are replayed in rank
order: the lowest rank that the index holds is applied at all its positions, and only the neighbours of a merged pair
get new entries. What is learned about a pre-token is kept for later runs, up to KEPT of them.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mapped, ragged, schema_with
from .pretokens import numbered

#: Pre-tokens whose ids a worker remembers; beyond that it forgets the later half.
KEPT = 300_000

#: Bytes of text for one run.
RUN_BYTES = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 token and rank lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Ranks:
    """Token ranks, and the rank that each neighbouring pair of tokens would form."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs: dict[int, int] = {}  # left << 32 | right to rank
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.byte = [ranks[bytes([b])] for b in range(256)]


def replay(words: list[bytes], r: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words end to end, and how many each has."""
    byte, pair_rank = r.byte, r.pairs.get
    symbols: list[int] = []  # the words' tokens end to end, a -1 after each word
    for word in words:
        symbols += [byte[b] for b in word]
        symbols.append(-1)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    index: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(zip(symbols, symbols[1:])):
        rank = pair_rank(a << 32 | b) if a >= 0 and b >= 0 else None
        if rank is not None:
            index.setdefault(rank, []).append(i)
    waiting = list(index)
    heapify(waiting)
    gone = -2
    while waiting:
        rank = heappop(waiting)
        places = index.pop(rank)
        places.sort()
        stop = -1  # places up to here belong to a word that must do a lower rank first
        later: list[int] = []
        for i in places:
            a = symbols[i]
            if a < 0:
                continue
            j = after[i]
            b = symbols[j]
            if b < 0 or pair_rank(a << 32 | b) != rank:
                continue  # a neighbour has merged since
            if i < stop:
                later.append(i)
                continue
            symbols[i], symbols[j] = rank, gone
            k = after[i] = after[j]
            before[k] = i
            lower = False
            c = symbols[k]
            if c >= 0 and (new := pair_rank(rank << 32 | c)) is not None:
                if new in index:
                    index[new].append(i)
                else:
                    index[new] = [i]
                    heappush(waiting, new)
                lower = new <= rank
            h = before[i]
            if h >= 0 and (c := symbols[h]) >= 0 and (new := pair_rank(c << 32 | rank)) is not None:
                if new in index:
                    index[new].append(h)
                else:
                    index[new] = [h]
                    heappush(waiting, new)
                lower = lower or new <= rank
            if lower:
                stop = symbols.index(-1, i)
        if later:
            if rank in index:
                index[rank] += later
            else:
                index[rank] = later
                heappush(waiting, rank)
    left = np.array(symbols, np.int64)
    left = left[left != gone]
    ends = np.flatnonzero(left == -1)
    return left[left >= 0].astype(np.int32), np.diff(np.append(-1, ends)) - 1


class Encoder:
    """Ids of texts, with the ragged table of the pre-tokens seen so far."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = Ranks(ranks)
        self.seen: dict[bytes, int] = {}
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def shorten(self, keep: int) -> None:
        """Forget all but the pre-tokens seen first, among which the frequent ones are."""
        self.seen = dict(islice(self.seen.items(), keep))
        self.ids, self.at = self.ids[: self.at[keep]].copy(), self.at[: keep + 1].copy()

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the rows' offsets."""
        if len(self.seen) > KEPT:
            self.shorten(KEPT // 2)
        done = len(self.seen)
        word, counts = numbered(flat, offsets, self.seen)
        if len(self.seen) > done:
            ids, sizes = replay(list(islice(self.seen, done, None)), self.ranks)
            self.ids = np.concatenate((self.ids, ids))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(sizes)))
        size = self.at[word + 1] - self.at[word]
        ends = np.concatenate(([0], np.cumsum(size)))
        rows = np.concatenate(([0], np.cumsum(counts)))
        return self.ids[ragged(self.at[word], size)] if len(word) else np.zeros(0, np.int32), ends[rows]


_ENCODERS: dict[str, Encoder] = {}


def encode(docs: DataFrame, ranks_path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs' columns and `into`, the token ids of each text (array<int>), special tokens being ordinary text.

    Null text has no ids. A column named `into` is replaced. ranks_path is read by the tasks: it lies in an installed package.
    """
    kept = [c for c in docs.columns if c != into]

    def run(batches):
        encoder = _ENCODERS.get(ranks_path)
        if encoder is None:
            encoder = _ENCODERS[ranks_path] = Encoder(read_ranks(ranks_path))
        for batch in batches:
            for part, flat, offsets in chunks(batch, text, RUN_BYTES):
                ids, at = encoder.encode(flat, offsets)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], lists], names=[*kept, into])

    return docs.select([F.col(f"`{c}`") for c in kept]).transform(mapped, run, schema_with(docs, kept, f"`{into}` array<int>"))


class Decoder:
    """Bytes of ids, from one flat table of all tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks, key=ranks.get)
        number = np.array([ranks[t] for t in tokens], np.int64)
        length = np.array([len(t) for t in tokens], np.int64)
        self.size = np.zeros(int(number.max()) + 1, np.int64)
        self.size[number] = length
        self.begin = np.zeros_like(self.size)
        self.begin[number] = np.cumsum(length) - length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The rows' bytes; offsets are those of the rows' ids."""
        ids = ids.astype(np.int64)
        size = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))[offsets]
        data = self.flat[ragged(self.begin[ids], size)] if len(ids) else np.zeros(0, np.uint8)
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded's columns and `into`, the bytes (binary) that the ids stand for. Null or no ids: no bytes."""
    kept = [c for c in encoded.columns if c != into]

    def run(batches):
        decoder = Decoder(read_ranks(ranks_path))
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            for a in range(0, len(batch), 256):
                part = lists.slice(a, 256)
                at = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))))
                out = decoder.decode(part.flatten().to_numpy(zero_copy_only=False), at)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, 256) for c in kept], out], names=[*kept, into])

    return encoded.select([F.col(f"`{c}`") for c in kept]).transform(mapped, run, schema_with(encoded, kept, f"`{into}` binary"))


def encode_and_decode(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """docs' columns, `ids` and `decoded`: as encode and then decode, in one worker instead of two.

    Null and empty texts have no ids and no bytes; no rows: no rows; equal rows are each encoded; a text is encoded whole. A column of
    docs named ids or decoded (in any case) is not carried.
    """
    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]

    def run(batches):
        encoder = _ENCODERS.get(ranks_path)
        if encoder is None:
            encoder = _ENCODERS[ranks_path] = Encoder(read_ranks(ranks_path))
        decoder = Decoder(encoder.ranks.ranks)
        for batch in batches:
            for part, flat, offsets in chunks(batch, text, RUN_BYTES):
                ids, at = encoder.encode(flat, offsets)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], lists, decoder.decode(ids, at)], names=[*kept, "ids", "decoded"])

    return docs.select([F.col(f"`{c}`") for c in kept]).transform(mapped, run, schema_with(docs, kept, "ids array<int>, decoded binary"))


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row.

    Null text is empty: no tokens, the digests of nothing. Equal rows are each reported; no rows: no rows; only doc_id and text are
    read. A text is encoded whole, however long; memory grows with the longest.
    """
    both = encode_and_decode(docs.select("doc_id", "text"), ranks_path).select("doc_id", "ids", "decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
