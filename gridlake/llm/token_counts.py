"""Token counts by rank-synchronous array merging.

Distinct pre-tokens lie in one ragged array of symbols. In each round every sequence finds its own lowest-rank pair and
merges all places of that pair at once, from the left where they overlap; sequences without a pair leave.
Counts of surviving symbols are kept for each pre-token and summed over the documents' pre-tokens.
"""

from __future__ import annotations

import json
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mapped, ragged, schema_with
from .pretokens import numbered

#: Pre-tokens whose counts a worker remembers; beyond that it forgets the later half.
KEPT = 600_000

#: Bytes of text for one run.
RUN_BYTES = 2 << 20

NEVER = np.int64(2**62)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Merges:
    """Merge rules of a tokenizer file: pair keys sorted, with ranks and results."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level BPE file")
        ids = model["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.size = max(ids.values()) + 1
        key = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.result = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.byte_ids = np.array([ids[c] for c in byte_letters()], np.int64)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or want whole words are not known here")
        self.special = [t["content"] for t in spec["added_tokens"]]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = size.copy()
        live = np.flatnonzero(size > 1)
        symbols = self.byte_ids[np.frombuffer(b"".join([words[i] for i in live.tolist()]), np.uint8)]
        of = np.repeat(np.arange(len(live)), size[live])
        while len(live):
            inner = np.append(of[1:] == of[:-1], False)
            rank = np.full(len(symbols), NEVER)
            at = np.flatnonzero(inner)
            rank[at] = self.lookup(symbols[at], symbols[at + 1])
            first = np.searchsorted(of, np.arange(len(live)))
            best = np.minimum.reduceat(rank, first)
            out[live] = np.diff(np.append(first, len(symbols)))
            go = best < NEVER
            merge = (rank == best[of]) & go[of]
            near = np.flatnonzero(merge[1:] & merge[:-1])
            if len(near):  # overlapping places: every second of a run, counted from its left
                heads = np.flatnonzero(merge & ~np.append(False, merge[:-1]))
                places = np.flatnonzero(merge)
                run = np.searchsorted(heads, places, side="right") - 1
                merge[places[(places - heads[run]) % 2 == 1]] = False
            symbols = np.where(merge, self.result[np.where(merge, rank, 0)], symbols)
            keep = go[of] & ~np.append(False, merge[:-1])
            number = np.cumsum(go) - 1
            symbols, of, live = symbols[keep], number[of[keep]], live[go]
        return out


class Counter:
    def __init__(self, path: str):
        self.merges = Merges(path)
        self.special = regex.compile(b"|".join(regex.escape(s.encode()) for s in sorted(self.merges.special, key=len, reverse=True))) if self.merges.special else None
        self.seen: dict[bytes, int] = {}
        self.sizes = np.zeros(0, np.int64)

    def count(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row of text."""
        if len(self.seen) > KEPT:  # forget all but those seen first, among which the frequent ones are
            self.seen, self.sizes = dict(islice(self.seen.items(), KEPT // 2)), self.sizes[: KEPT // 2].copy()
        n = len(offsets) - 1
        extra, of = np.zeros(n, np.int64), np.arange(n)
        if self.special is not None and (found := [m.span() for m in self.special.finditer(flat.tobytes())]):
            # special strings part the text: what stands between them is split by itself
            begin, end = np.array(found, np.int64).T
            row = np.searchsorted(offsets, begin, side="right") - 1
            within = end <= offsets[row + 1]
            begin, end, row = begin[within], end[within], row[within]
            extra += np.bincount(row, minlength=n)
            keep = np.ones(len(flat), bool)
            keep[ragged(begin, end - begin)] = False
            cuts = np.sort(np.concatenate((offsets[:-1], end)))
            of = np.searchsorted(offsets, cuts, side="right") - 1
            of = np.minimum(of, n - 1)
            moved = np.concatenate(([0], np.cumsum(keep)))
            flat, offsets = flat[keep], np.append(moved[cuts], moved[-1])
        done = len(self.seen)
        words, counts = numbered(flat, offsets, self.seen)
        if len(self.seen) > done:
            self.sizes = np.concatenate((self.sizes, self.merges.count(list(islice(self.seen, done, None)))))
        sums = np.concatenate(([0], np.cumsum(self.sizes[words])))
        ends = np.cumsum(counts)
        return np.bincount(of, weights=sums[ends] - sums[ends - counts], minlength=n).astype(np.int64) + extra


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row, as the tokenizers library counts by default.

    Null text: 0 bytes, 0 tokens. Equal rows are each counted; no rows: no rows. Only doc_id and text are read. A text is counted
    whole, however long; memory grows with the longest.
    """

    def run(batches):
        counter = _COUNTERS.get(path)
        if counter is None:
            counter = _COUNTERS[path] = Counter(path)
        for batch in batches:
            for part, flat, offsets in chunks(batch, limit=RUN_BYTES):
                n = counter.count(flat, offsets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").transform(mapped, run, schema_with(docs, ["doc_id"], "n_bytes long, n_tokens long")).withColumn("over_limit", F.col("n_tokens") > limit)
