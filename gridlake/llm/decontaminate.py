"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of a partition's documents. Its words that belong to the test phrases are indexed: suffix
array, Burrows-Wheeler transform, a wavelet matrix for rank, and suffix positions sampled every SAMPLE words and at
each run's start. All test phrases are searched backward at once, occurrences are located by walking to a sampled
position, and their spans are merged. Runs that hold a word pair no phrase has can't contain a phrase and are left out
of the index; nothing else is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, aside, chunks, distinct_spans, flat_text, mapped, prefix_sums, put_back, ragged, schema_with, span_hashes, spans_differ, staged, words_of

SAMPLE = 8


@dataclass
class Phrases:
    """Distinct windows of the test items over word numbers 1..V, and the items of each."""

    vocabulary: np.ndarray  # word hashes in order; number = place + 1
    flat: np.ndarray  # the words' bytes, end to end in the same order
    word_at: np.ndarray  # where each begins, and the end
    pairs: np.ndarray  # sorted keys of neighbouring words inside windows
    padded: np.ndarray  # windows x width, 0 after the end
    lengths: np.ndarray
    item_at: np.ndarray  # CSR: windows to items
    item_of: np.ndarray
    names: list[str]


def phrases_of(items: pa.Table, window: int = 10) -> Phrases:
    """items: item_id, text. Null or wordless texts have no windows; repeated ids and texts are one item each by id."""
    flat, offsets = flat_text(items.column("text"))
    flat = LOWER[flat]
    starts, ends, rows = words_of(flat, offsets, ALNUM)
    one, kind = distinct_spans(flat, starts, ends)
    hashes = span_hashes(prefix_sums(flat), starts[one], ends[one]) if len(one) else np.zeros(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    vocabulary, one = hashes[order], one[order]
    place = np.empty(len(one), np.int64)
    place[order] = np.arange(len(one))
    numbers = place[kind] + 1
    words = flat[ragged(starts[one], ends[one] - starts[one])], np.concatenate(([0], np.cumsum(ends[one] - starts[one])))
    names, item_no = np.unique(np.array([str(x) for x in items.column("item_id").to_pylist()], dtype=object).astype(str), return_inverse=True)
    first = np.searchsorted(rows, np.arange(len(items)))
    count = np.searchsorted(rows, np.arange(len(items)), side="right") - first
    size = np.minimum(count, window)
    windows = np.where(count > 0, count - size + 1, 0)
    at = ragged(first, windows)
    length = np.repeat(size, windows)
    item = np.repeat(item_no, windows)
    padded = np.zeros((len(at), window), np.int64)
    for k in range(window):
        has = length > k
        padded[has, k] = numbers[at[has] + k]
    if not len(at):
        return Phrases(vocabulary, *words, np.zeros(0, np.int64), padded, length, np.zeros(1, np.int64), np.zeros(0, np.int64), list(names))
    distinct, which = np.unique(padded, axis=0, return_inverse=True)
    links = np.unique(np.stack([which.reshape(-1), item], 1), axis=0)
    item_at = np.searchsorted(links[:, 0], np.arange(len(distinct) + 1))
    base = len(vocabulary) + 1
    left, right = distinct[:, :-1], distinct[:, 1:]
    return Phrases(vocabulary, *words, np.unique((left * base + right)[right > 0]), distinct, (distinct > 0).sum(1), item_at, links[:, 1], list(names))


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling; symbols may be any integers, and the end is smallest."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank, step, top = rank.astype(np.int64) + 1, 1, n + 2
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:]
        key = rank * top + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        rank, step = new, step * 2
        if rank.max() == n or step >= n:
            return order


class WaveletMatrix:
    """rank and access on integers below 2**bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros, self.level = bits, [], [], []
        for b in reversed(range(bits)):
            bit = (symbols >> b) & 1
            self.level.append(bit.astype(np.int8))
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        low = np.zeros_like(at)
        for k, b in enumerate(reversed(range(self.bits))):
            one = ((symbol >> b) & 1) == 1
            a, z = self.ones[k][low], self.ones[k][at]
            low = np.where(one, self.zeros[k] + a, low - a)
            at = np.where(one, self.zeros[k] + z, at - z)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k in range(self.bits):
            bit = self.level[k][at].astype(np.int64)
            ones = self.ones[k][at]
            out = out * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return out


class FMIndex:
    """Over symbols >= 1 in runs; 0 parts the runs."""

    def __init__(self, symbols: np.ndarray, vocabulary: int):
        n = len(symbols)
        apart = np.flatnonzero(symbols == 0)
        shown = symbols + len(apart)  # each separator is a symbol of its own, so no comparison runs past one
        shown[apart] = np.arange(len(apart))
        order = suffix_order(shown)
        last = symbols[order - 1]
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=vocabulary + 1))))
        self.bwt = WaveletMatrix(last, max(1, int(vocabulary).bit_length()))
        keep = (order % SAMPLE == 0) | (symbols[order - 1] == 0) | (order == 0)  # runs' starts too: a walk never meets a separator
        self.sampled = np.where(keep, order, -1)
        self.n = n

    def search(self, padded: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of each phrase, by backward steps."""
        low, high = np.zeros(len(padded), np.int64), np.full(len(padded), self.n, np.int64)
        live = np.arange(len(padded))
        for step in range(padded.shape[1]):
            live = live[(lengths[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = padded[live, lengths[live] - 1 - step]
            low[live] = self.counts[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.counts[symbol] + self.bwt.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, live = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            known = self.sampled[rows[live]]
            done = known >= 0
            out[live[done]] = known[done] + steps[live[done]]
            live = live[~done]
            symbol = self.bwt.access(rows[live])
            rows[live] = self.counts[symbol] + self.bwt.rank(symbol, rows[live])
            steps[live] += 1
        return out


def occurrences(numbers: np.ndarray, starts_row: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of every occurrence. numbers: each word's number or 0; starts_row: whether a document begins there."""
    none = np.zeros(0, np.int64)
    if not len(numbers) or not len(p.lengths):
        return none, none
    base = len(p.vocabulary) + 1
    joins = np.zeros(len(numbers), bool)  # whether the word goes on from the one before
    both = (numbers[1:] > 0) & (numbers[:-1] > 0) & ~starts_row[1:]
    at = np.flatnonzero(both)
    key = numbers[at] * base + numbers[at + 1]
    place = np.minimum(np.searchsorted(p.pairs, key), max(0, len(p.pairs) - 1))
    joins[at[(p.pairs[place] == key) if len(p.pairs) else np.zeros(len(at), bool)] + 1] = True
    begins = np.flatnonzero((numbers > 0) & ~joins)
    goes_on = np.append(joins[1:], False)
    stops = np.flatnonzero((numbers > 0) & ~goes_on) + 1
    size = stops - begins
    long = size >= p.lengths.min()
    begins, size = begins[long], size[long]
    if not len(begins):
        return none, none
    origin = np.full(int(size.sum()) + len(size), -1)
    firsts = np.cumsum(size + 1) - (size + 1)
    inside = ragged(firsts, size)
    origin[inside] = ragged(begins, size)
    symbols = np.where(origin >= 0, numbers[origin], 0)
    index = FMIndex(symbols, len(p.vocabulary))
    low, high = index.search(p.padded, p.lengths)
    found = np.flatnonzero(high > low)
    count = high[found] - low[found]
    return origin[index.locate(ragged(low[found], count))], np.repeat(found, count)


SPAN = "array<struct<start:int,end:int>>"
FOUND = f"doc_id long, n_words long, n_hit long, items array<string>, words {SPAN}, spans {SPAN}"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _spans(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> pa.Array:
    """List column of {start, end}, from spans in row order."""
    at = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    inner = pa.StructArray.from_arrays([pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(at), inner)


def numbered(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, p: Phrases) -> np.ndarray:
    """The number of each word of flat, 0 for one that no phrase has. A hash finds the place, bytes decide."""
    numbers = np.zeros(len(hashes), np.int64)
    if not len(p.vocabulary):
        return numbers
    live, place = np.arange(len(hashes)), np.searchsorted(p.vocabulary, hashes)
    while len(live):  # once more only for words that share a hash with another
        may = place < len(p.vocabulary)
        live, place = live[may], place[may]
        may = p.vocabulary[place] == hashes[live]
        live, place = live[may], place[may]
        unlike = spans_differ(flat, starts[live], ends[live], p.flat, p.word_at[place], p.word_at[place + 1])
        numbers[live[~unlike]] = place[~unlike] + 1
        live, place = live[unlike], place[unlike] + 1
    return numbers


def searched(part: pa.RecordBatch, flat: np.ndarray, offsets: np.ndarray, p: Phrases) -> pa.RecordBatch:
    """Columns of FOUND for the part's rows. Columns items and words of an earlier block's search are added to, if there."""
    n, low = len(part), LOWER[flat]
    starts, ends, rows = words_of(low, offsets, ALNUM)
    hashes = span_hashes(prefix_sums(low), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    numbers = numbered(low, starts, ends, hashes, p)
    first_of = np.ones(len(rows), bool)
    first_of[1:] = rows[1:] != rows[:-1]
    words, which = occurrences(numbers, first_of, p)
    change = np.zeros(len(rows) + 1, np.int64)
    np.add.at(change, words, 1)
    np.add.at(change, words + p.lengths[which], -1)
    items: list[set[str]] = [set() for _ in range(n)]
    if len(words):
        of_doc = np.unique(np.stack([rows[words], which], 1), axis=0)
        per = p.item_at[of_doc[:, 1] + 1] - p.item_at[of_doc[:, 1]]
        for d, i in zip(np.repeat(of_doc[:, 0], per).tolist(), p.item_of[ragged(p.item_at[of_doc[:, 1]], per)].tolist()):
            items[d].add(p.names[i])
    word0 = np.searchsorted(rows, np.arange(n))
    if "words" in part.schema.names:
        for d, (had, ranges) in enumerate(zip(part.column("items").to_pylist(), part.column("words").to_pylist())):
            items[d].update(had)
            for r in ranges:
                change[word0[d] + r["start"]] += 1
                change[word0[d] + r["end"]] -= 1
    hit = np.cumsum(change[:-1]) > 0
    goes_on = np.zeros(len(hit), bool)
    goes_on[1:] = hit[1:] & hit[:-1] & ~first_of[1:]
    heads = np.flatnonzero(hit & ~goes_on)
    tails = np.flatnonzero(hit & ~np.append(goes_on[1:], False))
    of = rows[heads]
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id").cast(pa.int64()),
            pa.array(np.bincount(rows, minlength=n), pa.int64()),
            pa.array(np.bincount(rows[hit], minlength=n), pa.int64()),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            _spans(of, heads - word0[of], tails + 1 - word0[of], n),
            _spans(of, starts[heads] - offsets[of], ends[tails] - offsets[of], n),
        ],
        names=["doc_id", "n_words", "n_hit", "items", "words", "spans"],
    )


def _pieces(batches, piece_bytes: int, window: int):
    """Items in pieces of at most about piece_bytes that share window - 1 words with the one before."""
    for batch in batches:
        ids, texts, numbers = [], [], []
        for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            raw, at, piece = (t or "").encode(), 0, 0
            flat = LOWER[np.frombuffer(raw, np.uint8)]
            starts, ends, _ = words_of(flat, np.array([0, len(flat)]), ALNUM)
            while at < len(starts) or not piece:
                to = max(at + window, int(np.searchsorted(ends, starts[at] + piece_bytes, side="right"))) if len(starts) else 0
                to = min(to, len(starts))
                ids.append(i)
                texts.append(raw[starts[at] : ends[to - 1]].decode() if to else "")
                numbers.append(piece)
                piece += 1
                at = len(starts) if to >= len(starts) else to - window + 1
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("item_id").type), pa.array(texts, pa.string()), pa.array(numbers, pa.int64())], names=["item_id", "text", "piece"])


def item_blocks(items: DataFrame, block_bytes: int, window: int = 10):
    """The test items, the stated query set, in blocks of about block_bytes of text: (item_id, text), and whether it is the last.

    An item longer than a block is cut to pieces that overlap by the longest window, so that no block grows with an item or with how
    often an id repeats. Blocks are dealt by a hash of the piece.
    """
    whole = items.select("item_id", "text")
    total = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    if n == 1:
        yield whole.toArrow(), True  # at most block_bytes of text
        return
    pieces = staged(whole.transform(mapped, lambda b: _pieces(b, block_bytes, window), schema_with(whole, ["item_id", "text"], "piece long")), "pieces")
    for i in range(n):
        yield pieces.filter(F.pmod(F.xxhash64("item_id", "text", "piece"), F.lit(n)) == i).select("item_id", "text").toArrow(), i == n - 1


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, items, words, spans and docs' other columns for each row of docs.

    items: ids of the items with an occurring window, as strings, sorted; words: the words hit, as ranges; spans: the
    same as merged byte ranges. Blocks of the test items are searched one after the other, each broadcast alone; with more
    than one, what is found is staged between them. Null text has no words; an empty items table hits nothing;
    equal rows are each reported; no rows: no rows. A column of docs with the name of a result column (in any case) is not carried.
    A very long text is a shard of its own, indexed whole.
    """
    made = ["n_words", "n_hit", "items", "words", "spans"]
    carried = [c for c in docs.columns if c.lower() not in made]
    found, df = None, docs.select([F.col(f"`{c}`") for c in carried])
    schema = schema_with(docs, carried, f"n_words long, n_hit long, items array<string>, words {SPAN}, spans {SPAN}")
    sc = docs.sparkSession.sparkContext
    for block, last in item_blocks(items, block_bytes, window):
        held = sc.broadcast(phrases_of(block, window))  # at most block_bytes of text

        def run(batches, held=held):
            p = held.value
            for batch in batches:
                for part, flat, offsets in chunks(batch):
                    got = searched(part, flat, offsets, p)
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in carried] + [got.column(c) for c in made], names=carried + made)

        found = df.transform(mapped, run, schema)
        df = found if last else staged(found, "decontaminated")
    return found


def _cut(text: str | None, spans: list[dict]) -> str | None:
    if text is None or not spans:
        return text
    raw, out, at = text.encode(), [], 0
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join([*out, raw[at:]]).decode()


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """docs with the merged spans cut out of text; n_chars, where docs has it, follows. A document left without words goes.

    All other columns are carried as they are, whatever their names. Null and empty texts stay; equal rows are each cut; no rows,
    or no items: docs as they are. Long texts are worked on whole.
    """
    own = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    found = find_contamination(aside(docs, own), items, window)
    schema = found.schema

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            cut = [_cut(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column("spans").to_pylist())]
            yield batch.set_column(at, batch.schema.field(at), pa.array(cut, batch.schema.field(at).type))

    hit = F.col("n_hit") > 0
    whole = found.filter((F.col("n_words") > F.col("n_hit")) | ~hit).transform(mapped, run, schema)
    if "n_chars" in own:
        whole = whole.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return whole.select(put_back(whole, docs.columns, own))
