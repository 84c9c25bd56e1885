"""Exact substring deduplication with logarithmic families of suffix arrays.

Every byte inside a window of `width` bytes that also starts earlier is removed. Windows are dealt to families by content:
a window's anchor is the least hash among its KGRAM-byte grams, so equal windows have equal anchors, and neighbouring windows with
one anchor travel together as one segment. Only segments whose anchor turns up more than once are
sent. A family takes its segments in batches: each batch gets a suffix array over its windows, in the alphabetical order of
their bytes; levels of equal size merge geometrically, and each merge scans the joint order for equal windows, keeps the
earliest and reports the others. Every two windows meet in one merge, whatever the order in which they come. Digests only spare
the sort from going deeper into ties; a match is told by its bytes.
Documents that repeat an earlier one as a whole are told by their SHA-256 and take no part.

An anchor that more than HOT segments share (a line in a third of all documents, say) is not left to one family: its
windows are dealt one by one by a hash of the whole window, and equal ones are reduced to the earliest before they are sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, flat_text, mapped, mixed, prefix_sums, ragged, span_hashes, spans_differ, staged, tasks_for

WIDTH, KGRAM = 100, 24
#: Segments of one anchor from which on its windows are dealt one by one.
HOT = 4096
#: Text bytes of a family's batch, and of a task's share of segments.
BATCH_BYTES, FAMILY_BYTES = 3 << 19, 6 << 20


def anchors(flat: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Segments of the rows: anchor, row, first window (byte in the flat text), number of windows, places of the anchor."""
    none = np.zeros(0, np.int64)
    n = len(flat) - width + 1
    if n < 1:
        return none.astype(np.uint64), none, none, none, none
    sums = prefix_sums(flat)
    at = np.arange(len(flat) - KGRAM + 1)
    gram, need = span_hashes(sums, at, at + KGRAM), width - KGRAM + 1
    least = _over(np.minimum, gram, need)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + width <= offsets[1:][rows]
    head = inside.copy()
    head[1:] &= (least[1:] != least[:-1]) | (rows[1:] != rows[:-1]) | ~inside[:-1]
    tail = inside.copy()
    tail[:-1] &= np.append(head[1:], False)[: n - 1] | ~inside[1:]
    first, last = np.flatnonzero(head), np.flatnonzero(tail)
    # a gram is an anchor's place if it is the least of some window over it
    around = np.concatenate((np.zeros(need - 1, np.uint64), least, np.zeros(need - 1, np.uint64)))
    places = np.flatnonzero(_over(np.maximum, around, need) == gram)
    a, b = np.searchsorted(places, first), np.searchsorted(places, last + need)
    inside = gram[places[ragged(a, b - a)]] == np.repeat(least[first], b - a)
    count = np.bincount(np.repeat(np.arange(len(first)), b - a), weights=inside, minlength=len(first))
    return least[first], rows[first], first, last - first + 1, np.maximum(1, count).astype(np.int64)


def _over(f, values: np.ndarray, need: int) -> np.ndarray:
    """f over every `need` neighbours, by doubling."""
    have = 1
    while have < need:
        step = min(have, need - have)
        values = f(values[:-step], values[step:])
        have += step
    return values


def word_at(flat: np.ndarray) -> np.ndarray:
    """For each byte of a text the eight bytes from there on as a number that sorts as they do; zeros follow the text. A view of a
    padded copy, one byte from number to number."""
    return np.ndarray((len(flat),), ">u8", buffer=np.concatenate((flat, np.zeros(8, np.uint8))), strides=(1,))


class Level:
    """A suffix array: places `at` of a text, in the alphabetical order of the `width` bytes from each on, with a digest of these
    bytes, the owner (a segment) and the start there of each. Windows that are equal stand side by side."""

    FIELDS = ("at", "digest", "owner", "start")

    def __init__(self, flat: np.ndarray, at: np.ndarray, digest: np.ndarray, owner: np.ndarray, start: np.ndarray):
        self.flat, self.at, self.digest, self.owner, self.start = flat, at, digest, owner, start

    def take(self, which: np.ndarray) -> "Level":
        return Level(self.flat, *[getattr(self, f)[which] for f in self.FIELDS])


def alphabetical(flat: np.ndarray, at: np.ndarray, digest: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of windows by their bytes, and which of them, in that order, differ from the one before.

    Windows are sorted by eight bytes, and those that still tie by the next eight, until the windows of every tie have one digest;
    these are then compared byte by byte.
    """
    words = word_at(flat)
    key = words[at].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.ones(len(at), bool)
    head[1:] = key[1:] != key[:-1]
    depth, open_ = 8, _mixed_ties(head, digest[order])
    while len(open_) and depth < width:
        own, group = order[open_], np.cumsum(head[open_])
        left = min(8, width - depth)
        key = words[at[own] + depth].astype(np.uint64) >> np.uint64(64 - 8 * left)
        again = np.lexsort((key, group))
        order[open_], key = own[again], key[again]
        head[open_[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
        open_ = open_[_mixed_ties(head[open_], digest[order[open_]])]  # ties only part further
        depth += 8
    tie = np.flatnonzero(~head)
    if len(tie):
        one, other = at[order[tie]], at[order[tie - 1]]
        differ = np.zeros(len(tie), bool)
        for d in [*range(0, width - 7, 8), width - 8]:
            differ |= words[one + d] != words[other + d]
        head[tie[differ]] = True  # one digest for different bytes: they part here, and no match is made of them
    return order, head


def _mixed_ties(head: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """The members of ties whose digests are not all the same."""
    strange = np.flatnonzero(~head[1:] & (digest[1:] != digest[:-1])) + 1
    if not len(strange):
        return strange
    tie = np.cumsum(head)
    mixed_ = np.zeros(int(tie[-1]) + 1, bool)
    mixed_[tie[strange]] = True
    return np.flatnonzero(mixed_[tie])


def suffix_array(flat: np.ndarray, at: np.ndarray, owner: np.ndarray, start: np.ndarray, width: int = WIDTH) -> Level:
    """The windows that begin at these places of a batch's text, to be ordered when they are scanned."""
    return Level(flat, at, span_hashes(prefix_sums(flat), at, at + width), owner, start)


def merged(levels: list[Level], rank: np.ndarray, width: int = WIDTH) -> tuple[Level, np.ndarray, np.ndarray]:
    """One level of the earliest window of each content, and the (owner, start) of the others, found by a scan over the joint order.

    rank: each segment's document in the order of documents.
    """
    ends = np.cumsum([0, *[len(x.flat) for x in levels]])
    flat = np.concatenate([x.flat for x in levels])
    at = np.concatenate([x.at + e for x, e in zip(levels, ends)])
    both = Level(flat, at, *[np.concatenate([getattr(x, f) for x in levels]) for f in Level.FIELDS[1:]])
    order, head = alphabetical(flat, at, both.digest, width)
    both = both.take(order)
    origin = (rank[both.owner] << 32) | both.start
    heads = np.flatnonzero(head)
    if not len(heads):
        return both, both.owner, both.start
    first = np.minimum.reduceat(origin, heads)
    is_first = origin == np.repeat(first, np.diff(np.append(heads, len(head))))
    # of a window given twice (a row that is there twice) one goes on, and the other is no repeat of itself
    held = np.flatnonzero(is_first)
    of = np.cumsum(head)[held]
    lost = ~is_first
    return both.take(held[np.append(True, of[1:] != of[:-1])]), both.owner[lost], both.start[lost]


def spans_of(doc: np.ndarray, start: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first byte, end) of the bytes under windows."""
    if not len(doc):
        return doc, start, start
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + width)
    last = np.append(np.flatnonzero(head)[1:], len(doc)) - 1
    return doc[head], start[head], start[last] + width


#: A segment; without seg its windows are known to start earlier elsewhere.
SEGMENT = "route long, doc long, digest long, lo int, n int, seg binary"
SPAN = "doc long, digest long, lo int, hi int"


class Family:
    """Levels of suffix arrays whose sizes grow geometrically; every two windows meet in one merge."""

    def __init__(self, width: int = WIDTH):
        self.width, self.levels, self.lost, self.n = width, {}, [], 0
        self.keys: list[tuple[np.ndarray, np.ndarray]] = []  # (doc, digest) of each segment

    def known(self, doc: np.ndarray, digest: np.ndarray, lo: np.ndarray, n: np.ndarray) -> None:
        """Segments whose windows start earlier elsewhere."""
        self.keys.append((doc, digest))
        self.lost.append((np.repeat(np.arange(len(n)) + self.n, n), ragged(lo, n)))
        self.n += len(n)

    def add(self, doc: np.ndarray, digest: np.ndarray, lo: np.ndarray, n: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> None:
        """A batch of segments with their text."""
        self.keys.append((doc, digest))
        level = suffix_array(flat, ragged(offsets[:-1], n), np.repeat(np.arange(len(n)) + self.n, n), ragged(lo, n), self.width)
        self.n += len(n)
        size, level = 0, self._merge([level])
        while size in self.levels:
            level = self._merge([self.levels.pop(size), level])
            size += 1
        self.levels[size] = level

    def _merge(self, levels: list[Level]) -> Level:
        doc, digest = (np.concatenate(x) for x in zip(*self.keys))
        order = np.lexsort((digest, doc))
        new = np.ones(len(order), bool)
        new[1:] = (doc[order][1:] != doc[order][:-1]) | (digest[order][1:] != digest[order][:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        level, owner, start = merged(levels, rank, self.width)
        if len(owner):
            self.lost.append((owner, start))
        return level

    def finish(self):
        """doc, digest, first byte and end of the spans to remove."""
        while len(self.levels) > 1:
            a, b = sorted(self.levels)[:2]
            self.levels[b] = self._merge([self.levels.pop(a), self.levels.pop(b)])
        none = np.zeros(0, np.int64)
        if not self.lost:
            return none, none, none, none
        owner, start = (np.concatenate(x) for x in zip(*self.lost))
        doc, digest = (np.concatenate(x) for x in zip(*self.keys))
        order = np.lexsort((digest, doc))
        new = np.ones(len(order), bool)
        new[1:] = (doc[order][1:] != doc[order][:-1]) | (digest[order][1:] != digest[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        one = order[new]
        of, lo, hi = spans_of(number[owner], start, self.width)
        return doc[one][of], digest[one][of], lo, hi


def _family(batches, width: int = WIDTH):
    """Spans to remove, from one task's segments."""
    family = Family(width)
    pending: list[pa.RecordBatch] = []
    waiting = 0

    def close() -> None:
        table = pa.Table.from_batches(pending)
        flat, offsets = flat_text(table.column("seg"))
        family.add(table.column("doc").to_numpy(), table.column("digest").to_numpy(), table.column("lo").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.int64), flat, offsets)

    for batch in batches:
        known = batch.filter(pc.is_null(batch.column("seg")))
        if len(known):
            family.known(known.column("doc").to_numpy(), known.column("digest").to_numpy(), known.column("lo").to_numpy().astype(np.int64), known.column("n").to_numpy().astype(np.int64))
        batch = batch.filter(pc.is_valid(batch.column("seg")))
        if len(batch):
            pending.append(batch)
            waiting += pc.sum(pc.binary_length(batch.column("seg"))).as_py()
        if waiting >= BATCH_BYTES:
            close()
            pending, waiting = [], 0
    if pending:
        close()
    doc, digest, lo, hi = family.finish()
    if len(doc):
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(digest), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["doc", "digest", "lo", "hi"])


NULL_ID = -(2**63)
TOLD = "route long, anchor long, doc long, digest long, lo int, n int, count int"
REPEATED = "anchor long, doc long, digest long, lo int, n int, often long, speaks boolean"


def _segments(batches, width: int):
    """For each piece of text its segments, and for each anchor of the piece one that speaks for all of them: the route
    brings speakers of an anchor to one task, with their numbers of segments; the others, repeated already, go anywhere."""
    for batch in batches:
        for part, flat, offsets in chunks(batch):
            anchor, row, first, n, places = anchors(flat, offsets, width)
            if not len(anchor):
                continue
            _, one, of = np.unique(anchor, return_index=True, return_inverse=True)
            count = np.bincount(of, weights=places)
            speaks = np.zeros(len(anchor), bool)
            speaks[one] = True
            doc, digest = part.column("doc").to_numpy()[row], part.column("digest").to_numpy()[row]
            route = np.where(speaks, anchor, mixed(digest.view(np.uint64) ^ first.astype(np.uint64)))
            columns = (route.view(np.int64), anchor.view(np.int64), doc, digest, (first - offsets[row]).astype(np.int32), n.astype(np.int32), np.where(speaks, count[of], -count[of]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["route", "anchor", "doc", "digest", "lo", "n", "count"])


def _repeated(batches):
    """The segments whose anchor turns up again, with how often (of an anchor that speaks: in all)."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    table = pa.Table.from_batches(held)
    anchor, count = table.column("anchor").to_numpy(), table.column("count").to_numpy().astype(np.int64)
    speaks, often = count > 0, np.abs(count)
    _, of = np.unique(anchor[speaks], return_inverse=True)
    often[speaks] = np.bincount(of, weights=count[speaks])[of] if len(of) else 0
    keep = pa.array(often > 1)
    out = table.select(["anchor", "doc", "digest", "lo", "n"]).append_column("often", pa.array(often)).append_column("speaks", pa.array(speaks)).filter(keep)
    yield from out.to_batches(max_chunksize=1 << 16)


def _dealt(batches, width: int):
    """Segments with their text, from documents with lists of segments; those of frequent anchors as single windows. Of equal
    ones in a piece of text the earliest is sent whole and the others are sent as known."""
    for batch in batches:
        for part, flat, offsets in chunks(batch):
            segs = part.column("segs")
            per = np.diff(segs.offsets.to_numpy()).astype(np.int64)
            inner = segs.flatten()
            anchor = inner.field("anchor").to_numpy(zero_copy_only=False)
            lo, n = (inner.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "n"))
            hot = inner.field("hot").to_numpy(zero_copy_only=False).astype(bool)
            row = np.repeat(np.arange(len(part)), per)
            each = np.where(hot, n, 1)
            which = np.repeat(np.arange(len(n)), each)
            lo = ragged(lo, each)
            row, hot, anchor = row[which], hot[which], anchor[which]
            n = np.where(hot, 1, n[which])
            first = offsets[row] + lo
            code = span_hashes(prefix_sums(flat), first, first + n + width - 1)
            doc, digest = part.column("doc").to_numpy()[row], part.column("digest").to_numpy()[row]
            order = np.lexsort((lo, digest, doc, code))
            head = np.ones(len(order), bool)
            head[1:] = code[order][1:] != code[order][:-1]
            of = np.empty(len(order), np.int64)
            of[order] = order[head][np.cumsum(head) - 1]
            end = first + n + width - 1
            of = np.where(spans_differ(flat, first, end, flat, first[of], end[of]), np.arange(len(of)), of)
            sent = of == np.arange(len(order))
            self_again = ~sent & (doc == doc[of]) & (digest == digest[of]) & (lo == lo[of])
            route = np.where(hot, code.view(np.int64), anchor)
            route = np.where(sent, route, mixed(code ^ mixed(digest.view(np.uint64) ^ lo.astype(np.uint64))).view(np.int64))
            for a in range(0, len(sent), 1 << 15):
                s = np.arange(a, min(len(sent), a + (1 << 15)))
                s = s[~self_again[s]]
                size = np.where(sent[s], n[s] + width - 1, 0)
                text = flat[ragged(first[s], size)].tobytes()
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                valid = np.packbits(sent[s], bitorder="little").tobytes()
                seg = pa.Array.from_buffers(pa.binary(), len(s), [pa.py_buffer(valid), pa.py_buffer(ends.tobytes()), pa.py_buffer(text)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route[s]), pa.array(doc[s]), pa.array(digest[s]), pa.array(lo[s].astype(np.int32)), pa.array(n[s].astype(np.int32)), seg], names=["route", "doc", "digest", "lo", "n", "seg"]
                )


def _kept(batches):
    """What is left of each document: doc, digest, n_removed, n_spans, kept."""
    for batch in batches:
        for part, flat, offsets in chunks(batch):
            removed, runs, kept = [], [], []
            for i, spans in enumerate(part.column("spans").to_pylist()):
                raw, upto, out, gone, count = flat[offsets[i] : offsets[i + 1]].tobytes(), 0, [], 0, 0
                for s in sorted((x["lo"], x["hi"]) for x in spans):
                    if s[1] <= upto and count:
                        continue
                    if s[0] > upto or not count:
                        out.append(raw[upto : s[0]])
                        count += 1
                        gone -= s[0]
                    else:
                        gone -= upto
                    gone += s[1]
                    upto = s[1]
                out.append(raw[upto:])
                removed.append(gone)
                runs.append(count)
                kept.append(b"".join(out))
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("digest"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc", "digest", "n_removed", "n_spans", "kept"])


#: Keys of documents to leave out that are sent to all tasks at most; more are joined by a shuffle.
SENT_KEYS = 1 << 20


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "digest": F.xxhash64("text")})


def later_copies(whole: DataFrame) -> DataFrame:
    """(doc, digest) of documents whose whole text an earlier document has. whole: doc, digest, sha."""
    first = whole.groupBy("sha").agg(F.min(F.struct("doc", "digest")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
    return whole.join(first, "sha").filter(F.struct("doc", "digest") > F.col("first")).select("doc", "digest").distinct()


def shortened(docs: DataFrame, width: int = WIDTH, without: DataFrame | None = None) -> DataFrame:
    """(doc, digest, n_removed, n_spans, kept) of each document that loses bytes; kept: the bytes left (binary).

    doc is doc_id, digest xxhash64 of the text. Rows alike in both are one document. without: (doc, digest) of documents to
    leave out, as later_copies finds them: each of their windows starts earlier in the first copy, so nobody misses them.
    """
    texts = keyed(docs.select("doc_id", "text")).filter(F.octet_length("text") >= width).select("doc", "digest", "text")
    if without is not None:
        texts = texts.join(F.broadcast(without) if without.count() <= SENT_KEYS else without, ["doc", "digest"], "left_anti")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    told = texts.transform(mapped, lambda b: _segments(b, width), TOLD).repartition(tasks_for(size, 32 << 20, 24), "route").transform(mapped, _repeated, REPEATED)
    told = staged(told, "repeated")
    hot = told.filter((F.col("often") > HOT) & F.col("speaks")).select("anchor").distinct().withColumn("hot", F.lit(True))
    wanted = told.join(hot, "anchor", "left").groupBy("doc", "digest").agg(F.collect_list(F.struct("anchor", "lo", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("segs"))  # no more than the document's own text has
    held = staged(texts.join(wanted, ["doc", "digest"]), "suspects")
    spread = told.agg(F.sum(F.col("n") + width)).first()[0] or 0
    found = held.transform(mapped, lambda b: _dealt(b, width), SEGMENT).repartition(tasks_for(spread, FAMILY_BYTES, 24), "route").transform(mapped, lambda b: _family(b, width), SPAN)
    spans = staged(found, "spans").groupBy("doc", "digest").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return held.select("doc", "digest", "text").join(spans, ["doc", "digest"]).transform(mapped, _kept, "doc long, digest long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row.

    A byte goes if a width-byte string over it also starts earlier: in a document with a smaller doc_id, or earlier in the
    same one. Null text: no bytes. Null doc_id: before all others. Rows with equal doc_id and text are one document, each
    reported; rows with equal doc_id and different texts stand in the order of their texts' hashes. No rows: no rows. A very long text
    is worked on whole where it is read, and its windows are dealt like any others. Other columns are not read.
    """
    whole = keyed(docs.select("doc_id", "text")).select("doc_id", "doc", "digest", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    whole = staged(whole, "whole")
    copies = staged(later_copies(whole.filter(F.col("n_bytes") >= width)), "copies")
    cut = shortened(docs, width, copies).select("doc", "digest", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept")).dropDuplicates(["doc", "digest"])
    both = whole.join(copies.withColumn("copy", F.lit(True)), ["doc", "digest"], "left").join(cut, ["doc", "digest"], "left")
    copied = F.col("copy").isNotNull()
    return both.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
