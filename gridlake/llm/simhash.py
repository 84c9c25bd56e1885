"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart share a variant within r bits of both. Each distinct fingerprint emits all its
variants within r = reach // 2 bits. Variants travel grouped by their leading bits: a row (leading bits of the variant,
fingerprint, flips left) stands for all variants with these leading bits, and the receiving task writes them out,
sorts them and links what collides. All holders of one variant lie within 2r bits of each other, so a
star to the one nearest to it keeps every link of the group without listing its pairs. Where every link counts as it is, a task keeps a
tree of the shortest it meets: it connects what they connect, and a dense group has no more of them than members. Where links are
verified on the texts, those of the trees come first. A link that a tree leaves out can matter only if one of the tree fails: groups where
one did are searched again, for all links between different components, which are compared in rounds, nearest first. In that search a
text travels with the parities of its shingles' hashes: links of texts whose parities rule the similarity out are not made. No link leaves
a group, so groups are dealt there by themselves: in parts of about WHOLE members, every two of which meet in one route, where pairs are
compared directly, also those of one fingerprint. Groups of more than PARTS parts are dealt by blocks of bits first: two fingerprints at most
`reach` bits apart have one of reach + 1 blocks in common, and those that share a block are dealt in parts as a group is.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, aside, chunks, flat_text, forget, mapped, mixed, put_back, ragged, schema_with, staged, tasks_for, words_of

#: Variants that a task holds at a time; rows that share leading bits, on average, before more bits deal them; members of a part of a group;
#: parts of a group before blocks of bits deal it.
HELD, ROUTED, WHOLE, PARTS = 1 << 22, 1 << 20, 1 << 10, 16


def joined_words(flat: np.ndarray, offsets: np.ndarray):
    """Words one space apart: the bytes, each word's start and end there, and its row."""
    starts, ends, rows = words_of(flat, offsets, NOT_SPACE)
    if not len(starts):
        return b"", starts, ends, rows
    padded = np.append(flat, np.uint8(32))
    take = ragged(starts, ends - starts + 1)
    text = padded[take]
    stop = np.cumsum(ends - starts + 1) - 1
    text[stop] = 32
    return text.tobytes(), stop - (ends - starts), stop, rows


def shingle_hashes(flat: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle of the rows' words, repeats included, and how many each row has."""
    n = len(offsets) - 1
    text, starts, ends, rows = joined_words(LOWER[flat], offsets)
    words = np.bincount(rows, minlength=n)
    first = np.cumsum(words) - words
    count = np.where(words > 0, np.maximum(1, words - width + 1), 0)
    at = ragged(first, count)
    to = np.minimum(at + width, np.repeat(first + words, count)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = (digest(text[a:b], 42) for a, b in zip(starts[at].tolist(), ends[to].tolist()))
    return np.fromiter(hashes, np.uint64, len(at)) if len(at) else np.zeros(0, np.uint64), count


#: A byte's eight bits as the eight bytes of a number, so that up to 255 of them add up without a carry.
SPREAD = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)


def voted(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One unsigned 64-bit fingerprint a row: a bit is set if it is in over half of the row's hashes; no hashes: 0."""
    out = np.zeros(len(count), np.uint64)
    has = np.flatnonzero(count)
    if not len(has):
        return out
    size = count[has]
    begin = (np.cumsum(count) - count)[has]
    pieces = -(-size // 255)
    at = np.repeat(begin, pieces) + 255 * ragged(np.zeros(len(has), np.int64), pieces)
    first = np.cumsum(pieces) - pieces
    votes = np.empty((len(has), 64), np.int64)
    for byte in range(8):
        sums = np.add.reduceat(SPREAD[((hashes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)], at)
        votes[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
    out[has] = np.packbits(votes * 2 > size[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprints(flat: np.ndarray, offsets: np.ndarray, width: int = 4) -> np.ndarray:
    """One unsigned 64-bit fingerprint a row: a bit is set if it is in over half of the shingles' hashes."""
    return voted(*shingle_hashes(flat, offsets, width))


def with_fingerprint(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and `fp`, the fingerprint as a signed long. Null or wordless text: 0."""

    def run(batches):
        for batch in batches:
            for part, flat, offsets in chunks(batch):
                fp = fingerprints(flat, offsets, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").transform(mapped, run, schema_with(docs, ["doc_id"], "fp long"))


def _flips(bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All masks of at most `most` of the low `bits` bits, and how many bits each has."""
    masks, used = [0], [0]
    for k in range(1, most + 1):
        for c in combinations(range(bits), k):
            masks.append(sum(1 << b for b in c))
            used.append(k)
    return np.array(masks, np.uint64), np.array(used, np.int64)


def _routes(fps: np.ndarray, left: np.ndarray, below: int, take: int):
    """Split variants by their next `take` bits under bit `below`: (those bits of the variant, row, flips left)."""
    masks, used = _flips(take, int(left.max(initial=0)))
    bits = (fps >> np.uint64(below - take)) & np.uint64((1 << take) - 1)
    code, row, rest = [], [], []
    for m, u in zip(masks, used):
        ok = np.flatnonzero(left >= u)
        code.append(bits[ok] ^ m)
        row.append(ok)
        rest.append(left[ok] - u)
    return np.concatenate(code), np.concatenate(row), np.concatenate(rest)


def _links(fps: np.ndarray, left: np.ndarray, below: int) -> np.ndarray:
    """Star links (fingerprint, nearest holder) among all variants of the rows' low `below` bits; pairs of indices into fps."""
    size = sum(math.comb(below, k) for k in range(int(left.max(initial=0)) + 1))
    if len(fps) < 2:
        return np.zeros((0, 2), np.int64)
    if len(fps) * size > HELD and below > 8:
        code, row, rest = _routes(fps, left, below, 4)
        order = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[order], np.arange(17))
        found = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = order[a:b]
            found.append(row[own][_links(fps[row[own]], rest[own], below - 4)])
        return np.concatenate(found)
    low = fps & np.uint64((1 << below) - 1)
    codes, owners, far = [], [], []
    for flips in range(int(left.max(initial=0)) + 1):
        own = np.flatnonzero(left == flips)
        if len(own):
            masks, used = _flips(below, flips)
            codes.append((low[own][:, None] ^ masks[None, :]).reshape(-1))
            owners.append(np.repeat(own, len(masks)))
            far.append(np.tile((used - flips).astype(np.int8), len(own)))  # flips of a variant in all, less those that all rows may make
    codes, owners, far = np.concatenate(codes), np.concatenate(owners), np.concatenate(far)
    order = np.argsort(codes)
    codes = codes[order]
    same = codes[1:] == codes[:-1]
    if not same.any():
        return np.zeros((0, 2), np.int64)
    member = np.zeros(len(codes), bool)
    member[1:] |= same
    member[:-1] |= same
    at = np.flatnonzero(member)
    owners, far, head = owners[order[at]], far[order[at]], np.append(True, codes[at][1:] != codes[at][:-1])
    group = np.cumsum(head) - 1
    by = np.lexsort((fps[owners], far, group))
    nearest = owners[by][np.flatnonzero(head)][group]
    pairs = np.stack([owners, nearest], 1)
    return np.unique(pairs[fps[pairs[:, 0]] != fps[pairs[:, 1]]], axis=0)


def _meetings(part: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row for each part of its group: (row, which two parts meet, a number that is below 0 if they are one)."""
    row, other = np.repeat(np.arange(len(part)), parts), ragged(np.zeros(len(part), np.int64), parts)
    mine = part[row]
    high = np.maximum(mine, other)
    return row, np.where(mine == other, -1 - mine, high * (high - 1) // 2 + np.minimum(mine, other))


def _close(fps: np.ndarray, part: np.ndarray, one: bool, reach: int):
    """Pairs of indices into fps at most `reach` bits apart, in bounded pieces: all of one part, or those between two."""
    ends = (np.arange(len(fps)),) * 2 if one else (np.flatnonzero(part == part.min()), np.flatnonzero(part != part.min()))
    step = max(1, (1 << 18) // max(1, len(ends[1])))
    for a in range(0, len(ends[0]), step):
        left = ends[0][a : a + step]
        i, j = np.nonzero(np.bitwise_count(fps[left][:, None] ^ fps[ends[1]][None, :]) <= reach)
        pairs = np.stack([left[i], ends[1][j]], 1)
        yield pairs[pairs[:, 0] < pairs[:, 1]] if one else pairs


def _tree(fps: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Those of the pairs that connect, shortest first, what none before them connects."""
    values, node = np.unique(fps[pairs], return_inverse=True)
    node = node.reshape(-1, 2)
    order = np.lexsort((node[:, 1], node[:, 0], np.bitwise_count(values[node[:, 0]] ^ values[node[:, 1]])))
    parent, keep = list(range(len(values))), []
    for i, (a, b) in zip(order.tolist(), node[order].tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep.append(i)
    return pairs[keep]


def _sent(lead: int, half: int) -> int:
    """Rows that a fingerprint is sent as, by leading bits."""
    return sum(math.comb(lead, k) for k in range(half + 1))


def leading_bits(count: int, half: int, least: int) -> int:
    """How many leading bits deal the variants of so many fingerprints: every bit more sends a fingerprint more often, so there are as few
    as leave ROUTED rows or fewer with the same ones, on average."""
    lead = least
    while lead < 20 and count * _sent(lead, half) > ROUTED << lead:
        lead += 1
    return lead


def near_links(distinct: DataFrame, reach: int = 4, count: int | None = None, least_lead: int = 8, tree: bool = True, least: float = 0.8) -> DataFrame:
    """Links (a, b), a != b, among distinct fingerprints `fp`: connected just as all pairs at most `reach` bits apart are.

    reach is even. Links are verified at the end by their Hamming distance. With `tree` no more links come of fingerprints that share
    leading bits than connect them; without, a has no more of them than variants, or rows of its group. With a column `label` in distinct, links are
    between different labels only; with columns `size` and `parity` (see parities), between texts that may have a similarity of `least`
    only; with a column `id`, a and b are ids and links may come more than once. With a column `group`, rows of one group, a number from 0
    on, are dealt whole and linked with each other only, and rows without one by leading bits. With a column `parts` too, a group is dealt in
    so many parts by its rows' ids, or fingerprints where they have none, and all its pairs are compared, also those that stars leave out: a
    row is sent once for each part, and no route holds more of the group than two parts. The number of leading bits that deal variants to tasks grows with the number
    of fingerprints; a task's variants are written out in bounded pieces.
    """
    half = reach // 2
    count = distinct.count() if count is None else count
    lead = leading_bits(count, half, least_lead)

    own = ["fp", *[x for x in ("label", "id", "size", "parity") if x in distinct.columns]]
    grouped = "group" in distinct.columns
    parted = grouped and "parts" in distinct.columns
    dealt = [*own, *(["group"] if grouped else []), *(["parts"] if parted else [])]

    def emit(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            group = batch.column("group").fill_null(-1).to_numpy() if grouped else np.full(len(fps), -1)
            together, apart = np.flatnonzero(group >= 0), np.flatnonzero(group < 0)
            cut = []  # route, the parts that meet, the row, its part, flips left
            if len(together):
                parts = batch.column("parts").fill_null(1).to_numpy()[together].astype(np.int64) if parted else np.ones(len(together), np.int64)
                by = batch.column("id").to_numpy(zero_copy_only=False).view(np.uint64) if "id" in own else fps
                part = (mixed(by[together]) % parts.astype(np.uint64)).astype(np.int64)
                row, meet = _meetings(part, parts)
                cut.append((-1 - group[together[row]], meet, together[row], part[row], np.full(len(row), half)))
            for a in range(0, len(apart), 1 << 14):
                some = apart[a : a + (1 << 14)]
                code, row, rest = _routes(fps[some], np.full(len(some), half), 64, lead)
                none = np.zeros(len(row), np.int64)
                cut.append((code, none, some[row], none, rest))
            for code, meet, row, part, rest in cut:
                places = [pa.array(code.astype(np.int64)), *[pa.array(x.astype(np.int32)) for x in (meet, part, rest)]]
                yield pa.RecordBatch.from_arrays([*places, *[batch.column(k).take(pa.array(row)) for k in range(len(own))]], names=["route", "meet", "part", "left", *own])

    def link(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        route, meet, part, left, fps, *more = (table.column(k).to_numpy() for k in ("route", "meet", "part", "left", *[x for x in own if x != "parity"]))
        order = np.lexsort((meet, route))
        route, meet, part, left, fps = route[order], meet[order], part[order], left[order].astype(np.int64), fps[order].view(np.uint64)
        of = {name: x[order] for name, x in zip(own[1:], more)}
        signs = flat_text(table.column("parity")) if "parity" in own else None
        cuts = np.flatnonzero(np.append(True, (route[1:] != route[:-1]) | (meet[1:] != meet[:-1])))
        for a, b in zip(cuts, np.append(cuts[1:], len(route))):
            kept = []
            direct = parted and route[a] < 0
            for pairs in _close(fps[a:b], part[a:b], meet[a] < 0, reach) if direct else [_links(fps[a:b], left[a:b], 64 - lead if route[a] >= 0 else 64)]:
                if "label" in of:
                    pairs = pairs[of["label"][a:b][pairs[:, 0]] != of["label"][a:b][pairs[:, 1]]]
                if signs:
                    pairs = pairs[may_be_similar(*signs, order[a:b], of["size"][a:b], pairs, least)]
                kept.append(pairs)
            pairs = np.concatenate(kept)
            if len(pairs):
                pairs = _tree(fps[a:b], pairs) if tree else pairs
                ends = [fps[a:b][pairs[:, k]] for k in (0, 1)]
                bits = np.bitwise_count(ends[0] ^ ends[1])
                named = [of["id"][a:b][pairs[:, k]] for k in (0, 1)] if "id" in of else [x.view(np.int64) for x in ends]
                near = bits <= reach
                yield pa.RecordBatch.from_arrays([*[pa.array(x[near]) for x in named], pa.array(bits[near].astype(np.int32))], names=["a", "b", "bits"])

    tasks = min(1 << lead, tasks_for(count * _sent(lead, half), 1 << 20, 24))
    routed = distinct.select(dealt).transform(mapped, emit, "route long, meet int, part int, left int, " + ", ".join(f"{x} {'binary' if x == 'parity' else 'long'}" for x in own)).repartition(tasks, "route", "meet")
    links = routed.transform(mapped, link, "a long, b long, bits int")
    return links if "id" in own else links.select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a, b): the least node reachable. Large-star and small-star rounds, each staged.

    Every round sends a node's neighbours to the least of them; minima are combined before the shuffle, and no list of
    neighbours is gathered.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        last, edges = edges, staged(small, "links")
        forget(last)
        if not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def near_duplicates(docs: DataFrame, width: int = 4, reach: int = 4) -> DataFrame:
    """doc_id, fp, component_id for each row of docs: the least doc_id reachable over links of at most reach bits.

    Null, empty and wordless texts have fingerprint 0 and link like others. Equal rows share a component; a null doc_id never
    names a component while another member has an id. No rows: no rows. Only doc_id and text are read. A very long text gives its
    fingerprint in one piece, in memory of some tens of bytes for each of its own.
    """
    rows = staged(with_fingerprint(docs.select("doc_id", "text"), width), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(near_links(distinct, reach))
    labelled = distinct.join(found.withColumnRenamed("node", "fp"), "fp")
    named = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    moved = labelled.join(named, "label").select("fp", F.col("component_id").alias("linked"))
    of = distinct.join(moved, "fp", "left").select("fp", F.coalesce("linked", "least").alias("component_id"))
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


#: Parameters of the search for near copies: shingles of VIEW words, TABLES fingerprints of independent bits for each text.
VIEW, TABLES = 2, 8


def sketched(docs: DataFrame, view: int = VIEW, tables: int = TABLES) -> DataFrame:
    """docs' columns but text, and for each text: `words`, a digest of its sequence of words, and `fps`, its fingerprints.

    Fingerprint t votes on the shingles' hashes mixed with t, so that every one is a new draw of 64 bits.
    """
    kept = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for part, flat, offsets in chunks(batch):
                text, starts, ends, rows = joined_words(LOWER[flat], offsets)
                at = np.searchsorted(rows, np.arange(len(part) + 1))
                spans = [(int(starts[a]), int(ends[b - 1])) if b > a else (0, 0) for a, b in zip(at[:-1], at[1:])]
                words = pa.array([xxhash.xxh3_128_digest(text[a:b]) for a, b in spans], pa.binary())
                hashes, count = shingle_hashes(flat, offsets, view)
                fps = np.stack([voted(hashes if not t else mixed(hashes + np.uint64(_STEP * t % 2**64)), count) for t in range(tables)], 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables), pa.array(fps.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], words, lists], names=[*kept, "words", "fps"])

    return docs.transform(mapped, run, schema_with(docs, kept, "words binary, fps array<long>"))


_STEP = 0x9E3779B97F4A7C15


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(*flat_text(pa.array([text], pa.string())), width)[0])


def parity_of(hashes: np.ndarray) -> bytes:
    """For each of m values of the hashes' low bits whether an odd number of hashes has it: m bits, m a power of two, at least 64 and
    twice the hashes. Halves added up by exclusive or are the parities of m / 2 values."""
    m = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def parities(rows: DataFrame, width: int = 5) -> DataFrame:
    """rows' columns but text, with `size`, how many different shingles the text has, and `parity`, theirs (see parity_of)."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x.as_py(), width) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([len(x) for x in sets], pa.int64()), pa.array([parity_of(x) for x in sets], pa.binary())], names=[*kept, "size", "parity"])

    return rows.transform(mapped, run, schema_with(rows, kept, "size long, parity binary"))


def may_be_similar(flat: np.ndarray, offsets: np.ndarray, row: np.ndarray, size: np.ndarray, pairs: np.ndarray, least: float) -> np.ndarray:
    """Whether the sets of each pair (of places in row and size) can have a Jaccard similarity of `least`: False only if they can't.

    Every element that only one of the sets has turns one parity, so the sets differ by as many elements as parities, or more.
    flat, offsets: the parities, by row.
    """
    words, first = flat.view(np.uint64) if flat.flags.aligned and flat.ctypes.data % 8 == 0 else np.frombuffer(flat.tobytes(), np.uint64), offsets[:-1] // 8
    wide = np.diff(offsets) // 8
    n = size[pairs]
    both = n.min(1)  # shared elements at most
    ok = both >= least * (n.sum(1) - both)
    of = np.where(ok[:, None], wide[row[pairs]], 0)
    for wa, wb in np.unique(of[ok], axis=0).tolist():
        which, narrow = np.flatnonzero((of[:, 0] == wa) & (of[:, 1] == wb)), min(wa, wb)
        for a in range(0, len(which), step := max(1, (1 << 18) // max(wa, wb))):
            part = which[a : a + step]
            ends = []
            for k, w in enumerate((wa, wb)):
                sign = words[first[row[pairs[part, k]]][:, None] + np.arange(w)]
                ends.append(np.bitwise_xor.reduce(sign.reshape(len(part), w // narrow, narrow), axis=1))
            apart = np.bitwise_count(ends[0] ^ ends[1]).sum(1, dtype=np.int64)
            shared = np.minimum(both[part], (n[part].sum(1) - apart) // 2)
            ok[part] = shared >= least * (n[part].sum(1) - shared)
    return ok


def candidates(sketches: DataFrame, tables: int = TABLES, reach: int = 4, tree: bool = True, least: float = 0.8) -> DataFrame:
    """Pairs (a, b) of ids, a < b, to look at, with their `owner` (a or b) and `bits`, how far they are apart, staged. With `tree`, of each
    table the star of texts with one fingerprint and a tree of the links of fingerprints at most `reach` bits apart (see near_links);
    without, every pair of texts whose fingerprints are equal or at most `reach` bits apart.

    sketches: id, fps; ids differ. With a column `label`, pairs are between different labels only; with `size` and `parity`, pairs that
    these show to be less similar than `least` are left out; with `group` and `parts`, texts of a group, a number from 0 on, are known to
    have no link to others.
    """
    found, made, label = None, [], ["label"] if "label" in sketches.columns else []
    more = [x for x in ("label", "size", "parity", "group", "parts") if x in sketches.columns]
    count = sketches.count()
    large = not tree and ("group" not in more or sketches.filter(F.col("parts") > PARTS).limit(1).count() > 0)
    for t in range(tables):
        own = sketches.select("id", F.col("fps")[t].alias("fp"), *more)
        if not tree:
            rows = own if "group" in more else own.withColumns({"group": F.lit(0).cast("long"), "parts": F.lit(PARTS + 1).cast("long")})
            if large:
                rows = rows.filter(F.col("parts") <= PARTS).unionByName(by_blocks(rows.filter(F.col("parts") > PARTS), reach))
            links = near_links(rows, reach, count, least_lead=6, tree=False, least=least).select(F.col("a").alias("owner"), F.col("b").alias("other"), "bits")
            found = links if found is None else found.unionByName(links)
            continue
        stars = own.groupBy("fp").agg(F.min(F.struct("id", *more)).alias("star"), F.count(F.lit(1)).alias("n")).select("fp", "n", "star.*")
        links = staged(near_links(stars, reach, count, least_lead=6, tree=tree, least=least), "table-links")
        made.append(links)
        same = own.join(stars.filter("n > 1").select("fp", F.col("id").alias("other"), *[F.col(x).alias("of_other") for x in label]), "fp")
        same = (same.filter("label <> of_other") if label else same).select(F.col("id").alias("owner"), "other", F.lit(0).alias("bits"))
        both = same.unionByName(links.select(F.col("a").alias("owner"), F.col("b").alias("other"), "bits"))
        found = both if found is None else found.unionByName(both)
    pairs = found.filter("owner <> other").groupBy(F.least("owner", "other").alias("a"), F.greatest("owner", "other").alias("b"))
    pairs = staged(pairs.agg(F.min("bits").alias("bits"), F.min("owner").alias("owner")), "pairs")
    forget(*made)
    return pairs


def by_blocks(rows: DataFrame, reach: int = 4) -> DataFrame:
    """rows (fp, group, parts, more) once for each of reach + 1 blocks of the fingerprint's bits, with the number of their group and block for
    `group`, and as many `parts` as its rows need. Of two fingerprints at most `reach` bits apart one block is the same."""
    cuts = [64 * k // (reach + 1) for k in range(reach + 2)]
    blocks = F.array(*[F.xxhash64("group", F.lit(a), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << b - a) - 1))) for a, b in zip(cuts, cuts[1:])])
    dealt = rows.withColumn("group", F.explode(F.transform(blocks, lambda x: x.bitwiseAND(F.lit(2**63 - 1))))).drop("parts")
    parts = dealt.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / WHOLE).alias("parts"))
    return dealt.join(parts, "group").select(rows.columns)


#: Bits of the bitmap that `among` broadcasts: 2 MB, whatever the number of ids.
SLOTS = 1 << 24


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose `id` is one of ids (column id). Rows whose hash no id has go before the shuffle, so that hardly more travel than
    stay: at most 513 pieces of a bitmap of the ids' hashes are broadcast."""
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS))
    pieces = ids.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))
    placed = rows.withColumns({"_piece": F.bitmap_bucket_number(slot), "_bit": F.bitmap_bit_position(slot)}).join(F.broadcast(pieces), "_piece")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = placed.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0)
    return held.join(ids.select("id").distinct(), "id").select(rows.columns)  # a semi join would be moved before the bitmap's


def ends_of(pairs: DataFrame) -> DataFrame:
    """The ids that pairs (a, b) name, as `id`; an id may come more than once."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def similar_pairs(pairs: DataFrame, texts: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """Those of the pairs (a, b, and more columns) whose texts' sets of shingles have a Jaccard similarity of `least` or more.
    texts: id, text."""
    kept = pairs.columns

    def sets(column):
        for text in column:
            yield shingle_set(text.as_py(), width)

    def run(batches):
        for batch in batches:
            keep = []
            for one, other in zip(sets(batch.column("text_a")), sets(batch.column("text_b"))):
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(both >= least * (len(one) + len(other) - both))
            yield batch.select(kept).filter(pa.array(keep, pa.bool_()))

    out, texts = pairs, among(texts, ends_of(pairs))
    for end in ("a", "b"):
        out = out.join(texts.select(F.col("id").alias(end), F.col("text").alias(f"text_{end}")), end)
    return out.select(*kept, "text_a", "text_b").transform(mapped, run, pairs.schema)


#: Pairs of an owner that the first round compares, and how many times as many each later one.
FIRST_ROUND, GROWTH = 2, 8


def verified_components(pairs: DataFrame, texts: DataFrame, labels: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(node, label): the components that labels and the similar ones of the candidate pairs make. texts: id, text.

    Each round compares the nearest pairs of every owner, GROWTH times as many as the round before, then leaves out pairs whose ends
    are in one component by now. So every pair is compared unless its ends are known to be connected, and the result is that of
    comparing all. A round's links join the components there are, as single nodes. A hub's text meets its pairs in a join that
    adaptive plans split.
    """
    most = FIRST_ROUND
    while True:
        open_ = pairs
        for end in ("a", "b"):
            open_ = open_.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")), end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
        near = F.row_number().over(Window.partitionBy("owner").orderBy("bits", "a", "b"))
        open_ = staged(open_.filter("of_a <> of_b").withColumn("place", near), "open-pairs")
        chosen = open_.filter(F.col("place") <= most).select("a", "b", "of_a", "of_b")
        if not chosen.limit(1).count():
            return labels
        found = similar_pairs(chosen, texts, width, least)
        joined = staged(components(found.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))), "joined")
        moved = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = staged(moved.unionByName(joined.join(labels.select("node"), "node", "left_anti")), "labels")
        pairs, most = open_.filter(F.col("place") > most).select("a", "b", "bits", "owner"), most * GROWTH


def near_copies(sketches: DataFrame, texts: DataFrame, width: int = 5, least: float = 0.8, tables: int = TABLES) -> DataFrame:
    """(node, label): the components of the similar pairs among the candidates, as if each candidate had been compared.
    sketches: id, fps; texts: id, text.

    First the links of trees are compared. Where none of a tree's fails, those it left out lie within a component. The members of
    groups in which one failed are searched again, each text with its component and its parities, for every pair of texts within reach in
    two components that the parities leave open: most pairs there fail, and as many as the square of a group's members would be made of them.
    """
    pairs = candidates(sketches, tables)
    texts = staged(among(texts, ends_of(pairs)), "texts")  # no text but these is looked at again
    passed = similar_pairs(pairs.select("a", "b"), texts, width, least).withColumn("passed", F.lit(True))
    tried = staged(pairs.select("a", "b").join(passed, ["a", "b"], "left"), "tried")
    labels = staged(components(tried.filter("passed").select("a", "b")), "labels")
    failed = tried.filter("passed is null")
    if not failed.limit(1).count():
        return labels
    groups = staged(components(pairs.select("a", "b")), "groups")
    bad = groups.join(failed.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("label").distinct()
    sized = groups.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / WHOLE).alias("parts")).join(bad, "label", "left_semi")
    sized = sized.select("label", "parts", F.col("label").alias("group"))
    again = groups.join(sized, "label").select("node", "group", "parts").join(labels, "node", "left")
    again = again.select(F.col("node").alias("id"), F.coalesce("label", "node").alias("label"), "group", "parts")
    again = texts.join(staged(sketches.join(again, "id"), "again"), "id").transform(parities, width)
    more = candidates(staged(again, "again"), tables, tree=False, least=least)
    return verified_components(more.join(tried.select("a", "b"), ["a", "b"], "left_anti"), texts, labels, width, least)


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8, tables: int = TABLES) -> DataFrame:
    """docs without all but one row of each group of near copies: the one with the least doc_id (null last), whole, with all its columns.

    Two texts are near copies if their sets of `width`-word shingles have a Jaccard similarity of `least` or more; a group is what
    such links connect. Links are looked for among the pairs that ball hashing of `tables` fingerprints on VIEW-word shingles
    finds, and each is verified on the texts. Texts with the same words in order are copies; so are all texts without words, null ones
    too. Of rows with the least id the least by its hash stays, and of equal rows one. A row without an id, or with the id of
    another row, goes only if a row of its group stays. No rows: no rows. Columns may have any names. Long texts are taken whole.
    """
    others = [f"`{f.name}`" for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    held = staged(aside(docs, ["doc_id", "text"], _hash=F.xxhash64(*others), _row=F.monotonically_increasing_id()), "rows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_hash").alias("hash"), F.col("_row").alias("row"))
    rows = staged(held.select(place.alias("place"), "text").transform(sketched, VIEW, tables), "sketches")
    distinct = rows.groupBy("words").agg(F.min("place").alias("place"), F.min("place.row").alias("id"), F.first("fps").alias("fps"))
    distinct = staged(distinct, "distinct")  # one row for each sequence of words
    labels = near_copies(distinct.select("id", "fps"), held.select(F.col("_row").alias("id"), "text"), width, least, tables).withColumnRenamed("node", "id")
    group = F.coalesce("label", "id").alias("group")
    first = distinct.join(labels, "id", "left").groupBy(group).agg(F.min("place").alias("place"))
    gone = rows.select(F.col("place.row").alias("_row")).join(first.select(F.col("place.row").alias("_row")), "_row", "left_anti")
    return held.join(gone, "_row", "left_anti").select(put_back(held, docs.columns, ["doc_id", "text"]))
