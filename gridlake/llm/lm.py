"""Language-model scores of whole documents: a gated recurrent network over frequent words, unigram counts for the others.

The counts of all training words are gathered by a shuffle. The network's vocabulary is the most frequent words; another word's
probability is the network's for UNKNOWN times the word's share of the rest by counts. Counts of HEAD words go to
all tasks, a bounded table; those of other words come by a join on the word, and nothing is left out.

The network is trained on every training document, each once: a round takes its share of them, deals them to replicas that start
from the same network, and averages what they have learned. The number of replicas grows with the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, chunks, distinct_spans, flat_text, in_test_part, mapped, prefix_sums, ragged, slices, span_hashes, spans_differ, staged, words_of
from .gru import END, UNKNOWN, Network

CLASSES, CLASS_SIZE, HIDDEN = 32, 32, 24
#: Frequent words whose counts are broadcast, of so many bytes each at most; longer and rarer words are joined.
HEAD, HEAD_BYTES = 1 << 16, 64
#: Rounds of training, replicas in a round at least, and training tokens of a replica; tokens it trains on at a time.
ROUNDS, REPLICAS, REPLICA_TOKENS, TRAIN_TOKENS = 2, 6, 1 << 24, 1 << 19
#: Tokens that are scored side by side.
SCORE_TOKENS = 2 << 20


def _words(flat: np.ndarray, offsets: np.ndarray):
    low = LOWER[flat]
    return low, *words_of(low, offsets, NOT_SPACE)


def _strings(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    at = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(low[ragged(starts, size)].tobytes())])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts of docs."""

    def count(batches):
        for batch in batches:
            for _, flat, offsets in chunks(batch):
                low, starts, ends, _ = _words(flat, offsets)
                one, kind = distinct_spans(low, starts, ends)
                n = np.bincount(kind, minlength=len(one))
                yield pa.RecordBatch.from_arrays([_strings(low, starts[one], ends[one]), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select("text").transform(mapped, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Vocabulary:
    """Head words by hash, most frequent first, with counts; the first of them are the network's."""

    def __init__(self, words: list[str], counts: np.ndarray, ends: int):
        self.flat = np.frombuffer("".join(words).encode(), np.uint8)
        size = np.array([len(w.encode()) for w in words], np.int64)
        self.to = np.cumsum(size)
        self.at = self.to - size
        code = span_hashes(prefix_sums(self.flat), self.at, self.to) if len(words) else np.zeros(0, np.uint64)
        order = np.argsort(code)
        self.code, self.place, self.counts, self.ends = code[order], order, counts, ends
        # where codes of each leading bits begin, sixteen times as many as there are codes: few steps from there to any code
        self.shift = np.uint64(64 - min(24, 4 + max(1, len(words).bit_length())))
        self.begin = np.searchsorted(self.code, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift).astype(np.int32)
        self.known = min(len(words), CLASSES * CLASS_SIZE - 2)

    def places(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's place in the head, or -1. A hash finds it, bytes decide; of head words with one hash the first is found, and
        the others count as words outside of the head."""
        out = np.full(len(starts), -1)
        if not len(self.code) or not len(starts):
            return out
        code = span_hashes(prefix_sums(low), starts, ends)
        last = len(self.code) - 1
        at = np.minimum(self.begin[(code >> self.shift).astype(np.int64)], last)
        behind = np.flatnonzero((self.code[at] < code) & (at < last))
        while len(behind):
            at[behind] += 1
            behind = behind[(self.code[at[behind]] < code[behind]) & (at[behind] < last)]
        may = np.flatnonzero(self.code[at] == code)
        place = self.place[at[may]]
        unlike = spans_differ(low, starts[may], ends[may], self.flat, self.at[place], self.to[place])
        out[may] = np.where(unlike, -1, place)
        return out

    def tokens(self, flat: np.ndarray, offsets: np.ndarray):
        """Network tokens of all rows, END after each, with offsets; and the words' places, rows and spans."""
        low, starts, ends, rows = _words(flat, offsets)
        place = self.places(low, starts, ends)
        n = len(offsets) - 1
        words = np.bincount(rows, minlength=n)
        at = np.concatenate(([0], np.cumsum(words + 1)))
        out = np.full(int(at[-1]), END)
        out[np.arange(len(rows)) + rows] = np.where((place >= 0) & (place < self.known), place + 2, UNKNOWN)
        return out, at, place, rows, low, starts, ends


MODEL = "part int, salt int, seen long, flat binary"
#: Weights of a model that travel as one row.
MODEL_PART = 4096


def _model_rows(parts: dict[int, np.ndarray], seen: int, salt: int):
    for part, flat in parts.items():
        columns = [pa.array([part], pa.int32()), pa.array([salt], pa.int32()), pa.array([seen], pa.int64()), pa.array([flat.astype(np.float64).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "salt", "seen", "flat"])


def _replica(batches, net: Network, rate: float, salt: int):
    """Sums of weights times tokens seen, in parts, after one pass over the task's texts in their order."""
    own = Network(net.classes, net.size, net.hidden, {k: v.copy() for k, v in net.p.items()})
    memory, held, waiting = None, [], 0
    for batch in batches:
        flat, offsets = flat_text(batch.column(batch.schema.get_field_index("tokens")))
        for a, b in slices(offsets, 2 * TRAIN_TOKENS):
            held.append(flat[offsets[a] : offsets[b]].view(np.uint16))
            waiting += len(held[-1])
            if waiting >= TRAIN_TOKENS:
                memory, held, waiting = own.train(np.concatenate(held), memory, rate=rate), [], 0
    if waiting:
        memory = own.train(np.concatenate(held), memory, rate=rate)
    if memory:
        whole = np.concatenate([own.p[k].reshape(-1) for k in Network.SHAPES]).astype(np.float64) * memory["seen"]
        yield from _model_rows({i: whole[a : a + MODEL_PART] for i, a in enumerate(range(0, len(whole), MODEL_PART))}, memory["seen"], salt)


def _summed(batches):
    """Rows of the same part added up, one after the other."""
    sums: dict[int, list] = {}
    for batch in batches:
        for part, salt, seen, flat in zip(*[batch.column(c).to_pylist() for c in ("part", "salt", "seen", "flat")]):
            had = sums.setdefault(part, [0, 0.0, salt])
            had[0] += seen
            had[1] = had[1] + np.frombuffer(flat)
    for part, (seen, flat, salt) in sums.items():
        yield from _model_rows({part: flat}, seen, salt)


def fit(parts: DataFrame, vocabulary: Vocabulary, words: int) -> Network:
    """The network after ROUNDS of averaged replicas. parts: row, held_out, tokens; words: of the training texts."""
    counts = np.concatenate(([vocabulary.ends, words - vocabulary.counts[: vocabulary.known].sum()], vocabulary.counts[: vocabulary.known]))
    net = Network.fresh(counts, CLASSES, CLASS_SIZE, HIDDEN)
    train = parts.filter(~F.col("held_out"))
    replicas = max(REPLICAS, -(-(words + vocabulary.ends) // (ROUNDS * REPLICA_TOKENS)))
    for turn in range(ROUNDS):
        now, rate = parts.sparkSession.sparkContext.broadcast(net), 0.008 / (turn + 1)

        def learn(batches):
            from pyspark import TaskContext

            return _replica(batches, now.value, rate, TaskContext.get().partitionId() % 64)

        own = train.filter(F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == turn).select("row", "tokens")
        learned = own.repartition(replicas, "row").sortWithinPartitions("row").transform(mapped, learn, MODEL)
        for keys in (["part", "salt"], ["part"]):
            learned = learned.repartition(*keys).transform(mapped, _summed, MODEL)
        rows = sorted(learned.collect(), key=lambda r: r["part"])  # one model
        if not rows:
            continue
        mean = np.concatenate([np.frombuffer(r["flat"]) / r["seen"] for r in rows]).astype(np.float32)
        at, weights = 0, {}
        for k in Network.SHAPES:
            weights[k] = mean[at : at + net.p[k].size].reshape(net.p[k].shape).copy()
            at += net.p[k].size
        net = Network(CLASSES, CLASS_SIZE, HIDDEN, weights)
    return net


PARTS = "doc_id long, held_out boolean, tokens binary, n_tokens long, known long, head double, n_unknown long, head_unknown double, rest array<struct<word:string,n:int>>"


def _parts(batches, vocabulary: Vocabulary):
    """A row's tokens, what its scores are made of as far as the head goes, and the row's other words."""
    log_head = np.log10(vocabulary.counts + 0.1)
    for batch in batches:
        for part, flat, offsets in chunks(batch):
            tokens, at, place, rows, low, starts, ends = vocabulary.tokens(flat, offsets)
            n = len(part)
            in_head, unknown = place >= 0, (place < 0) | (place >= vocabulary.known)
            value = np.where(in_head, log_head[np.maximum(place, 0)] if len(log_head) else 0.0, 0.0)
            add = lambda w, which: np.bincount(rows[which], weights=None if w is None else w[which], minlength=n)
            out = np.flatnonzero(~in_head)
            kind = distinct_spans(low, starts[out], ends[out])[1]
            by = np.lexsort((kind, rows[out]))
            order, kind = out[by], kind[by]
            first = np.ones(len(order), bool)
            first[1:] = (kind[1:] != kind[:-1]) | (rows[order][1:] != rows[order][:-1])
            heads = np.flatnonzero(first)
            one, times = order[heads], np.diff(np.append(heads, len(order)))
            lists = np.searchsorted(rows[one], np.arange(n + 1)).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([_strings(low, starts[one], ends[one]), pa.array(times.astype(np.int32))], names=["word", "n"]))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    part.column("held_out"),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * 2).astype(np.int32).tobytes()), pa.py_buffer(tokens.astype(np.uint16).tobytes())]),
                    pa.array(np.diff(at)),
                    pa.array((add(None, in_head) + (vocabulary.ends > 0)).astype(np.int64)),
                    pa.array(add(value, in_head) + math.log10(vocabulary.ends + 0.1), pa.float64()),
                    pa.array(add(None, unknown).astype(np.int64)),
                    pa.array(add(value, in_head & unknown).astype(np.float64)),
                    rest,
                ],
                names=["doc_id", "held_out", "tokens", "n_tokens", "known", "head", "n_unknown", "head_unknown", "rest"],
            )


def _scored(batches, net: Network):
    """(row, net): the network's log10 probability of each row's tokens; rows are taken together until they have SCORE_TOKENS."""
    held, waiting = [], 0

    def close():
        table = pa.Table.from_batches(held)
        flat, offsets = flat_text(table.column("tokens"))
        score = net.score(flat.view(np.uint16), offsets // 2) / math.log(10)
        return pa.RecordBatch.from_arrays([table.column("row").combine_chunks(), pa.array(score, pa.float64())], names=["row", "net"])

    for batch in batches:
        held.append(batch)
        waiting += len(flat_text(batch.column(batch.schema.get_field_index("tokens")))[0]) // 2
        if waiting >= SCORE_TOKENS:
            yield close()
            held, waiting = [], 0
    if held:
        yield close()


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities) of each row.

    Learns from rows whose crc32 of doc_id modulo 10 is not 0. Null and empty texts have one token, the end. Equal rows are each
    scored; no rows: no rows. Only doc_id and text are read. Without training rows counts are 0 and the network keeps its start. A
    text is scored whole, however long; memory grows with the longest.
    """
    rows = docs.select("doc_id", "text", in_test_part(F.col("doc_id"), 10, 0).alias("held_out"))
    train = rows.filter(~F.col("held_out"))
    counts = staged(word_counts(train), "word-counts")
    ends = train.select("doc_id").count()
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    words, kinds = int(sums["n"] or 0), int(sums["v"]) + (ends > 0)
    total = words + ends
    top = counts.filter(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("c"), "word").limit(HEAD).toArrow()  # HEAD rows at most
    vocabulary = Vocabulary(top.column("word").to_pylist(), top.column("c").to_numpy().astype(np.float64), ends)
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast(vocabulary)
    parts = rows.transform(mapped, lambda b: _parts(b, held.value), PARTS)
    parts = staged(parts.withColumn("row", F.monotonically_increasing_id()), "lm-parts")
    net = fit(parts, vocabulary, words)
    model = sc.broadcast(net)
    rest = parts.select("row", F.explode("rest").alias("w")).select("row", "w.word", "w.n")
    seen = rest.join(counts, "word", "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"))
    tail = seen.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.1)).alias("tail"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    scored = parts.select("row", "tokens").transform(mapped, lambda b: _scored(b, model.value), "row long, net double")
    all_mass = total + 0.1 * (kinds + 1)
    own_mass = float((vocabulary.counts[: vocabulary.known] + 0.1).sum()) + (ends + 0.1 if ends else 0.0)
    rest_mass = max(all_mass - own_mass, 0.1)
    both = parts.drop("rest", "tokens").join(scored, "row").join(tail, "row", "left")
    extra = F.coalesce("tail", F.lit(0.0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head") + extra - F.col("n_tokens") * math.log10(all_mass)).alias("base_score"),
        (F.col("net") + F.col("head_unknown") + extra - F.col("n_unknown") * math.log10(rest_mass)).alias("score"),
    )
