"""Two different words whose sums are equal modulo 2^64 for every odd base: each operator tells them apart."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from gridlake.llm import bpe, common, decontaminate, exact_dedup, lm, token_counts

T = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
U = T.translate(str.maketrans("ab", "ba"))
TEXTS = [T, U, f"{T} and {U}", f"x {U} {T} {U}", f"{U} {U}", T + U, U + T, f"{T} y " * 3]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).persist()


def spans(*words):
    flat = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return flat, ends - np.array([len(w) for w in words]), ends


def test_the_words_have_one_hash_and_are_two_kinds():
    flat, starts, ends = spans(T, U, T, U, "z", U)
    code = common.span_hashes(common.prefix_sums(flat), starts, ends)
    assert code[0] == code[1] and code[0] != code[4]
    one, kind = common.distinct_spans(flat, starts, ends)
    assert len(one) == 3 and kind[0] == kind[2] != kind[1] == kind[3] == kind[5] and (kind[one] == np.arange(3)).all()


def test_tokens(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = {r["doc_id"]: r for r in bpe.round_trip(docs, path).collect()}
    for i, t in enumerate(TEXTS):
        ids = coder.encode_ordinary(t)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and rows[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(TEXTS, add_special_tokens=False)]
    assert [r["n_tokens"] for r in token_counts.count_tokens(docs, path).sort("doc_id").collect()] == want


def test_passages(spark, docs):
    items = spark.createDataFrame([(1, U), (2, f"{T} and"), (3, "z")], "item_id long, text string")
    rows = decontaminate.find_contamination(docs, items).sort("doc_id").collect()
    assert [r["items"] for r in rows] == [[k for k, p in (("1", [U]), ("2", [T, "and"])) if any(t.split()[i : i + len(p)] == p for i in range(len(t.split())))] for t in TEXTS]
    assert [r["n_hit"] for r in rows] == [0, 1, 3, 2, 2, 0, 0, 0]


def test_words(docs):
    counts = {r["word"]: r["c"] for r in lm.word_counts(docs).collect()}
    assert counts == Counter(w for t in TEXTS for w in t.split())
    vocabulary = lm.Vocabulary([T, "and"], np.array([2.0, 1.0]), 1)
    assert vocabulary.places(*spans(T, U, "and", "x")).tolist() == [0, -1, 1, -1]
    rows = next(lm._parts(docs.selectExpr("*", "false as held_out").toArrow().to_batches(), vocabulary))
    rest = rows.column("rest").to_pylist()
    assert [{x["word"]: x["n"] for x in r} for r in rest] == [dict(Counter(w for w in t.split() if w not in (T, "and"))) for t in TEXTS]


def test_repeats(docs):
    seen, want = set(), []
    for t in TEXTS:
        raw, covered = t.encode(), bytearray(len(t))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                covered[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        want.append(sum(covered))
    assert [r["n_removed"] for r in exact_dedup.remove_repeats(docs).sort("doc_id").collect()] == want


def test_spans_are_compared_to_their_last_byte():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("ab"), n)) for n in (0, 1, 7, 8, 9, 15, 16, 17, 18, 40, 3000) for _ in range(6)]
    words += [w[:i] + "c" + w[i + 1 :] for w in words for i in {0, len(w) // 2, len(w) - 1} if 0 <= i < len(w)]
    flat, starts, ends = spans(*words)
    a, b = (x.reshape(-1) for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    want = np.array([words[i] != words[j] for i, j in zip(a, b)])
    assert (common.spans_differ(flat, starts[a], ends[a], flat, starts[b], ends[b]) == want).all()
    assert (common.spans_differ(flat, starts[a], ends[a], flat.copy(), starts[b], ends[b]) == want).all()
