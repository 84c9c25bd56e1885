"""Columns of the user's own pass through every stage as they are, whatever their names, and odd rows have a defined result."""

import corpus_pipeline as p
import pytest
from gridlake.llm import bpe, language, pii, simhash

TEXT = "write to anna@example.org or call +1 415 555 2671 about the quiet harbour town and its old stone mill by the river"
NAMES = ["score", "lang_pred", "spans", "items", "words", "n_words", "n_hit", "ids", "decoded", "_key", "_spans", "_clean", "_rest", "_row", "_hash", "fp", "fps", "place", "Text2", "a b", "pii", "_pii_all", "_upto", "n_tokens", "round_trip", "SCORE2"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in NAMES) + ", m map<string,int>, l array<struct<`x y`:int>>"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [TEXT, TEXT, None, "", "!!! 123", TEXT + " and more words follow here so that it is another text of its own kind and length, long enough to stay", "x" * 10 + " the mill and the river by the town"]
    rows = [(i if i != 3 else None, t, "en", "s", len(t or ""), *[f"{n}{i}" for n in NAMES], {"k": i}, [(i,)]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


def held(rows, but=()):
    return {tuple(str(r[c]) for c in r.__fields__ if c not in but) for r in rows}


@pytest.mark.parametrize("stage", [s for s in p.STAGES[:-1]], ids=lambda s: s[0])
def test_stage_carries_columns(spark, sf, docs, stage):
    out = stage[1](spark, docs, sf)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got, want = held(out.collect(), ("text", "n_chars")), held(docs.collect(), ("text", "n_chars"))
    assert got and got <= want
    assert stage[1](spark, docs.limit(0), sf).count() == 0
    ids = {r["doc_id"] for r in out.collect()}
    if stage[0] == "language_id":
        assert ids == {0, 1, 5, 6}
    if stage[0] == "near_duplicates":
        assert ids == {0, 2, 4, 5, 6}  # texts without words are copies of each other
    if stage[0] == "personal_data":
        assert got == want and {r["text"] for r in out.collect() if r["doc_id"] == 0} == {TEXT.replace("anna@example.org", "[EMAIL]").replace("+1 415 555 2671", "[PHONE]")}
        assert all(r["n_chars"] == len(r["text"] or "") for r in out.collect())


def test_tokens_carry_columns(spark, sf, docs):
    out = p.tokens(spark, docs, sf)
    renamed = [f"docs_{c}" if c in ("ids", "n_tokens", "round_trip") else c for c in docs.columns]
    assert out.columns == [*renamed, "n_tokens", "ids", "round_trip"]
    rows = out.collect()
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert {(r["doc_id"], r["docs_ids"], r["decoded"], r["score"]) for r in rows} == {(r["doc_id"], r["ids"], r["decoded"], r["score"]) for r in docs.collect()}


def test_texts_longer_than_a_chunk(spark, sf):
    """A text above the bytes that a task takes at a time is worked on whole."""
    from gridlake.llm import common, exact_dedup, token_counts
    import public_tokenizers
    import random

    rng = random.Random(5)
    line = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    long = line + " " + " ".join(f"word{rng.randrange(5000)}" for _ in range(160_000)) + " +1 415 555 2671 " + line
    assert len(long) > common.CHUNK_BYTES
    df = spark.createDataFrame([(1, long, "en"), (2, line, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in exact_dedup.remove_repeats(df).collect()}
    assert got[1]["n_removed"] >= len(line) and got[2]["n_removed"] == len(line)
    assert bpe.round_trip(df, p.RANKS).count() == 2 and {r["n_bytes"] for r in token_counts.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json")).collect()} == {len(long), len(line)}
    assert {r["n_phone"] for r in pii.find_personal_data(df).collect()} == {0, 1}
    assert pii.redact(df).filter("doc_id = 1").first()["text"] == long.replace("+1 415 555 2671", "[PHONE]")
    assert simhash.keep_one(df).count() == 2 and language.keep_known(df).count() == 2


def test_a_megabyte_of_numbers_takes_seconds(spark):
    import time

    text = ",".join(str(1234567 + 7919 * i) for i in range(110_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.find_personal_data(df)
    began = time.time()
    assert found.count() == 1 and found.first()["n_card"] == 0
    assert time.time() - began < 60
