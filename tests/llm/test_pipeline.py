"""Each stage of the pipeline on its own input against plain Python."""

import corpus_pipeline as p
from gridlake.llm import common


def test_stages(spark, sf):
    import re

    import public_tokenizers
    import tiktoken

    from gridlake.llm import bpe

    docs = common.documents(spark, sf)
    first = p.language_id(spark, docs, sf)
    assert first.columns == docs.columns
    got = {r[0] for r in first.select("doc_id").collect()}
    assert got <= {r["doc_id"] for r in docs.collect() if re.search(r"[^\W\d_]", r["text"] or "")} and docs.filter("lang is not null").count() - len(got) <= 10
    second = p.near_duplicates(spark, first, sf)
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    sets = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())(re.sub("[A-Z]", lambda m: m[0].lower(), t).split()) for i, t in texts.items()}
    label = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    want, kept = {i for i in texts if label[i] == i}, [r[0] for r in second.select("doc_id").collect()]
    assert second.columns == docs.columns and want <= set(kept) and len(kept) == len(set(kept)) <= len(want) + 1
    third = p.decontamination(spark, second, sf)
    passages = [r["text"].lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert third.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in third.collect()}
    for w in passages:
        if len(w) >= 10:
            assert not any(" ".join(w) in t.lower() for t in texts.values())
    fourth = p.personal_data(spark, third, sf)
    assert fourth.columns == docs.columns and not [r for r in fourth.collect() if re.search(r"[a-z]@[a-z0-9]+\.[a-z]", r["text"] or "")]
    last = p.tokens(spark, fourth, sf).collect()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(p.RANKS), special_tokens={})
    assert all(r["round_trip"] and r["ids"] == enc.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["ids"]) for r in last) and len(last) == fourth.count()
    assert p.run(spark, sf).count() == len(last)
