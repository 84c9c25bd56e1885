"""The text operators against plain Python, on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridlake.llm import bpe, common, decontaminate, exact_dedup, gru, hamming, language, lm, pii, pretokens, sharding, simhash, token_counts

random.seed(11)
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = "the of and tion ing er on an re he in ed nd ha at en es or ti hi as to".split()


def prose(n: int) -> str:
    return " ".join("".join(random.choices(WORDS, k=random.randint(1, 3))) for _ in range(n))


LINE = prose(40)
ODD = [
    None, "", " ", "x", "ñ", "日本語テキスト 😀😀", "ab" * 700, "é" * 300, "\x00\x01 a\x85b", "A B C D E", LINE, LINE, prose(3000) + " " + LINE, LINE + " " + prose(30), "<|endoftext|>x<|endoftext|>",
    "a@b.com_x@y.zz 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111, +1 (415) 555-2671 DE89 3704 0044 0532 0130 00", "'s't're I'll don't", "1" * 500,
]
TEXTS = ODD + [prose(random.randint(1, 120)) + (" " + LINE if i % 3 == 0 else "") for i in range(120)]


@pytest.fixture(scope="module")
def docs(spark):
    langs = ["en", "de", None]
    rows = [(i, t, langs[i % 3], f"src{i % 2}", len(t or ""), i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score int").repartition(5).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# sharding


def test_shards(docs, empty):
    rows = sharding.shard_documents(docs).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(TEXTS)}
    assert all(r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24 for r in rows) and any(r["grown_shard"] == 24 for r in rows)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.shard_documents(empty).count() == 0
    twice = sharding.shard_documents(docs.union(docs)).collect()
    assert len({(r["shard"], r["slot"]) for r in twice}) == 2 * len(TEXTS)


def test_growth_moves_rows_only_into_the_new_shard(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"))
    for n in (24, 25, 30):
        both = sharding.place(sharding.place(ids, n), n + 1, into="grown").collect()
        moved = [r for r in both if r["shard"] != r["grown"]]
        assert all(r["grown"] == n for r in moved) and abs(len(moved) - 4000 / (n + 1)) < 60


def test_weights_decide_shares(spark):
    count = Counter(r[0] for r in sharding.place(spark.range(12000).select(F.col("id").alias("doc_id")), 24).select("shard").collect())
    assert len(count) == 24 and max(count.values()) < 620 and min(count.values()) > 390


# exact substrings


def repeats(docs_, width=100):
    seen, out = set(), {}
    for d, t in docs_:
        raw = (t or "").encode()
        hit = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            w = raw[p : p + width]
            if w in seen:
                hit[p : p + width] = b"\1" * width
            seen.add(w)
        out[d] = (len(raw), sum(hit), sum(1 for i, h in enumerate(hit) if h and not (i and hit[i - 1])), sha(bytes(b for b, h in zip(raw, hit) if not h)))
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_exact_repeats(docs, empty, hot, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    want = repeats(enumerate(TEXTS))
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.remove_repeats(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 5000
    assert exact_dedup.remove_repeats(empty).count() == 0
    twice = sorted(map(tuple, exact_dedup.remove_repeats(docs.union(docs)).collect()))
    assert twice == sorted((d, *w) for d, w in want.items() for _ in range(2))


def test_family_merges_in_any_order():
    segs = [(d, lo, t.encode()) for d, t in enumerate(TEXTS) if t and len(t.encode()) >= 100 for lo in (0,)]
    random.shuffle(segs)
    family = exact_dedup.Family(100)
    for a in range(0, len(segs), 7):
        part = segs[a : a + 7]
        flat, offsets = common.flat_text(pa.array([s[2] for s in part], pa.binary()))
        family.add(*(np.array(x, np.int64) for x in ([s[0] for s in part], [0] * len(part), [s[1] for s in part], [len(s[2]) - 99 for s in part])), flat, offsets)
    assert max(family.levels) > 1  # batches have met in levels
    doc, _, lo, hi = family.finish()
    removed = Counter()
    for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist()):
        removed[d] += b - a
    assert removed == Counter({d: v[1] for d, v in repeats(enumerate(TEXTS)).items() if v[1]})


def test_windows_stand_in_the_order_of_their_bytes():
    rng = np.random.default_rng(8)
    for letters, width in ((2, 13), (3, 100), (2, 8), (200, 20)):
        flat = rng.integers(0, letters, 3000).astype(np.uint8)
        flat[1500:2100] = flat[200:800]
        at = rng.permutation(len(flat) - width + 1)
        digest = common.span_hashes(common.prefix_sums(flat), at, at + width)
        order, head = exact_dedup.alphabetical(flat, at, digest, width)
        windows = [flat[p : p + width].tobytes() for p in at[order].tolist()]
        assert windows == sorted(windows) and head[1:].tolist() == [a != b for a, b in zip(windows, windows[1:])]
        order, head = exact_dedup.alphabetical(flat, at, np.zeros(len(at), np.uint64), width)  # one digest for all: bytes still tell
        tied = [flat[p : p + width].tobytes() for p in at[order].tolist()]
        assert all(a == b for a, b, h in zip(tied, tied[1:], head[1:]) if not h)


# decontamination


def test_contamination(spark, docs, empty):
    items = [(7, LINE), (70, " ".join(LINE.split()[5:20])), (8, "ñ"), (9, None), (10, ""), (11, prose(50)), (12, "A b C"), (7, LINE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = word(lower(t))
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    sizes = sorted({len(w) for w in windows})
    want = {}
    for d, t in enumerate(TEXTS):
        w = word(lower(t))
        hit, ids = set(), set()
        for k in range(len(w)):
            for m in sizes:
                if k + m <= len(w) and tuple(w[k : k + m]) in windows:
                    ids |= windows[tuple(w[k : k + m])]
                    hit |= set(range(k, k + m))
        want[d] = (len(w), len(hit), sorted(ids))
    for block in (16 << 20, 200):  # in one block, and block by block
        found = decontaminate.find_contamination(docs, bench, block_bytes=block)
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found.collect()} == want
    assert sum(bool(v[1]) for v in want.values()) > 30
    assert decontaminate.find_contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(empty, bench).count() == 0
    left = decontaminate.remove_contamination(docs, bench)
    assert left.columns == docs.columns and not [r for r in left.collect() if LINE in (r["text"] or "")]
    clean = {d for d, v in want.items() if not v[1]}
    assert {(r["doc_id"], r["text"]) for r in left.collect() if r["doc_id"] in clean} == {(d, TEXTS[d]) for d in clean}


def test_fm_index_finds_all(spark):
    rng = np.random.default_rng(3)
    symbols = np.append(rng.integers(0, 5, 400), 0)  # runs end with a separator
    index = decontaminate.FMIndex(symbols, 4)
    padded = np.array([[a, b, c] for a in range(1, 5) for b in range(1, 5) for c in range(5)])
    lengths = (padded > 0).sum(1)
    low, high = index.search(padded, lengths)
    for p, m, a, b in zip(padded.tolist(), lengths.tolist(), low.tolist(), high.tolist()):
        want = [i for i in range(len(symbols) - m + 1) if symbols[i : i + m].tolist() == p[:m]]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# Hamming search


@pytest.mark.parametrize("rows, dims", [(900, 64), (60, 64), (300, 8)])
def test_nearest_codes(spark, rows, dims):
    rng = np.random.default_rng(rows)
    base = rng.standard_normal((rows, dims))
    base[rows // 3 : 2 * rows // 3] = base[0]  # a third of all rows alike
    data = [(int(i), [float(x) for x in v], "other") for i, v in enumerate(base)] + [(rows, None, "x"), (rows + 50, [], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, distance string").repartition(4)
    code = {i: sum(1 << k for k in range(64) if k < len(v) and v[k] > 0) for i, v, _ in data if v is not None}
    want = set()
    for q in [i for i in code if i % 50 == 0]:
        near = sorted(((code[q] ^ code[i]).bit_count(), i) for i in code if i != q)[:10]
        want |= {(q, n + 1, i, d) for n, (d, i) in enumerate(near)}
    assert {tuple(r) for r in hamming.top_k(df).collect()} == want
    assert hamming.top_k(df.limit(0)).count() == 0


# SimHash


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h))


def closure(fps, reach):
    label = {f: f for f in fps}

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    order = sorted(fps)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= reach:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {f: root(f) for f in fps}


def test_near_duplicates(docs, empty):
    fp = {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}
    roots = closure(set(fp.values()), 4)
    least: dict[int, int] = {}
    for i, f in sorted(fp.items(), reverse=True):
        least[roots[f]] = i
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f, least[roots[f]]) for i, f in fp.items()}
    assert simhash.near_duplicates(empty).count() == 0


def shingles(t, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def test_one_of_each_group_of_near_copies(spark, docs, empty):
    words = prose(400).split()
    near = []
    for i in range(40):  # a copy with each of 1 to 40 words changed: similarity from 0.97 down to below 0.4
        copy = list(words)
        for k in range(i + 1):
            copy[9 * k + 3] = f"zz{i}q{k}"
        near.append((1000 + i, " ".join(copy), None, "near", 0, 0))
    rows = docs.union(spark.createDataFrame(near, docs.schema)).persist()
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                label[max(root(a), root(b))] = min(root(a), root(b))
    want = {i for i in texts if root(i) == i}
    kept = simhash.keep_one(rows.union(docs))
    got = sorted(r["doc_id"] for r in kept.collect())
    assert kept.columns == docs.columns and len(got) == len(set(got))
    assert want <= set(got) and len(set(got) - want) <= 1  # a link may be out of reach; none is made that isn't one
    assert simhash.keep_one(empty).count() == 0


def test_links_of_close_codes(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    codes = set(base.tolist())
    for b in base.tolist():
        for _ in range(6):
            b ^= sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False))
            codes.add(b)
    df = spark.createDataFrame([(c - 2**64 if c >= 2**63 else c,) for c in codes], "fp long")
    links = simhash.near_links(df)
    assert links.filter("bit_count(a ^ b) > 4").count() == 0
    found = {r["node"] % 2**64: r["label"] for r in simhash.components(links).collect()}
    want = closure(codes, 4)
    for a in codes:
        same = {b for b in codes if want[b] == want[a]}
        assert ({b for b in found if found[b] == found[a]} == same) if len(same) > 1 else a not in found


# tokens


def test_bpe(docs, empty):
    ranks = bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["ids"] for r in bpe.encode(docs, RANKS).select("doc_id", "ids").collect()} == want
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip(docs, RANKS).collect()}
    assert got == {i: (len(x), sha(",".join(map(str, x))), sha(TEXTS[i] or "")) for i, x in want.items()}
    assert bpe.round_trip(empty, RANKS).count() == 0
    back = bpe.decode(bpe.encode(docs, RANKS), RANKS).select("doc_id", "decoded", "score").collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_replay_defers_to_lower_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 290, b"cb": 310, b"abcb": 280}
    enc = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(random.choices("abc", k=random.randint(1, 12))) for _ in range(300)]
    ids, sizes = bpe.replay([w.encode() for w in words], bpe.Ranks(ranks))
    ends = np.cumsum(sizes)
    assert [ids[e - s : e].tolist() for s, e in zip(sizes, ends)] == [enc.encode_ordinary(w) for w in words]


def test_split_is_the_pattern():
    import regex

    texts = [t or "" for t in TEXTS] + ["".join(random.choices("ab1 \n\t's're日😀½.!\u0085 ́", k=random.randint(1, 60))) for _ in range(400)]
    flat, offsets = common.flat_text(pa.array(texts))
    first, rows = pretokens.split(flat, offsets)
    raw, ends = flat.tobytes(), np.append(first[1:], len(flat))
    got = [[] for _ in texts]
    for a, b, r in zip(first.tolist(), ends.tolist(), rows.tolist()):
        got[r].append(raw[a:b].decode())
    assert got == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


def test_token_counts(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    want = {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    rows = token_counts.count_tokens(docs, path).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows} == {i: (len((t or "").encode()), want[i], want[i] > 512) for i, t in enumerate(TEXTS)}
    assert token_counts.count_tokens(empty, path).count() == 0


# language


def test_language(spark, docs, empty):
    de = "der die und nicht ein ich auf mit sich auch dem den von ist".split()
    rows = [(i, " ".join(random.choices(de if i % 2 else "the of and that with for was his they".split(), k=random.randint(3, 80))), "de" if i % 2 else "en", "x") for i in range(300)]
    rows += [(1000, None, "de", "x"), (1001, "123 !!", "de", "x"), (1002, "", None, "x"), (1003, "ß", None, "x"), (1003, "ß", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    f = language.fit(df)
    got = language.identify(df, f)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    told = {r["doc_id"]: r for r in got.collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and np.mean([told[i]["lang_pred"] == told[i]["lang"] for i in held]) > 0.98
    assert all(told[i]["lang_pred"] == "und" and told[i]["score"] == 0 for i in (1000, 1001, 1002)) and told[1003]["lang_pred"] in ("de", "en")
    assert all(0 <= r["score"] <= 1 for r in told.values()) and got.count() == len(rows)
    assert language.identify(empty, language.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, language.fit(empty)).collect()} == {"und"}
    f = language.fit(docs)
    plain = {i: plain_language(t, f) for i, t in enumerate(TEXTS)}
    for r in language.identify(docs.drop("score"), f).collect():
        assert r["lang_pred"] == plain[r["doc_id"]][0] and r["score"] == pytest.approx(plain[r["doc_id"]][1], abs=1e-9)
    assert {r["doc_id"] for r in language.keep_known(docs).collect()} == {i for i, (p, s) in plain.items() if p != "und" and (s > 0 or len(TEXTS[i].encode()) < 4)}


def plain_language(t, f):
    """One text at a time, with a filter for each language as a set of slots."""
    raw = lower(t).encode()
    if not re.search(r"[^\W\d_]", t or ""):
        return "und", 0.0
    grams = [raw[k : k + 4] for k in range(len(raw) - 3)]
    rest = []
    for i in range(len(f.languages)):
        found = 0
        for g in grams:
            at = [int(x[0]) for x in language.probes(np.array([int.from_bytes(g, "little")], np.uint32))]
            found += all(int(f.slots[i // 64][p]) >> (i % 64) & 1 for p in at)
        rest.append(min(1.0, max(0.0, (found / max(1, len(grams)) - f.false_rate[i]) / (1 - f.false_rate[i]))))
    best = rest.index(max(rest)) if max(rest) > 0 else f.usual
    return f.languages[best], rest[best] / max(sum(rest), 1e-12)


def test_filters_hold_what_was_learned(spark, docs):
    """Counts, choice and false-positive rates from plain counting."""
    f = language.fit(docs, kept=50)
    own = [(lang, t) for i, t in enumerate(TEXTS) if t is not None and (lang := ["en", "de", None][i % 3]) and zlib.crc32(str(i).encode()) % 4 != 2]
    counts = {x: Counter(raw[k : k + 4] for lang, t in own if lang == x for raw in [lower(t).encode()] for k in range(len(raw) - 3)) for x in ("de", "en")}
    total = {x: sum(c.values()) for x, c in counts.items()}
    for i, x in enumerate(f.languages):
        other = "en" if x == "de" else "de"
        good = [g for g, n in counts[x].items() if n > 1 and 2 * n / total[x] >= counts[other][g] / total[other]]
        value = {g: int.from_bytes(g, "little") for g in good}
        best = sorted(good, key=lambda g: (-counts[x][g], value[g]))[:50]
        slots = {int(p[0]) for g in best for p in language.probes(np.array([value[g]], np.uint32))}
        assert set(np.flatnonzero((f.slots[0] >> np.uint64(i)) & np.uint64(1)).tolist()) == slots
        assert f.false_rate[i] == pytest.approx((len(slots) / language.SLOTS) ** language.PROBES)


def test_samples_are_never_empty(spark, docs):
    ids = spark.range(20000).select(F.col("id").alias("doc_id"))
    assert common.least_hashed(ids, 7, "doc_id").count() == 7 and common.least_hashed(ids, 30000, "doc_id").count() == 20000
    few = spark.range(20000).select((F.col("id") % 3).alias("doc_id"))  # three ids, so most shares of the hashes hold none
    assert common.least_hashed(few, 7, "doc_id").select("doc_id").distinct().count() == 1
    assert language.sample_of(docs, sample=5).count() == 5 and len(language.fit(docs, sample=5).languages) > 0
    twice = docs.select(F.lit(None).cast("long").alias("doc_id"), "text", "lang")
    assert language.sample_of(twice, sample=5).count() == 1


def test_held_out_languages(spark, sf):
    from gridlake.llm import queries

    told = queries.op7_language_bitmask_filters(spark, sf).filter("held_out").join(common.documents(spark, sf).select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred <> 'und'").collect()
    assert len(told) > 30 and sum(r["lang"] == r["lang_pred"] for r in told) >= 0.97 * len(told)


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((int(x) * 2 - 9 if int(x) > 4 else int(x) * 2) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for o, (k, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[k]:
                out.append((m.start(), o, k, m.end()))
    return sorted(out)


def test_personal_data(spark, empty):
    bits = ["a", "@", ".", "b.com", "+1", "1", "23", "456", "-", " ", "é", "😀", "_", "%", "4111111111111111", "1.2.3.4", "(", ")", "255", "IBAN DE89370400440532013000"]
    texts = TEXTS + ["".join(random.choices(bits, k=random.randint(1, 40))) for _ in range(600)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    for r in pii.find_personal_data(df).collect():
        want = base_spans(texts[r["doc_id"]])
        listed = [f"{k}:{a}:{b}" for a, _, k, b in want]
        assert r["base_sha256"] == sha(",".join(listed)) and [r[f"n_{k}"] for k in BASE] == [sum(x[2] == k for x in want) for k in BASE]
        assert set(listed) <= set(filter(None, r["spans"].split(","))) and all(0 < s <= 1 for s in r["scores"])
    assert pii.find_personal_data(empty).count() == 0
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(pii.find_personal_data(df)._jdf.queryExecution(), "simple")
    assert "Python" not in plan and "Arrow" not in plan
    clean = pii.redact(df)
    assert clean.columns == df.columns
    for r in clean.collect():
        t = texts[r["doc_id"]]
        assert r["text"] == t if not base_spans(t) and "DE89" not in (t or "") and "+1" not in (t or "") and "4111" not in (t or "") else r["text"] != t or not base_spans(t)


def test_checksums(spark):
    r = spark.range(1).select(pii.luhn(F.lit("4111111111111111")), pii.luhn(F.lit("4111111111111112")), pii.mod97(F.lit("DE89370400440532013000")), pii.mod97(F.lit("DE88370400440532013000"))).first()
    assert tuple(r) == (True, False, True, False)


# language model


def test_scores(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 40)  # so that some words are joined
    monkeypatch.setattr(lm, "CLASSES", 5)
    monkeypatch.setattr(lm, "CLASS_SIZE", 6)  # so that some words of the head are unknown to the network
    learned, fit = {}, lm.fit
    monkeypatch.setattr(lm, "fit", lambda parts, vocabulary, words: learned.setdefault("net", fit(parts, vocabulary, words)))
    rows = lm.score_documents(docs).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None]
    c = Counter(w for i, t in enumerate(TEXTS) if zlib.crc32(str(i).encode()) % 10 for w in words(t))
    n, v = sum(c.values()), len(c)
    head = sorted((w for w in c if w is not None and len(w.encode()) <= lm.HEAD_BYTES), key=lambda w: (-c[w], w.encode()))[:28]
    number = {None: 0} | {w: i + 2 for i, w in enumerate(head)}
    rest = n + 0.1 * (v + 1) - sum(c[w] + 0.1 for w in [*head, None])
    net = {k: x.astype(np.float64) for k, x in learned["net"].p.items()}

    def plain(t):
        """The recurrence and both softmaxes one word at a time."""
        h, before, out, u = np.zeros(24), 0, 0.0, net["U"]
        sigmoid = lambda x: 1 / (1 + np.exp(-x))
        for w in words(t):
            x, k = net["X"][before] + net["b"], number.get(w, 1)
            z, r = sigmoid(x[:24] + h @ u[:, :24]), sigmoid(x[24:48] + h @ u[:, 24:48])
            h = (1 - z) * np.tanh(x[48:] + r * (h @ u[:, 48:])) + z * h
            kinds, slots = np.exp(h @ net["C"] + net["c"]), np.exp(h @ net["W"][k // 6] + net["w"][k // 6])
            out += math.log10(kinds[k // 6] / kinds.sum() * slots[k % 6] / slots.sum()) + (math.log10((c[w] + 0.1) / rest) if k == 1 else 0)
            before = k
        return out

    for r in rows:
        assert r["score"] == pytest.approx(plain(TEXTS[r["doc_id"]]), rel=2e-4, abs=2e-3)
    assert sorted(r["doc_id"] for r in rows) == list(range(len(TEXTS)))
    for r in rows:
        w = words(TEXTS[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) and r["score"] < 0
    assert lm.score_documents(empty).count() == 0


def test_network_learns_and_sums_to_one():
    rng = np.random.default_rng(2)
    texts = [np.array([*np.tile([2, 3, 4], int(rng.integers(2, 9))), 0]) for _ in range(60)]
    net = gru.Network.fresh(np.bincount(np.concatenate(texts), minlength=6).astype(float), 3, 2, 8)
    flat, at = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    before, memory = net.score(flat, at).sum(), None
    for _ in range(6):
        memory = net.train(flat, memory, streams=8, rate=0.03)
    assert memory["seen"] == 6 * len(flat)
    assert net.score(flat, at).sum() > before / 2
    h = rng.standard_normal((5, 8)).astype(np.float32)
    total = sum(np.exp(net.log_probabilities(h, np.full(5, w))[0]) for w in range(6))
    assert np.allclose(total, 1, atol=1e-5)
    whole = net.score(flat, at, window=32)
    assert np.allclose(whole, net.score(flat, at, window=5), atol=1e-3)  # the state is carried


def test_gradients_are_those_of_the_loss():
    """Each weight's gradient against differences of the log probability, over one window with ends of texts in it."""
    rng = np.random.default_rng(4)
    tokens = rng.integers(0, 6, 24)
    net = gru.Network.fresh(np.ones(6), 3, 2, 4)
    net.p = {k: rng.standard_normal(v.shape) * 0.5 for k, v in net.p.items()}

    def loss(p):
        own = gru.Network(3, 2, 4, p)
        h, total = np.zeros((1, 4)), 0.0
        for before, t in zip([0, *tokens[:-1]], tokens):
            h = h * (before != 0)
            h, _ = own.step((p["X"] + p["b"])[[before]], h)
            k, s = np.exp(h @ p["C"] + p["c"])[0], np.exp(h @ p["W"][t // 2] + p["w"][t // 2])[0]
            total -= math.log(k[t // 2] / k.sum() * s[t % 2] / s.sum())
        return total / len(tokens)

    seen = {}
    own = gru.Network(3, 2, 4, {k: v.copy() for k, v in net.p.items()})
    memory = own.train(tokens, {"turn": 0, "seen": 0} | {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}, window=24, streams=1, rate=0)
    for name, v in net.p.items():
        for at in list(np.ndindex(v.shape))[:: max(1, v.size // 12)]:
            up, down = ({k: x.copy() for k, x in net.p.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            want = (loss(up) - loss(down)) / 2e-5
            seen[name] = max(seen.get(name, 0), abs(want))
            assert memory[name][0][at] * 10 == pytest.approx(want, rel=1e-3, abs=1e-5), (name, at)  # the first moment is a tenth of it
    assert all(seen.values())
