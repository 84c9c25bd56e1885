"""The stage that keeps one document of each component, where ids are missing or repeat."""

import random

import numpy as np
import pyarrow as pa

from gridlake.llm import simhash
from gridlake.llm.common import flat_text

A, B, C = ("one two three four five six seven eight", "rivers run slowly past the old stone mill", "copper wires hum above the empty winter road")
SCHEMA = "doc_id long, text string, source string"


def kept(spark, rows, parts=3):
    return sorted(map(tuple, simhash.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()), key=str)


def test_rows_without_id_are_no_duplicates(spark):
    assert kept(spark, [(None, A, "x"), (None, B, "x"), (None, C, "x")]) == sorted([(None, A, "x"), (None, B, "x"), (None, C, "x")], key=str)
    assert kept(spark, [(None, A, "x"), (7, A, "y"), (None, A, "x"), (None, B, "x")]) == sorted([(7, A, "y"), (None, B, "x")], key=str)


def test_repeated_ids_with_other_texts_stay(spark):
    rows = [(1, A, "x"), (1, B, "x"), (1, C, "x"), (2, B, "x")]
    assert kept(spark, rows) == sorted(rows[:3], key=str)


def test_one_row_of_equal_ones_and_always_the_same(spark):
    rows = [(1, A, "x"), (1, A, "y"), (1, A, "x"), (2, None, "x"), (2, "", "x")]
    first = kept(spark, rows)
    assert len(first) == 2 and all(kept(spark, rows[::-1], n) == first for n in (1, 4))


def group_of(n, seed, changes):
    """Near copies of one text of 200 words, each with up to `changes` words of its own."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(i % (changes + 1)):
            words[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_a_large_group_is_the_same_for_any_number_of_partitions(spark):
    texts = group_of(250, 1, 2) + group_of(60, 2, 12) + [f"{t} {i}" for i, t in enumerate(group_of(40, 3, 1))]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    found = kept(spark, rows, 3)
    assert found == kept(spark, rows, 11)
    stay = {d for d, _, _ in found}
    assert {0, 250, 310} <= stay and len(stay) < 100


def test_what_trees_leave_out_is_found_as_if_every_pair_were_compared(spark):
    texts = group_of(120, 4, 5) + group_of(30, 5, 14) + group_of(30, 6, 1)
    table = spark.createDataFrame(list(enumerate(texts)), "id long, text string").persist()
    sketches = simhash.sketched(table).select("id", "fps").persist()
    pairs = simhash.candidates(sketches, tree=False).persist()
    assert pairs.filter("a >= b or (owner <> a and owner <> b) or bits > 4").count() == 0
    assert simhash.candidates(sketches).count() < pairs.count()
    at_once = simhash.components(simhash.similar_pairs(pairs.select("a", "b"), table))
    want = {tuple(r) for r in at_once.collect()}
    assert {tuple(r) for r in simhash.near_copies(sketches, table).collect()} == want and len(want) > 20
    assert simhash.near_copies(sketches.limit(0), table).count() == 0


def test_links_between_labels_only(spark):
    rows = [(0, 1), (1, 1), (3, 2), (1 << 20, 3)]
    found = simhash.near_links(spark.createDataFrame(rows, "fp long, label long"), tree=False).collect()
    of = dict(rows)
    assert found and all(of[r["a"]] != of[r["b"]] for r in found)


def test_parities_leave_every_similar_pair(spark):
    rng = np.random.default_rng(3)
    sets = [np.zeros(0, np.uint64)]
    for n in (1, 7, 31, 40, 130, 900, 1100):
        base = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        sets += [np.unique(np.concatenate((base[: n - cut], base[n : n + new]))) for cut in (0, n // 9, n // 8, n // 3) for new in (0, n // 9, n // 5)]
    flat, offsets = flat_text(pa.array([simhash.parity_of(x) for x in sets], pa.binary()))
    pairs = np.array([(a, b) for a in range(len(sets)) for b in range(len(sets))])
    may = simhash.may_be_similar(flat, offsets, np.arange(len(sets)), np.array([len(x) for x in sets]), pairs, 0.8)
    shared = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in pairs])
    either = np.array([len(np.union1d(sets[a], sets[b])) for a, b in pairs])
    assert may[shared >= 0.8 * either].all()
    assert not may[shared < 0.6 * either].any()


def test_links_of_a_large_group_of_unlike_texts_are_not_written_out(spark):
    """Near fingerprints, and hardly two texts that are similar: nearly all links between them would fail."""
    texts = [(i, i, [1 << i % 40], t) for i, t in enumerate(group_of(1600, 7, 15)[15::16])]
    sketches = spark.createDataFrame(texts, "id long, label long, fps array<long>, text string")
    open_ = simhash.candidates(sketches.drop("text"), 1, tree=False).filter("bits > 0")
    left = simhash.candidates(sketches.transform(simhash.parities), 1, tree=False).filter("bits > 0")
    similar = {(r["a"], r["b"]) for r in simhash.similar_pairs(open_.select("a", "b"), sketches.select("id", "text")).collect()}
    found = {(r["a"], r["b"]) for r in left.collect()}
    assert similar <= found and len(found) * 10 < open_.count()


def test_rows_among_ids(spark):
    rows = spark.range(0, 60000, 1, 5).selectExpr("id * 8589934592 div 7 - 100 as id", "cast(id as string) as text").persist()
    ids = rows.sample(0.1, 1).select("id").persist()
    want = {r["id"] for r in ids.collect()}
    got = simhash.among(rows, ids.union(ids).union(spark.createDataFrame([(5,)], "id long"))).collect()
    assert len(got) == len(want) and {r["id"] for r in got} == want and got[0].asDict().keys() == {"id", "text"}
    assert not simhash.among(rows, ids.limit(0)).count()


def written(spark):
    """Bytes of shuffles that the application has written so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_of_no_candidate_are_not_shuffled(spark):
    rng = random.Random(9)
    far = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(1500)) for _ in range(600)]
    table = spark.createDataFrame(list(enumerate(group_of(30, 8, 8) + far)), "id long, text string").persist()
    sketches = simhash.sketched(table).select("id", "fps").persist()
    sketches.count()
    key = "spark.sql.autoBroadcastJoinThreshold"
    before, at = spark.conf.get(key), written(spark)
    spark.conf.set(key, -1)
    try:
        assert simhash.near_copies(sketches, table).count() > 1
    finally:
        spark.conf.set(key, before)
    assert written(spark) - at < 0.5 * sum(map(len, far))


def test_groups_are_dealt_whole_and_linked_as_if_by_leading_bits(spark):
    rng = np.random.default_rng(6)
    rows = []
    for group in range(40):
        base = int(rng.integers(0, 2**62))
        rows += [(len(rows) + k, group * 1000 if group % 4 else None, sum(1 << int(b) for b in rng.integers(0, 62, 3)) ^ base) for k in range(12)]
    table = spark.createDataFrame(rows, "id long, own long, fp long").persist()
    links = lambda t: {(r["a"], r["b"], r["bits"]) for r in simhash.near_links(t, tree=False).collect()}
    assert links(table.selectExpr("id", "fp", "own as group")) == links(table.select("id", "fp")) != set()
    apart = spark.createDataFrame([(0, 1, 5), (1, 2, 7), (2, 2, 15)], "id long, group long, fp long")
    assert {frozenset(x[:2]) for x in links(apart)} == {frozenset((1, 2))}


def test_parts_of_a_group_meet_and_every_pair_is_compared(spark):
    rng = np.random.default_rng(8)
    fps = sorted({sum({1 << int(b) for b in rng.integers(0, 40, 4)}) for _ in range(300)})
    want = {(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4}
    for parts in (1, 2, 7, 20):
        table = spark.createDataFrame([(k, fp, k % 5 and 9, parts) for k, fp in enumerate(fps)], "id long, fp long, group long, parts long")
        found = [(max(r["a"], r["b"]), min(r["a"], r["b"])) for r in simhash.near_links(table, tree=False).collect()]
        assert len(found) == len(set(found)) and set(found) == {(a, b) for a, b in want if (a % 5 == 0) == (b % 5 == 0)}


def test_texts_of_a_large_group_are_sent_once_for_each_part(spark, monkeypatch):
    sent, plain = [], simhash.mapped

    def mapped(df, run, schema):
        out = plain(df, run, schema)
        if run.__name__ == "emit" and "parity" in out.columns:
            sent.append((df.count(), out.count()))
        return out

    monkeypatch.setattr(simhash, "mapped", mapped)
    table = spark.createDataFrame(list(enumerate(group_of(240, 4, 30))), "id long, text string").persist()
    sketches = simhash.sketched(table).select("id", "fps").persist()
    whole = {tuple(r) for r in simhash.near_copies(sketches, table).collect()}
    monkeypatch.setattr(simhash, "WHOLE", 80)
    assert {tuple(r) for r in simhash.near_copies(sketches, table).collect()} == whole
    assert len(sent) == 16 and all(0 < a <= b <= 3 * a for a, b in sent) and max(b / a for a, b in sent) > 1


def test_leading_bits_follow_memory_alone():
    sent = [simhash._sent(simhash.leading_bits(n, 2, 6), 2) for n in (50_000, 250_000, 15_000_000)]
    assert sent[0] == sent[1] == 22 and sent[2] < 60


def test_texts_of_one_fingerprint_are_compared_with_each_other(spark, monkeypatch):
    """A text unlike the others has the least id of a fingerprint that two copies share, and one of a fingerprint nearby."""
    near, far = group_of(3, 11, 2), group_of(1, 12, 0) + group_of(1, 13, 0)
    table = spark.createDataFrame(list(enumerate([far[0], *near[:2], far[1], near[2]])), "id long, text string")
    sketches = spark.createDataFrame([(0, [0]), (1, [0]), (2, [0]), (3, [7]), (4, [7])], "id long, fps array<long>")
    want = {(1, 1), (2, 1), (4, 1)}
    assert {tuple(r) for r in simhash.near_copies(sketches, table, tables=1).collect()} == want
    monkeypatch.setattr(simhash, "WHOLE", 1)
    monkeypatch.setattr(simhash, "PARTS", 2)
    assert {tuple(r) for r in simhash.near_copies(sketches, table, tables=1).collect()} == want


def test_every_pair_of_a_group_dealt_by_blocks_is_compared(spark, monkeypatch):
    rng = np.random.default_rng(10)
    fps = [sum({1 << int(b) for b in rng.integers(0, 40, 4)}) - (1 << 63) * int(k % 2) for k in range(300)] + [5, 5, 5]
    want = {(a, b) for b in range(len(fps)) for a in range(b) if ((fps[a] ^ fps[b]) & 2**64 - 1).bit_count() <= 4}
    sketches = spark.createDataFrame([(k, [fp]) for k, fp in enumerate(fps)], "id long, fps array<long>")
    monkeypatch.setattr(simhash, "WHOLE", 40)
    found = simhash.candidates(sketches, 1, tree=False).collect()
    assert {(r["a"], r["b"]) for r in found} == want and len(found) == len(want)
