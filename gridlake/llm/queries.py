"""One query for each operator, on the whole table it is meant for, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, filter_audit, hamming, language, lm, pii, quality, sharding, simhash, spelling, token_counts
from .common import documents, in_test_part


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.remove_repeats(documents(spark, sf_dir))


def op3_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_simhash_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_language_bitmask_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", in_test_part(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op9_rank_synchronous_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_gated_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_naive_bayes_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", in_test_part(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def _placed_sql(node: sharding.Node) -> str:
    """SQL for the shard that column k reaches from the node."""
    if node.shard is not None:
        return str(node.shard)
    if len(node.children) == 1:
        return _placed_sql(node.children[0])
    waits = [f"-ln((cast(concat('0x', substr(md5(concat('{c.name}:', k)), 1, 13)) as bigint) + 0.5e0) / {float(1 << 52)!r}) / {c.weight!r}" for c in node.children]
    cases = " ".join(f"when {i} then {_placed_sql(c)}" for i, c in enumerate(node.children))
    return f"case list_position([{', '.join(waits)}], list_min([{', '.join(waits)}])) - 1 {cases} end"


def _op1_sql() -> str:
    table = "(select list_transform(range(16), lambda i: list_reduce(list_prepend(i, range(4)), lambda c, s: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t)"
    return f"""
    with nibbles as {table},
    d as (select doc_id, coalesce(cast(doc_id as varchar), 'null') as k, coalesce(text, '') as text from documents),
    coded as (
      select doc_id, k, hex(encode(text)) as h from d
    ),
    crc as (
      select doc_id, k, length(h) // 2 + 8 as size,
        xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h)), lambda i: strpos('0123456789ABCDEF', h[cast(xor(i, 1) as bigint) + 1]) - 1)),
          lambda c, x: xor(c // 16, t[cast(xor(c % 16, x) as bigint) + 1])), 4294967295) as text_crc32
      from coded, nibbles
    ),
    placed as (
      select doc_id, size, text_crc32, cast('0x' || substr(md5(k), 1, 7) as bigint) % 256 as bucket,
        {_placed_sql(sharding.tree_of(24))} as shard, {_placed_sql(sharding.tree_of(25))} as grown_shard
      from crc
    )
    select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'key' as law, cast(shard as int) as shard,
      cast(row_number() over (partition by shard order by bucket, doc_id, text_crc32, size) - 1 as bigint) as slot, cast(grown_shard as int) as grown_shard
    from placed"""


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = rf"""
with dw as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bwin as (select distinct item_id, least(10, len(w)) as m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from bw where len(w) > 0)),
dwin as (select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as win
  from (select doc_id, m, w, unnest(range(1, len(w) - m + 2)) as i from dw, (select distinct m from bwin) where len(w) >= m)),
hits as (select doc_id, item_id, i, m from dwin join bwin using (m, win)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from hits) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, cast(item_id as varchar) as s from hits) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join pos using (doc_id) left join its using (doc_id)"""


_CODE = " + ".join(f"(case when coalesce(embedding[{i + 1}], 0) > 0 then {1 << i}::uhugeint else 0 end)" for i in range(64))
_OP4 = f"""
with c as (select vec_id, cast({_CODE} as ubigint) as code from embeddings where embedding is not null),
d as (select q.vec_id as query_id, r.vec_id as neighbour_id, cast(bit_count(xor(q.code, r.code)) as int) as distance
  from c q join c r on q.vec_id % 50 = 0 and q.vec_id <> r.vec_id),
k as (select query_id, cast(row_number() over (partition by query_id order by distance, neighbour_id) as int) as rank, neighbour_id, distance from d)
select query_id, rank, neighbour_id, distance from k where rank <= 10"""


_OP11 = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select doc_id, part, text, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') as words from d),
firsts as (select text, min(doc_id) as least from d group by text),
f as (
  select doc_id, part,
    len(words) < 50 as a,
    100 * len(list_distinct(words)) < 65 * len(words) as b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) as c,
    regexp_matches(text, '[#$%&*|]') as d,
    coalesce(doc_id > least, false) as e
  from w join firsts using (text)
),
l as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
m as (
  select part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) as fails, count(*) as n,
    count(*) filter (good) as good, count(*) filter (toxic) as toxic
  from f left join l using (doc_id) group by all
),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select [p.x, q.x, r.x, s.x, t.x] as o from x p, x q, x r, x s, x t
  where q.x <> p.x and r.x not in (p.x, q.x) and s.x not in (p.x, q.x, r.x) and t.x not in (p.x, q.x, r.x, s.x)
),
steps as (select o, unnest(range(1, 6)) as step from orders),
s as (
  select part, array_to_string(o, '') as filter_order, step, o[step] as letter,
    sum(case when list_has_any(fails, o[:step]) then 0 else n end) as kept,
    sum(case when list_contains(fails, o[step]) and not list_has_any(fails, o[:step - 1]) then n else 0 end) as removed,
    sum(case when list_contains(fails, o[step]) and list_has_any(fails, o[:step - 1]) then n else 0 end) as redundant,
    sum(case when fails = [o[step]] then n else 0 end) as unique_fails,
    sum(case when list_contains(fails, o[step]) and not list_has_any(fails, o[:step - 1]) then good else 0 end) as good_lost,
    sum(case when list_contains(fails, o[step]) and not list_has_any(fails, o[:step - 1]) then toxic else 0 end) as toxic_lost
  from m, steps group by all
)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from s"""


_OP13 = rf"""
with recursive nibbles as (select list_transform(range(16), lambda i: list_reduce(list_prepend(i, range(4)), lambda c, s: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
runs as (
  select coalesce(cast(doc_id as varchar), '') as doc, {_LOWER.format("run")} as run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) as run from documents)
  where length(run) >= 7 group by all
),
coded as (select doc, run, n, hex(encode(doc || ':' || run)) as h from runs),
hashed as (
  select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h)), lambda i: strpos('0123456789ABCDEF', h[cast(xor(i, 1) as bigint) + 1]) - 1)),
    lambda c, x: xor(c // 16, t[cast(xor(c % 16, x) as bigint) + 1])), 4294967295) as crc
  from coded, nibbles
),
made as (select case when crc % 31 = 0 then substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) else run end as word, n from hashed),
words as (select word, cast(sum(n) as bigint) as n from made where length(word) >= 7 group by word having sum(n) >= 2),
cuts as (select word, n, substr(word, 1, i - 1) as a, substr(word, i + 1) as b from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
shorter as (select distinct c.word as longer, c.n as longer_n, w.word as shorter, w.n as shorter_n from cuts c join words w on w.word = c.a || c.b),
near as (
  select x.word, y.word as other, y.n as other_n from cuts x join cuts y on x.a = y.a and x.b = y.b and x.word <> y.word
  union all select longer, shorter, shorter_n from shorter
  union all select shorter, longer, longer_n from shorter
),
best as (select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word),
formed as (select word, n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * n then other end as form, case when other_n >= 10 * n then other_n end as form_n from words left join best using (word)),
follow as (
  select word, word as root, form as ahead from formed
  union all select f.word, f.ahead, g.form from follow f join formed g on g.word = f.ahead
)
select word, form, root, n, n_near, form_n from formed join (select word, root from follow where ahead is null) using (word)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_hash_tree_sharding": _op1_sql(), "op3_fm_index_decontamination": _OP3, "op4_multi_index_hamming": _OP4, "op11_filter_interaction_audit": _OP11, "op13_spelling_variants": _OP13}
