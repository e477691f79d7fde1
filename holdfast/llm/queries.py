"""Registered queries of the subpackage: production parameters, whole tables, thin digests. SQL beside them where it can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, exact_dedup, hard_negatives, html_text, jaccard_join, marked_words, mixing, packing, pii, quality, topk, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return register


def vocabulary() -> str:
    import public_tokenizers

    return bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


#: Sources are evened out to 99 % of the largest entropy, none is repeated above four times, as many tokens as there are.
MIX = mixing.Mix(entropy=0.99, passes=4.0, budget=1.0, seed=1)


@query("op1_mixing", r"""
with recursive t as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '\S+')), 0) as n, case when source is null then '' else '=' || source end as k, coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, '')) as tag from documents),
tot as (select k, count(*) as cnt, sum(n) as tokens from t group by k),
w as (select ln(tokens / (select cast(sum(tokens) as double) from tot)) as lp, ln(tokens) as lt from tot where tokens > 0),
arr as (select list(lp) as lps, list(lt) as lts, list(struct_pack(lp := lp, lt := lt)) as s, count(*) as c, (select sum(tokens) from tot) as total from w),
ends as (select (-list_sum(list_transform(lps, lambda x: exp(x) * x))) >= 0.99 * ln(c) - 1e-12 as whole,
  total / c * list_max(list_transform(lts, lambda x: exp(-x))) > 4 as above from arr),
be(i, lo, hi) as (select 0, 0::double, 1::double union all
  select i + 1, case when ok then mid else lo end, case when ok then hi else mid end from (
    select i, lo, hi, (lo + hi) / 2 as mid, ln(list_sum(list_transform(lps, lambda x: exp((lo + hi) / 2 * x))))
      - list_sum(list_transform(lps, lambda x: exp((lo + hi) / 2 * x) * (lo + hi) / 2 * x)) / list_sum(list_transform(lps, lambda x: exp((lo + hi) / 2 * x))) >= 0.99 * ln(c) - 1e-12 as ok
    from be, arr where i < 32)),
bp(i, lo, hi) as (select 0, 0::double, 1::double union all
  select i + 1, case when ok then mid else lo end, case when ok then hi else mid end from (
    select i, lo, hi, (lo + hi) / 2 as mid, total * list_max(list_transform(s, lambda x: exp((lo + hi) / 2 * x.lp - x.lt))) / list_sum(list_transform(lps, lambda x: exp((lo + hi) / 2 * x))) > 4 as ok
    from bp, arr where i < 32)),
a as (select greatest(case when whole then 1 else floor((select lo from be where i = 32) * 1e6) / 1e6 end,
  case when above then least(1, ceil((select lo from bp where i = 32) * 1e6) / 1e6) else 0 end) as a from ends),
src as (select k, cnt, case when tokens > 0 then exp(a * ln(tokens / total::double)) / z else 0 end as weight,
    case when tokens > 0 then round(exp(a * ln(tokens / total::double) - ln(tokens)) * (total / z), 6) else 1 end as repeats, greatest(1, cnt // 2048) as blocks
  from (select tot.*, a.a, arr.total, list_sum(list_transform(lps, lambda x: exp(a.a * x))) as z from tot, a, arr)),
part as (select t.k, md5('1:' || floor(repeats)::int || ':' || tag) as key, n, blocks, repeats - floor(repeats) as part from t join src using (k)),
run as (select *, cast('0x' || substr(key, 1, 8) as bigint) % blocks as block from part where part > 0),
lasts as (select k, block, max(key) as last from (
    select *, coalesce(sum(n) over (partition by k, block order by key, n rows between unbounded preceding and 1 preceding), 0) + n / 2 <= part * sum(n) over (partition by k, block) as used from run)
  where used group by k, block),
times as (select t.*, src.weight, src.blocks, floor(repeats)::int + case when exists (
    select 1 from lasts where lasts.k = t.k and lasts.block = cast('0x' || substr(md5('1:' || floor(repeats)::int || ':' || tag), 1, 8) as bigint) % src.blocks
      and md5('1:' || floor(repeats)::int || ':' || tag) <= lasts.last) then 1 else 0 end as times
  from t join src using (k)),
uses as (select doc_id, source, k, tag, weight, n, blocks, unnest(range(times))::int as epoch from times),
keyed as (select *, md5('1:' || epoch || ':' || tag) as key from uses),
placed as (select *, cast('0x' || substr(key, 1, 8) as bigint) % blocks as block from keyed)
select doc_id, source, round(weight, 6) as weight, n as n_tokens, epoch, block, row_number() over (partition by k, epoch, block order by key, n) as place from placed""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"), MIX)


@query("op2_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents")).drop("set_key")


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op4_exact_dedup", """
with t as (select doc_id, coalesce(text, '') as text from documents),
g as (select text, max(doc_id) as keep_id, count(*) as group_size from t group by text)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(text) as text_sha256 from t join g using (text)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_packed_ids")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = packing.tokenizer_from(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, spark)
    rows = packing.pack(table(spark, sf_dir, "documents"), tokenizer, size=2048, pad=50256)
    return rows.select("doc_ids", "parts", "lengths", F.col("n_tokens").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


@query("op7_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary())


@query("op8_exact_topk", """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_sentencepiece")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return marked_words.encode_digests(table(spark, sf_dir, "documents"), marked_words.read_model(public_tokenizers.path("piece_bpe_32k.model")))


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations"))))


@query("op13_hard_negatives", """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_inner_product(a.v, c.v) as bigint) as score
  from v a join v c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
    cast(row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as int) as rank
  from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
