"""The queries of this subpackage's operators over their whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, knn, minhash, mixing, pii, sharding, token_counts, toxicity, url_filter
from .common import table

#: Bytes of text in a shard, at most.
SHARD_BYTES = 16 << 20


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of offending sentences of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score_documents(docs, model, columns=["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))  # a null id has no label to learn
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    return embed_dedup.link_embeddings(table(spark, sf_dir, "embeddings"), 0.93)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False, columns=["doc_id"])


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document by extendible hashing of its id, of at most SHARD_BYTES of text."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARD_BYTES)


def _shards_sql(limit: int, deepest: int = 16) -> str:
    levels = " union all ".join(f"select doc_id, n_bytes, bits, {d} as depth, bits >> {sharding.BITS - d} as prefix from d" for d in range(deepest + 1))
    return f"""
with d as (
  select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as bits
  from documents),
l as ({levels}),
s as (select depth, prefix, sum(n_bytes)::bigint as shard_bytes, count(*) as shard_rows from l group by depth, prefix),
f as (
  select doc_id, n_bytes, bits, prefix, depth, shard_bytes, shard_rows,
         row_number() over (partition by doc_id, n_bytes, bits order by depth) as k
  from l join s using (depth, prefix) where shard_bytes <= {limit} or shard_rows <= 1)
select doc_id, n_bytes,
       case when depth = 0 then '' else right(bin(bits | (1::bigint << 60)), 60)[1:depth] end as shard,
       depth::int as depth, shard_bytes, shard_rows
from f where k = 1"""


def shards_of_64k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with shards so small that small tables split, too."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 64 << 10)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the ten best candidates of every hundredth vector."""
    return knn.top_k(table(spark, sf_dir, "embeddings"), 10, 100, 1024)


TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as x
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.x::double[], c.x::double[])::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as k from s)
select query_id, k::int as rank, vec_id, score from r where k <= 10"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048, columns=["doc_id"])


def bytes_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op6: doc_id and n_bytes."""
    return op6_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def round_trip_of_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op3: the hash of the decoded bytes is that of the text."""
    return op3_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), "source", mixing.word_count("text").alias("size"))
    out = mixing.mix_copies(mixing.stored(rows, "words"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def targets_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the mix that SQL can express: each source's size and target."""
    docs = table(spark, sf_dir, "documents")
    sizes = docs.groupBy("source").agg(F.sum(mixing.word_count("text")).alias("source_size"))
    return mixing.source_targets(mixing.stored(sizes, "sizes")).select("source", "source_size", F.round("target", 4).alias("target"))


#: The water level: each source in turn is full, or the rest is shared by weight.
TARGETS_SQL = r"""
with s as (select source, sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0))::bigint as source_size from documents group by source),
w as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w, 1.5::double * sum(source_size) over () as total from s),
c as (select *, 2.0::double * source_size as cap, 2.0::double * source_size / w as level from w),
l as (select a.level, (any_value(a.total) - sum(case when b.level < a.level then b.cap else 0 end)) / nullif(sum(case when b.level >= a.level then b.w else 0 end), 0) as water from c a cross join c b group by a.level),
m as (select arg_min(water, level) as water from l where water <= level)
select source, source_size, round(least(cap, coalesce(water * w, cap)), 4) as target from c, m"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with surrogates, their number and places, of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs).select("doc_id", "text", F.size("pii").alias("n_entities"), "pii")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def rules_of_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the url filter that SQL can express: page_id, host, path and rule."""
    parts = table(spark, sf_dir, "pages").select("page_id", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    return parts.withColumn("rule", url_filter.rule_of(F.col("host"), F.col("path")))


RULES_SQL = r"""
with u as (select page_id, case when contains(url, '://') then regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) else '' end as h,
                  case when contains(url, '://') then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end as path from pages),
p as (select page_id, translate(coalesce(h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce(path, '') as path from u),
r as (select * from (values ('com/'), ('example.com/en/'), ('www.example.com/en/'), ('net/es/'), ('net/fr/')) t(rule)),
f as (select page_id, host, path, arg_max(rule, len(rule)) as rule from p, r
      where (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, rule[len(split_part(rule, '/', 1)) + 1:]) group by all)
select page_id, host, path, rule from p left join f using (page_id, host, path)"""


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, component_id and kept of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


LINKS_SQL = """
with recursive v as (
  select distinct vec_id, label, embedding::double[] as x from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0),
n as (select vec_id, label, x, sqrt(list_inner_product(x, x)) as size from v where list_inner_product(x, x) > 0),
l as (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.93),
r as (select distinct vec_id as node, vec_id as low from embeddings where vec_id is not null union select l.a, r.low from r join l on l.b = r.node)
select node as vec_id, (select count(*) from l where a = node) as n_links, min(low) as component_id, min(low) = node as kept from r group by node"""


#: All pairs that share a shingle, with exact document frequencies.
NEAR_SQL = r"""
with recursive t as (select doc_id, text, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents where doc_id is not null and text is not null),
k as (select text, min(doc_id) as rep, count(*) as copies, any_value(w) as w from t where len(w) > 0 group by text),
s as (select rep, copies, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as shingle from (select *, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from k)),
f as (select rep, shingle, any_value(copies) as copies, count(*) as tf from s group by all),
d as (select shingle, sum(copies) as df from f group by 1),
n as (select sum(copies) as n from k),
x as (select rep, shingle, pow(2, round_even(16 * log2((1 + ln(tf)) * (1 + 0.5 / 255 * round_even(255 * least(1, greatest(0, ln(greatest(df / n, pow(2, -12))) / ln(pow(2, -12)))), 0))), 0) / 16) as weight from f join d using (shingle), n),
m as (select rep, sum(weight) as total from x group by 1),
p as (select a.rep as a, b.rep as b, sum(least(a.weight, b.weight)) as common from x a join x b on a.shingle = b.shingle and a.rep < b.rep group by all),
l as (select a, b from p join m ma on ma.rep = a join m mb on mb.rep = b where common / (ma.total + mb.total - common) >= 0.8
  union select k.rep, t.doc_id from t join k on t.text = k.text and t.doc_id <> k.rep),
e as (select a, b from l union select b, a from l),
r as (select distinct doc_id as node, doc_id as low from documents where doc_id is not null union select e.a, r.low from r join e on e.b = r.node)
select node as doc_id, min(low) as component_id, min(low) = node as kept from r group by node"""


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_embedding_dedup, op3_bpe, op4_sharding, op5_topk, op6_token_counts, op7_mixing, op8_pii, op9_urls, op10_minhash, shards_of_64k, targets_of_sources, rules_of_urls, bytes_of_texts, round_trip_of_bpe)}
ORACLES = {
    "shards_of_64k": _shards_sql(64 << 10, 20), "targets_of_sources": TARGETS_SQL, "rules_of_urls": RULES_SQL,
    "bytes_of_texts": "select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes from documents",
    "round_trip_of_bpe": "select doc_id, sha256(coalesce(text, '')) as decoded_sha256 from documents",
    "op2_embedding_dedup": LINKS_SQL, "op4_sharding": _shards_sql(SHARD_BYTES), "op5_topk": TOPK_SQL, "op10_minhash": NEAR_SQL,
}
