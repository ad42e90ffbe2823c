"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, lattice, lm, packing, repeats, secrets, simhash, topk, toxicity
from .common import held_out, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. Null and empty texts: no ids. Repeated rows each give a row, an empty table none."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a piece. Null and empty texts are one piece of one id. Repeated rows are packed each, an empty table gives none."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. Texts without words, null ones too, are one component. Null ids count last; an empty table gives none."""
    return simhash.simhash_report(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. Null texts and texts without a letter: ``und`` and 0. Rows without an id aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~held_out("doc_id", 4)).select("doc_id", "text", "lang"))
    return language.predict(docs, model, held_out("doc_id", 4).alias("held_out"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. Null texts: empty. Repeated rows are copies of each other; an empty table gives none."""
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector. Null, zero and non-finite vectors and rows without an id link with nothing; an empty table gives none."""
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. Null texts: empty, with a score. Rows without an id aren't held out; an empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, model, held_out("doc_id", 4).alias("held_out"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. Null texts: one end. Rows without an id aren't held out; an empty table gives none."""
    return lm.score(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five rows a query. Null and non-finite vectors take no part; repeated rows are repeated candidates and one query."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. Null texts: no spans. Repeated rows each give a row, an empty table none."""
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_best_fit_packing, op3_simhash, op4_language_id, op5_suffix_dedup, op6_embedding_dedup, op7_toxicity, op8_lm_score, op9_exact_topk, op10_secret_scan)}


#: Every 400-byte string as hex; starts of those that occur twice make up the removed runs, what lies between is kept.
_OP5 = """with d as (select row_number() over () as r, doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
w as (select r, s, md5(substring(h, 2 * s + 1, 800)) as k from (select r, unnest(range(0, length(h) // 2 - 399)) as s, h from d)),
m as (select r, s from (select r, s, count(*) over (partition by k) as n from w) where n > 1),
i as (select r, s, sum(new) over (partition by r order by s) as run from (select r, s, case when s - lag(s) over (partition by r order by s) <= 400 then 0 else 1 end as new from m)),
x as (select r, min(s) as b, max(s) + 400 as e from i group by r, run),
y as (select r, b, e, lag(e, 1, 0) over (partition by r order by b) as before from x),
z as (select r, count(*) as n_spans, sum(e - b) as n_removed, max(e) as last from y group by r),
k as (select r, string_agg(substring(h, 2 * before + 1, 2 * (b - before)), '' order by b) as kept from y join d using (r) group by r)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join z using (r) left join k using (r)"""
_FINITE = "vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0"
_OP6 = f"""with recursive u as (select vec_id, [x::double for x in embedding] as e from embeddings where {_FINITE} and len([x for x in embedding if x <> 0]) > 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
p as (select a, b from l union select p.a, l.b from p join l on p.b = l.a),
n as (select a, count(*) as n from l group by a), o as (select a, min(b) as b from p group by a)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, least(v.vec_id, coalesce(o.b, v.vec_id))::bigint as component_id, v.vec_id <= coalesce(o.b, v.vec_id) as kept
from embeddings v left join n on n.a = v.vec_id left join o on o.a = v.vec_id"""
_OP9 = f"""with v as (select vec_id, [floor(256 * x::double) for x in embedding] as e from embeddings where {_FINITE}),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5"""


def oracle_sql() -> dict[str, str]:
    """Plain SQL for what DuckDB can say, over all strings or pairs: cheap at small scale only.

    Tokenizers, trained models, XXH64 and window entropies are beyond it; tests hold those against brute force.
    """
    return {"op5_suffix_dedup": _OP5, "op6_embedding_dedup": _OP6, "op9_exact_topk": _OP9}
