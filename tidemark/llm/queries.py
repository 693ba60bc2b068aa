"""Registered queries of the subpackage: one per numbered operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import config_packing, cover_search, hidden_markov, minhash_components, order_minhash, passage_dedup, periodic_runs, pii_spans, quality_fm, raking, secret_cnn, spelling_variants, warc_archives
from tidemark.llm.texts import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.repeats(read(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare(read(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_cnn.find(read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_search.top_k(read(spark, sf_dir, "embeddings"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.language_scores(read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_packing.pack(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans.find(read(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components.components(read(spark, sf_dir, "documents"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.weights(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(read(spark, sf_dir, "documents"), divisor=199)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs(read(spark, sf_dir, "documents"), edited=True)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archives.round_trip(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_repeated_passages": op1_repeated_passages,
    "op2_fingerprints": op2_fingerprints,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_top_k": op5_top_k,
    "op6_language_model": op6_language_model,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_mixture": op10_mixture,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_warc": op13_warc,
}
ORACLES: dict[str, str] = {
    "op5_top_k": """
        with parts as (select vec_id, unnest(embedding)::double as c, unnest(range(len(embedding))) as at from embeddings),
        bad as (select distinct vec_id from parts where c is null or not isfinite(c)),
        v as (select vec_id, list_transform(embedding, lambda c: floor(1024 * c::double)) as x from embeddings
              where embedding is not null and vec_id is not null and vec_id not in (select vec_id from bad)),
        s as (select q.vec_id as query_id, r.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * r.x[i]))::bigint as score
              from v q join v r on q.vec_id % 100 = 0 and r.vec_id != q.vec_id and len(q.x) = len(r.x))
        select query_id, rank::int as rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10""",
    "op13_warc": """
        with h as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
        b as (select page_id, payload_bytes, list_reduce(list_transform(range(32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::int >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), lambda x, y: x || y) as payload_digest
              from h),
        g as (select *, max(page_id) over (partition by payload_digest) as largest from b)
        select page_id, payload_bytes, payload_digest, case when page_id = largest then 'response' else 'revisit' end as record_type,
          case when page_id != largest then largest end as refers_to from g""",
}
