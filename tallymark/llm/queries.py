"""The registered queries of the operators in this package: thin projections of their outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, bpe, exact_dedup, importance, jaccard_forest, kd_shards, licenses, packing, phrases, quote_links, routed_search, toxicity, warc_zip
from .common import crc_remainder, fresh_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_routed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return routed_search.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc_zip.write_archives(table(spark, sf_dir, "pages"), path)
    return warc_zip.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(*toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.with_scores(docs, net, ["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.classes(table(spark, sf_dir, "documents"))


def op4_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "planes")
    bitplane.write_files(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"))
    rows = written(bitplane.read_documents(spark, path, with_ids=False), "plane-rows")
    return bitplane.with_starts(rows).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.link(table(spark, sf_dir, "conversations"))


def op11_importance_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, shortest=1, longest=1, buckets=10_000, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard_table(table(spark, sf_dir, "documents"), shards=8)


def op13_phrase_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=30, longest=4, covered=80, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_zip": op1_warc_zip,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard_forest": op3_jaccard_forest,
    "op4_bitplane_tokens": op4_bitplane_tokens,
    "op5_license_scan": op5_license_scan,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_routed_search": op7_routed_search,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_quote_links": op10_quote_links,
    "op11_importance_crc": op11_importance_crc,
    "op12_kd_shards": op12_kd_shards,
    "op13_phrase_growth": op13_phrase_growth,
}

ORACLES: dict[str, str] = {
    "op1_warc_zip": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, coalesce(html, '') as h from pages),
        k as (select *, case when n >= 1000 then max(page_id) over (partition by h) end as first from p)
        select page_id, n as payload_bytes, sha1(h) as payload_digest,
               case when first is not null and page_id <> first then 'revisit' else 'response' end as record_type,
               case when page_id <> first then first end as refers_to
        from k""",
    "op5_license_scan": licenses.oracle(),
    "op11_importance_crc": importance.oracle(percent=10, least_words=20, buckets=10_000, seed=2024),
    "op13_phrase_growth": phrases.oracle(least=30, longest=4, covered=80, top=2000),
    "op8_exact_dedup": """
        select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
               count(*) over (partition by coalesce(text, '')) as group_size,
               doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents""",
}
