"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quarry.runtime import table

#: The vocabulary file; another place can be given by the environment.
TOKENIZER = os.environ.get("QUARRY_TOKENIZER", "")


def tokenizer_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


#: The rule list that the URL query applies before mined rules.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.urlfilter import judge

    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op2_wavelet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.wavelet import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality import fit, judge

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, size=2048)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "html"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.sharding import kd_shards

    return kd_shards(table(spark, sf_dir, "documents"), leaves=40)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=5, threshold=0.8)


def op10_subspace_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.subspace import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"), every=199, shortest=6, least=5, times=5)


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.license import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op13_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.annulus import clustered

    return clustered(table(spark, sf_dir, "embeddings"), dims=64, k=8, rounds=10, seed=3, scale=1024)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    from quarry.llm import sql

    return {"op11_spelling_variants": sql.spellings(every=199, shortest=6, least=5, times=5), "op13_annulus_clusters": sql.centroids(dims=64, k=8, rounds=10, seed=3, scale=1024)}
