"""The queries of this subpackage: thin callers of its operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlake.llm import oracle
from airlake.session import ship_package

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlake.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlake.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlake.llm.pii import digest, find

    return digest(find(table(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlake.llm.secret_scan import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlake.llm.suffixes import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlake.llm.quality import score

    return score(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlake.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlake.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlake.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlake.llm.lang_id import fit, predict

    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlake.llm.phrases import mine

    return mine(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from airlake.llm.merkle import lower_cased, manifest, verify

    return verify(manifest(table(spark, sf_dir, "documents"), lower_cased()))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_simhash_dedup, op3_pii, op4_packing, op5_secret_scan,
    op6_suffix_dedup, op7_quality_rules, op8_source_mix, op9_toxicity, op10_embedding_dedup,
    op11_language_id, op12_phrase_mining, op13_merkle_manifest,
)}

ORACLE = {"op7_quality_rules": oracle.OP7, "op8_source_mix": oracle.OP8, "op10_embedding_dedup": oracle.OP10,
          "op12_phrase_mining": oracle.OP12, "op13_merkle_manifest": oracle.OP13}
