"""Catalogue of the text operators: one query each, with its SQL twin where SQL can express it."""

from __future__ import annotations

import uuid

import corpus_pipeline
import public_tokenizers as tokenizers_dir
from pyspark.sql import DataFrame, SparkSession

from stationproof.functions.state import checkpoint_dir
from stationproof.llm import bpe, class_lm, decontaminate, licenses, near_dedup, neighbours, periodic_runs, pieces, quality, resample, secrets, token_counts, token_file, twins
from stationproof.llm.common import documents


def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


def op2_class_lm(spark: SparkSession, sf: str) -> DataFrame:
    return class_lm.score(documents(spark, sf))


def op3_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.report(licenses.scan(documents(spark, sf), keep=["doc_id"]))


def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf), tokenizers_dir.path("piece_bpe_32k.model"), keep=["doc_id"])


def op5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.report(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op6_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf), width=2, percent=80).drop("text_hash")


def op7_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.digests(pieces.encode(documents(spark, sf), tokenizers_dir.path("piece_bpe_32k.model"), keep=["doc_id"]))


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    return quality.score(docs, *quality.train(docs), keep=["doc_id"])


def op9_secrets(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return secrets.report(docs, secrets.learn(docs))


def op10_token_file(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/token-files/{uuid.uuid4().hex}"
    token_file.write(documents(spark, sf), folder, tokenizers_dir.path("word_bpe_49k.json"), end_id=2)
    return token_file.read(spark, folder)


def op11_resample(spark: SparkSession, sf: str) -> DataFrame:
    return resample.report(resample.resample(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"), keep=["doc_id"]))


def op12_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(bpe.encode(documents(spark, sf), tokenizers_dir.path("byte_bpe_50k.json"), keep=["doc_id"]))


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic_runs.report(periodic_runs.find(periodic_runs.plant(documents(spark, sf)), keep=["doc_id"]))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_class_lm": op2_class_lm,
    "op3_licenses": op3_licenses,
    "op4_token_counts": op4_token_counts,
    "op5_neighbours": op5_neighbours,
    "op6_near_dedup": op6_near_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_token_file": op10_token_file,
    "op11_resample": op11_resample,
    "op12_bpe": op12_bpe,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}
ORACLE: dict[str, str] = {
    "op1_decontaminate": twins.DECONTAMINATE,
    "op6_near_dedup": twins.NEAR_DEDUP,
    "op9_secrets": twins.SECRETS,
    "op11_resample": twins.RESAMPLE,
}
