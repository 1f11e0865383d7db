"""Registered queries of the operators in this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiline.llm import (
    chosen_path,
    chunk_bpe,
    cross_parse,
    feast_whitening,
    jump_shard,
    lattice,
    license_scan,
    orc_tokens,
    pieces,
    residue_mining,
    revisits,
    sql,
    template_decontam,
    toxicity_fm,
    window_lm,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = sql.ORACLES


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of the crawl records derived from all pages, with merged headers as one text."""
    found = revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.array_sort(F.transform("headers", lambda h: F.concat(F.lower(h["name"]), F.lit(": "), h["value"]))), "; ")
    return found.select("record_id", "url_key", "outcome", "response_id", headers.alias("headers"), "payload_digest")


@query
def op2_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by jump consistent hashing of doc_id."""
    return jump_shard.layout(table(spark, sf_dir, "documents"), 24)


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.default_templates(spark))


@query
def op4_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return chunk_bpe.digests(table(spark, sf_dir, "documents"), pieces.vocabulary("word_bpe_49k.json"))


@query
def op5_window_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document."""
    docs = table(spark, sf_dir, "documents")
    return window_lm.score(docs, window_lm.train(docs))


@query
def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and digests of all documents' ids, read back from ORC files."""
    return orc_tokens.round_trip(table(spark, sf_dir, "documents"), pieces.vocabulary("byte_bpe_50k.json"))


@query
def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark questions, with other slot values or the same."""
    return template_decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: number of links and class of every document."""
    return chosen_path.join(table(spark, sf_dir, "documents"))


@query
def op9_lattice_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors: number of links and component of every vector."""
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op10_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity_fm.score(docs, toxicity_fm.train(docs, labels))


@query
def op11_residue_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive, by exact integer scores."""
    return residue_mining.hard_negatives(table(spark, sf_dir, "embeddings"))


@query
def op12_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the least cross-parsing cost."""
    docs = table(spark, sf_dir, "documents")
    return cross_parse.identify(docs, cross_parse.training_passages(docs))


@query
def op13_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened values of every vector on the 32 largest principal components."""
    vectors = table(spark, sf_dir, "embeddings")
    return feast_whitening.whiten(vectors, feast_whitening.fit(vectors))
