"""A corpus in four stages: toxic documents go, near copies go, benchmark leaks go, and the rest is tokenized.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of the documents. Rows with null or empty texts pass through
all stages; the cases of each operator are in its module.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lexiline import session
from lexiline.llm import chosen_path, chunk_bpe, pieces, template_decontam, toxicity_fm
from lexiline.llm.common import forget, scope, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that each stage has stored, by its place.
LEFT: dict[int, list[str]] = {}


def place(n: int) -> Callable[[Stage], Stage]:
    """A stage deletes what the stage before it has stored, as that one's output is written by then."""

    def tidied(stage: Stage) -> Stage:
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            forget(spark, LEFT.get(n - 1, []), docs)
            with scope() as paths:
                out = stage(session.tune(spark), docs, sf_dir)
            LEFT.setdefault(n, []).extend(paths)
            return out

        return run_stage

    return tidied


@place(0)
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, trained on the labelled ones, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_fm.reject(docs, toxicity_fm.train(docs, labels))


@place(1)
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return chosen_path.keep_first(docs)


@place(2)
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark questions."""
    return template_decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@place(3)
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each document."""
    return chunk_bpe.digests(docs, pieces.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", tokenize),
]

#: Training, the class search and the tokenizer are beyond SQL; the tests hold the operator of each stage against brute force, one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held: list[str] = []
    for _, stage in STAGES[:-1]:
        with scope() as paths:
            docs = stored(stage(spark, docs, sf_dir))
        held += paths
        forget(spark, held, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
