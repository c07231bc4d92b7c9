"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

The first four keep the columns of documents and drop rows; the last gives the mix over what is left. Between stages the rows are written
as Parquet and read again, and what an operator left in the shared folder is deleted. No stage shortens a text or skips a row.

Defined cases: a row whose doc_id is null isn't learnt from but filtered like any other, and stays in the near-duplicate stage; a null text
counts as empty; of rows that repeat id and text one stays; columns of any other name are carried along; empty tables give empty results of
the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from polyvane.llm.decontam import remove_contaminated
from polyvane.llm.exact import exact_dedup
from polyvane.llm.minhash import remove_near_duplicates
from polyvane.llm.mixing import mix
from polyvane.llm.quality import fit_quality, keep_quality
from polyvane.llm.work import Work, scope

#: Documents that score less are rejected.
QUALITY = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier is fitted on the labelled rows of the stage's input and rejects what it scores as bad."""
    return keep_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), QUALITY)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words to a shingle, similarity of 0.8 or more; the smallest doc_id of each component stays."""
    return remove_near_duplicates(docs, k=5, threshold=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("mix", mix_stage),
]

#: The classifier has no SQL; tests hold each stage and the whole against plain Python, the classifier against its own scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Work(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with scope():
            docs = work.table(stage(spark, docs, sf_dir), name)
        if k:
            work.drop(STAGES[k - 1][0])
    return docs
