"""The training-data pipeline: quality, near-duplicates, decontamination, mixture, token files.

Each stage works on all that the one before kept. It is written as Parquet to
the folder that the cluster shares and read again, so a stage's executors may go
once it is done. All but the last return the columns of ``documents``.

* quality: importance resampling rejects what is not like text labelled good;
* dedup: one document, that of the least doc_id, of each component of near copies
  (five-word shingles, Jaccard similarity 0.8 or more) stays;
* decontaminate: documents that hold a benchmark item go;
* mix: a document's text becomes the words that the mix takes of it, repeats
  included; documents of which it takes none go;
* tokens: ids in rANS token files, read back as one row for each document.

Defined results for odd input: documents with a null, empty or blank text have no
weight and go in the first stage, as do repeated rows in the second, where one
row of each group stays, that of the least doc_id (null last). Null doc_ids,
sources and languages are kept otherwise. Very long texts pass through whole.
Columns beyond those of ``documents``, whatever their names, are carried to the
last stage. An empty table, and empty labels or benchmark, give empty or
unfiltered results.
"""

from pyspark.sql import DataFrame, SparkSession

from lexweft.llm.common import materialize, table
from lexweft.llm.importance import quality_stage
from lexweft.llm.minhash import dedup_stage
from lexweft.llm.mixing import mixing_stage
from lexweft.llm.templates import decontamination_stage
from lexweft.llm.token_files import token_stage


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_stage(spark, docs, sf_dir)


def _dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_stage(spark, docs, sf_dir)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination_stage(spark, docs, sf_dir)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing_stage(spark, docs, sf_dir)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_stage(spark, docs, sf_dir)


STAGES = [
    ("quality", _quality),
    ("dedup", _dedup),
    ("decontaminate", _decontaminate),
    ("mix", _mix),
    ("tokens", _tokens),
]

#: SQL can't express the classifier, the near copies or the tokenizer; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
