"""A pipeline from raw documents to token ids; each stage reads the written result of the one before.

Stages take (spark, docs, sf_dir) and return documents again, the last one ids.  None can be written in SQL: the rules, the
classifier and the rates are fitted to the data, and fingerprints and pieces have no SQL functions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from khata.llm.jaccard import first_of_similar
from khata.llm.lines import without_lines
from khata.llm.mixing import mixed_documents, take_copies
from khata.llm.pieces import encode
from khata.llm.quality import good_documents
from khata.llm.queries import DOMAIN
from khata.session import shared_folder

#: Target shares of the tokens which reach the mixing stage: nearly all clean text, a little of the rest.
SHARES = {"q1t0": 0.98, "q1t1": 0.01, "q0t0": 0.005, "q0t1": 0.005}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents which the rules reject go."""
    return good_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-equal lines one occurrence stays; the length follows the text."""
    return without_lines(docs, length="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents with a similarity of 0.8 or more in shingles of five words the one with the smallest id stays."""
    return first_of_similar(docs, width=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated, so that the expected tokens of each domain meet their share."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored, _, _ = mixed_documents(docs, labels, DOMAIN, SHARES)
    return take_copies(docs, scored)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, in place of its text."""
    return encode(docs).drop("text")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("mixing to target weights", mixing),
    ("sentencepiece", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; what a stage returns is written below the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs


ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
