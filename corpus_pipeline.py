"""From raw documents to packed sequences: five stages, each over all that its predecessor kept.

Language identification drops what no language explains, near-duplicates leave one document
of each group, documents with benchmark passages go, secrets are masked in place, and the rest
is packed. Stages hand on the columns of documents; the last gives pieces of sequences.

Null, empty and letterless texts go in the first stage, as no language explains them; a null id is an id like any
other. Very long texts are judged and handed on whole. Rows that repeat id and text are copies, of which one stays;
rows that repeat an id with other texts stay apart. Ties among copies go to the smallest id, then the smallest text
hash. An empty table gives an empty result in every stage. Further columns, whatever their names, are handed on as they are
until packing, which reads doc_id and text only (names that begin with two underscores are taken).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rulelens.llm import decontam, langid, neardup, packing, secrets
from rulelens.llm.arrowio import read_table, shared_dir
from rulelens.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest centroid accepts; the fit uses the labelled ones. Without any label every document goes."""
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component; links are five-word shingles at a Jaccard similarity of 0.8 or more.

    SimHash fingerprints and distance tables choose what is verified. Documents without words are one component.
    """
    return neardup.representatives(docs, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark; all, if that is empty."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets of any length masked; n_chars follows the text."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", packed),
]

#: SQL can express neither the centroids nor the forest; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
