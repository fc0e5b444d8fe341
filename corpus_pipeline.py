"""From raw documents to token ids: five stages, each of which calls one operator of ``dataproof.llm``.

Every stage gets all that its predecessor kept and returns the columns of ``documents``; the last one
returns the encoded documents. Between stages the documents are written to the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataproof.llm import byte_bpe, decontaminate, divergence, jaccard_join, quality_knn
from dataproof.llm.common import numbered, settle
from dataproof.queries.registry import Query, table


def _at(docs: DataFrame, names: list[str], column: str) -> str:
    return names[docs.columns.index(column)]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from labels that are not held out."""
    labels = table(spark, sf_dir, "labels")
    model = quality_knn.fit(docs.select("doc_id", "text"), labels.where(~quality_knn.held_out(labels)))
    rows, names = numbered(docs)
    kept = quality_knn.scores(rows, model, text=_at(docs, names, "text")).where("predicted = 1")
    return kept.select(names).toDF(*docs.columns)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the distribution divergence reject go."""
    rows, names = numbered(docs)
    judged = divergence.judge(rows, text=_at(docs, names, "text"), lang=_at(docs, names, "lang"))
    # A filter on the verdict would be planned with the whole computation repeated in it; a generator has it once.
    own = F.array(F.struct(*names))
    return judged.select(F.inline(F.when(F.col("kept"), own))).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 80 %, the one with the least id stays."""
    return jaccard_join.keep_one(docs, percent=80, width=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_checked(docs, byte_bpe.read_ranks(path, public_tokenizers.PATTERN))


STAGES = [
    ("quality classifier", quality_stage),
    ("quality rules", rules_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: SQL can express neither the classifier nor the vocabulary; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), "stage")
    return docs


REGISTRY = {"pipeline": Query(run, ORACLE_SQL)}
