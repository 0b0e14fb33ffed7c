"""Corpus pipeline: quality rules, near-duplicates, personal data, packing.

Each stage takes what its predecessor kept. Null ids and texts are allowed in
every stage: rows with a null id are judged by no one and stay, a null text is
rejected by the quality rules if its row has an id. Rows that share an id are
one document: if one of them is rejected, all go. Repeated rows stay repeated
where the stage keeps them. Texts of any length are read whole. Extra columns
are dropped. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.llm import neardup, packing, pii, quality
from quillwave.llm.common import written
from quillwave.llm.queries import BYTE_BPE, table

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of ``docs`` without the ids that a stage rejects; rows with a null id stay."""
    rejected = written(verdicts.where("NOT kept").select("doc_id").distinct(), "rejected")
    return docs.join(rejected, "doc_id", "left_anti").select(*_COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that fail a rule or the classifier."""
    return _kept(docs, quality.score(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near copies (five-word shingles, similarity 0.8)."""
    return _kept(docs, neardup.near_duplicates(docs, words=5))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; ``n_chars`` follows."""
    return pii.redacted(docs.select(*_COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document in sequences of 1024 tokens."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
