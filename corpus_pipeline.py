"""A training-data pipeline: language ID, near-duplicates, personal data, mixing, packing.

Each stage works on the rows that the stage before it has kept, written as Parquet in
between. All but the last return the columns of documents, and extra columns too, whatever
their names. Every stage takes an empty table and then returns one; ties are decided as the
operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import stored, table
from sensorloom.llm.langid import keep_identified, train_language_model
from sensorloom.llm.mixing import TARGETS, mix
from sensorloom.llm.packing import pack
from sensorloom.llm.pii import sanitize
from sensorloom.llm.similar import keep_dissimilar


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose best language has under 0.3 of the words' posterior, go.

    Null and empty texts go. Repeated rows stay or go together. Without a labelled text that has
    a letter nothing is learned, and all rows go.
    """
    return keep_identified(docs, train_language_model(docs), min_score=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash, or by a Jaccard similarity of at least 0.8, of their five-word shingles, the one of smallest doc_id stays.

    Fingerprints at most 4 bits apart are linked by the SimHash operator; pairs at 0.8 that lie
    further apart are found exactly. Null, empty and wordless texts are one group. Repeated
    rows are kept once; null ids come last.
    """
    return keep_dissimilar(docs, similarity=0.8, shingle=5, radius=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced in the texts; n_chars follows.

    All rows stay, repeated ones too. Null texts stay null and their n_chars becomes null.
    """
    clean = sanitize(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are kept at rates of at most 1 that bring the label domains to their target shares.

    Null and empty texts have the posterior of an empty text. Repeated rows stay or go
    together. Without labels all rows stay.
    """
    return mix(docs, table(spark, sf_dir, "labels"), TARGETS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in windows of 2048 tokens; null and empty texts are their end token, repeated rows are packed once each."""
    return pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: No SQL: a trained field, fingerprints' components and differencing cannot be expressed; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
