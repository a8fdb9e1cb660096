"""A training corpus from documents: five stages, each over all that the one before kept.

1. toxicity: documents that score 0.5 or more go.
2. near duplicates: one document of each group stays.
3. repeats: byte strings of 100 bytes or more that also start earlier are cut out.
4. decontamination: documents contaminated by the benchmark go.
5. pieces: two sampled segmentations of each document that is left, with its
   text and other columns.

Each stage is a function of (spark, docs, sf_dir).  All but the last return the
columns of documents.  Extra columns pass through.  Empty tables give empty
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import decontaminate, jaccard, pieces, repeats, toxicity
from strataline.llm.shared import settle, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the model of `labels` calls toxic.

    A text that is null, empty or without words scores alike wherever it stands.
    Without any label all documents stay.
    Repeated rows fare alike; rows with a null id are judged too.
    """
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of near duplicates (five words, 0.8 or more): the one with the least id.

    Rows with a null id and texts without words stay.  Rows that repeat an id
    and its text leave one row; an id keeps its texts of different groups.
    """
    return jaccard.keep_representatives(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the bytes of 100-byte strings that also start earlier, in whole characters.

    Null and empty texts, and rows with a null id, stay as they are; documents
    of which nothing is left go.  Several rows under one id count as one
    document.  n_chars follows the text.
    """
    kept = repeats.cut_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those of which a twentieth of the words stand in windows of `benchmark`.

    Null and empty texts are clean.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document and sample: the document's columns, the piece ids and their scores.

    A null or empty text has one sample without pieces.  A column of docs that
    has the name of one of the sample's columns gives way to it.
    """
    return pieces.sample_segmentations(docs, carry=tuple(docs.columns)).drop("key")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("decontamination", decontamination_stage),
    ("pieces", pieces_stage),
]

#: Trained models, similarity search and sampling have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
