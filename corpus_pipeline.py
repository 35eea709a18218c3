"""A corpus pipeline over the documents table.

Five stages, each calling one operator of ``tarn.llm``; each works on all that
its predecessor kept. Between stages the documents are written as Parquet to the
shared checkpoint folder and read again, so a lost executor costs one task. Stages
hold the session's Arrow batches to 1000 rows, as texts can be long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import line_dedup as lines
from tarn.llm import near, packing, quality_cnn
from tarn.llm import substring_dedup as substrings
from tarn.llm.common import small_batches, table
from tarn.llm.queries import read, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _renewed(docs: DataFrame) -> DataFrame:
    """The columns of documents after a stage that has changed texts."""
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more stay.

    Null texts score as empty ones; repeated rows, which score alike, stay or go
    together. Other columns are dropped; an empty table stays empty.
    """
    small_batches(spark)
    network = quality_cnn.fit(docs, read(spark, sf_dir, "labels"))
    scored = quality_cnn.score(docs, network, carry=("text", "lang", "source", "n_chars"))
    return scored.where(F.col("score") >= 0.3).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document before holds too go; all documents stay.

    A null text becomes an empty one. Rows of one id are one document, rows without
    an id one document after all others.
    """
    small_batches(spark)
    return _renewed(lines.line_dedup(docs, carry=("lang", "source")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest id, null ids last.

    Near copies have SimHash fingerprints over five-word shingles that differ in
    three bits at most, or a Jaccard similarity of 0.8 or more over these shingles.
    Texts without words (null, empty) are copies of each other. Rows decide, not
    ids: copies without an id leave one row, repeated rows of an id leave one, and a
    text that is like no other stays whatever shares its id.
    """
    small_batches(spark)
    return near.representatives(docs, carry=("lang", "source", "n_chars")).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go; all documents stay, null texts as empty ones.

    Kept words are joined by one space, so a text's line ends go here.
    """
    small_batches(spark)
    return _renewed(substrings.substring_dedup(docs, carry=("lang", "source")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens.

    A null or empty text is one piece, its closing id. Repeated rows get places of
    their own; a null id stays null.
    """
    small_batches(spark)
    pieces = packing.token_pieces(docs, vocabulary("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", pack),
]

#: The classifier has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the whole pipeline makes of the documents table."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
