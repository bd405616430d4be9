"""A pipeline of the training-data operators over documents: toxic documents go, one of each group of near copies stays, secrets are struck out, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequery.llm import packing, secrets, simhash, toxicity
from pagequery.llm.common import drop_path, materialize, table

#: A document is rejected if its toxicity reaches this.
REJECT = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below REJECT, with all their columns; rows without an id, a text or a label are scored like others."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), threshold=REJECT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id, those without one last."""
    return simhash.keep_first(docs)


def strike_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with their secrets struck out and n_chars counted anew."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; repeated rows are packed each."""
    return packing.pack_documents(docs.select(F.col("doc_id"), F.col("text")), model=packing.vocabulary())


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("secrets", strike_secrets), ("packing", pack)]
#: A compression model and fingerprints of hashed shingles can't be spelt in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every earlier stage's are written to the shared folder and read again, and go once the next stage's are there."""
    docs, paths = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), paths)
        for path in paths[:-1]:
            drop_path(spark, path)
        del paths[:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
