"""The corpus pipeline: toxic documents go, one document of each near-copy class stays, leaked ones go, secrets are masked, and
what is left is encoded. Each stage works on all that the one before it kept, written as Parquet in between."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from peptrellis.llm import bpe, decontaminate, nearcopy, secrets, toxicity
from peptrellis.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal model rejects, each row judged by its own text: null and empty texts, rows without an
    id and repeated rows stay or go like others. Without labels of both classes nothing goes."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays; of repeated rows of it, one. Documents without an id are
    classed by their text, and different texts of one id apart; texts without a word all stay, but for repeated rows of an id."""
    return nearcopy.first_of_classes(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, or enough of one; null and empty texts and rows without an id stay like
    others, and repeated rows as often as they came."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; null and empty texts, null ids and repeated rows stay as they are."""
    return secrets.masked(docs, public_tokenizers.path("byte_bpe_50k.json"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of all documents and of the texts decoded from them, a row for each row (a null text is empty)."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained model decides in two stages: SQL cannot express them.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
