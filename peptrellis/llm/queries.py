"""The registered queries of the numbered operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, importance, licences, lm, nearcopy, orcids, quality, repair, secrets, substrings, toxicity, urlrules
from .common import stage_path, table

ORACLE: dict[str, str] = {"op6_licence_digests": licences.SQL, "op8_rare_token_urls": urlrules.SQL, "op11_importance_draw": importance.SQL, "op12_repeated_spans": substrings.SQL}


def op1_rare_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited or partial copy of one."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ordinal_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity grades of all documents."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under the unigram base and the recurrent model."""
    return lm.scored(table(spark, sf_dir, "documents"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of exact and near copies among all documents."""
    return nearcopy.near_duplicates(table(spark, sf_dir, "documents"))


def op5_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secret candidates of all documents and the forest's verdicts."""
    return secrets.scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents and whole lines that are a known licence text or notice."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as ORC and read back."""
    path = stage_path(spark, "token-ids")
    orcids.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return orcids.token_digests(spark, path)


def op8_rare_token_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page urls."""
    return urlrules.judged(table(spark, sf_dir, "pages"))


def op9_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' token ids and of the texts decoded from them."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all documents and what the learnt decision list keeps."""
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents towards the benchmark's texts, and those drawn."""
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of long passages that a document of a smaller id has."""
    return substrings.digests(table(spark, sf_dir, "documents"))


def op13_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage: their faults, the cheapest repair and a digest of what it gives."""
    return repair.digests(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_rare_seed_alignment": op1_rare_seed_alignment,
    "op2_ordinal_severity": op2_ordinal_severity,
    "op3_gru_lm": op3_gru_lm,
    "op4_order_minhash": op4_order_minhash,
    "op5_forest_secrets": op5_forest_secrets,
    "op6_licence_digests": op6_licence_digests,
    "op7_orc_token_ids": op7_orc_token_ids,
    "op8_rare_token_urls": op8_rare_token_urls,
    "op9_bpe_rounds": op9_bpe_rounds,
    "op10_decision_lists": op10_decision_lists,
    "op11_importance_draw": op11_importance_draw,
    "op12_repeated_spans": op12_repeated_spans,
    "op13_grammar_repair": op13_grammar_repair,
}
