"""The corpus pipeline: STAGES, run in order, each over all that its predecessor kept.

Every stage but the last returns the columns of its documents, whatever their names.
Between stages the rows rest in a written table, so lost executors cost no more than the
stage that runs.

Defined results. Null texts count as empty: the classifier scores them, all empty ones are
near duplicates of each other, they hold no benchmark window and no secret, and pack as
the end id alone; a null text stays null. Null ids come last among near duplicates. Very
long texts are read whole. Of repeated rows near-dedup keeps one (see ``one_of_each``).
Empty tables give no rows; without usable labels no document is rejected. Further columns
pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import classifier, decontaminate, packing, secrets, simhash
from strata.llm.common import fresh, stash, table
from strata.llm.queries import END_ID, tokenizer

KEPT_FROM = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; all, if it has nothing to learn from."""
    net = classifier.fit(docs, table(spark, sf_dir, "labels"))
    if net.constant is not None:
        return docs
    out = fresh(docs, "judged")
    judged = classifier.classify(docs, net, out=out)
    return judged.filter(F.col(f"{out}.score") >= KEPT_FROM).drop(out)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more."""
    return simhash.one_of_each(docs, size=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    out = fresh(docs, "leak")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), out=out)
    return found.filter(F.col(f"{out}.n_hit") == 0).drop(out)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    out = fresh(docs, "secrets")
    found = secrets.find_secrets(docs, out=out)
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col(out)))
    changed = F.when(F.size(out) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).drop(out)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 4096 tokens."""
    got = packing.pack(docs, tokenizer(), END_ID, by_words=True)
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", packed),
]

#: Learned scores, sampled keys and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
