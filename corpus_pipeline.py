"""A corpus pipeline: quality, near duplicates, secrets, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``docs`` is what the
stage before returned, written as Parquet and read again.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import ensure_checkpoint_dir, table
from treeloom.llm.mixing import mix
from treeloom.llm.neardup import near_duplicates
from treeloom.llm.packing import pack_documents
from treeloom.llm.quality import score, train
from treeloom.llm.queries import LANGUAGE_TARGETS, language_labels, tokenizer_path
from treeloom.llm.secret_scan import default_ratios, redact, scan


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose probability of the top grade is at least one half."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, least_tail=0.5).where("keep").select(docs.columns)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group; five-word shingles, similarity 0.8 or more."""
    groups = near_duplicates(docs, shingle=5, percent=80)
    dropped = groups.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found by a mark; all documents stay."""
    found = scan(docs, default_ratios(spark))
    text = F.when(F.col("text").isNotNull(), redact(F.col("text"), F.col("spans")))
    return found.select(*[text.alias("text") if c == "text" else F.length(text).cast("long").alias("n_chars") if c == "n_chars" else c for c in docs.columns])


def domain_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of languages below their target; none is left out."""
    labelled = language_labels(docs, table(spark, sf_dir, "labels"))
    mixed = mix(docs, labelled, LANGUAGE_TARGETS, keep_all=True)
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path(), capacity=2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_neardup", minhash_neardup),
    ("secret_scan", secret_scan),
    ("domain_mixing", domain_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: A trained classifier, hashing and a tokenizer can't be expressed in SQL; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage returns is written to the shared folder and reread."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    name, stage = STAGES[-1]
    stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")
