"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept: rules clean lines and reject junk,
a classifier rejects what scores low, one document of each group of near-duplicates stays, secrets are redacted, and the
token sequences are packed.  All but the last return the columns of documents.  Each row's edge cases are those of the
operators: null texts count as empty (and are rejected by the rules), rows with a null id are linked with nothing and stay, and
empty tables pass through.  Each stage reads the columns of documents (COLUMNS), all of which must be there, and leaves out others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import near_dups, packing, quality, secrets, textstats
from docloom.llm.common import staged, table
from docloom.llm.queries import tokenizer_path
from docloom.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go; documents that fail, or lose too much of their text, go."""
    ship(spark)
    judged = textstats.judge_documents(docs.select(COLUMNS)).where("kept")
    return judged.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled raw documents, gives a chance under 0.3 go."""
    scored = quality.classify_quality(docs.select(COLUMNS), table(spark, sf_dir, "labels"), F.lit(False), keep=COLUMNS, training=table(spark, sf_dir, "documents"))
    return scored.where("predicted = 1").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays."""
    ship(spark)
    docs = docs.select(COLUMNS)
    kept = near_dups.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    clean = secrets.redact_documents(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids and their places in sequences of 2048."""
    ship(spark)
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Tokenizing, line rules, fitted models and components are beyond SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, "stage")
    return docs
