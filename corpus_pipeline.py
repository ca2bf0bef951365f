"""A corpus pipeline of five operators: language ID, n-gram Jaccard join, decontamination, PII, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents. run() applies them to documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovelens.llm import decontam, jaccard, langid, packing, pii
from grovelens.llm.common import free_name, materialize, table

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known stay; texts that are null or have no letter (`und`) go, and lang becomes the predicted one.

    The profiles are learnt from the stage's own labelled rows; without any, every row goes. Repeated rows and null ids are each judged,
    ties go to the first language in order, texts are taken whole, an empty table stays empty.
    """
    model = langid.learn(docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang"))
    pred, score = free_name("pred", docs), free_name("score", docs)
    marked = langid.annotate(docs, model, pred, score).filter(F.col(pred) != langid.UNKNOWN)
    return marked.select(*[F.col(pred).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8 or more) the row with the smallest doc_id stays.

    Null and wordless texts link with nothing and stay. Of repeated rows one stays; a row with a null id stays only where no row of its
    component has one. Texts are compared whole; an empty table stays empty.
    """
    return jaccard.representatives(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds an item of `benchmark` go, repeated rows and null ids alike; null texts stay, an empty table or benchmark changes nothing."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in angle brackets; every row stays, null texts, repeated rows and null ids as they are."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences. A null text is the end token alone, repeated rows and null ids are packed one by one, an empty table gives no piece."""
    pieces = packing.pack(docs, public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: SQL can't express the first, second and last stage; tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
