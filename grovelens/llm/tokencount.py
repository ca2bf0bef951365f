"""Token counts through a digest cache.

The cache is a Parquet folder of (content, tokenizer, n_tokens): the SHA-256 of a normalised text, the SHA-256 of the
tokenizer's file, the count. Contents are joined to it by both digests, each different content that it lacks is encoded
once, and the new counts are appended. An append is one Parquet commit; if two runs append the same count, the reader
merges them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from grovelens.llm.bpe import encoder
from grovelens.llm.common import bound_batches, documents, materialize, shared_dir, skew_join, trimmed

CACHE_SCHEMA = StructType([StructField("content", BinaryType()), StructField("tokenizer", BinaryType()), StructField("n_tokens", LongType())])


def normalised(text: Column) -> Column:
    """A null text is an empty one. Nothing else may change: any other form could have another count."""
    return F.coalesce(text, F.lit(""))


def tokenizer_digest(path: str) -> bytes:
    return hashlib.sha256(Path(path).read_bytes()).digest()


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = coder.count(part.column("body").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(n, pa.int64())], names=["content", "n_tokens"])

    return count


def read_cache(df: DataFrame, cache: str, tokenizer: bytes) -> DataFrame:
    """(content, n_tokens) of one tokenizer version; one row for each content, however often it was appended."""
    rows = df.sparkSession.read.schema(CACHE_SCHEMA).parquet(cache)
    return rows.filter(F.col("tokenizer") == F.lit(tokenizer)).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    cache: a folder in a store that all executors share, made if missing; None: `token-counts` in spark.checkpoint.dir, which
    later runs find again. A null text counts as empty (0 tokens). Rows are answered one by one, repeated rows, ties and null ids
    too; an empty table gives an empty result; columns other than doc_id and text are ignored. A text is encoded whole, however
    long, by one worker; copies of one content are answered by a join that splits hot contents off.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    cache = cache or f"{shared_dir(spark).rstrip('/')}/token-counts"
    bound_batches(spark)
    where = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)

    texts = documents(docs).select("doc_id", normalised(F.col("text")).alias("body"))
    texts = texts.select("doc_id", "body", F.unhex(F.sha2("body", 256)).alias("content"))
    # each content moves once: the first of its copies in a task is picked before the shuffle
    distinct = texts.groupBy("content").agg(F.first("body").alias("body"))
    misses = distinct.join(read_cache(docs, cache, version), "content", "left_anti")
    found = misses.mapInArrow(trimmed(_counter(tokenizer)), "content binary, n_tokens long")
    found.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)

    sizes = materialize(texts.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), "content"))
    return skew_join(sizes, read_cache(docs, cache, version), "content", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
