"""A corpus from raw documents to tokens, in five stages, each written and read again.

Toxic documents go; of near duplicates (five words, similarity 0.8) one stays; secrets are blacked out; sources
are mixed to target weights, which takes some documents more than once and some not at all; what is left is
encoded. Every stage but the last returns the columns of `documents`.

Rows with a null doc_id go through the first three stages like any other; the mix leaves them out, since it has to
tell rows apart. Null texts count as empty; empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm.bpe import decode, encode
from scenelake.llm.common import table
from scenelake.llm.mixing import take_mix
from scenelake.llm.ngram_join import JoinParameters, keep_one
from scenelake.llm.secrets import redact
from scenelake.llm.toxicity import fit, held_out, reject_toxic
from scenelake.session import run_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't vote toxic."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return reject_toxic(docs, fit(docs, labels))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    return keep_one(docs, p=JoinParameters(words=5, percent=80))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets blacked out; n_chars follows where a text has changed."""
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    known = clean.schema["n_chars"].dataType
    changed = F.col("text").contains("[SECRET]")
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast(known)).otherwise(F.col("n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    return take_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document taken: doc_id, lang, source, n_tokens, the packed ids, and whether what they decode to is the
    text, byte by byte."""
    coded = encode(docs.select("doc_id", "lang", "source", "text"))
    back = decode(coded.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).drop("text"), as_text=False)
    return back.select(
        "doc_id", "lang", "source", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids",
        (F.sha2("decoded", 256) == F.col("digest")).alias("decodes"),
    )


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: No SQL encodes by merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{run_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
