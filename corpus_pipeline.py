"""From raw documents to token ids: language, near-duplicates, secrets, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents that the next one works on;
all but the last return the columns of its input. The stages' results are written between them by whoever runs
them one by one; run() applies all to the documents of a folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import blob_ledger, mixing
from tidepanel.llm.bpe_dp import encode
from tidepanel.llm.common import materialize, ready
from tidepanel.llm.langid_ecoc import identify
from tidepanel.llm.superminhash import near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a clear language: ``und``, or too small a gap between codewords."""
    ready(spark)
    return identify(docs, carry=docs.columns).where(~F.col("ambiguous")).select(*(f"carried.{c}" for c in docs.columns))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates; one row of those with equal id and text. Null ids stay."""
    ready(spark)
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    one = rows.join(kept, "id", "left_semi").dropDuplicates(["id", "text"])
    return one.union(rows.where("id is null")).select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found in a text by a mark, and n_chars, where there is such a column, by the new length; all documents stay."""
    ready(spark)
    ledger = materialize(blob_ledger.scan(docs, blob_ledger.empty_ledger(spark)))
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    clean = blob_ledger.findings(rows, ledger).withColumn("text", blob_ledger.redact(F.col("text"), F.col("spans")))
    value = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in value:
        value["n_chars"] = F.when(F.size("spans") > 0, F.length("text")).otherwise(value["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return clean.select(*(value[c].alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take from each source the words that its target weight gives it, some of them twice."""
    ready(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of them and of what they decode to."""
    ready(spark)
    coded = encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", deduplicate),
    ("secret scans", secrets),
    ("mixing to target weights", mix),
    ("BPE encoding and decoding", tokens),
]

#: Not expressible in SQL: language ID is learned and the mix is drawn.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
