"""A training corpus from raw documents: five stages, each one of the operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bpe, language_id, mixing, pseudonyms, simhash
from tessera.llm.common import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose language the model gives no such share is rejected.
LANGUAGE_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language the model knows; texts without letters go."""
    model = language_id.train(docs.where(~language_id.held_out()))
    rows = language_id.predict(docs.select(*COLUMNS), model)
    return rows.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies (five-word Jaccard likeness of 0.8 or more): that of smallest id, then text hash; null ids come last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_hash").alias("_hash")))
    chosen = simhash.near_copies(docs).groupBy("component").agg(first.alias("c")).select("c.*")
    rows = docs.select(*COLUMNS).withColumns({"_null": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_hash": F.xxhash64("text")})
    kept = rows.join(chosen, ["_null", "_id", "_hash"])
    # rows of the same id and text count once; the join has dealt them by these keys already
    again = Window.partitionBy("_null", "_id", "_hash").orderBy("lang", "source", "n_chars")
    return kept.withColumn("_n", F.row_number().over(again)).where("_n = 1").select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in place of personal data; n_chars follows the text."""
    rows = pseudonyms.pseudonymise(docs.select(*COLUMNS))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, which mix_position tells; every source is kept whole."""
    rows = mixing.interleave(docs.select(*COLUMNS), weights=mixing.TARGET_WEIGHTS)
    return rows.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*COLUMNS, "mix_position")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, in the order of the mix."""
    if "mix_position" not in docs.columns:
        return bpe.encode_decode(docs)
    # files are not read in the order of their names
    rows = docs.repartitionByRange("mix_position").sortWithinPartitions("mix_position")
    return bpe.encode_decode(rows, carry="mix_position")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("pseudonyms", replace_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Language identification and rank-array encoding have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_dir(spark).rstrip("/")
    work = f"{base}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{work}/{i}_{name}")
            docs = spark.read.parquet(f"{work}/{i}_{name}")
    return docs
