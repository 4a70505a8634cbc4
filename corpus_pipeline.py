"""The corpus pipeline: filter, deduplicate, redact, mix and pack documents.

STAGES are (name, function) in order; each function takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import mixing, packing, pii, simhash, toxicity
from postlake.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the toxicity model does not reject; it learns from all labels but the held-out fold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each SimHash component: that with the smallest id, null ids last, and of repeated ids any one.

    Rows are told apart by a key of their own, so a row whose id is null or stands on other rows too is judged by its text.
    """
    rows = materialize(docs.select(*COLUMNS).withColumn("row_key", F.monotonically_increasing_id()), "rows")
    found = simhash.near_duplicates(rows, id_col="row_key", order_col="doc_id")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("rank").isNull().alias("no_id"), "rank", F.col("doc_id").alias("row_key"))).alias("first"))
    keys = materialize(first.select("first.row_key"), "kept")
    return rows.join(keys, "row_key", "left_semi").select(*COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by marks; n_chars follows the text."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to the target weights, in shuffled order."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into token sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read by the next; rows of the last.

    Null and empty texts, null and repeated ids and an empty table pass as the stages' operators say.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"stage-{name}")
    return docs


#: A learned model decides in the first stage, which SQL can't express.
ORACLE_SQL = None
