"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, html_extract, langid, licenses, mixing, packing, pii, simhash, topk, toxicity
from .common import crc_bucket

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned outside the held-out fold."""
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_directed", "n_quoted")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents repeated to the target weights of their sources."""
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "text", "lang", "n_chars")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages of all documents, learned outside the held-out fold."""
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs)
    return langid.predict(docs, model).select("doc_id", F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of all documents."""
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every vector whose id is divisible by 20."""
    return topk.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95."""
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of personal data in all documents."""
    return pii.digest(pii.find(_read(spark, sf_dir, "documents")))


def queries() -> dict[str, Query]:
    """One query per operator, each over its whole table; null, empty and odd rows as in the operator's docstring."""
    return {f.__name__: f for f in (op1_toxicity, op2_html_extraction, op3_best_fit_packing, op4_mixing, op5_simhash, op6_language_id, op7_license_scan, op8_exact_topk, op9_embedding_dedup, op10_pii)}


OP4_SQL = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
t AS (SELECT sum(pow(CAST(n_docs AS DOUBLE), 0.5)) AS w, CAST(sum(n_docs) AS BIGINT) AS n FROM n),
r AS (SELECT source, pow(CAST(n_docs AS DOUBLE), 0.5) / t.w * t.n / n_docs AS rate FROM n, t),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
u AS (SELECT *, CAST(('0x' || substr(md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
d AS (SELECT u.doc_id, u.source, u.text, u.lang, u.n_chars, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u) AS n FROM u)
SELECT doc_id, source, CAST(unnest(range(n)) AS INTEGER) AS copy, text, lang, n_chars FROM d"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op7_license_scan": licenses.oracle(), "op8_exact_topk": topk.ORACLE}
