"""Mix sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output over its share of the input. Each document draws a
count from a Poisson distribution with that mean by inverting it at a number made from a hash of seed and id, is exploded
by its count, and goes to a place in a global shuffle that comes from the same kind of hash. All of it is built from
DataFrame functions and repeats exactly for a seed.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, shuffle_width

#: With more sources than this, rates are joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 10_000
SEED = 17
#: Hash digits in a number between 0 and 1 (exact in a double).
_DIGITS = 13


def cumulative(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... until it can't be told from 1; [1.0] for a rate of 0."""
    if not rate > 0:
        return [1.0]
    last = math.ceil(rate + 12 * math.sqrt(rate) + 20)
    if rate < 700:
        out, p, total = [], math.exp(-rate), 0.0
        for k in range(last + 1):
            if k:
                p = p * rate / k
            total += p
            out.append(total)
        return out
    out, total = [], 0.0
    for k in range(last + 1):  # the first terms underflow
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(total)
    return out


def unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of md5('seed|part|...')."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long").cast("double") / F.lit(float(16**_DIGITS))


def rates(docs: DataFrame, targets: dict[str, float] | None, alpha: float, size: float, source_col: str = "source") -> DataFrame:
    """(source, n_docs, rate): documents and mean repetition rate of each source; a null source is one of its own.

    targets gives relative weights by source, those not named get none; without targets, weights are n_docs ** alpha.
    """
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"))
    if targets is None:
        n = n.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(alpha)))
    else:
        flat = [x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))]
        n = n.withColumn("weight", F.coalesce(F.element_at(F.create_map(*flat), F.col("source")), F.lit(0.0)) if flat else F.lit(0.0))
    t = n.agg(F.sum("weight").alias("weight"), F.sum("n_docs").alias("n_docs")).first()
    if not t["weight"]:
        return n.select("source", "n_docs", F.lit(0.0).alias("rate"))
    rate = F.col("weight") / F.lit(t["weight"]) * F.lit(t["n_docs"]) * F.lit(float(size)) / F.col("n_docs")
    return n.select("source", "n_docs", rate.alias("rate"))


def _inverse(docs: DataFrame, r: DataFrame, source_col: str, u: Column, name: str) -> DataFrame:
    """docs with the drawn count in a column of that name."""
    spark, src, cdf, salt = docs.sparkSession, f"{name}_source", f"{name}_cdf", f"{name}_salt"
    rows = r.orderBy(F.desc("n_docs"), "source").limit(BROADCAST_SOURCES + 1).collect()
    if len(rows) <= BROADCAST_SOURCES:
        table = spark.createDataFrame([(x["source"], cumulative(x["rate"])) for x in rows], f"{src} string, {cdf} array<double>")
        joined = docs.join(F.broadcast(table), docs[source_col].eqNullSafe(F.col(src)), "left")
    else:
        # Too many sources to send around: a hot source is split over salts, and each salt gets its rate.
        salts = 64

        @F.pandas_udf("array<double>")
        def pull(rates: pd.Series) -> pd.Series:
            return rates.map(cumulative)

        table = r.select(F.col("source").alias(src), pull("rate").alias(cdf), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(f"{salt}_r"))
        salted = docs.withColumn(salt, F.floor(u * salts).cast("int"))
        joined = salted.join(table, salted[source_col].eqNullSafe(F.col(src)) & (F.col(salt) == F.col(f"{salt}_r")), "left").drop(salt, f"{salt}_r")
    return joined.withColumn(name, F.size(F.filter(F.coalesce(cdf, F.array(F.lit(1.0))), lambda c: c <= u))).drop(src, cdf)


def mix(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, size: float = 1.0, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The columns of docs and copy (from 0) and shuffle_key, documents repeated to the target weights.

    size: expected documents out over documents in. Each document's count is Poisson with its source's rate; a rate of 0
    gives none. Equal ids draw equal counts (repeated rows are repeated alike); a null id draws like an empty one; a null
    source is mixed like a source; null and empty texts count as documents; an empty table gives an empty result. Other
    columns pass through; those named copy or shuffle_key are replaced.

    Rows lie in a global shuffle: dealt to tasks by a hash and sorted within them by shuffle_key, a number in [0, 1)
    that is random over the whole output. It comes from id and copy; for rows without an id, which may be many, from their place in the input.
    """
    given = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("copy", "shuffle_key")])
    r = rates(given, targets, alpha, size, source_col)
    u = unit(seed, F.col(id_col))
    name = fresh(given.columns, "drawn")
    drawn = _inverse(given, r, source_col, u, name).where(F.col(name) > 0)
    drawn = drawn.withColumn(name + "_place", F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()))
    out = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(name) - 1))).drop(name)
    key = F.when(F.col(id_col).isNull(), unit(seed + 1, F.lit("place"), F.col(name + "_place"), F.col("copy"))).otherwise(unit(seed + 1, F.col(id_col), F.col("copy")))
    out = out.withColumn("shuffle_key", key).drop(name + "_place")
    return out.repartition(shuffle_width(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key", id_col, "copy")
