"""The employer universe: two research batches merged into one company table with an audit, by precedence.

Batch A outranks batch B, a reviewed sitemap outranks both, an override outranks that, and a user's exclusion outranks all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import integer_from, slug, split_values, tenant_parts
from ..operators.evidence import employer_score

AUDIT_COLUMNS = "id name enabled connector_type monitor_status confidence score evidence_year certified software_related change_employer sector batch domain careers_url fit_tags notes".split()
EXCLUDED = "Excluded from monitoring at the user's request."


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all text, without a byte-order mark."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def _cell(df: DataFrame, *names: str) -> Column:
    have = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(""))


def connector(kind: Column, identifier: Column) -> tuple[Column, Column, Column]:
    """(enabled, connector JSON, monitor status) that a board kind and identifier allow."""
    tail = F.element_at(F.split(F.regexp_replace(identifier, "/+$", ""), "/"), -1)
    tenant = tenant_parts(identifier)
    us = F.lit("US").alias("default_country")
    named = lambda type_, key, policy="documented_public_api": F.to_json(F.struct(F.lit(type_).alias("type"), tail.alias(key), F.lit(policy).alias("access_policy"), us))
    has = identifier != ""
    tenant_json = F.to_json(F.struct(F.lit("workday").alias("type"), tenant["host"].alias("host"), tenant["tenant"].alias("tenant"), tenant["site"].alias("site"), F.lit("strict").alias("access_policy"), F.lit(False).alias("access_approved"), us))
    manual = F.to_json(F.struct(F.lit("manual").alias("type"), identifier.alias("identifier"), us))
    made = F.when((kind == "greenhouse") & has, named("greenhouse", "board_token")).when((kind == "lever") & has, named("lever", "site")).when((kind == "ashby") & has, named("ashby", "board_name")).when((kind == "smartrecruiters") & has, named("smartrecruiters", "company_identifier", "disabled")).when((kind == "workday") & tenant.isNotNull(), tenant_json).otherwise(manual)
    on = kind.isin("greenhouse", "lever", "ashby") & has
    status = F.when(on, "enabled-documented-public-api").when((kind == "workday") & tenant.isNotNull(), "disabled-pending-tenant-review").when((kind == "smartrecruiters") & has, "disabled-robots-conflict").otherwise("research-only-no-safe-connector-yet")
    return on, made, status


def normalize(batch: DataFrame, name: str) -> DataFrame:
    """A batch's rows in the common columns; counts come from the evidence text in batch A, from columns in batch B."""
    cell = lambda *names: _cell(batch, *names)
    summary = cell("evidence_summary")
    confidence = F.lower(F.replace(F.coalesce(F.nullif(cell("sponsorship_confidence"), F.lit("")), F.lit("historical")), F.lit(" "), F.lit("-")))
    if name == "A":
        counts = [integer_from(p, summary) for p in (r"(\d+)\s+Certified H-1B LCA", r"(\d+)\s+had software", r"(\d+)\s+change-employer position")]
    else:
        counts = [F.coalesce(cell(c).try_cast("int"), F.lit(0)) for c in ("fy2025_q4_certified_records", "fy2025_q4_softwareish_records", "fy2025_q4_change_employer_positions")]
    on, made, status = connector(F.lower(cell("ats_type")), cell("ats_identifier_or_base_url", "ats_identifier/base_url"))
    title = cell("canonical_name")
    return batch.select(
        F.lower(title).alias("key"), slug(title).alias("id"), title.alias("name"), cell("domain").alias("domain"), cell("careers_url").alias("careers_url"), on.alias("enabled"), made.alias("connector"), status.alias("monitor_status"),
        confidence.alias("confidence"), employer_score(confidence).alias("score"), summary.alias("summary"), split_values(cell("evidence_urls", "evidence_url(s)")).alias("sources"), cell("sponsorship_recent_year").alias("evidence_year"),
        counts[0].alias("certified"), counts[1].alias("software_related"), counts[2].alias("change_employer"), split_values(cell("role_fit_tags")).alias("fit_tags"), cell("caveats").alias("notes"), cell("sector").alias("sector"), F.lit(name).alias("batch"),
    ).dropDuplicates(["key"])


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join by name without case; A's values, with tags, sources and notes of both, and B's connector where only that one is enabled."""
    columns = [c for c in a.columns if c != "key"]
    both = a.select("key", *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select("key", *[F.col(c).alias(f"b_{c}") for c in columns]), "key", "full_outer")
    in_a, in_b = F.col("a_id").isNotNull(), F.col("b_id").isNotNull()
    two = in_a & in_b
    take_b = two & ~F.col("a_enabled") & F.col("b_enabled")
    plain = lambda c: F.when(in_a, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    chosen = {c: plain(c) for c in columns}
    for c in ("enabled", "connector", "monitor_status"):
        chosen[c] = F.when(take_b, F.col(f"b_{c}")).otherwise(plain(c))
    chosen["fit_tags"] = F.when(two, F.array_sort(F.array_union("a_fit_tags", "b_fit_tags"))).otherwise(plain("fit_tags"))
    chosen["sources"] = F.when(two, F.array_union("a_sources", "b_sources")).otherwise(plain("sources"))
    notes = F.array_join(F.array_distinct(F.filter(F.array("a_notes", "b_notes"), lambda x: x != "")), " ")
    chosen["notes"] = F.when(two, notes).otherwise(plain("notes"))
    chosen["sector"] = F.when(two & (F.col("a_sector") == ""), F.col("b_sector")).otherwise(plain("sector"))
    chosen["batch"] = F.when(two, "A+B").otherwise(plain("batch"))
    return both.select("key", *[v.alias(c) for c, v in chosen.items()])


def apply_overrides(companies: DataFrame, overrides: DataFrame) -> DataFrame:
    """overrides (name, enabled, connector, monitor_status), nulls leaving a value; ValueError for a name without a company."""
    unknown = [r["name"] for r in overrides.join(companies, "name", "left_anti").select("name").orderBy("name").limit(5).collect()]
    if unknown:
        raise ValueError(f"overrides name unresearched employers: {unknown}")
    o = overrides.select("name", *[F.col(c).alias(f"o_{c}") for c in ("enabled", "connector", "monitor_status")])
    df = companies.join(F.broadcast(o), "name", "left")
    return df.select(*[F.coalesce(f"o_{c}", c).alias(c) if c in ("enabled", "connector", "monitor_status") else F.col(c) for c in companies.columns])


def exclude(companies: DataFrame, names: Sequence[str]) -> DataFrame:
    """The user's word is the last: named companies are off, whatever was found."""
    out = F.col("name").isin(*names) if names else F.lit(False)
    note = F.array_join(F.array_distinct(F.filter(F.array(F.lit(EXCLUDED), F.col("notes")), lambda x: x != "")), " ")
    off = F.regexp_replace("connector", r"\}\s*\z", ',"access_policy":"disabled"}')
    return companies.withColumns({"enabled": F.when(out, False).otherwise(F.col("enabled")), "monitor_status": F.when(out, "disabled-by-user").otherwise(F.col("monitor_status")), "notes": F.when(out, note).otherwise(F.col("notes")), "connector": F.when(out, off).otherwise(F.col("connector"))})


def build(a: DataFrame, b: DataFrame, sitemaps: DataFrame | None = None, overrides: DataFrame | None = None, excluded: Sequence[str] = ()) -> DataFrame:
    """The company table, best evidence first (ties by name). sitemaps: like overrides, but names without a company are ignored."""
    df = merge(normalize(a, "A"), normalize(b, "B"))
    if sitemaps is not None:
        df = apply_overrides(df, sitemaps.join(df.select("name"), "name", "left_semi"))
    if overrides is not None:
        df = apply_overrides(df, overrides)
    df = exclude(df, excluded)
    country = F.coalesce(F.get_json_object("connector", "$.default_country"), F.lit(""))
    return df.withColumn("connector_type", F.get_json_object("connector", "$.type")).withColumn("default_country", country).drop("key").orderBy(F.desc("score"), "name")


def audit(companies: DataFrame) -> DataFrame:
    return companies.withColumn("fit_tags", F.array_join("fit_tags", "; ")).select(*AUDIT_COLUMNS)


def write(companies: DataFrame, path: str) -> None:
    """The company table as JSON lines and its audit as CSV, each one file in order (a universe is some thousands of rows)."""
    ordered = companies.orderBy(F.desc("score"), "name")
    ordered.coalesce(1).write.mode("overwrite").json(f"{path}/companies")
    audit(ordered).coalesce(1).write.mode("overwrite").csv(f"{path}/audit", header=True)
