"""Gates, capped scores and priorities as one projection, with one Arrow stage behind the cheap gates."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.experience import read_experience
from ..functions.html import explicit_countries, strip_html_where_marked
from ..functions.text import fold_hyphens, matches, strip
from ..rules import BANK_LADDER, STAFF_NAMES, RuleSet
from .evidence import role_score, role_signal
from .location import location_status

QUICK = ("non-US location", "title lacks a target engineering discipline")
READ = ("needs", "min_years", "max_years", "overages", "restricted", "scopes")


def likely_detail(title: Column, rules: RuleSet) -> Column:
    """Titles worth a detail request: likely ones that aren't plainly off target."""
    plain = F.regexp_replace(title, "(?iUd)" + rules["detail_exempt_title_regex"], "")
    return matches(title, rules["likely_detail_title_regex"]) & (matches(title, rules["aligned_data_engineer_title_regex"]) | ~matches(plain, rules["non_target_title_regex"]))


def _number(x: Column) -> Column:
    """As %g writes it, for whole numbers and one decimal."""
    return F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")


def notes(*pairs: tuple[Column, Column | str]) -> Column:
    """The texts whose conditions hold, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in pairs])))


def title_score(title: Column, rules: RuleSet) -> Column:
    points = [F.when(matches(title, p), float(w)).otherwise(0.0) for _, w, p in rules.title_rules]
    return F.least(F.lit(rules.max_title), reduce(add, points, F.lit(0.0)))


def skill_flags(text: Column, rules: RuleSet) -> list[Column]:
    return [reduce(or_, [matches(text, p) for p in patterns]) for _, _, patterns in rules.skill_groups]


def skill_score(flags: list[Column], rules: RuleSet) -> Column:
    points = [F.when(f, float(w)).otherwise(0.0) for f, (_, w, _) in zip(flags, rules.skill_groups, strict=True)]
    return F.least(F.lit(rules.max_skill), reduce(add, points, F.lit(0.0)))


def breadth_bonus(groups: Column) -> Column:
    n = F.size(groups)
    return F.when(n >= 4, 6.0).when(n == 3, 4.0).when(n == 2, 2.0).otherwise(0.0)


def experience_points(years: Column, rules: RuleSet) -> Column:
    return F.when(years <= 2, 3.0).when(years <= rules.ideal_years, 12.0).when(years <= rules.max_years, 8.0).otherwise(0.0)


def priority(accepted: Column, specialty: Column, secondary: Column, band: Column, years: Column, score: Column, sponsorship: Column, age_days: Column, rules: RuleSet) -> Column:
    fit = ~band & F.coalesce((years > 2) & (years <= rules.ideal_years), F.lit(False))
    first = fit & specialty & ~secondary & (score >= rules.p0_score) & (sponsorship >= rules.p0_sponsorship) & F.coalesce(age_days <= 2.25, F.lit(True))
    second = fit & (score >= rules.p1_score) & (sponsorship >= rules.p1_sponsorship)
    return F.when(~accepted, "REJECT").when(first, "P0").when(second, "P1").otherwise("P2")


def prepared(postings: DataFrame, rules: RuleSet) -> DataFrame:
    """postings with _title, _location_status and _quick, the reason that spares reading the description (or null)."""
    title = strip(F.col("title"))
    df = postings.withColumn("_title", title).withColumn("_location_status", location_status(F.col("location"), F.col("workplace_type"), explicit_countries(F.col("raw")), F.col("default_country")))
    lacks = ~matches(F.col("title"), rules["target_title_regex"]) & ~matches(F.col("title"), rules["aligned_data_engineer_title_regex"])
    abroad = F.lit(rules.require_us) & (F.col("_location_status") == "non_us")
    return df.withColumn("_quick", F.when(abroad, QUICK[0]).when(lacks, QUICK[1]))


def evaluate(postings: DataFrame, rules: RuleSet, now: Column) -> DataFrame:
    """postings (joined to their company's confidence, score and default_country) with the decision's columns.

    Adds accepted, match_score, priority, why, rejection_reasons, min_years, max_years, sponsorship_score and
    role_signal, and puts the description that was judged in place. Rows with a quick reason don't pass through
    Python for their description: they take the other branch of a union.
    """
    df = prepared(postings, rules)
    quick = df.where(F.col("_quick").isNotNull())
    none = F.lit(None).cast("double")
    quick = quick.select(
        *[c for c in postings.columns],
        "_location_status",
        F.lit(False).alias("accepted"), F.lit(0.0).alias("match_score"), F.lit("REJECT").alias("priority"),
        F.array().cast("array<string>").alias("why"), F.array("_quick").alias("rejection_reasons"), none.alias("min_years"), none.alias("max_years"),
        F.col("score").alias("sponsorship_score"), F.lit("not_stated").alias("role_signal"),
    )
    return _full(df.where(F.col("_quick").isNull()), postings.columns, rules, now).unionByName(quick)


def _full(df: DataFrame, columns: list[str], rules: RuleSet, now: Column) -> DataFrame:
    df = df.withColumn("description", fold_hyphens(strip_html_where_marked(F.coalesce("description", F.lit("")))))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    df = df.withColumn("_text", F.concat(F.col("_title"), F.lit("\n"), blank("department"), F.lit("\n"), F.col("description")))
    df = df.withColumn("_meta", F.concat(blank("employment_type"), F.lit("\n"), blank("department")))
    df = df.withColumn("_read", read_experience(F.col("description"), F.col("_text"), rules.secondary_groups, rules["work_authorization_restriction_regex"], rules.required_scopes, rules.degree, rules["core_technology_regex"]))
    df = df.select("*", *[F.col(f"_read.{c}").alias(f"_{c}") for c in READ])
    flags = skill_flags(F.col("_text"), rules)
    df = df.withColumn("_flags", F.array(*flags))  # each pattern is matched once
    flags = [F.get("_flags", k) for k in range(len(rules.skill_groups))]
    labels = F.array_compact(F.array(*[F.when(f, F.lit(g[0])) for f, g in zip(flags, rules.skill_groups, strict=True)]))
    df = df.withColumn("_labels", labels).withColumn("_skill", skill_score(flags, rules)).withColumn("_signal", role_signal(F.col("_text")))
    df = df.withColumn("_sponsor", role_score(F.col("_signal"), F.col("score")))

    title, text, meta, years = F.col("_title"), F.col("_text"), F.col("_meta"), F.col("_min_years")
    aligned, platform = matches(title, rules["aligned_data_engineer_title_regex"]), matches(title, rules["secondary_platform_title_regex"])
    platform_dept = matches(blank("department"), rules["secondary_platform_department_regex"])
    ranges = F.filter("_needs", lambda n: n["is_range"] & ~n["preferred"])
    df = df.withColumn("_junior", F.exists(ranges, lambda n: n["high"] <= 2)).withColumn("_band", F.exists(ranges, lambda n: (n["low"] <= 1) & (n["high"] <= 3)))
    fit = experience_points(years, rules)
    raw = title_score(title, rules) + F.col("_skill") + breadth_bonus(F.col("_labels")) + fit - F.when(F.col("_band"), 6.0).otherwise(0.0)
    df = df.withColumn("match_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(raw, 1))))

    without = lambda p: F.regexp_replace(title, "(?iUd)" + p, "")
    software = matches(text, rules["software_development_evidence_regex"])
    senior = matches(title, rules["selective_senior_title_regex"])
    status, sponsor, signal, score = F.col("_location_status"), F.col("_sponsor"), F.col("_signal"), F.col("match_score")
    us = F.lit(rules.require_us)
    gates = [
        ((title == "") | (blank("source_url") == ""), "missing title or official source URL"),
        (matches(title, rules["internship_title_regex"]) | matches(meta, rules["internship_title_regex"]), "internship/co-op"),
        (matches(without(BANK_LADDER), rules["junior_title_regex"]) | matches(meta, rules["early_career_metadata_regex"]), "new-grad/entry-level"),
        (matches(title, rules["management_title_regex"]), "people-management role"),
        (matches(blank("department"), rules["irrelevant_department_regex"]) & ~platform_dept, "department is outside backend/platform/security/SRE scope"),
        (matches(without(STAFF_NAMES), rules["too_senior_title_regex"]), "staff/principal/architect/lead level"),
        (matches(title, rules["level_i_title_regex"]), "level-I/junior role"),
        (matches(title, rules["level_iv_title_regex"]), "level-IV/V role exceeds target seniority"),
        (matches(title, rules["irrelevant_title_regex"]) & ~(aligned | platform), "title is outside backend/platform/security/SRE scope"),
        (matches(title, r"\bfederal\b") | F.col("_restricted"), "citizenship/clearance-restricted or federal role"),
        (~matches(title, rules["target_title_regex"]) & ~aligned, QUICK[1]),
        (~matches(text, rules["core_professional_evidence_regex"]), "posting lacks a professionally evidenced core technology or domain"),
        (matches(title, rules["operations_title_regex"]) & ~software, "operations-oriented title lacks software-development evidence"),
        (aligned & ~software, "streaming data-engineer title lacks software-development evidence"),
        (matches(F.col("description"), rules["unsupported_specialization_evidence_regex"]), "posting requires a specialist domain not established by the resume"),
        *[(F.array_contains("_scopes", label), f"posting requires {label}") for label, _ in rules.required_scopes],
        (us & (status == "non_us"), QUICK[0]),
        (us & (status == "unknown"), "US eligibility could not be verified from location"),
        (F.col("_junior"), "experience range is explicitly junior (at most two years)"),
        (~F.col("_junior") & F.col("_band"), "experience range is an early-career band (1-3 years)"),
        (~F.col("_junior") & ~F.col("_band") & (years <= 1) & (F.col("_max_years") <= 1), "experience floor is explicitly junior (one year or less)"),
    ]
    over = F.transform("_overages", lambda o: F.concat(F.lit("requires "), o["years"].cast("string"), F.lit("+ years of "), o["label"], F.lit(", beyond verified resume depth")))
    late = [
        (years > rules.max_years, F.concat(F.lit("requires about "), _number(years), F.lit("+ years"))),
        (senior & years.isNull(), f"Senior title with no verifiable 3-{rules.senior_max_years:g} year experience floor"),
        (senior & (years > rules.senior_max_years), "Senior role exceeds configured experience ceiling"),
        ((signal == "explicit_no_sponsorship") & F.lit(rules.exclude_explicit_no), "posting explicitly rules out sponsorship"),
        (sponsor < rules.min_sponsorship, "employer/role sponsorship confidence below threshold"),
        (score < rules.min_score, F.concat(F.lit("match score "), _number(score), F.lit(f" is below {rules.min_score:g}"))),
    ]
    df = df.withColumn("rejection_reasons", F.array_distinct(F.concat(notes(*gates), over, notes(*late)))).withColumn("accepted", F.size("rejection_reasons") == 0)
    accepted = F.col("accepted")
    why = notes(
        (us & status.startswith("us_inferred"), "US location inferred from the employer feed configuration"),
        (us & (status == "us") | ~us & status.isin("us", "us_inferred_remote", "us_inferred_missing"), "US/US-remote location"),
        (years <= rules.max_years, F.concat(F.lit("experience floor appears to be "), _number(years), F.lit(" years"))),
        (senior & (years <= rules.senior_max_years), "Senior title retained because stated experience is within range"),
        (signal == "explicit_h1b_sponsorship_available", "posting explicitly indicates H-1B sponsorship availability"),
        (signal == "explicit_sponsorship_available", "posting explicitly indicates generic visa sponsorship availability"),
        ((signal == "not_stated") & (sponsor >= rules.min_sponsorship), F.concat(F.col("confidence"), F.lit(" employer-level sponsorship evidence"))),
        (F.size("_labels") > 0, F.concat(F.lit("matches "), F.array_join(F.slice("_labels", 1, 6), ", "))),
        (accepted & (years > rules.ideal_years), "experience floor is above the ideal target; priority capped at P2"),
        (accepted & years.isNull(), "experience floor is not verifiable; priority capped at P2"),
        (accepted & (years <= 2), "experience floor is below the target band; priority capped at P2"),
    )
    age = (F.unix_micros(now) - F.unix_micros("posted_at")) / F.lit(86_400_000_000.0)
    second = matches(title, rules["secondary_specialty_title_regex"]) | aligned | platform | platform_dept
    rank = priority(accepted, matches(title, rules["p0_specialty_title_regex"]), second, F.col("_band"), years, score, sponsor, age, rules)
    return df.select(
        *columns, "_location_status", "accepted", "match_score", rank.alias("priority"), why.alias("why"), "rejection_reasons",
        years.alias("min_years"), F.col("_max_years").alias("max_years"), F.bround("_sponsor", 2).alias("sponsorship_score"), signal.alias("role_signal"),
    )
