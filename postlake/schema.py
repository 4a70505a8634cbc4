"""Row types, enumerated domains and state tables."""

from __future__ import annotations

POSTING = (
    "company_id string, company string, source string, source_job_id string, title string, location string, description string, "
    "source_url string, apply_url string, posted_at timestamp, posting_date_kind string, posting_date_confidence string, "
    "employment_type string, department string, workplace_type string, raw string"
)
POSTING_COLUMNS = [part.split()[0] for part in POSTING.split(", ")]

COMPANY = (
    "id string, name string, domain string, careers_url string, enabled boolean, connector_type string, connector string, default_country string, "
    "confidence string, score double, summary string, sources array<string>, fit_tags array<string>, notes string"
)

# Enumerated domains.
RUN_STATUS = ("running", "success", "partial", "failed")
USABLE_RUN = ("success", "partial")
SOURCE_STATUS = ("ok", "degraded", "error", "skipped")
EVENTS = ("new", "seen", "reposted", "updated")
PRIORITIES = ("P0", "P1", "P2", "REJECT")
LOCATION_STATUS = ("us", "non_us", "us_inferred_remote", "unknown")
ROLE_SIGNALS = ("explicit_no_sponsorship", "explicit_h1b_sponsorship_available", "explicit_sponsorship_available", "not_stated")
DATE_CONFIDENCE = ("high", "medium_high", "medium", "low", "unknown")
EMPLOYER_SCORES = {"high": 0.82, "medium-high": 0.72, "medium": 0.62, "low": 0.45, "historical": 0.30}

STATE = {
    "runs": "run_id string, started_at timestamp, finished_at timestamp, mode string, status string, companies_total int, companies_ok int, companies_failed int, fetched_jobs int, accepted_jobs int, emitted_jobs int, error string",
    "jobs": "job_key string, company_id string, source_job_id string, source_url string, title string, location string, posted_at timestamp, first_seen_at timestamp, last_seen_at timestamp, last_emitted_at timestamp, content_hash string, active boolean",
    "sightings": "run_id string, job_key string, seen_at timestamp, posted_at timestamp, accepted boolean, emitted boolean, match_score double, priority string, event_type string",
    "company_runs": "run_id string, company_id string, source string, status string, fetched_jobs int, requests int, error string, warning string",
    "profile_fingerprints": "company_id string, source string, profile_fingerprint string, applied_at timestamp",
    "raw_pages": "url string, etag string, last_modified string, fetched_at timestamp, status int, body binary",
    "receipts": "job_key string, posted_at timestamp, reported_at timestamp, report_id string",
}
STATE_KEYS = {
    "runs": ["run_id"],
    "jobs": ["job_key"],
    "sightings": ["run_id", "job_key"],
    "company_runs": ["run_id", "company_id"],
    "profile_fingerprints": ["company_id", "source"],
    "raw_pages": ["url"],
    "receipts": ["job_key"],
}
