import pytest

from postlake.plans import universe

A = "canonical_name,domain,careers_url,ats_type,ats_identifier_or_base_url,sponsorship_confidence,evidence_summary,evidence_urls,role_fit_tags,caveats,sector,sponsorship_recent_year\n"
B = "canonical_name,ats_type,ats_identifier/base_url,sponsorship_confidence,fy2025_q4_certified_records,fy2025_q4_softwareish_records,fy2025_q4_change_employer_positions,role_fit_tags,caveats,evidence_urls,sector\n"


def batches(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿" + A + 'Acme,acme.example,https://acme.example/jobs,manual,,High,"120 Certified H-1B LCA; 30 had software; 4 change-employer positions",u1;u2,b;a,note a,tech,2025\nSolo,,,greenhouse,https://boards.example/solo,,,,x,,,\n')
    (tmp_path / "b.csv").write_text(B + "ACME,lever,acme,low,9,8,7,c;a,note b,u2;u3,retail\nBeta,workday,t:wd1:site,medium high,5,4,3,,,,\n")
    return universe.read_batch(spark, str(tmp_path / "a.csv")), universe.read_batch(spark, str(tmp_path / "b.csv"))


def test_precedence(spark, tmp_path):
    a, b = batches(spark, tmp_path)
    rows = {r["id"]: r.asDict() for r in universe.build(a, b).collect()}
    acme = rows["acme"]
    assert list(rows) == ["acme", "beta", "solo"]
    assert (acme["batch"], acme["confidence"], acme["score"], acme["certified"], acme["software_related"], acme["change_employer"]) == ("A+B", "high", 0.82, 120, 30, 4)
    assert acme["fit_tags"] == ["a", "b", "c"] and acme["sources"] == ["u1", "u2", "u3"] and acme["notes"] == "note a note b" and acme["sector"] == "tech"
    assert acme["enabled"] and acme["connector_type"] == "lever"  # only B's connector was enabled
    assert rows["beta"]["connector_type"] == "workday" and not rows["beta"]["enabled"] and rows["beta"]["score"] == 0.72
    assert rows["solo"]["enabled"] and rows["solo"]["score"] == 0.30
    assert universe.audit(universe.build(a, b)).columns == universe.AUDIT_COLUMNS


def test_overrides_and_exclusions(spark, tmp_path):
    a, b = batches(spark, tmp_path)
    o = spark.createDataFrame([("Beta", True, '{"type": "sitemap"}', "reviewed")], "name string, enabled boolean, connector string, monitor_status string")
    rows = {r["id"]: r for r in universe.build(a, b, overrides=o, excluded=["Solo"]).collect()}
    assert rows["beta"]["connector_type"] == "sitemap" and rows["beta"]["enabled"]
    assert not rows["solo"]["enabled"] and rows["solo"]["monitor_status"] == "disabled-by-user" and universe.EXCLUDED in rows["solo"]["notes"]
    bad = spark.createDataFrame([("Nobody", True, "{}", "x")], "name string, enabled boolean, connector string, monitor_status string")
    with pytest.raises(ValueError):
        universe.build(a, b, overrides=bad)
    assert universe.build(a, b, sitemaps=bad).count() == 3
