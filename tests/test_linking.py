"""Linking, names, alerts and metrics on fixed rows."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import alerts, linking
from faultline.operators import engine as op


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("Acme Co., Ltd.", "acme"), ("Port of Rotterdam", "rotterdam port"), ("USA", "united states"), ("U.S.", "u s"), ("Nordic Steel Industries Group", "nordic steel"), (None, ""), ("Müller  & Söhne", "müller söhne")])
def test_linking_text(spark, text, want):
    assert one(spark, linking.linking_text(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("name", "kind", "want"), [("Apple Inc.", "ORG", "APPLE"), ("Port of Rotterdam", "", "ROTTERDAM PORT"), ("USA", "", "UNITED STATES"), ("Ningbo port", "PORT", "NINGBO PORT"), ("Co.", "ORG", "CO."), ("Apple Inc.", "CITY", "APPLE INC."), (None, "", "UNKNOWN")])
def test_entity_name(spark, name, kind, want):
    assert one(spark, linking.entity_name(F.lit(name).cast("string"), F.lit(kind))) == want


def test_numbers(spark):
    assert one(spark, linking.numbers(F.lit("Plant 007 of 12"))) == ["007", "12", "7"]
    assert one(spark, linking.conflict(linking.numbers(F.lit("Unit 5")), linking.numbers(F.lit("Unit 6"))))
    assert not one(spark, linking.conflict(linking.numbers(F.lit("Unit 05")), linking.numbers(F.lit("Unit 5"))))


def test_cascade(spark):
    master = spark.createDataFrame([("S2", "Nordic Steel Works"), ("S1", "Acme Metals Ltd"), ("S3", "Supplier 17"), ("S4", "Delta Marine Motors")], "id string, name string")
    mentions = spark.createDataFrame([(x,) for x in ("ACME METALS LTD", "s2", "Acme Metals Inc.", "Nordic Steel Work", "Delta Marine Motor Works", "Supplier 18", "Nothing alike", " ", "Nordic Steel Works")], "mention string")
    got = {x.mention: (x.linked_id, x.match_method) for x in linking.link(mentions, master, "SUPPLIER").collect()}
    assert got == {"ACME METALS LTD": ("S1", "exact"), "s2": ("S2", "exact"), "Acme Metals Inc.": ("S1", "normalized"), "Nordic Steel Work": ("S2", "alias"), "Delta Marine Motor Works": ("S4", "fuzzy"), "Supplier 18": ("UNKNOWN", "unresolved"), "Nothing alike": ("UNKNOWN", "unresolved"), "Nordic Steel Works": ("S2", "exact")}


def test_dispatch_and_report(spark):
    s = spark.createDataFrame([("S1", "Acme")], "id string, name string")
    l_ = spark.createDataFrame([("L1", "East Hub", "Lyon", "France"), ("L0", "West Hub", "Nice", "France")], "id string, name string, city string, country string")
    p = spark.createDataFrame([("P1", "Bolt", "Fasteners")], "id string, name string, category string")
    m = spark.createDataFrame([("Acme", "ORG"), ("France", "GPE"), ("lyon", "CITY"), ("fasteners", "PRODUCT"), ("Bolt", "MISC"), ("zzz", None)], "mention string, entity_type string")
    links = linking.link_entities(m, s, l_, p)
    assert {(x.mention, x.linked_id, x.match_method) for x in links.collect()} == {("Acme", "S1", "exact"), ("France", "L0", "alias"), ("lyon", "L1", "normalized"), ("fasteners", "P1", "alias"), ("Bolt", "P1", "exact"), ("zzz", "UNKNOWN", "unresolved")}
    r = linking.link_report(links).first()
    assert (r.total_entities, r.exact_matches, r.unresolved_entities, r.unresolved_percentage) == (6, 2, 1, "16.7%")


def test_alerts_of_bare_records(spark):
    rows = spark.createDataFrame([("SUP1", "E1", 80.0, 4.0, "NO"), ("SUP2", "E2", None, None, None)], "supplier_id string, event_id string, deterministic_risk double, severity double, single_source string")
    got = {x.supplier_id: x for x in alerts.generate_alerts(rows).collect()}
    a = got["SUP1"]
    assert (a.alert_id, a.combined_risk, a.risk_band, a.graphsage_risk) == ("ALT-E1-SUP1", 0.8, "CRITICAL", 0.8)
    assert a.reasons.startswith("High-severity disruption; Moderate geographic proximity to event") and a.reasons.endswith("Single-source sole supplier vulnerability"), "any text counts as true, also NO"
    assert a.explanation.splitlines()[:5] == ["Supplier:", "SUP1 (Supplier SUP1)", "", "Risk:", "CRITICAL"]
    assert (got["SUP2"].combined_risk, got["SUP2"].event_type) == (0.5, "Operational Disruption")


def test_truthy_flags_and_missing_ids(spark):
    cases = (("boolean", [True, False, None]), ("double", [1.0, 0.0, None]), ("int", [2, 0, None]), ("string", ["NO", "", None]))
    for kind, values in cases:
        rows = spark.createDataFrame([(f"S{i}", v) for i, v in enumerate(values)], f"supplier_id string, single_source {kind}")
        got = {r.supplier_id: "Single-source" in r.reasons for r in alerts.generate_alerts(rows).collect()}
        assert got == {"S0": True, "S1": False, "S2": False}, kind
    bare = alerts.generate_alerts(spark.range(7, numPartitions=3).selectExpr("0.9 as deterministic_risk"), F.lit("2024-01-01"))
    assert sorted(r.alert_id for r in bare.collect()) == [f"ALT-EVT_{i:05d}-SUP_{i:05d}" for i in range(7)] and "created_at" in bare.columns


def test_unified_alerts(spark):
    old = spark.createDataFrame([("A1", "high", 72.0, 60.0, 55.0)], "alert_id string, combined_risk_level string, combined_risk_score double, deterministic_risk double, graph_risk_score double")
    a = alerts.unified(old).first()
    assert (a.risk_band, a.combined_risk, a.risk_score_100, a.deterministic_risk, a.graphsage_risk, a.event_type) == ("HIGH", 0.72, 72.0, 0.6, 0.55, "Disruption")


def test_drivers(spark):
    f = {"severity": 0.8, "exposure": 0.2, "supplier": 0.5, "product": 0.3, "dependency": 0.5, "single": 1.0}
    assert one(spark, alerts.drivers({k: F.lit(v) for k, v in f.items()})) == ["1. event severity is high", "2. single-source dependency exists with no immediate redundant supplier", "3. supplier criticality is moderate", "4. supplier has moderate dependency"]
    assert one(spark, alerts.drivers({k: F.lit(0.1) for k in f})) == ["1. event severity is low", "2. affected location is geographically distant"]


def test_metrics_and_prune(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.6), (0, 0.6), (0, 0.2), (1, 0.1)], "label long, score double")
    m = op.classifier_metrics(rows).first()
    assert (m.roc_auc, m.accuracy, m.precision, m.recall) == (0.583333, 0.6, 0.666667, 0.666667)
    assert op.classifier_metrics(rows.limit(0)).first().roc_auc == 0.0
    e = spark.createDataFrame([("a", "b"), ("a", "x")], "src string, dst string")
    assert [tuple(x) for x in op.prune(e, spark.createDataFrame([("a",), ("b",)], "node_id string")).collect()] == [("a", "b")]


def test_entity_risk(spark):
    s = spark.createDataFrame([("S1", "Acme", "High", "Tier-1", True), ("S2", "Beta", "Low", "Tier-2", False), ("S3", None, None, None, None)], "supplier_id string, supplier_name string, criticality string, tier string, single_source boolean")
    a = spark.createDataFrame([("A2", "S2", "Beta", 0.2, 0.2, 0.2, "late", "x"), ("A1", "S2", "Beta", 80.0, 0.4, 0.4, "early", "y"), ("A3", "S9", "Gone", 0.5, 0.5, 0.5, "r", "z")], "alert_id string, supplier_id string, supplier_name string, deterministic_risk double, graphsage_risk double, gat_risk double, reasons string, explanation string")
    got = {r.entity_id: r for r in alerts.entity_risk(a, s).collect()}
    assert sorted(got) == ["S1", "S2", "S3", "S9"]
    # 0.30 * 0.5 + 0.25 * 1 + 0.25 * 1 + 0.20 * 0.2, and 5 for the single source
    one = got["S1"]
    assert (one.deterministic_risk, one.graphsage_risk, one.gat_risk, one.risk_band, one.active_alerts_count) == (0.74, 0.666, 0.703, "HIGH", 0)
    assert one.combined_risk == pytest.approx(0.71225, abs=6e-5) and one.reasons.endswith("Single-source sole supplier vulnerability")
    two = got["S2"]
    assert (two.deterministic_risk, two.combined_risk, two.risk_band, two.reasons, two.active_alerts_count) == (0.8, 0.6, "HIGH", "early", 2)
    assert got["S3"].entity_name == "Supplier S3" and "Tier-2" in got["S3"].reasons and got["S9"].combined_risk == 0.5


def test_numbers_decide(spark):
    """Of names that share all their words, the one with the number wins; numbers in conflict rule a name out."""
    names = spark.createDataFrame([(f"S{i}", f"Vendor {i:05d}") for i in range(300)] + [("T", "Vendor Works")], "id string, name string")
    both = {(r.mention, r.linked_id, r.match_method) for r in linking.link(spark.createDataFrame([("The Vendor 7",), ("vendor 00007 x",)], "mention string"), names, "SUPPLIER").collect()}
    assert both == {("The Vendor 7", "S7", "fuzzy"), ("vendor 00007 x", "S7", "alias")}
