"""Audits, quarantine, requests, evaluation, batch risk, pages and the sixteen features on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from faultline.operators import alerts, evaluation, features, listings, quality


@pytest.fixture
def pack(spark):
    s = spark.createDataFrame([("S1", "a", "REAL_DATA"), ("S2", None, "synthetic"), ("S2", "c", "DERIVED"), (None, "d", None)], "supplier_id string, supplier_name string, data_status string")
    p = spark.createDataFrame([("P1",), ("P2",)], "product_id string")
    sp = spark.createDataFrame([(" S1 ", "P1"), ("S1", "P1"), ("S1", "P1"), ("S9", "P1"), ("S9", "P2"), (None, None), (None, None)], "supplier_id string, product_id string")
    sites = spark.createDataFrame([("S7", "L1")], "supplier_id string, location_id string")
    empty = spark.createDataFrame([], "location_id string")
    return {"suppliers": s, "products": p, "supplier_products": sp, "supplier_locations": sites, "locations": empty}


def test_reports_count_each_fault_of_each_table(pack):
    got = {r["file"]: r for r in quality.reports(pack, {"products": ("product_id", "product_name")}).collect()}
    s, sp = got["suppliers"], got["supplier_products"]
    assert (s["row_count"], s["column_count"], s["duplicate_ids"], s["total_missing_cells"], s["missing_by_column"]) == (4, 3, 1, 3, {"supplier_id": 1, "supplier_name": 1, "data_status": 1})
    assert (s["synthetic_rows"], s["real_rows"], s["unknown_rows"], s["is_valid"]) == (1, 1, 2, False)
    # two rows beyond the first: one of the equal pairs, one of the nulls; the spaced id is another key but no orphan
    assert (sp["duplicate_relationships"], sp["total_invalid_refs"], sp["invalid_references"]) == (2, 1, {"supplier_id->suppliers.supplier_id": 1})
    assert (got["products"]["missing_columns"], got["products"]["is_valid"]) == ("product_name", False)
    # an empty parent has no orphans, but the supplier S7 is one
    assert got["supplier_locations"]["invalid_references"] == {"supplier_id->suppliers.supplier_id": 1}
    assert (got["locations"]["row_count"], got["locations"]["is_valid"]) == (0, True)


def test_relationships_that_repeat_leave_a_table_valid(spark):
    df = spark.createDataFrame([("S1", "P1"), ("S1", "P1")], "supplier_id string, product_id string")
    r = quality.reports({"supplier_products": df}).first()
    assert (r["duplicate_relationships"], r["is_valid"]) == (1, True)


def test_summary_and_lines(pack):
    reported = quality.reports(pack)
    s = quality.pack_summary(reported).first()
    assert (s["total_files"], s["total_records"], s["real_records"], s["total_duplicate_ids"], s["total_invalid_foreign_keys"], s["all_files_valid"]) == (5, 14, 1, 1, 2, False)
    lines = {r["file"]: r["line"] for r in quality.report_lines(reported).collect()}
    assert lines["products"].endswith("VALID") and lines["suppliers"].endswith("FLAGGED") and lines["suppliers"].startswith("suppliers.csv          | 4  ")
    none = quality.pack_summary(reported.where("file = ''")).first()
    assert (none["total_files"], none["total_records"], none["all_files_valid"]) == (0, 0, True)


def test_split_keeps_every_row_once_with_its_reasons(spark):
    rows = [(1, 5, "a"), (2, -1, "a "), (2, 3, "b"), (3, None, "x"), (None, 1, None), (None, 1, None)]
    df = spark.createDataFrame(rows, "id int, n int, parent string").withColumn("errors", F.lit("kept"))
    held = spark.createDataFrame([("a",), ("a",), ("b ",), (None,)], "key string")
    got = quality.split(df, {"n not negative": F.col("n") >= 0, "has an id": F.col("id").isNotNull()}, ("id",), {"parent": (held, "key")})
    assert [tuple(r) for r in got.accepted.collect()] == [(1, 5, "a", "kept")]
    bad = sorted(((r["id"] or 0, r["n"] or 0, r["reasons"]) for r in got.quarantined.collect()))
    assert bad == [(0, 1, ["has an id"]), (0, 1, ["has an id"]), (2, -1, ["n not negative", "id repeats"]), (2, 3, ["id repeats"]), (3, 0, ["n not negative", "parent unknown"])]
    with pytest.raises(ValueError):
        quality.checked(df, {}, into="errors")


def test_split_of_an_empty_table_and_of_no_rules(spark):
    df = spark.createDataFrame([], "id int")
    got = quality.split(df, {"id": F.col("id") > 0}, ("id",), {"id": (df, "id")})
    assert got.accepted.count() == got.quarantined.count() == 0
    free = quality.split(spark.createDataFrame([(1,), (1,)], "id int"), {})
    assert free.accepted.count() == 2 and free.quarantined.columns == ["id", "reasons"]


def test_a_hot_value_is_marked_in_every_row(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("key"))
    got = quality.split(df, {}, ("key",))
    assert (got.accepted.count(), got.quarantined.count()) == (20_000, 10_000)


def test_requests_fill_defaults_and_name_what_is_out_of_bounds(spark):
    rows = [("ports", "24", None, 1), ("ab", "0", "51", 2), (None, "168", "50", 3), ("x" * 501, "1.5", "ten", 4), ("port \U0001f6a2", "24.0", "1", 5), ("", "169", "", 6)]
    got = {r["extra"]: r for r in quality.requests(spark.createDataFrame(rows, "topic string, hours string, limit string, extra int"), quality.LIVE).collect()}
    assert [got[i]["reasons"] for i in range(1, 7)] == [[], ["topic", "hours", "limit"], [], ["topic", "hours", "limit"], [], ["topic", "hours", "limit"]]
    assert (got[1]["limit"], got[1]["timeout_seconds"], got[1]["model_type"], got[1]["country"], got[5]["hours"]) == (10, 60, "both", None, 24)
    assert got[3]["topic"].startswith("India ports") and got[4]["hours"] is None
    f = quality.requests(spark.createDataFrame([("A1", None, "c" * 1001), ("A2", "ACCEPT", "")], "alert_id string, decision string, comment string"), quality.FEEDBACK)
    assert [r["reasons"] for r in f.orderBy("alert_id").collect()] == [["decision", "comment"], []]
    assert f.where("alert_id = 'A2'").first()["analyst_id"] == "analyst_default"


def _weighted(pairs):
    kinds, n = {x for p in pairs for x in p}, len(pairs)
    out = [0.0, 0.0, 0.0]
    for k in kinds:
        tp, said, support = sum(t == p == k for t, p in pairs), sum(p == k for _, p in pairs), sum(t == k for t, _ in pairs)
        p, r = tp / said if said else 0.0, tp / support if support else 0.0
        for i, v in enumerate((p, r, 2 * p * r / (p + r) if p + r else 0.0)):
            out[i] += v * support / n
    return [round(x, 4) for x in out]


def test_class_metrics_equal_a_loop(spark):
    pairs = [(f"k{i % 4}", f"k{(i * i) % 5}") for i in range(97)] + [("k1", None), (None, None), ("only true", "k0")]
    got = evaluation.class_metrics(spark.createDataFrame(pairs, "truth string, predicted string")).first()
    assert [got["precision"], got["recall"], got["f1"]] == _weighted([(t or "None", p or "None") for t, p in pairs]) and got["samples"] == 100
    none = evaluation.class_metrics(spark.createDataFrame([], "truth string, predicted string")).first()
    assert tuple(none) == (0.0, 0.0, 0.0, 0)


def test_links_are_right_by_the_number_of_the_mention(spark):
    rows = [("Supplier 007", "X", "SUP00007", 0.8), ("Hub 12", "GPE", "LOC00012", None), ("Product 123456", "X", "PROD123456", 0.5), ("Acme 3", "ORG", "SUP00004", 0.9), ("Acme 0", "ORG", None, 0.9), ("no number", "ORG", "SUP00001", 1.0), ("Hub 5", "DATE", "x", 1.0), (None, None, None, None)]
    got = evaluation.link_metrics(spark.createDataFrame(rows, "entity_text string, entity_type string, linked_id string, confidence double")).first()
    assert tuple(got) == (0.6, 0.36, 5)


def test_agreement_and_severe_share(spark):
    c = spark.createDataFrame([(True, True), (True, False), (None, None), (False, None)], "expected boolean, found boolean")
    assert tuple(evaluation.agreement(c).first()) == (0.5, 4)
    a = spark.createDataFrame([("HIGH",), ("LOW",), (None,)], "risk_level string")
    assert tuple(evaluation.severe_share(a).first()) == (0.333, 3)
    assert tuple(evaluation.severe_share(a.where("risk_level = ''")).first()) == (0.0, 0)


def test_batch_risk_reads_aliases_and_keeps_the_rows_columns(spark):
    df = spark.createDataFrame([("a", 5, 1.0, "high", "old", "x"), ("b", None, None, None, "old", "y")], "id string, severity int, geo_exposure double, criticality string, risk_band string, exposure string")
    got = {r["id"]: r for r in alerts.batch_risk(df).collect()}
    assert set(got["a"].asDict()) == {"id", "severity", "geo_exposure", "criticality", "exposure", *alerts.BATCH}
    a, b = got["a"], got["b"]
    assert (a["exposure"], a["severity"], a["primary_driver"], a["risk_type"]) == ("x", 5, "Event Severity", "HEURISTIC_RISK")
    crit = 0.15 * 2 * 0.4
    assert math.isclose(b["normalized_score"], 0.25 * 0.5 + 0.20 * 0.5 + crit + 0.15 * 0.5, abs_tol=1e-9) and b["risk_band"] == "MEDIUM"
    assert a["reasons"].startswith("1. event severity is high; 2. affected location is geographically close; 3. supplier criticality is high") and a["explanation"].startswith(f"Deterministic Risk: {round(a['risk_score'], 1)}/100")
    assert alerts.batch_risk(df.where("id = ''")).count() == 0


def test_a_present_alias_wins_although_it_is_null(spark):
    df = spark.createDataFrame([("a", None, 5)], "id string, event_severity int, severity int")
    assert alerts.batch_risk(df).first()["normalized_score"] == pytest.approx(0.25 * 0.5 + 0.20 * 0.5 + 0.3 * 0.4 + 0.15 * 0.5)


def test_pages_filters_and_totals(spark):
    df = spark.createDataFrame([(i, f"Maker {i}", ("India", "Japan", None)[i % 3], "High" if i % 2 else "Low") for i in range(30)], "supplier_id int, supplier_name string, country string, criticality string")
    s = listings.LISTINGS["suppliers"]
    got = listings.page(listings.filtered(df, s, search="MAKER 1", country="india"), "supplier_id", offset=1, limit=2).collect()
    assert sorted((r["supplier_id"], r["_total"]) for r in got) == [(15, 3), (18, 3)]
    assert [r["supplier_id"] for r in listings.filtered(df, s, search="MAKER 1", country="india", criticality="high").collect()] == [15]
    assert listings.filtered(df, s, pattern="r (1|2)$").count() == 2 and listings.filtered(df, s, search="[").count() == 0
    assert listings.filtered(df, s, country=None, tier="").count() == 30
    assert listings.page(df, "supplier_id", offset=99).count() == 0
    with pytest.raises(ValueError):
        listings.filtered(df, s, colour="red")
    with pytest.raises(ValueError):
        listings.page(df, "supplier_id", limit=0)
    assert [r["supplier_id"] for r in listings.by_id(df, "supplier_id", "7").collect()] == [7] and listings.by_id(df, "supplier_id", "x").count() == 0


def test_display_graph_shows_the_first_of_each_type(spark):
    nodes = spark.createDataFrame([(f"{t}{i:02}", t) for t in ("NEWS", "PRODUCT", "FACILITY") for i in range(20)] + [(None, "NEWS")], "node_id string, node_type string")
    edges = spark.createDataFrame([("NEWS00", "PRODUCT09"), ("NEWS03", "PRODUCT01"), ("NEWS02", "FACILITY00")], "source string, target string")
    n, e = listings.display_graph(nodes, edges)
    assert sorted(r["node_id"] for r in n.collect()) == [f"NEWS{i:02}" for i in range(3)] + [f"PRODUCT{i:02}" for i in range(10)]
    assert [tuple(r) for r in e.collect()] == [("NEWS00", "PRODUCT09")]
    first, _ = listings.display_graph(nodes, edges, None, 4)
    assert sorted(r["node_id"] for r in first.collect()) == [f"FACILITY{i:02}" for i in range(4)]


def test_sixteen_features(spark):
    rows = [("a", " supplier ", "4", None, "Yes"), ("b", "PRODUCT", "nan", 0.7, "no"), ("c", None, None, None, None), (None, "EVENT", "1", 0.1, None)]
    nodes = spark.createDataFrame(rows, "node_id string, node_type string, severity string, exposure_score double, single_source string")
    edges = spark.createDataFrame([("a", " b "), ("a", "b"), ("b", "c"), ("a", "ghost"), (None, "a")], "source string, target string")
    labels = spark.createDataFrame([("a", "80"), ("a", "x"), ("b", None)], "entity_id string, risk_score string")
    got = {r["node_id"]: r for r in features.features16(nodes, edges, labels).collect()}
    assert set(got) == {"a", "b", "c"} and len(features.FEATURES) == 16
    assert [round(v, 6) for v in got["a"]["x"]] == [1, 0, 0, 0, 0, 0, 0.8, 0.2, 0.5, 0, 0.5, 1, 0.8, 0, 0.666667, 0.666667] and got["a"]["y"] == 0.8
    assert [round(v, 6) for v in got["b"]["x"]] == [0, 1, 0, 0, 0, 0, 0, 0.7, 0, 0.5, 0.5, 0, 0.3, 0.666667, 0.333333, 1] and got["b"]["y"] == 0
    assert got["c"]["x"][:6] == [0] * 6 and got["c"]["x"][12:] == [0.3, 1 / 3, 0, 1 / 3]
    assert features.features16(nodes, edges.where("source = ''")).where("x[15] <> 0").count() == 0
