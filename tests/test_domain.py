"""Golden values of scalar operators, and every query against its DuckDB text on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from faultline.functions import columns as c
from faultline.operators import engine as op
from faultline.plans import registry

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "low", "high"), [((51.5074, -0.1278), (48.8566, 2.3522), 340, 346), ((40.7128, -74.006), (39.9526, -75.1652), 125, 135), ((35.6762, 139.6503), (35.4437, 139.638), 24, 28), ((19.076, 72.8777), (18.5204, 73.8567), 115, 125)])
def test_haversine(spark, a, b, low, high):
    assert low <= one(spark, c.haversine(*(F.lit(x) for x in (*a, *b)))) <= high


def test_haversine_out_of_range(spark):
    assert one(spark, c.haversine(F.lit(95.0), F.lit(0.0), F.lit(0.0), F.lit(190.0))) is None


@pytest.mark.parametrize(("d", "score"), [(25.0, 1.0), (25.1, 0.85), (250.0, 0.65), (9999.0, 0.2), (None, 0.1), (-1.0, 0.1)])
def test_zones(spark, d, score):
    assert one(spark, c.zone(F.lit(d).cast("double"), 1)) == score


def test_risk_goldens(spark):
    s, level = op.four_factor_risk(F.lit("High"), F.lit("High"), F.lit("High"), F.lit(1.0), F.lit(False))
    assert (one(spark, s), one(spark, level)) == (92.5, "CRITICAL")
    s, _ = op.four_factor_risk(F.lit("High"), F.lit("High"), F.lit("High"), F.lit(1.0), F.lit(True))
    assert one(spark, s) == 97.5


def test_clean_text(spark):
    assert one(spark, c.clean_text(F.lit("<b>Port</b> closed , see https://x.y/z now !"))) == "Port closed, see now!"


def test_events(spark):
    rows = spark.createDataFrame([("a", "Minor fire at the depot. All fine."), ("b", "Nothing here"), ("c", None), ("d", "A catastrophic warehouse fire.")], "article_id string, content string")
    got = {r.article_id: (r.event_type, r.severity, r.trigger) for r in op.extract_events(rows).collect()}
    assert got == {"a": ("Fire", 3, "fire"), "d": ("Fire", 5, "warehouse fire")}


def test_quality_operators(spark):
    df = spark.createDataFrame([("S1", 1), ("S1", 1), ("S2", None), (None, 3)], "id string, v int")
    assert [r.id for r in op.duplicate_ids(df, "id").collect()] == ["S1"]
    assert op.duplicate_relationships(df, ["id", "v"]).first().extra_rows == 1
    assert {r.column_name: r.n_missing for r in op.missing_cells(df).collect()} == {"id": 1, "v": 1}
    assert [r.orphan for r in op.orphans(df, "id", df.where("id = 'S1'"), "id").collect()] == ["S2"]


def test_orphans_of_the_whole_table(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (5,)], "l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1,), (2,), (3,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    assert [r.orphan for r in registry.queries()["dq_fk_orphans"](spark, str(tmp_path)).collect()] == ["5"]


def test_reasons(spark):
    low, high, no = F.lit(0.1), F.lit(0.8), F.lit(False)
    assert one(spark, op.alert_reasons(low, low, low, low, no, low, high, high)) == "Graph propagation from affected upstream nodes; Essential product criticality"
    assert one(spark, op.alert_reasons(low, low, low, low, no, low, low, low)) == "Routine baseline operational monitoring"
    want = ["High-severity disruption", "Geographic exposure detected", "High dependency relationship", "Elevated deterministic risk", "Graph propagation from affected upstream nodes"]
    assert one(spark, op.alert_reasons(high, high, high, high, no, high, low, low)).split("; ") == want


@pytest.mark.parametrize(("value", "want"), [(1, 0.2), (1.0, 0.2), ("4.0", 0.8), (True, 1.0), (False, 0.0), ("severe", 0.85), (3.3333, 0.6667), (50, 0.5), ("-3", 0.5), (-3, 0.0), (500, 1.0), ("500", 0.5), ("odd", 0.5), (None, 0.5)])
def test_factor(spark, value, want):
    assert one(spark, c.factor(F.lit(value), c.SEVERITY)) == want


@pytest.mark.parametrize(("value", "want"), [(1, 1.0), (2, 0.4), ("1", 0.2), ("HIGH", 0.75), (50, 0.5), (-1, 0.0), ("severe", 0.5), (True, 1.0), (None, 0.5)])
def test_legacy_factor(spark, value, want):
    assert one(spark, c.legacy_factor(F.lit(value), c.SEVERITY4)) == want


def test_band_before_rounding(spark):
    row = spark.createDataFrame([(0.99984, 1.0, 0.0, 1.0, 1.0, None)], "severity double, exposure double, supplier double, product double, dependency double, single string")
    got = op.six_factor_risk(row).first()
    assert (got.risk_norm, got.risk_band, got.primary_driver) == (0.75, "HIGH", "severity")
    assert op.six_factor_risk(row.withColumn("single", F.lit("Sole"))).first().f_single == 1.0


def test_whole_word_severity(spark):
    assert one(spark, op.severity(F.lit(4), F.lit("A fire near the minority district office"))) == 4
    assert one(spark, op.severity(F.lit(4), F.lit("A fire severed the cable"))) == 4
    assert one(spark, op.severity(F.lit(3), F.lit("A minor flood destroyed nothing"))) == 4


def test_hits_counts_terms_within_terms(spark):
    assert one(spark, c.hits(F.lit("the freight train, a freighter and supply chain freight train"), ("freight", "freight train", "train", "supply chain", "chain"))) == 5


def test_orphans_of_an_empty_parent(spark):
    df = spark.createDataFrame([("S1",)], "id string")
    assert op.orphans(df, "id", df.limit(0), "id").count() == 0


def test_graph_measures(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "c"), ("a", "c"), ("e", "d")], "src string, dst string")
    n = spark.createDataFrame([(x,) for x in "abcdefg"], "node_id string")
    assert op.density(e, n).first().density == 0.119048
    assert {tuple(r) for r in op.degree_stats(e, n).collect()} == {("in", 0, 2, 0.714, 0.0), ("out", 0, 2, 0.714, 1.0), ("total", 0, 3, 1.429, 2.0)}
    assert {tuple(r) for r in op.ego_network(e, "b", 1).collect()} == {("a", "b"), ("c", "b"), ("a", "c")}
    assert ("d", "c") in {tuple(r) for r in op.ego_network(e, "b", 2).collect()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels"):
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def rows(table, cols):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in zip(*(table[x].to_pylist() for x in cols), strict=True))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toArrow()
    if sql := registry.oracle_sql().get(name):
        want = duck.execute(sql).to_arrow_table()
        cols = sorted(want.column_names)
        assert sorted(got.column_names) == cols
        assert rows(got, cols) == rows(want, cols)


def test_stream(spark, tmp_path):
    from faultline.streaming import ingest

    (tmp_path / "a.json").write_text('{"url": "http://A", "published_at": "2024-01-01T00:00:00"}\n{"url": "http://a ", "published_at": "2024-01-01T00:01:00"}\n{"url": " ", "published_at": "2024-01-01T00:02:00"}\n')
    q = ingest.fresh(ingest.articles(spark, str(tmp_path), "url string, published_at timestamp")).writeStream.format("memory").queryName("fresh").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("fresh").count() == 1
