"""The graph builder against a dictionary graph, row by row, and dense indices by type."""

import random

import pytest

from faultline.operators import builder


@pytest.fixture(scope="module")
def tables(spark):
    g = random.Random(7)
    d = spark.createDataFrame
    s = [(i, f"S{g.randrange(30)}" if i < 40 else (" ", "nan", None)[i - 40], f"name {i}", g.choice((1, 2, None)), g.choice(("High", None))) for i in range(43)]
    p = [(i, f"P{g.randrange(25)}", f"part {i}", g.choice(("Low", "High"))) for i in range(30)]
    loc = [(i, f"L{i}", f"place {i}", g.choice((10.5, None)), 20.0) for i in range(8)]
    sp = [(i, f"S{g.randrange(34)}", f"P{g.randrange(28)}", g.choice((85.0, 12.345, None))) for i in range(60)]
    sl = [(i, f"S{g.randrange(32)}", f"L{g.randrange(10)}", g.choice(("Warehouse", None))) for i in range(40)]
    n = [(i, f"A{i}", "t" * 150 if i else None, "feed") for i in range(6)]
    e = [(i, f"E{i}", f"A{g.randrange(8)}", g.choice(("Fire", "Flood")), g.choice((4, None)), g.choice(("L1", "L2", "UNKNOWN", None, "L99"))) for i in range(20)]
    old = [(0, "S3", "supplier", "old", None), (1, "X1", None, None, "there"), (2, "P2", "product", None, None)]
    oe = [(0, "X1", "S3", None, None), (1, "S3", "gone", "RELATION", 2.0), (2, "L1", "FAC_S1_L1", "OVERRIDES", 0.12345)]
    rows = {"suppliers": s, "products": p, "locations": loc, "supplier_products": sp, "supplier_locations": sl, "news": n, "events": e, "nodes": old, "edges": oe}
    schema = {
        "suppliers": "ordinal long, supplier_id string, supplier_name string, tier int, criticality string", "products": "ordinal long, product_id string, product_name string, criticality string", "locations": "ordinal long, location_id string, location_name string, latitude double, longitude double",
        "supplier_products": "ordinal long, supplier_id string, product_id string, share_percent double", "supplier_locations": "ordinal long, supplier_id string, location_id string, facility_type string", "news": "ordinal long, article_id string, title string, source_name string",
        "events": "ordinal long, event_id string, article_id string, event_type string, severity int, location_id string", "nodes": "ordinal long, node_id string, node_type string, label string, source string", "edges": "ordinal long, source string, target string, edge_type string, weight double",
    }
    return rows, {k: d(v, schema[k]) for k, v in rows.items()}


def drawn(t, chained=True):
    """Nodes and edges as dictionaries, in the order of the tables and their rows."""
    nodes, edges = {}, {}
    ok = lambda *x: all(v is not None and v.strip() not in ("", "nan") for v in x)
    put = lambda k, **a: nodes.setdefault(k, {}).update(a)
    link = lambda u, v, k, w: edges.__setitem__((u, v), (k, round(w, 4)))
    for _, i, k, label, src in t["nodes"]:
        put(i, node_type=(k or "UNKNOWN").upper(), label=label or i, source=src or "PROJECT_DEMO_EXPANSION")
    for _, i, n, tier, crit in t["suppliers"]:
        if ok(i):
            put(i, node_type="SUPPLIER", label=n, tier=tier or 1, criticality=crit or "Medium", source="MASTER_SUPPLIERS")
    for _, i, n, crit in t["products"]:
        put(i, node_type="PRODUCT", label=n, criticality=crit, source="MASTER_PRODUCTS")
    for _, i, n, lat, _lon in t["locations"]:
        put(i, node_type="LOCATION", label=n, latitude=lat or 0.0, source="MASTER_LOCATIONS")
    for _, i, title, src in t["news"]:
        put(i, node_type="NEWS", label=(title or i)[:100], source=src)
    for _, i, _a, kind, sev, _l in t["events"]:
        put(i, node_type="EVENT", label=kind, severity=float(sev or 3), source="NLP_EVENT_EXTRACTION")
    for _, s, loc, kind in t["supplier_locations"]:
        put(f"FAC_{s}_{loc}", node_type="FACILITY", label=f"Facility {s}-{loc}", facility_type=kind or "Manufacturing", source="SUPPLIER_LOCATIONS")
        link(loc, f"FAC_{s}_{loc}", "LOCATION_AFFECTS_FACILITY", 0.9)
        link(f"FAC_{s}_{loc}", s, "FACILITY_BELONGS_TO_SUPPLIER", 1.0)
    for _, s, p, share in t["supplier_products"]:
        link(s, p, "SUPPLIER_PROVIDES_PRODUCT", round(share / 100, 3) if share is not None else 0.8)
    for _, i, a, _k, _s, loc in t["events"]:
        link(a, i, "NEWS_HAS_EVENT", 0.95)
        if loc not in (None, "UNKNOWN"):
            link(i, loc, "EVENT_AT_LOCATION", 0.9)
    for _, u, v, k, w in t["edges"]:
        link(u, v, k or "RELATION", 1.0 if w is None else w)
    for kind, most, w, name in builder.CHAINS if chained else ():
        some = [k for k, a in nodes.items() if a["node_type"] == kind]
        for a, b in list(zip(some[1:], some, strict=False))[:most]:
            link(a, b, name, w)
    lost = {k for k in edges if k[0] not in nodes or k[1] not in nodes}
    return nodes, {k: v for k, v in edges.items() if k not in lost}, lost


def test_builder_against_dictionaries(tables):
    rows, t = tables
    nodes, edges, lost = drawn(rows)
    g = builder.build(**t)
    got = {r.node_id: r for r in g.nodes.collect()}
    assert sorted(got) == sorted(nodes)
    for k, want in nodes.items():
        assert {a: got[k][a] for a in want} == want, k
    assert {(r.source, r.target): (r.edge_type, r.weight) for r in g.edges.collect()} == edges
    assert {(r.source, r.target) for r in g.removed.collect()} == lost
    assert {r.node_id for r in g.ghosts.collect()} == {x for e in lost for x in e if x not in nodes}
    assert {k for k, _ in edges.values()} >= {"LOCATION_AFFECTS_FACILITY", "FACILITY_BELONGS_TO_SUPPLIER", "SUPPLIER_PROVIDES_PRODUCT", "NEWS_HAS_EVENT", "EVENT_AT_LOCATION", "SUPPLIER_DEPENDS_ON_SUPPLIER", "PRODUCT_DEPENDS_ON_PRODUCT"}
    s = {(r.part, r.kind): r.n for r in builder.summary(g).collect()}
    assert (s["nodes", "all"], s["edges", "all"], s["removed", "all"]) == (len(nodes), len(edges), len(lost))
    assert s["nodes", "SUPPLIER"] == sum(a["node_type"] == "SUPPLIER" for a in nodes.values())
    at, rel = builder.encode(g)
    index = {}
    for r in at.collect():
        index[r.node_id] = (r.node_type, r.idx)
        assert len(r.x) == 8
    for kind in {a["node_type"] for a in nodes.values()}:
        assert [index[k] for k in sorted(k for k, a in nodes.items() if a["node_type"] == kind)] == [(kind, i) for i in range(s["nodes", kind])]
    want = sorted((index[u][0], k, index[v][0], index[u][1], index[v][1], w) for (u, v), (k, w) in edges.items())
    assert sorted(tuple(r) for r in rel.collect()) == want


def test_chain_only_where_absent(spark, tables):
    rows, t = tables
    held = spark.createDataFrame([(0, "S3", "S4", "SUPPLIER_DEPENDS_ON_SUPPLIER", 0.5)], "ordinal long, source string, target string, edge_type string, weight double")
    g = builder.build(**(t | {"edges": held}))
    got = {(r.source, r.target) for r in g.edges.where("edge_type = 'SUPPLIER_DEPENDS_ON_SUPPLIER'").collect()}
    assert got <= {("S3", "S4")} and g.edges.where("edge_type = 'PRODUCT_DEPENDS_ON_PRODUCT'").count() > 0


def test_empty_tables(tables):
    _, t = tables
    g = builder.build(**{k: v.limit(0) for k, v in t.items()})
    assert g.nodes.count() == g.edges.count() == g.removed.count() == 0
    at, rel = builder.encode(g)
    assert at.count() == rel.count() == 0


def test_nodes_alone_and_ids_that_repeat(tables, monkeypatch):
    """Nodes are made without the edges, and only ids that stand in several rows are merged attribute by attribute."""
    names = ("suppliers", "products", "locations", "supplier_locations", "news", "events")
    tables = tables[1]
    g = builder.build(**tables)
    monkeypatch.setattr(builder, "_edges", lambda *a, **b: pytest.fail("edges are not needed"))
    alone = builder.nodes_of(**{k: v for k, v in tables.items() if k in (*names, "nodes")})
    assert sorted(map(str, alone.collect())) == sorted(map(str, g.nodes.collect()))
    assert alone.count() == alone.select("node_id").distinct().count()
