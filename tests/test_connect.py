"""Iterative graph operators against brute force, and entity spans on small texts."""

import random

import pytest

from faultline.functions import lexicon as lx
from faultline.operators import connect, spans
from faultline.operators import engine as op
from faultline.plans import registry


def reach(nodes, edges):
    seen = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            for n in nodes:
                if a in seen[n] and b not in seen[n]:
                    seen[n].add(b)
                    changed = True
    return seen


def test_components(spark):
    g = random.Random(4)
    edges = [(g.randrange(18), g.randrange(18)) for _ in range(20)]
    nodes = {n for e in edges for n in e} | {30}
    e, n = spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(30,)], "node_id int")
    fwd, both = reach(nodes, edges), reach(nodes, edges + [(b, a) for a, b in edges])
    assert {tuple(r) for r in connect.weak_components(e, n).collect()} == {(x, min(both[x])) for x in nodes}
    assert {tuple(r) for r in connect.strong_components(e, n).collect()} == {(x, min(y for y in fwd[x] if x in fwd[y])) for x in nodes}


def test_empty_graph(spark):
    e = spark.createDataFrame([], "src int, dst int")
    assert connect.weak_components(e).count() == connect.strong_components(e).count() == 0


def test_greedy(spark):
    g = random.Random(8)
    pairs = [(g.randrange(25), g.randrange(25)) for _ in range(40)]
    want = []
    for i in range(25):
        if not any((i, j) in pairs or (j, i) in pairs for j in want):
            want.append(i)
    got = connect.greedy_kept(spark.createDataFrame([(i,) for i in range(25)], "id int"), spark.createDataFrame(pairs, "a int, b int"))
    assert sorted(r.id for r in got.collect()) == want


def shares(edges, side):
    t = {}
    for e in edges:
        t[e[side]] = t.get(e[side], 0.0) + e[2]
    return [(a, b, w / (t[(a, b)[side]] or 1.0)) for a, b, w in edges], t


def settled_risk(edges, shock, d=0.6, limit=15, tol=1e-4):
    w, _ = shares(edges, 1)
    r0 = {n: shock.get(n, 0.0) for a, b, _ in edges for n in (a, b)}
    r = dict(r0)
    for _ in range(limit):
        new = {n: min(1.0, max(0.0, (1 - d) * r0[n] + d * sum(x * r[a] for a, b, x in w if b == n))) for n in r}
        moved, r = max(abs(new[n] - r[n]) for n in r), new
        if moved < tol:
            break
    return r


def settled_rank(edges, alpha=0.85, limit=100, tol=1e-6):
    w, t = shares(edges, 0)
    nodes = {n for a, b, _ in edges for n in (a, b)}
    r = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(limit):
        lost = sum(r[n] for n in nodes if not t.get(n))
        new = {n: (1 - alpha) / len(nodes) + alpha * (sum(x * r[a] for a, b, x in w if b == n) + lost / len(nodes)) for n in nodes}
        moved, r = sum(abs(new[n] - r[n]) for n in nodes), new
        if moved < tol * len(nodes):
            return r
    return dict.fromkeys(nodes, 1 / len(nodes))


CHAIN = [("L", "F", 0.9), ("F", "S", 1.0), ("S", "P", 0.3), ("T", "P", 0.5), ("T", "Q", 0.0)]


def test_settled(spark):
    g = random.Random(6)
    loops = [(f"n{a}", f"n{b}", g.randint(0, 9) / 10) for a, b in {(g.randrange(14), g.randrange(14)) for _ in range(30)} if a != b]
    for edges, hit in ((CHAIN, "L"), (loops, loops[0][0])):
        e = spark.createDataFrame(edges, "src string, dst string, weight double")
        shock = spark.createDataFrame([(hit, 1.0)], "node_id string, shock double")
        assert {r.node_id: r.risk for r in op.propagate(e, shock).collect()} == pytest.approx(settled_risk(edges, {hit: 1.0}), abs=6e-5)
        assert {r.node_id: r.rank for r in op.pagerank(e).collect()} == pytest.approx(settled_rank(edges), abs=6e-7)
    # a product three hops away is reached, and the supplier has lost what had not settled
    risk = settled_risk(CHAIN, {"L": 1.0})
    assert risk["P"] > 0 and risk["S"] == pytest.approx(0.6 * 0.6 * 0.4)
    assert {r.rank for r in op.pagerank(spark.createDataFrame(CHAIN, "src string, dst string, weight double"), limit=1).collect()} == {round(1 / 6, 6)}


def test_spans(spark):
    text = "The Port of Rotterdam and Tesla Berlin Factory; semiconductors from Shanghai, China."
    df = spark.createDataFrame([(1, text), (2, None), (3, " ")], "id int, text string")
    got = [(r.id, r.entity_text, r.entity_type) for r in spans.entity_spans(df, "id", "text").collect()]
    # "The Port" fits the pattern of ports; the listed name overlaps it but does not lie within it, so both stay.
    assert got == [(1, "The Port", "PORT"), (1, "Port of Rotterdam", "PORT"), (1, "Tesla Berlin Factory", "FACILITY"), (1, "semiconductors", "PRODUCT"), (1, "Shanghai", "CITY"), (1, "China", "COUNTRY")]
    assert all(text[a:b] == t for a, b, t, *_ in spans.spans_of(text, spans.passes()))


def test_spans_of_reports(spark):
    """A report of each incident names a port; these made-up texts stand here, not in a registered query."""
    reports = [(i, f"Strike near {p}") for i, p in enumerate(lx.PORTS)]
    got = spans.entity_spans(spark.createDataFrame(reports, "id int, text string"), "id", "text").where("entity_type = 'PORT'").collect()
    assert {(r.id, r.entity_text) for r in got} >= set(enumerate(lx.PORTS))


def test_spans_of_news(spark, tmp_path):
    """The registered query reads the whole news: a place late in a long document is found."""
    text = "calm " * 20_000 + "until Shanghai closed"
    spark.createDataFrame([(5, text, "a"), (15, None, "b")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in registry.queries()["entity_spans"](spark, str(tmp_path)).where("entity_type = 'CITY'").drop("normalized_entity").collect()]
    at = len("Celebrity gossip and sports. ") + text.index("Shanghai")
    assert got == [("ART5", at, at + 8, "Shanghai", "CITY", 0.93)]


def test_ego_network_works_out_its_edges_once(spark):
    """Each row passes once, however often the edges are used; the result is that of a walk."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(x):
        seen.add(1)
        return x

    pairs = [("a", "b"), ("c", "b"), ("c", "d"), ("d", "e"), ("x", "y")]
    rows = spark.createDataFrame(pairs, "s string, dst string").repartition(1).select(noted.asNondeterministic()("s").alias("src"), "dst")
    got = sorted(tuple(r) for r in op.ego_network(rows, "a", 2).collect())
    assert got == [("a", "b"), ("c", "b")] and seen.value <= 2 * len(pairs)
