"""Edges in tiles: sums, ranks, shocks and components over many tiles are those of plain loops, and nodes move by tile, not by edge."""

import random

import numpy as np
import pytest

from faultline.operators import builder, connect, engine, gnn, tiles, training


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(tiles, "EDGES", 40)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_follow_the_order(spark):
    ids = [f"n{i}" for i in range(50)]
    got = {r.node_id: r.idx for r in tiles.numbered(spark.createDataFrame([(i,) for i in ids], "node_id string").repartition(5)).collect()}
    assert got == {x: i for i, x in enumerate(sorted(ids))}


def test_vectors_move_by_tile(spark, monkeypatch):
    """every two of forty nodes are linked; a node goes to each tile once, not once an edge."""
    monkeypatch.setattr(tiles, "EDGES", 400)
    n = 40
    e = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(n) for j in range(n) if i != j], "node_id string, source string")
    t = tiles.tiled(e)
    many = t.tiles.count()
    assert 4 <= many <= 8 and t.ends.count() <= many * n < e.count() / 4 and t.tiles.selectExpr("sum(size(a))").first()[0] == e.count()
    x = np.arange(n * 3).reshape(n, 3) / 7
    nodes = spark.createDataFrame([(f"n{i}", x[i].tolist()) for i in range(n)] + [("alone", [1.0, 1.0, 1.0])], "node_id string, h array<double>")
    got = {r.node_id: r.m for r in gnn.neighbour_mean(nodes, t, 3).collect()}
    assert got.pop("alone") == [0.0, 0.0, 0.0]
    for i in range(n):
        assert got[f"n{i}"] == pytest.approx(((x.sum(0) - x[i]) / (n - 1)).tolist())


def test_edges_of_missing_ends(spark):
    """An edge with an end that the vectors lack carries nothing, nor does one without an end."""
    e = spark.createDataFrame([("a", "b"), ("a", "gone"), ("lost", "a"), (None, "a"), ("a", None)], "node_id string, source string")
    x = spark.createDataFrame([("a", [1.0]), ("b", [3.0])], "node_id string, h array<double>")
    assert {r.node_id: r.m for r in gnn.neighbour_mean(x, e, 1).collect()} == {"a": [3.0], "b": [0.0]}


@pytest.mark.parametrize("kind", ["sage", "gat"])
def test_training_in_many_tiles(spark, monkeypatch, kind):
    """gradients do not depend on how the edges are cut into tiles."""
    g = random.Random(3)
    nodes = spark.createDataFrame([(f"n{i}", [g.random(), g.random()], g.random()) for i in range(12)], "node_id string, h array<double>, y double")
    links = spark.createDataFrame([(f"n{g.randrange(12)}", f"n{i}", 1.0) for i in range(12) for _ in range(4)], "src string, dst string, weight double")
    start = gnn.sage_weights(1, 2, 2) if kind == "sage" else gnn.gat_weights(1, 2, 2)
    run = lambda: training.train_propagation(nodes, links, start, kind, training.Config(epochs=1))
    whole = run()
    monkeypatch.setattr(tiles, "EDGES", 12)
    cut = run()
    assert whole[1] == cut[1] and np.allclose(training.flatten(whole[0]), training.flatten(cut[0]), atol=1e-9)


def test_components_in_many_tiles(spark, small):
    """a hub and chains longer than a tile, a circle, and nodes by themselves."""
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 150)] + [(i, 200 + (i - 199) % 5) for i in range(200, 205)] + [(204, 0), (300, 300)]
    e, n = spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(400,)], "node_id int")
    every = {x for p in edges for x in p} | {400}
    weak = {x: 0 if x < 60 or 200 <= x < 205 else 100 if 100 <= x <= 150 else x for x in every}
    assert dict(map(tuple, connect.weak_components(e, n).collect())) == weak
    assert dict(map(tuple, connect.strong_components(e, n).collect())) == {x: 200 if 200 <= x < 205 else x for x in every}


def test_shock_in_many_tiles(spark, monkeypatch):
    """risks are the same however the edges are cut."""
    g = random.Random(9)
    edges = spark.createDataFrame([(f"n{i}", f"n{j}", g.random()) for i, j in {(g.randrange(30), g.randrange(30)) for _ in range(150)}], "src string, dst string, weight double")
    shock = spark.createDataFrame([("n1", 1.0)], "node_id string, shock double")
    risk, rank = (lambda: sorted(map(tuple, engine.propagate(edges, shock).collect()))), (lambda: sorted(map(tuple, engine.pagerank(edges).collect())))
    whole = risk(), rank()
    monkeypatch.setattr(tiles, "EDGES", 10)
    for a, b in zip(whole, (risk(), rank()), strict=True):
        assert [x for x, _ in a] == [x for x, _ in b] and [v for _, v in a] == pytest.approx([v for _, v in b], abs=2e-4)


def test_nodes_are_not_joined_where_no_id_repeats(spark):
    """the rows are not shuffled against an empty list of ids."""
    s = spark.createDataFrame([(1, "S1", "one"), (2, "S2", "two")], "ordinal long, supplier_id string, supplier_name string")
    p = spark.createDataFrame([(1, "P1", "bolt")], "ordinal long, product_id string, product_name string")
    loc = spark.createDataFrame([(1, "L1", "here")], "ordinal long, location_id string, location_name string")
    sl = spark.createDataFrame([("S1", "L1")], "supplier_id string, location_id string")
    got = builder.nodes_of(s, p, loc, sl)
    assert "Join" not in plan(got) and sorted(r.node_id for r in got.collect()) == ["FAC_S1_L1", "L1", "P1", "S1", "S2"]


def test_sites_of_a_supplier_stay_together(spark):
    """places by sites, most rows of the risk, are not shuffled by place and supplier."""
    places = spark.sql("values (1L, 'L1', 1d, 2d), (2L, 'L2', 5d, 6d) as t(ordinal, location_id, latitude, longitude)")
    many = spark.range(1_000_000).selectExpr("concat('S', id) as supplier_id", "1d as latitude", "2d as longitude")
    sites = spark.sql("select 'S1' as supplier_id, 'L2' as location_id")
    # planned for a table too large to be sent to every task, and run on a small one
    assert "hashpartitioning(location_id" not in engine.nearest_site(places, many, sites)._jdf.queryExecution().executedPlan().toString()
    near = engine.nearest_site(places, many.where("supplier_id = 'S1'"), sites)
    assert {(r.location_id, r.site_id) for r in near.collect()} == {("L1", None), ("L2", "L2")}
