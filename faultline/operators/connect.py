"""Iterative graph operators: greedy resolution of duplicates, weakly and strongly connected components.

Every round is checkpointed to the shared folder; one count a round reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import tiles
from faultline.operators.blocks import Block, Box, graph
from faultline.operators.storage import cut

#: Lanes that share out the nodes of one component where its name is joined.
LANES = 8


def greedy_kept(rows: DataFrame, similar: DataFrame) -> DataFrame:
    """(id) of the rows that an arrival-order pass keeps: each is compared with the rows kept before it only.

    ``rows`` holds ``id`` in arrival order, ``similar`` pairs (a, b) at or above the threshold. If A~B and B~C
    but not A~C, A and C stay. Pairs of one id and repeated pairs change nothing.
    """
    pairs = cut(similar.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    kept = []
    ids = rows.select("id").where("id is not null").distinct()
    open_ = ids.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_semi")
    kept.append(ids.join(open_, "id", "left_anti"))
    sure = kept[0]
    open_ = cut(open_)
    while not open_.isEmpty():
        gone = pairs.join(sure.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        open_ = cut(open_.join(gone, "id", "left_anti"))
        waits = pairs.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        sure = cut(open_.join(waits, "id", "left_anti"))
        kept.append(sure)
        open_ = cut(open_.join(sure, "id", "left_anti"))
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def _spread(label: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, label): the least label that reaches each node along ``edges(src, dst)``, its own included."""
    while True:
        pull = edges.join(label.withColumnRenamed("node_id", "src"), "src").select(F.col("dst").alias("node_id"), F.col("label").alias("new")).groupBy("node_id").agg(F.min("new").alias("new"))
        step = cut(label.join(pull, "node_id", "left").select("node_id", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("moved")))
        label = step.select("node_id", "label")
        if step.where("moved").isEmpty():
            return label


def _nodes(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    every = edges.select(F.col("src").alias("node_id")).union(edges.select("dst"))
    return (every.union(nodes.select("node_id")) if nodes is not None else every).where("node_id is not null").distinct()


def weak_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, component): the least node that edges reach in either direction.

    Nodes are numbered in their order; a block of edges (``blocks.py``) knows which of its own and far nodes it joins,
    and rounds pass least numbers between blocks, both ways, until they agree.
    """
    index = tiles.numbered(_nodes(edges, nodes))
    g = graph(index.select("node_id"), edges.where("src <> dst").select(F.col("dst").alias("node_id"), F.col("src").alias("source")), index)

    def told(state: dict) -> list[tuple[str, np.ndarray]]:
        return [("far", state["own"][:, None]), ("back", state["far"][:, None])]

    def begin(block: Block, state: dict, box: Box) -> list[tuple[str, np.ndarray]]:
        at = block.size + np.arange(block.far)
        if block.number in block.groups:  # far nodes of the block itself
            lo, hi = block.groups[block.number]
            at[lo:hi] = block.asked[block.number]
        both = np.unique(np.stack([block.a, at[block.b]]), axis=1)
        state["joined"] = _settle(np.arange(block.size + block.far), both[0], both[1])[np.r_[np.arange(block.size), at]]
        state |= {"own": block.cols["idx"].astype(np.int64), "far": np.full(block.far, np.iinfo(np.int64).max)}
        return told(state)

    def move(block: Block, state: dict, box: Box) -> list[tuple[str, np.ndarray]]:
        own = state["own"].copy()
        for name, at, rows in box.came:
            if name == "back":
                own[block.asked[at]] = np.minimum(own[block.asked[at]], rows[:, 0])
        far = box.far("far", 1, np.int64)[:, 0]
        low = np.full(block.size + block.far, np.iinfo(np.int64).max)
        np.minimum.at(low, state["joined"], np.r_[own, far])
        low = low[state["joined"]]
        state["moved"] = bool((low[: block.size] < state["own"]).any() or (low[block.size :] < far).any())
        state["own"], state["far"] = low[: block.size], low[block.size :]
        return told(state)

    sent = g.step([], begin)
    while True:
        sent = g.step([sent], move)
        if not any(g.each([sent], lambda block, state, box: state["moved"])):
            break
    label = g.table(edges.sparkSession, [sent], lambda block, state, box: state["own"], "long").select(F.col("idx").alias("node_id"), F.col("value").alias("label"))
    g.free()
    own = label.select(F.col("node_id").alias("idx"), "label").join(index, "idx")
    own = cut(own.select("node_id", "label", F.col("idx").alias("at"), F.pmod(F.xxhash64("node_id"), F.lit(LANES).cast("long")).alias("lane")))
    # the name of a component of most nodes is there in several lanes, so that no task has them all
    names = own.where("label <> at").select(F.col("label").alias("idx")).distinct().join(index, "idx").select(F.col("idx").alias("label"), F.col("node_id").alias("component"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long"))).alias("lane"))
    return own.where("label = at").select("node_id", F.col("node_id").alias("component")).unionByName(own.where("label <> at").join(names, ["label", "lane"]).select("node_id", "component"))


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least label that each place reaches; labels are places, and each round follows them on to their own."""
    while len(a):
        low = np.minimum(label[a], label[b])
        if (low == label[a]).all() and (low == label[b]).all():
            break
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
    return label


def strong_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, component): nodes that reach each other share the least of them.

    Nodes without an edge in or out are cut away first, round by round; what is left is coloured by the least
    node that reaches it, and each colour's root collects the nodes of its colour that reach back.
    """
    left, e = cut(_nodes(edges, nodes)), cut(edges.select("src", "dst").where("src <> dst").distinct())
    done = []
    while not left.isEmpty():
        inner = e.select(F.col("src").alias("node_id")).intersect(e.select(F.col("dst").alias("node_id")))
        single = cut(left.join(inner, "node_id", "left_anti"))
        if single.isEmpty():
            color = _spread(left.select("node_id", F.col("node_id").alias("label")), e)
            s, d = color.select(F.col("node_id").alias("src"), F.col("label").alias("x")), color.select(F.col("node_id").alias("dst"), F.col("label").alias("y"))
            back = cut(e.join(s, "src").join(d, "dst").where("x = y").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "x"))
            hit = cut(color.where("node_id = label"))
            front = hit
            while not front.isEmpty():
                more = back.join(front.select(F.col("node_id").alias("src")), "src").select(F.col("dst").alias("node_id"), F.col("x").alias("label")).distinct()
                front = cut(more.join(hit, "node_id", "left_anti"))
                hit = cut(hit.unionByName(front))
            done.append(hit.select("node_id", F.col("label").alias("component")))
        else:
            done.append(single.select("node_id", F.col("node_id").alias("component")))
        out = done[-1].select("node_id")
        left = cut(left.join(out, "node_id", "left_anti"))
        e = cut(e.join(out.withColumnRenamed("node_id", "src"), "src", "left_anti").join(out.withColumnRenamed("node_id", "dst"), "dst", "left_anti"))
    result = done[0] if done else _nodes(edges, nodes).select("node_id", F.col("node_id").alias("component"))
    for d in done[1:]:
        result = result.unionByName(d)
    return result
