"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells, one representative a group.

A vector lies in the cell of its nearest center and also in every cell whose dividing plane is near enough. Of two
vectors that are at most d apart and lie on two sides of a plane, one is at most d / 2 from it, so every link is met
in some cell, and no vector needs to meet the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.components import components
from faultline.llm.shared import lists, stored
from faultline.llm.vectors import matrix

#: Vectors of a cell to aim at, most cells, most bytes of centers, sampled vectors a cell, and vectors of a tile's side.
CELL, CELLS, CENTER_BYTES, SAMPLE, LANE = 4_096, 4_096, 16 << 20, 32, 2_048
ROUNDS = 12


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, scaled by their largest component first so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """At most ``k`` centers of length 1 for unit rows; products are taken 1,024 rows at a time. Empty cells take a row each."""
    g = np.random.default_rng(seed)
    c = x[np.sort(g.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(ROUNDS if len(c) > 1 else 0):
        near = np.concatenate([(x[i : i + 1024] @ c.T).argmax(1) for i in range(0, len(x), 1024)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        length = np.sqrt(np.square(total).sum(1))
        dead = length < 1e-9
        total[dead], length[dead] = x[g.integers(len(x), size=int(dead.sum()))], 1.0
        c = total / length[:, None]
    return np.unique(c, axis=0)


def usable(v: Column) -> Column:
    """A vector with components, none null or not finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def fit(classes: DataFrame, dim: int, count: int) -> np.ndarray:
    """Centers from a sample by hash: at most SAMPLE vectors a cell, so the driver holds 32 times CENTER_BYTES at worst before doubling for sums."""
    k = int(max(1, min(-(-count // CELL), CELLS, CENTER_BYTES // (8 * dim))))
    need = SAMPLE * k
    some = classes.where((F.size("v") == dim) & (F.pmod(F.xxhash64("uid", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, need / count) * (1 << 30)) + 1)).select("v").limit(2 * need)
    rows = some.toArrow()
    return spherical_kmeans(unit(matrix(rows["v"])), k) if len(rows) else np.zeros((0, dim))


def assign(centers: np.ndarray, apart: float):
    """A task from (uid, w, label, v) to a row per cell of a vector: unit vector, home cell, all its cells."""
    gap = np.sqrt(np.maximum(2 - 2 * centers @ centers.T, 1e-12))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("dim").to_numpy()
            for d in np.unique(size):
                rows = batch.filter(pa.array(size == d))
                for i in range(0, rows.num_rows, 512):
                    part = rows.slice(i, 512)
                    u = unit(matrix(part.column("v")))
                    if len(centers) and d == centers.shape[1]:
                        s = u @ centers.T
                        home = s.argmax(1)
                        mine = (s.max(1)[:, None] - s) <= (apart / 2 + 1e-9) * gap[home]
                        mine[np.arange(len(u)), home] = True
                    else:
                        home, mine = np.zeros(len(u), np.int64), np.ones((len(u), 1), bool)
                    cells = [np.flatnonzero(m) for m in mine]
                    yield pa.record_batch([part.column("uid"), part.column("w"), part.column("label"), part.column("dim"), lists(list(u), pa.float64()), pa.array(home, pa.int32()), lists([c.astype(np.int32) for c in cells], pa.int32())], ["uid", "w", "label", "dim", "u", "home", "cells"])

    return run


def tile(key: tuple, left: pa.Table, right: pa.Table, least: float) -> pa.Table:
    """Vectors at home in a cell against vectors in it: (uid, n, other) with the links met here and the least uid of the tile's linked group.

    A pair of two homes may meet in both cells; the cell of the smaller number counts it.
    """
    empty = pa.table({"uid": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
    if not len(left) or not len(right):
        return empty
    cell = key[2].as_py()
    link = matrix(left["u"]) @ matrix(right["u"]).T >= least
    a, b = left["uid"].to_numpy(), right["uid"].to_numpy()
    link &= a[:, None] != b[None, :]
    home = right["home"].to_numpy()
    for other in np.unique(home[home < cell]):
        both = np.array([other in c for c in left["cells"].to_pylist()], bool)
        link[np.ix_(both, home == other)] = False
    i, j = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
    if not len(i):
        return empty
    link, a, b = link[np.ix_(i, j)], a[i], b[j]
    guest = home[j] != cell
    to_left = link @ right["w"].to_numpy()[j]
    to_right = np.where(guest, left["w"].to_numpy()[i] @ link, 0)
    x, y = a.copy(), b.copy()
    big = np.iinfo(np.int64).max
    while True:
        before = x.sum(), y.sum()
        x = np.minimum(x, np.where(link, y[None, :], big).min(1))
        y = np.minimum(y, np.where(link, x[:, None], big).min(0))
        if (x.sum(), y.sum()) == before:
            break
    return pa.table({"uid": np.concatenate([a, b]), "n": pa.array(np.concatenate([to_left, to_right]), pa.int64()), "other": np.concatenate([x, y])})


def classes_of(rows: DataFrame) -> DataFrame:
    """(uid, label, v, dim, low, w): vectors equal in label and every component are one class, counted before they meet anything."""
    found = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("w"))
    return stored(found.withColumn("uid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "classes")


def groups(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; rows of one label link at a cosine of ``least`` or more.

    A row whose vector is null, empty or zero or holds null or non-finite components, or whose label is null, links with
    nothing and is its own component. So is a row with a null id: its component is null and it is not kept. Rows that
    repeat an id are vectors of their own, each counted; rows of unequal length never link. Other columns are not read.
    An empty table gives no rows.
    """
    v = F.col(vector_col).cast("array<double>")
    ok = usable(v) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(ok, F.col(label_col).cast("string")).alias("label"), F.when(ok, F.transform(v, lambda x: x + 0.0)).alias("v"))
    rows = stored(rows, "vectors")
    classes = classes_of(rows)
    common = classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").first()
    centers = fit(classes, common["dim"], common["n"]) if common else np.zeros((0, 1))
    apart = float(np.sqrt(max(0.0, 2 - 2 * least)))
    placed = stored(classes.select("uid", "w", "label", "dim", "v").mapInArrow(assign(centers, apart), "uid long, w long, label string, dim int, u array<double>, home int, cells array<int>"), "placed")
    members = placed.withColumn("cell", F.explode("cells"))
    at = ["label", "dim", "cell"]
    size = members.groupBy(*at).agg(F.ceil(F.count("*") / LANE).cast("int").alias("lanes"))
    lane = F.pmod(F.xxhash64("uid", F.lit(9)), F.col("lanes")).cast("int")
    members = members.join(size, at)
    every = F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))
    left = members.where("home = cell").withColumn("row", lane).withColumn("col", every).select(*at, "row", "col", "uid", "w", "u", "cells")
    right = members.withColumn("col", lane).withColumn("row", every).select(*at, "row", "col", "uid", "w", "u", "home")
    cut = [*at, "row", "col"]
    left, right = (x.toDF(*x.columns) for x in (left, right))
    met = stored(left.groupBy(*cut).cogroup(right.groupBy(*cut)).applyInArrow(lambda k, x, y: tile(k, x, y, least), "uid long, n long, other long"), "links")
    links = met.groupBy("uid").agg(F.sum("n").alias("n"))
    found = components(met.select(F.col("uid").alias("a"), F.col("other").alias("b")))
    per = classes.select("uid", "label", "v", "low", "w").join(links, "uid", "left").join(found.select(F.col("node").alias("uid"), "component"), "uid", "left")
    per = stored(per.select("label", "v", "low", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "uid").alias("component")), "per_class")
    least_id = per.groupBy("component").agg(F.min("low").alias("component_id"))
    named = per.join(least_id, "component").select("label", "v", "n_links", "component_id")
    out = rows.join(named, ["label", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def keep_one(vectors: DataFrame, least: float = 0.98, **columns: str) -> DataFrame:
    """The rows of ``vectors`` whose id is its group's least. A group's rows of that id all stay; rows without an id stay too."""
    key = columns.get("id_col", "vec_id")
    kept = groups(vectors, least, **columns).where("kept").select(F.col("vec_id").alias("__kept")).distinct()
    return vectors.join(kept, F.col(key).cast("long") == F.col("__kept"), "left").where(F.col("__kept").isNotNull() | F.col(key).isNull()).drop("__kept")
