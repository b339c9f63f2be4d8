"""Removal of near-duplicate and spurious trajectories.

All take ``trajectories(id, x, y, vx, vy, lh, ...)``. Neighbour searches within a radius are equi-joins on
grid cells as wide as the radius: one side is replicated to the adjacent cells, and the exact distance is
the residual, so that no nested loop is planned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumentrail.functions.sky import is_valid
from lumentrail.operators.graph import components, materialised, spread


def bins(width: float, max_dt: float) -> list[Column]:
    """Cells of the start and of the end after ``max_dt`` days, by truncation toward zero."""
    cell = lambda v: (v / width).cast("int")
    return [cell(F.col("x")).alias("bx0"), cell(F.col("y")).alias("by0"), cell(F.col("x") + F.col("vx") * max_dt).alias("bx1"), cell(F.col("y") + F.col("vy") * max_dt).alias("by1")]


def grid_best(trajectories: DataFrame, width: float, max_dt: float) -> DataFrame:
    """The best trajectory of each cell of start and end, the first id of equal ones, and how many there were.

    An arg-max by a combining aggregation: one row per cell leaves each task.
    """
    best = F.max(F.struct("lh", (-F.col("id")).alias("nid"))).alias("best")
    cells = trajectories.select("*", *bins(width, max_dt)).groupBy("bx0", "by0", "bx1", "by1").agg(best, F.count("*").alias("n"))
    kept = cells.select((-F.col("best.nid")).alias("id"), "bx0", "by0", "bx1", "by1", "n")
    return trajectories.join(kept, "id")


FEATURES = {
    "all": lambda t, s: ["x", "y", F.col("vx") * s, F.col("vy") * s],
    "pos_vel": lambda t, s: ["x", "y", F.col("vx") * s, F.col("vy") * s],
    "position": lambda t, s: _at(t[:1]),
    "start_position": lambda t, s: _at(t[:1]),
    "mid_position": lambda t, s: _at(t[1:2]),
    "start_end_position": lambda t, s: _at([t[0], t[2]]),
    "nn_start_end": lambda t, s: _at([t[0], t[2]]),
    "nn_start": lambda t, s: _at(t[:1]),
}


def _at(times: list[float]) -> list[Column]:
    return [c for t in times for c in (F.col("x") + F.col("vx") * t, F.col("y") + F.col("vy") * t)]


def with_features(trajectories: DataFrame, kind: str, times: tuple[float, float, float] = (0.0, 0.0, 0.0), v_scale: float = 1.0) -> DataFrame:
    """Adds the array ``f`` that a kind of clustering measures distances in; ``times``: first, median, last."""
    cols = FEATURES[kind](list(times), v_scale)
    return trajectories.withColumn("f", F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in cols]))


def dimensions(kind: str) -> int:
    return len(FEATURES[kind]([0.0, 0.0, 0.0], 1.0))


def _places(points: DataFrame, dims: int, *aggs: Column) -> DataFrame:
    """The different positions of points ``(id, f)`` as columns ``f0, f1, ...``, with aggregates of their points.

    Points without a position in every dimension have no neighbours and no place.
    """
    f = [F.col("f")[i].alias(f"f{i}") for i in range(dims)]
    there = [is_valid(F.col(f"f{i}")) for i in range(dims)]
    return points.select("*", *f).where(reduce(and_, there)).groupBy(*[f"f{i}" for i in range(dims)]).agg(*aggs)


def _near(home: DataFrame, other: DataFrame, eps: float, dims: int) -> DataFrame:
    """Joins places ``(f0, f1, ..., more)`` with those of ``other`` within ``eps``; more columns must differ in name.

    Cells are of the first three dimensions. ``other`` is sent to 9 or 27 cells, which the planner doesn't see, so it's
    kept from being broadcast.
    """
    keys = [f"c{i}" for i in range(min(dims, 3))]
    cell = lambda i, d=0: (F.floor(F.col(f"f{i}") / eps) + d).cast("long")
    around = lambda i: F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: cell(i, d))).alias(f"c{i}")
    a = spread(home).select("*", *[cell(i).alias(k) for i, k in enumerate(keys)])
    b = spread(other)
    for i in range(len(keys)):
        b = b.select("*", around(i))
    b = b.withColumnsRenamed({f"f{i}": f"g{i}" for i in range(dims)})
    d2 = sum((F.col(f"f{i}") - F.col(f"g{i}")) * (F.col(f"f{i}") - F.col(f"g{i}")) for i in range(dims))
    return a.join(b.hint("merge"), keys).where(d2 <= eps * eps).drop(*keys)


def neighbours(points: DataFrame, eps: float, dims: int) -> DataFrame:
    """``(a, b)``: ids of all pairs of points ``(id, f)`` within ``eps``, in both directions, without equal ids.

    ``f`` has ``dims`` elements. Distances are of places, each once; the ids of two places are paired where they are
    found, so that pairs, whose number grows with the square of the density, are never shuffled.
    """
    at = _places(points, dims, F.collect_list("id").alias("ids"))
    pairs = _near(at.withColumnRenamed("ids", "as"), at.withColumnRenamed("ids", "bs"), eps, dims)
    return pairs.select(F.explode("as").alias("a"), "bs").select("a", F.explode("bs").alias("b")).where("a != b")


def _linked(f: np.ndarray, eps: float, chunk: int = 1 << 21) -> np.ndarray:
    """For each point the first one that it's linked with, by steps of at most ``eps``; pairs are made in chunks."""
    first = np.arange(len(f))
    cell = np.floor(f / eps)
    cell = (cell - cell.min(axis=0)).astype(np.int64) + 1
    size = [int(n) for n in cell.max(axis=0) + 2]
    used = max(k for k in range(1, len(size) + 1) if k == 1 or math.prod(size[:k]) < 1 << 62)
    scale = np.array([math.prod(size[i + 1 : used]) for i in range(used)], np.int64)
    code = cell[:, :used] @ scale
    order = np.argsort(code, kind="stable")
    code = code[order]
    for step in product((0, 1, -1), repeat=used):
        if step < (0,) * used:  # the other direction of a step
            continue
        lo, hi = (np.searchsorted(code, code + step @ scale, side) for side in ("left", "right"))
        if not any(step):
            lo = np.arange(1, len(code) + 1)
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(code):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, "right")))
            n = hi[at:to] - lo[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = np.arange(len(i)) + np.repeat(lo[at:to] - np.cumsum(n) + n, n)
            i, j, at = order[i], order[j], to
            apart = first[i] != first[j]
            i, j = i[apart], j[apart]
            near = ((f[i] - f[j]) ** 2).sum(axis=1) <= eps * eps
            i, j = i[near], j[near]
            while len(i):
                a, b = first[i], first[j]
                np.minimum.at(first, np.maximum(a, b), np.minimum(a, b))
                while ((up := first[first]) != first).any():
                    first = up
                apart = first[i] != first[j]
                i, j = i[apart], j[apart]
    return first


def _stars(places: DataFrame, eps: float, dims: int) -> DataFrame:
    """Edges ``(u, v)`` between the nodes of places ``(node, f0, f1, ...)`` that join the same as all pairs within ``eps``.

    The first two dimensions are cut into blocks four times as wide as ``eps``, each with what lies within ``eps`` of it,
    so every pair is in a block. A task links a block and returns an edge for each place: as many edges as places, however
    dense they lie.
    """
    wide, reach = 4 * eps, eps * (1 + 1e-9)
    block = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / wide), F.floor((F.col(c) + reach) / wide)))
    cut = places.withColumn("k0", block("f0")).withColumn("k1", block("f1")) if dims > 1 else places.withColumn("k0", block("f0")).withColumn("k1", F.lit(0))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        node = pdf["node"].to_numpy()
        first = _linked(pdf[[f"f{i}" for i in range(dims)]].to_numpy(float), eps)
        other = first != np.arange(len(first))
        return pd.DataFrame({"u": node[first[other]], "v": node[other]})

    n = 4 * max(2, places.sparkSession.sparkContext.defaultParallelism)
    return cut.repartition(n, "k0", "k1").groupBy("k0", "k1").applyInPandas(link, "u long, v long")


def clustered(trajectories: DataFrame, kind: str, eps: float, times: tuple[float, float, float] = (0.0, 0.0, 0.0), v_scale: float = 1.0) -> DataFrame:
    """Adds ``cluster``, the least id of the component of points linked within ``eps``.

    This is DBSCAN with clusters from one point on. Points at one place are one node, and the linking within blocks is
    left to their tasks, see ``_stars``; blocks are joined by stars, see ``graph.components``.
    """
    dims = dimensions(kind)
    points = with_features(trajectories, kind, times, v_scale)
    places = materialised(_places(points.select("id", "f"), dims, F.min("id").alias("node")))
    of = components(_stars(places, eps, dims))
    roots = places.join(of, "node", "left").select(*[F.col(f"f{i}").alias(f"__f{i}") for i in range(dims)], F.coalesce("root", "node").alias("cluster"))
    same = reduce(and_, [F.col("f")[i] == F.col(f"__f{i}") for i in range(dims)])
    return points.join(roots, same, "left").select(*trajectories.columns, F.coalesce("cluster", "id").alias("cluster"))


def best_of_cluster(trajectories: DataFrame, kind: str, eps: float, times: tuple[float, float, float] = (0.0, 0.0, 0.0), v_scale: float = 1.0) -> DataFrame:
    """The trajectory of the largest likelihood in each cluster, the least id of equal ones."""
    of = clustered(trajectories, kind, eps, times, v_scale)
    kept = of.groupBy("cluster").agg(F.max(F.struct("lh", (-F.col("id")).alias("nid"))).alias("best")).select((-F.col("best.nid")).alias("id"))
    return trajectories.join(kept, "id", "left_semi")


def sweep(trajectories: DataFrame, kind: str, eps: float, times: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Keeps a trajectory if none within ``eps`` is better; of equal ones within ``eps``, the first by id.

    At one place only the best, the first of equal ones, can stay, so places are compared. Trajectories without a
    likelihood or a position are nobody's neighbours and stay. The second step walks groups of equal likelihood that are linked, which one task can hold as long as
    exact ties are few.
    """
    dims = dimensions(kind)
    points = with_features(trajectories, kind, times)
    best = F.max(F.struct("lh", (-F.col("id")).alias("nid"))).alias("best")
    at = _places(points.where("lh is not null").select("id", "lh", "f"), dims, best).select(*[f"f{i}" for i in range(dims)], (-F.col("best.nid")).alias("id"), F.col("best.lh").alias("lh"))
    at = materialised(at)
    beaten = _near(at, at.withColumnRenamed("lh", "lb").drop("id"), eps, dims).where("lb > lh").select("id").distinct()
    top = materialised(at.join(beaten, "id", "left_anti"))
    ties = materialised(_near(top, top.withColumnsRenamed({"id": "b", "lh": "lb"}), eps, dims).where("lh = lb and id > b").select(F.col("id").alias("u"), F.col("b").alias("v")))
    groups = components(ties).select(F.col("node").alias("u"), "root")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        links: dict[int, set[int]] = {}
        for u, v in zip(pdf.u, pdf.v, strict=True):
            links.setdefault(u, set()).add(v)
            links.setdefault(v, set()).add(u)
        kept: set[int] = set()
        out = []
        for i in sorted(links):
            if links[i] & kept:
                out.append(i)
            else:
                kept.add(i)
        return pd.DataFrame({"id": np.array(out, np.int64)})

    lost = ties.join(groups, "u").groupBy("root").applyInPandas(walk, "id long")
    kept = top.select("id").join(lost, "id", "left_anti")
    free = points.where(~reduce(and_, [is_valid(F.col("f")[i]) for i in range(dims)], F.col("lh").isNotNull())).select(*trajectories.columns)
    return trajectories.join(kept, "id", "left_semi").unionAll(free)


def apply_clustering(trajectories: DataFrame, kind: str, eps: float, times: tuple[float, float, float], v_scale: float = 1.0) -> DataFrame:
    """Dispatch by the name of the kind."""
    if kind in ("grid_start_end", "grid_start"):
        return grid_best(trajectories, float(np.ceil(eps)), times[2] if kind == "grid_start_end" else 0.0).select(trajectories.columns)
    if kind.startswith("nn_"):
        return sweep(trajectories, kind, eps, times)
    if kind not in FEATURES:
        raise ValueError(f"unknown clustering {kind}")
    return best_of_cluster(trajectories, kind, eps, times, v_scale)


def predictive_lines(trajectories: DataFrame, dist_lim: float = 4.0, min_samp: int = 2, radius: float = 60.0, last_dt: float = 1.0) -> DataFrame:
    """Greedy: the best trajectory claims those near the line of its motion; claims of enough members stay.

    Each step depends on all earlier ones, so one task runs it, on what earlier filters left.
    """
    schema = trajectories.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        pdf = pdf.sort_values(["lh", "id"], ascending=[False, True], ignore_index=True)
        alive, kept = np.ones(len(pdf), bool), []
        x, y, vx, vy = (pdf[c].to_numpy(float) for c in ("x", "y", "vx", "vy"))
        for i in range(len(pdf)):
            if not alive[i]:
                continue
            dx, dy = x - x[i], y - y[i]
            speed = np.hypot(vx[i], vy[i]) or 1.0
            off = np.abs(dx * vy[i] - dy * vx[i]) / speed if vx[i] or vy[i] else np.hypot(dx, dy)
            near = alive & (np.hypot(dx, dy) < radius) & (off < dist_lim)
            near[i] = True
            alive &= ~near
            if near.sum() >= min_samp:
                kept.append(i)
        yield pdf.iloc[kept]

    return trajectories.repartition(1).mapInPandas(run, StructType(schema.fields))
