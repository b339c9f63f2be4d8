"""The search: sums of psi and phi along every line from a start pixel, scores, and the best of each pixel."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrail.functions.sky import is_valid, position
from lumentrail.operators.curves import clipped_sums
from lumentrail.operators.graph import materialised, spread
from lumentrail.operators.images import dense, within

#: Above so many probes (start pixels x velocities x images) the dense kernel is used.
RELATIONAL_PROBES = 10_000_000
#: The dense kernel sends all psi and phi to every task only within this size.
CUBE_BYTES = 256 << 20


def scored(psi: Column, phi: Column) -> tuple[Column, Column]:
    """Likelihood and flux; -1 without a positive sum of phi."""
    return F.when(phi > 0, psi / F.sqrt(phi)).otherwise(F.lit(-1.0)), F.when(phi > 0, psi / phi).otherwise(F.lit(-1.0))


def probes(starts: DataFrame, velocities: DataFrame, times: DataFrame) -> DataFrame:
    """All lines of all start pixels at all times, with the pixel that they pass: three small tables multiplied."""
    p = starts.select(F.col("x").alias("x0"), F.col("y").alias("y0")).crossJoin(F.broadcast(velocities.select("vx", "vy"))).crossJoin(F.broadcast(times.select("t", "zt")))
    return p.select("x0", "y0", "vx", "vy", "t", position(F.col("x0"), F.col("vx"), F.col("zt")).alias("x"), position(F.col("y0"), F.col("vy"), F.col("zt")).alias("y"))


def evaluate(starts: DataFrame, velocities: DataFrame, images: DataFrame) -> DataFrame:
    """``(x, y, vx, vy, obs_count, psi, phi, lh, flux)`` of every line that meets a valid pixel.

    An equi-join on the pixel that a line is predicted to pass; pixels outside or masked have no row and add
    nothing. Sums are combined before they are shuffled.
    """
    times = images.select("t", "zt").distinct()
    sums = probes(starts, velocities, times).join(images.select("t", "y", "x", "psi", "phi"), ["t", "y", "x"]).groupBy(F.col("x0").alias("x"), F.col("y0").alias("y"), "vx", "vy").agg(F.count("*").cast("int").alias("obs_count"), F.sum("psi").alias("psi"), F.sum("phi").alias("phi"))
    lh, flux = scored(F.col("psi"), F.col("phi"))
    return sums.select("x", "y", "vx", "vy", "obs_count", "psi", "phi", lh.alias("lh"), flux.alias("flux"))


def evaluate_clipped(starts: DataFrame, velocities: DataFrame, images: DataFrame, low: float, high: float, coefficient: float, width: float = 2.0) -> DataFrame:
    """As ``evaluate``, with outliers of the flux curve clipped from the sums but not from the count."""
    times = images.select("t", "zt").distinct()
    hits = probes(starts, velocities, times).join(images.select("t", "y", "x", "psi", "phi"), ["t", "y", "x"])
    curves = hits.groupBy(F.col("x0").alias("x"), F.col("y0").alias("y"), "vx", "vy").agg(F.count("*").cast("int").alias("obs_count"), F.array_sort(F.collect_list(F.struct((F.col("psi") / F.col("phi")).alias("f"), "psi", "phi"))).alias("c"))
    psi, phi = clipped_sums(F.col("c"), low, high, coefficient, width)
    lh, flux = scored(psi, phi)
    return curves.select("x", "y", "vx", "vy", "obs_count", psi.alias("psi"), phi.alias("phi"), lh.alias("lh"), flux.alias("flux"))


def top_per_pixel(scores: DataFrame, k: int, min_obs: int = 0, filter_first: bool = True) -> DataFrame:
    """The k best lines of each start pixel, ties to smaller vx, then vy.

    The filter on observations comes before the ranking, so that lines with too few take no places;
    ``filter_first=False`` ranks first.
    """
    enough = F.col("obs_count") >= min_obs
    rank = F.row_number().over(Window.partitionBy("x", "y").orderBy(F.desc(F.round("lh", 9)), "vx", "vy"))
    best = (scores.where(enough) if filter_first else scores).withColumn("rank", rank).where(F.col("rank") <= k)
    return best if filter_first else best.where(enough)


def search(starts: DataFrame, velocities: DataFrame, images: DataFrame, k: int = 8, min_obs: int = 0, min_lh: float = float("-inf")) -> DataFrame:
    """The best lines of each start pixel with enough observations and likelihood, unsorted."""
    return top_per_pixel(evaluate(starts, velocities, images), k, min_obs).where(F.col("lh") >= min_lh)


def search_dense(starts: DataFrame, velocities: DataFrame, images: DataFrame, width: int, height: int, k: int = 8, min_obs: int = 0, min_lh: float = float("-inf")) -> DataFrame:
    """As ``search``, with psi and phi as a dense cube in every task and numpy gathers over blocks of pixels.

    Meant for far more lines than pixels: nothing but the best lines leaves a task. The cube grows with the
    images, so its size is checked first; beyond the bound use ``search``, whose join has no such limit.
    """
    times = [tuple(r) for r in images.select("t", "zt").distinct().sort("t").collect()]
    if (size := 2 * 8 * len(times) * width * height) > CUBE_BYTES:
        raise ValueError(f"the cube takes {size} bytes, over the bound of {CUBE_BYTES}; use search")
    rows = images.select("t", "y", "x", "psi", "phi").toPandas()
    at = {t: i for i, (t, _) in enumerate(times)}
    cube = np.zeros((len(times), height + 1, width + 1, 3))  # the last row and column stand for what lies outside
    cube[rows.t.map(at), rows.y, rows.x] = np.column_stack([rows.psi, rows.phi, np.ones(len(rows))])
    sc = images.sparkSession.sparkContext
    shared = sc.broadcast((cube, np.array([z for _, z in times])))
    vel = velocities.select("vx", "vy").distinct().sort("vx", "vy").toPandas().to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cube, zt = shared.value
        for pdf in batches:
            out = []
            for x0, y0 in zip(pdf.x.to_numpy(), pdf.y.to_numpy(), strict=True):
                px = np.floor(x0 + vel[:, :1] * zt + 0.5).astype(int)
                py = np.floor(y0 + vel[:, 1:] * zt + 0.5).astype(int)
                px[(px < 0) | (px >= width)] = width
                py[(py < 0) | (py >= height)] = height
                psi, phi, n = cube[np.arange(len(zt))[None, :], py, px].sum(axis=1).T
                with np.errstate(divide="ignore", invalid="ignore"):
                    lh, flux = np.where(phi > 0, psi / np.sqrt(phi), -1.0), np.where(phi > 0, psi / phi, -1.0)
                some = np.flatnonzero((n > 0) & (n >= min_obs))
                best = some[np.lexsort((vel[some, 1], vel[some, 0], -np.round(lh[some], 9)))][:k]
                out += [(x0, y0, *vel[i], int(n[i]), psi[i], phi[i], lh[i], flux[i], r) for r, i in enumerate(best, 1) if lh[i] >= min_lh]
            yield pd.DataFrame(out, columns=["x", "y", "vx", "vy", "obs_count", "psi", "phi", "lh", "flux", "rank"])

    return starts.select("x", "y").mapInPandas(run, "x int, y int, vx double, vy double, obs_count int, psi double, phi double, lh double, flux double, rank int")


def search_auto(starts: DataFrame, velocities: DataFrame, images: DataFrame, width: int, height: int, **kw) -> DataFrame:
    """``search`` or ``search_dense``, by the number of probes and the size of the cube; results are the same."""
    n = images.select("t").distinct().count()
    many = starts.count() * velocities.count() * n > RELATIONAL_PROBES
    return search_dense(starts, velocities, images, width, height, **kw) if many and 16 * n * width * height <= CUBE_BYTES else search(starts, velocities, images, **kw)


def ordered(results: DataFrame, lh_col: str = "lh") -> DataFrame:
    """By likelihood, best first, in a total order."""
    return results.orderBy(F.desc(lh_col), "x", "y", "vx", "vy")


def batch(results: DataFrame, start: int, count: int) -> DataFrame:
    if count <= 0:
        raise ValueError("count must be positive")
    return ordered(results).offset(start).limit(count)


def _refine_dense(results: DataFrame, velocities: DataFrame, images: DataFrame, radius: int, min_obs: int) -> DataFrame | None:
    vel = velocities.select("vx", "vy").sort("vx", "vy").toPandas()
    cube = dense(images, ["zt"], ["psi", "phi"]) if images.where("psi is null or phi is null or isnan(psi) or isnan(phi)").isEmpty() else None
    kinds = {results.schema[c].dataType.simpleString() for c in ("x", "y")}
    if cube is None or vel.duplicated().any() or vel.isna().any(axis=None) or not kinds <= {"int", "smallint", "tinyint"} or not results.groupBy("id").count().where("count > 1").isEmpty():
        return None
    shared = images.sparkSession.sparkContext.broadcast((cube, vel.to_numpy(float)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (times, y0, x0, (psi, phi)), vel = shared.value
        zt, (_, height, width) = times["zt"].to_numpy(float), psi.shape
        plane = np.arange(len(zt)) * (height * width)
        hit, psi, phi = (np.isfinite(psi) * 1.0).ravel(), np.nan_to_num(psi).ravel(), np.nan_to_num(phi).ravel()
        d = np.arange(-radius, radius + 1)
        # lines in order of x, y, vx, vy: the first of equal ones is the one to keep
        lines = len(d), len(d), len(vel)
        step = max(1, 300_000 // (math.prod(lines) * len(zt)))
        for pdf in batches:
            out = []
            for i in range(0, len(pdf), step):
                part = pdf[i : i + step]
                n = len(part)
                x, y = (part[c].to_numpy(np.int64)[:, None] + d for c in ("x", "y"))
                vx, vy = part["vx"].to_numpy(float)[:, None] + vel[:, 0], part["vy"].to_numpy(float)[:, None] + vel[:, 1]
                px = within(np.floor(x[:, :, None, None] + vx[:, None, :, None] * zt + 0.5), x0, width)
                py = within(np.floor(y[:, :, None, None] + vy[:, None, :, None] * zt + 0.5), y0, height)
                at = (plane + py * width)[:, None] + px[:, :, None]
                count, a, b = (v[at].sum(axis=-1).reshape(n, -1) for v in (hit, psi, phi))
                with np.errstate(divide="ignore", invalid="ignore"):
                    lh, flux = np.where(b > 0, a / np.sqrt(b), -1.0), np.where(b > 0, a / b, -1.0)
                ok = (count > 0) & (count >= min_obs)
                k = np.where(ok, np.round(lh, 9), -np.inf).argmax(axis=1)
                some = np.flatnonzero(ok.any(axis=1))
                k = k[some]
                j, e, v = np.unravel_index(k, lines)
                out.append(pd.DataFrame({"id": part["id"].to_numpy()[some], "x": x[some, j].astype(np.int32), "y": y[some, e].astype(np.int32), "vx": vx[some, v], "vy": vy[some, v], "obs_count": count[some, k].astype(np.int32), "lh": lh[some, k], "flux": flux[some, k]}))
            if out:
                yield pd.concat(out)

    there = results.where(reduce(and_, [is_valid(F.col(c).cast("double")) for c in ("x", "y", "vx", "vy")]))
    kind = results.schema["id"].dataType.simpleString()
    return spread(there.select("id", "x", "y", "vx", "vy")).mapInPandas(run, f"id {kind}, x int, y int, vx double, vy double, obs_count int, lh double, flux double")


def refine(results: DataFrame, velocities: DataFrame, images: DataFrame, radius: int = 1, min_obs: int = 0) -> DataFrame:
    """For each ``results(id, x, y, vx, vy)`` the best line nearby: start within ``radius``, velocity offset from a table.

    If the stack fits a cube and nothing is repeated, each task looks up all lines of its results, few at a time, and
    nothing is shuffled; otherwise all lines are joined with the pixels.
    """
    images = materialised(images.select("t", "zt", "y", "x", "psi", "phi"))
    if (out := _refine_dense(results, velocities, images, radius, min_obs)) is not None:
        return out
    d = F.sequence(F.lit(-radius), F.lit(radius))
    near = results.select("id", F.explode(F.transform(d, lambda e: (F.col("x") + e).cast("int"))).alias("x0"), "y", "vx", "vy").select("id", "x0", F.explode(F.transform(d, lambda e: (F.col("y") + e).cast("int"))).alias("y0"), "vx", "vy")
    near = near.crossJoin(F.broadcast(velocities.select(F.col("vx").alias("dvx"), F.col("vy").alias("dvy")))).select("id", "x0", "y0", (F.col("vx") + F.col("dvx")).alias("vx"), (F.col("vy") + F.col("dvy")).alias("vy"))
    times = images.select("t", "zt").distinct()
    p = near.crossJoin(F.broadcast(times)).select("id", "x0", "y0", "vx", "vy", "t", position(F.col("x0"), F.col("vx"), F.col("zt")).alias("x"), position(F.col("y0"), F.col("vy"), F.col("zt")).alias("y"))
    sums = p.join(images.select("t", "y", "x", "psi", "phi"), ["t", "y", "x"]).groupBy("id", "x0", "y0", "vx", "vy").agg(F.count("*").cast("int").alias("obs_count"), F.sum("psi").alias("psi"), F.sum("phi").alias("phi"))
    lh, flux = scored(F.col("psi"), F.col("phi"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("lh", 9)), "x", "y", "vx", "vy"))
    return sums.select("id", F.col("x0").alias("x"), F.col("y0").alias("y"), "vx", "vy", "obs_count", lh.alias("lh"), flux.alias("flux")).where(F.col("obs_count") >= min_obs).withColumn("rank", rank).where("rank = 1").drop("rank")
