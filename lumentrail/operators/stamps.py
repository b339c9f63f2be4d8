"""Cut-outs around trajectories, in long form ``(id, t, dy, dx, sci, var)``, and their sums over time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrail.functions.arrays import lower_median
from lumentrail.functions.sky import day_of, is_valid, truncated
from lumentrail.operators.graph import materialised, spread
from lumentrail.operators.images import dense, within


def cutouts(results: DataFrame, pixels: DataFrame, radius: int) -> DataFrame:
    """Pixels within ``radius`` of the predicted position of ``results(id, x, y, vx, vy)`` in each image.

    The band join is made an equi-join by exploding the offsets; pixels without data have no row.
    """
    d = F.sequence(F.lit(-radius), F.lit(radius))
    times = pixels.select("t", "mjd", "zt").distinct()
    at = results.select("id", "x", "y", "vx", "vy").crossJoin(F.broadcast(times)).select("id", "t", "mjd", truncated(F.col("x"), F.col("vx"), F.col("zt")).alias("cx"), truncated(F.col("y"), F.col("vy"), F.col("zt")).alias("cy"))
    at = at.withColumn("dy", F.explode(d)).withColumn("dx", F.explode(d)).select("id", "t", "mjd", "dy", "dx", (F.col("cy") + F.col("dy")).alias("y"), (F.col("cx") + F.col("dx")).alias("x"))
    return at.join(pixels.select("t", "y", "x", "sci", "var"), ["t", "y", "x"]).where(is_valid(F.col("sci"))).select("id", "t", "mjd", "dy", "dx", "sci", "var")


def coadds(stamps: DataFrame, by_day: bool = False) -> DataFrame:
    """Per pixel of the stamp: sum, mean, lower median, and the mean weighted by inverse variance.

    With ``by_day`` there is one for each calendar day. Pixels without any data have no row; they count as 0.
    """
    keys = ["id", "dy", "dx"] + (["day"] if by_day else [])
    df = stamps.withColumn("day", day_of(F.col("mjd"))) if by_day else stamps
    good = is_valid(F.col("var")) & (F.col("var") != 0)
    return df.groupBy(*keys).agg(
        F.sum("sci").alias("sum"),
        F.avg("sci").alias("mean"),
        lower_median(F.array_sort(F.collect_list("sci"))).alias("median"),
        F.coalesce(F.try_divide(F.sum(F.when(good, F.col("sci") / F.col("var"))), F.sum(F.when(good, 1 / F.col("var")))), F.lit(0.0)).alias("weighted"),
    )


def _dense_stamps(results: DataFrame, pixels: DataFrame, radius: int, make: Callable, schema: str) -> DataFrame | None:
    """``make(sci, var, mjd)`` of all cut-outs of each trajectory, from a cube of the stack in every task.

    ``sci`` and ``var`` are of the shape (trajectories, pixels of the stamp in row order, images). ``make`` returns the
    indices of trajectories and the columns after ``id``. Nothing is shuffled and a task holds few cut-outs at a time.
    None if the stack is too large or irregular for a cube, or if an id has several trajectories.
    """
    cube = dense(pixels, ["mjd", "zt"], ["sci", "var"])
    if cube is None or not results.groupBy("id").count().where("count > 1").isEmpty():
        return None
    shared = results.sparkSession.sparkContext.broadcast(cube)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        images, y0, x0, (sci, var) = shared.value
        zt, mjd, t = images["zt"].to_numpy(float), images["mjd"].to_numpy(float), np.arange(len(images))
        d = np.arange(-radius, radius + 1)
        dy, dx = np.repeat(d, len(d))[None, :, None], np.tile(d, len(d))[None, :, None]
        step = max(1, 300_000 // (len(d) ** 2 * len(t)))
        for pdf in batches:
            out = []
            for i in range(0, len(pdf), step):
                part = pdf[i : i + step]
                x, y, vx, vy = (part[c].to_numpy(float)[:, None] for c in ("x", "y", "vx", "vy"))
                cx, cy = np.trunc(x + vx * zt + 0.5), np.trunc(y + vy * zt + 0.5)
                at = t, within(cy[:, None, :] + dy, y0, sci.shape[1]), within(cx[:, None, :] + dx, x0, sci.shape[2])
                which, cols = make(sci[at], var[at], mjd)
                out.append(pd.DataFrame({"id": part["id"].to_numpy()[which], **cols}))
            if out:
                yield pd.concat(out)

    there = results.where(reduce(and_, [is_valid(F.col(c).cast("double")) for c in ("x", "y", "vx", "vy")]))
    kind = results.schema["id"].dataType.simpleString()
    return spread(there.select("id", "x", "y", "vx", "vy")).mapInPandas(run, f"id {kind}, {schema}")


def _coadded(sci: np.ndarray, var: np.ndarray) -> dict[str, np.ndarray]:
    """As ``coadds``, along the last axis; ``n`` is the number of images with data."""
    valid = np.isfinite(sci)
    n = valid.sum(axis=-1)
    good = valid & np.isfinite(var) & (var != 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.where(valid, sci, 0.0).sum(axis=-1)
        weights = np.where(good, 1 / var, 0.0).sum(axis=-1)
        weighted = np.where(weights != 0, np.where(good, sci / var, 0.0).sum(axis=-1) / weights, 0.0)
        mean = total / n
    median = np.take_along_axis(np.sort(np.where(valid, sci, np.inf), axis=-1), np.maximum(n - 1, 0)[..., None] // 2, axis=-1)[..., 0]
    return {"n": n, "sum": total, "mean": mean, "median": median, "weighted": weighted}


def _offsets(cell: np.ndarray, radius: int) -> dict[str, np.ndarray]:
    side = 2 * radius + 1
    return {"dy": (cell // side - radius).astype(np.int32), "dx": (cell % side - radius).astype(np.int32)}


def coadds_at(results: DataFrame, pixels: DataFrame, radius: int, by_day: bool = False) -> DataFrame:
    """``coadds`` of ``cutouts`` of ``results(id, x, y, vx, vy)``, without a shuffle if the stack fits a cube."""
    pixels = materialised(pixels.select("t", "mjd", "zt", "y", "x", "sci", "var"))

    def make(sci, var, mjd):
        day = np.floor(mjd).astype(np.int64) - 40587 if by_day else np.zeros(len(mjd), np.int64)
        which, parts = [], []
        for d in np.unique(day):
            c = _coadded(sci[..., day == d], var[..., day == d])
            i, cell = np.nonzero(c.pop("n"))
            which.append(i)
            parts.append(pd.DataFrame(_offsets(cell, radius) | {k: v[i, cell] for k, v in c.items()} | ({"day": np.full(len(i), d, np.int32)} if by_day else {})))
        return np.concatenate(which), dict(pd.concat(parts).items())

    schema = "dy int, dx int, sum double, mean double, median double, weighted double" + ", day int" * by_day
    out = _dense_stamps(results, pixels, radius, make, schema)
    if out is None:
        return coadds(cutouts(results, pixels, radius), by_day)
    return out.withColumn("day", F.date_from_unix_date("day")) if by_day else out


def peaks_at(results: DataFrame, pixels: DataFrame, radius: int) -> DataFrame:
    """``peak_offset`` of the mean ``coadds`` of ``cutouts``, without a shuffle if the stack fits a cube."""
    pixels = materialised(pixels.select("t", "mjd", "zt", "y", "x", "sci", "var"))

    def make(sci, var, mjd):
        c = _coadded(sci, var)
        which = np.flatnonzero(c["n"].any(axis=1))
        at = _offsets(np.where(c["n"] > 0, c["mean"], -np.inf).argmax(axis=1)[which], radius)
        return which, {"peak_dy": at["dy"], "peak_dx": at["dx"], "offset": np.hypot(at["dy"], at["dx"])}

    out = _dense_stamps(results, pixels, radius, make, "peak_dy int, peak_dx int, offset double")
    return peak_offset(coadds(cutouts(results, pixels, radius))) if out is None else out


def normalised_at(results: DataFrame, pixels: DataFrame, radius: int) -> DataFrame:
    """``(id, dy, dx, mean)``: ``normalised`` mean ``coadds`` of ``cutouts``, without a shuffle if the stack fits a cube."""
    pixels = materialised(pixels.select("t", "mjd", "zt", "y", "x", "sci", "var"))

    def make(sci, var, mjd):
        c = _coadded(sci, var)
        there = c["n"] > 0
        n, low = there.sum(axis=1), np.where(there, c["mean"], np.inf).min(axis=1)
        which, cell = np.nonzero(there)
        with np.errstate(divide="ignore", invalid="ignore"):
            total = np.where(there, c["mean"], 0.0).sum(axis=1) - n * low
            mean = np.where(total != 0, (c["mean"] - low[:, None]).T / total, 0.0).T
        return which, _offsets(cell, radius) | {"mean": mean[which, cell]}

    out = _dense_stamps(results, pixels, radius, make, "dy int, dx int, mean double")
    return normalised(coadds(cutouts(results, pixels, radius))).select("id", "dy", "dx", "mean") if out is None else out


def as_arrays(coadd: DataFrame, value: str, radius: int) -> DataFrame:
    """A coadd as one 2-D array per result, 0 where there is no data."""
    n = 2 * radius + 1
    cells = coadd.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("dy") + radius) * n + F.col("dx") + radius, value))).alias("m"))
    row = lambda j: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", j * n + i), F.lit(0.0)))
    return cells.select("id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), row).alias(f"coadd_{value}"))


def reshaped(flat: Column, size: int) -> Column:
    """A flat stamp as rows of ``size`` values."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.slice(flat, j * size + 1, size))


def peak_offset(coadd: DataFrame, value: str = "mean") -> DataFrame:
    """``(id, peak_dy, peak_dx, offset)``: brightest pixel, first in row order, and its distance from the centre."""
    best = F.max(F.struct(F.col(value), (-F.col("dy")).alias("ndy"), (-F.col("dx")).alias("ndx"))).alias("b")
    p = coadd.groupBy("id").agg(best).select("id", (-F.col("b.ndy")).alias("peak_dy"), (-F.col("b.ndx")).alias("peak_dx"))
    return p.withColumn("offset", F.sqrt(F.col("peak_dy") * F.col("peak_dy") + F.col("peak_dx") * F.col("peak_dx")))


def observing_days(observations: DataFrame) -> DataFrame:
    """Distinct days per result of ``observations(id, mjd)``."""
    return observations.groupBy("id").agg(F.countDistinct(day_of(F.col("mjd"))).alias("num_days"))


def brightness_search(curves: DataFrame, offsets: list[float], drop_edges: bool = True) -> DataFrame:
    """Best flux for ``curves(id, flux, i, sci, var)`` among flux times the offsets, by least chi-square.

    Ties go to the first offset; results whose best is the first or last offset are dropped, as the
    minimum may lie outside.
    """
    spark = curves.sparkSession
    off = spark.createDataFrame(list(enumerate(map(float, offsets))), "k int, offset double")
    good = is_valid(F.col("sci")) & is_valid(F.col("var")) & (F.col("var") > 0)
    chi = curves.where(good).crossJoin(F.broadcast(off)).groupBy("id", "flux", "k", "offset").agg(F.sum(F.pow(F.col("sci") - F.col("flux") * F.col("offset"), 2) / F.col("var")).alias("chi2"))
    best = chi.groupBy("id", "flux").agg(F.min(F.struct(F.round("chi2", 9).alias("chi2"), "k", "offset")).alias("b"))
    best = best.where(~F.col("b.k").isin(0, len(offsets) - 1)) if drop_edges else best
    return best.select("id", (F.col("flux") * F.col("b.offset")).alias("best_flux"), F.col("b.offset").alias("offset"), F.col("b.chi2").alias("chi2"))


def normalised(stamps: DataFrame, value: str = "mean") -> DataFrame:
    """Stamp pixels shifted to a least value of 0 and divided by their sum."""
    low = stamps.groupBy("id").agg(F.min(value).alias("low"), F.sum(value).alias("total"), F.count("*").alias("n"))
    return stamps.join(low, "id").withColumn(value, F.coalesce(F.try_divide(F.col(value) - F.col("low"), F.col("total") - F.col("n") * F.col("low")), F.lit(0.0))).drop("low", "total", "n")


def divergence(stamps: DataFrame, sigma: float, value: str = "mean") -> DataFrame:
    """Kullback-Leibler divergence of a centred Gaussian from each normalised stamp; pixels of 0 are left out."""
    s = normalised(stamps, value)
    g = F.exp(-(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")) / (2 * sigma * sigma))
    total = s.withColumn("g", g).groupBy("id").agg(F.sum("g").alias("gs"))
    p = F.col("g") / F.col("gs")
    return s.withColumn("g", g).join(total, "id").where(F.col(value) > 0).groupBy("id").agg(F.sum(p * F.log(p / F.col(value))).alias("divergence"))


def classify(stamps: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """Probabilities from a model of one's own: any picklable function of a batch of arrays ``(id, stamp)``."""

    def run(pdfs):
        for pdf in pdfs:
            p = model(pdf["stamp"])
            yield pd.DataFrame({"id": pdf["id"], "prob_real": p, "prob_bogus": 1 - p, "cnn_class": p >= threshold})

    return stamps.mapInPandas(run, "id long, prob_real double, prob_bogus double, cnn_class boolean")
