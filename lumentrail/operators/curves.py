"""Light curves of results: extraction, robust clipping, and statistics over what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrail.functions.arrays import count_true, masked_sum, quantile
from lumentrail.functions.sky import is_valid, position, truncated


def psi_phi_curves(results: DataFrame, images: DataFrame) -> DataFrame:
    """Adds ``psi_curve`` and ``phi_curve`` to ``results(id, x, y, vx, vy)``: one value per image in time order, 0 where there is none."""
    return _curves(results, images, ("psi", "phi"), position, 0.0)


def sci_var_curves(results: DataFrame, pixels: DataFrame) -> DataFrame:
    """Adds ``sci_curve`` and ``var_curve``; pixels by truncation, null where there is none."""
    return _curves(results, pixels, ("sci", "var"), truncated, None)


def _curves(results: DataFrame, images: DataFrame, columns: tuple[str, str], place, missing: float | None) -> DataFrame:
    times = images.select("t", "zt").distinct()
    at = results.select("id", "x", "y", "vx", "vy").crossJoin(F.broadcast(times)).select("id", "t", place(F.col("x"), F.col("vx"), F.col("zt")).alias("x"), place(F.col("y"), F.col("vy"), F.col("zt")).alias("y"))
    a, b = columns
    hits = at.join(images.select("t", "y", "x", a, b), ["t", "y", "x"], "left")
    value = lambda c: F.coalesce(F.col(c), F.lit(missing)) if missing is not None else F.col(c)
    both = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("t", value(a).alias("a"), value(b).alias("b")))).alias("c"))
    return results.join(both.select("id", F.col("c.a").alias(f"{a}_curve"), F.col("c.b").alias(f"{b}_curve")), "id")


def clip_curve(curve: Column, low: float, high: float, coefficient: float, n_sigma: float = 2.0, clip_negative: bool = False, floor: float = 1e-8) -> Column:
    """Which values lie strictly within n sigma of the median, sigma from two percentiles (interpolated).

    Values that aren't finite are out. With ``clip_negative`` percentiles are of positive values alone, and
    all others are out.
    """
    good = F.filter(curve, lambda v: is_valid(v) & ((v > 0) if clip_negative else F.lit(True)))
    o = F.array_sort(good)
    q = F.struct(quantile(o, low / 100).alias("a"), quantile(o, 0.5).alias("m"), quantile(o, high / 100).alias("b"))
    # bound once per row: a lambda over a one-element array
    return F.element_at(F.transform(F.array(q), lambda s: F.transform(curve, lambda v: F.coalesce(is_valid(v) & ((v > 0) if clip_negative else F.lit(True)) & (v > s["m"] - n_sigma * coefficient * F.greatest(s["b"] - s["a"], F.lit(floor))) & (v < s["m"] + n_sigma * coefficient * F.greatest(s["b"] - s["a"], F.lit(floor))), F.lit(False)))), 1)


def clip_matrix(curves: DataFrame, low: float, high: float, coefficient: float, n_sigma: float = 2.0, value: str = "lh") -> DataFrame:
    """The same test in long form, for ``curves(id, i, <value>)``: adds ``valid``; the spread is at least 1e-5.

    For curves too long for an array: percentiles are aggregates, joined back.
    """
    v = F.col(value)
    spread = curves.where(is_valid(v)).groupBy("id").agg(F.percentile(v, F.array(F.lit(low / 100), F.lit(0.5), F.lit(high / 100))).alias("q"))
    d = n_sigma * coefficient * F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(1e-5))
    return curves.join(spread, "id", "left").withColumn("valid", F.coalesce(is_valid(v) & (v > F.col("q")[1] - d) & (v < F.col("q")[1] + d), F.lit(False))).drop("q")


def nearest_rank_bounds(ordered: Column, low: float, high: float, coefficient: float, width: float) -> tuple[Column, Column]:
    """Bounds of the in-search clip: percentiles are values of the curve, at rank ceil(n q + 0.001)."""
    n = F.size(ordered)
    at = lambda q: F.get(ordered, F.greatest(F.ceil(n * q + 0.001).cast("int") - 1, F.lit(0)))
    m, d = at(0.5), coefficient * (at(high / 100) - at(low / 100))
    return m - width * d, m + width * d


def clipped_sums(c: Column, low: float, high: float, coefficient: float, width: float) -> tuple[Column, Column]:
    """Sums of psi and phi over an array of (f, psi, phi) sorted by f, with bounds of f included."""
    lo, hi = nearest_rank_bounds(c["f"], low, high, coefficient, width)
    kept = F.filter(c, lambda s: (s["f"] >= lo) & (s["f"] <= hi))
    return F.aggregate(kept["psi"], F.lit(0.0), lambda a, v: a + v), F.aggregate(kept["phi"], F.lit(0.0), lambda a, v: a + v)


def restated(results: DataFrame, min_obs: int = 0, min_lh: float = float("-inf")) -> DataFrame:
    """Likelihood, flux and count from ``psi_curve``, ``phi_curve`` and ``obs_valid``; 0 where phi sums to 0.

    Rows without a valid observation go, then those below the limits.
    """
    psi, phi = masked_sum(F.col("psi_curve"), F.col("obs_valid")), masked_sum(F.col("phi_curve"), F.col("obs_valid"))
    df = results.withColumn("__psi", psi).withColumn("__phi", phi).withColumn("obs_count", count_true(F.col("obs_valid")))
    df = df.withColumn("lh", F.when(F.col("__phi") > 0, F.col("__psi") / F.sqrt("__phi")).otherwise(0.0)).withColumn("flux", F.when(F.col("__phi") > 0, F.col("__psi") / F.col("__phi")).otherwise(0.0))
    return df.drop("__psi", "__phi").where((F.col("obs_count") > 0) & (F.col("obs_count") >= min_obs) & (F.col("lh") >= min_lh))
