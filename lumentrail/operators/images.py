"""Image stacks as tables of pixels, and their preparation for the search.

A stack is ``pixels(t, mjd, zt, y, x, sci, var)``; a masked pixel is an absent row, or one whose sci or
var isn't finite.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumentrail.functions.sky import flux_scale, is_valid


def gaussian_kernel(sigma: float) -> np.ndarray:
    """A normalised Gaussian of radius int(3 sigma)."""
    r = int(3 * sigma)
    i = np.arange(-r, r + 1)
    k = np.exp(-(i[:, None] ** 2 + i[None, :] ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def kernel_table(spark: SparkSession, kernel: np.ndarray) -> DataFrame:
    """``(j, i, w)``: offsets in y and x, and weights."""
    k = np.asarray(kernel, float)
    if k.ndim != 2 or k.shape[0] != k.shape[1] or not k.shape[0] % 2 or not np.isfinite(k).all() or (k < 0).any() or k.sum() <= 0:
        raise ValueError("a kernel is odd, square, finite and not negative")
    k, r = k / k.sum(), k.shape[0] // 2
    return spark.createDataFrame([(j - r, i - r, float(k[j, i])) for j in range(len(k)) for i in range(len(k))], "j int, i int, w double")


def zeroed(pixels: DataFrame) -> DataFrame:
    """Times since the first image in ``zt``."""
    first = pixels.agg(F.min("mjd").alias("__first"))
    return pixels.drop("zt").crossJoin(F.broadcast(first)).withColumn("zt", F.col("mjd") - F.col("__first")).drop("__first")


def mask_outside(pixels: DataFrame, column: str, low: float = -math.inf, high: float = math.inf) -> DataFrame:
    return pixels.where(F.col(column).between(low, high))


def mask_flags(pixels: DataFrame, flags: int, mask_col: str = "mask", threshold: float | None = None) -> DataFrame:
    """Drops pixels with any of the flags, and those brighter than a threshold."""
    keep = F.col(mask_col).bitwiseAND(F.lit(flags)) == 0
    return pixels.where(keep if threshold is None else keep & (F.col("sci") <= threshold))


def grow_mask(pixels: DataFrame, masked: DataFrame, radius: int) -> DataFrame:
    """Drops pixels within ``radius``, in either axis, of a pixel of ``masked(t, y, x)``."""
    d = F.sequence(F.lit(-radius), F.lit(radius))
    grown = masked.select("t", "y", F.explode(F.transform(d, lambda e: (F.col("x") + e).cast("int"))).alias("x")).select("t", F.explode(F.transform(d, lambda e: (F.col("y") + e).cast("int"))).alias("y"), "x").distinct()
    return pixels.join(grown, ["t", "y", "x"], "left_anti")


def masked_fraction(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """``(t, masked, fraction)`` of the images that have any row."""
    good = F.count(F.when(is_valid(F.col("sci")) & is_valid(F.col("var")), 1))
    return pixels.groupBy("t").agg((width * height - good).alias("masked"), (1 - good / (width * height)).alias("fraction"))


def keep_images(pixels: DataFrame, kept: DataFrame) -> DataFrame:
    """Only the images of ``kept(t)``, with times zeroed anew."""
    return zeroed(pixels.join(F.broadcast(kept.select("t").distinct()), "t", "left_semi"))


def scale_by_magnitude(pixels: DataFrame, scales: DataFrame) -> DataFrame:
    """Flux divided by 10^(m / 2.5) and variance by its square, for ``scales(t, mag)``; others stay."""
    f = flux_scale(F.coalesce("mag", F.lit(0.0)))
    return pixels.join(F.broadcast(scales.select("t", "mag")), "t", "left").withColumn("sci", F.col("sci") / f).withColumn("var", F.col("var") / (f * f)).drop("mag")


def scale_by_filter(pixels: DataFrame, image_filters: DataFrame, color_scale: dict[str, float]) -> DataFrame:
    """Scales by a magnitude for each filter of ``image_filters(t, filter)``: one per image, each with a scale."""
    bad = image_filters.groupBy("t").agg(F.countDistinct("filter").alias("n"), F.min(F.col("filter").isin(list(color_scale))).alias("known")).where("n <> 1 or not known")
    if not bad.isEmpty():
        raise ValueError("each image needs exactly one filter, and each filter a scale")
    pairs = F.create_map(*[F.lit(x) for kv in color_scale.items() for x in kv])
    return scale_by_magnitude(pixels, image_filters.select("t", F.element_at(pairs, F.col("filter")).alias("mag")).distinct())


def image_statistics(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Per image: least, largest and mean flux and variance of valid pixels, and the share of masked ones."""
    good = pixels.where(is_valid(F.col("sci")) & is_valid(F.col("var")))
    agg = [f(c).alias(f"{c}_{n}") for c in ("sci", "var") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return good.groupBy("t").agg(*agg, (1 - F.count("*") / (width * height)).alias("masked"))


def bad_images(pixels: DataFrame, width: int, height: int, masked: float = 0.5, flux: tuple[float, float] = (-1e8, 1e8), variance: tuple[float, float] = (1e-10, 1e10)) -> DataFrame:
    """Images that fail validation, with which test failed."""
    s = image_statistics(pixels, width, height)
    tests = {"masked": F.col("masked") > masked, "flux": ~(F.col("sci_min").between(*flux) & F.col("sci_max").between(*flux)), "variance": ~(F.col("var_min").between(*variance) & F.col("var_max").between(*variance))}
    return s.select("t", F.array_compact(F.array(*[F.when(c, n) for n, c in tests.items()])).alias("failed")).where("size(failed) > 0")


def disordered(pixels: DataFrame, seed: int = 0) -> DataFrame:
    """Images with their times permuted by a seeded hash, as a negative control."""
    times = pixels.select("mjd").distinct()
    a = times.withColumn("n", F.row_number().over(Window.orderBy("mjd")))
    b = times.select(F.col("mjd").alias("new")).withColumn("n", F.row_number().over(Window.orderBy(F.xxhash64("new", F.lit(seed)), "new")))
    return zeroed(pixels.join(F.broadcast(a.join(b, "n").drop("n")), "mjd").drop("mjd").withColumnRenamed("new", "mjd"))


def psi_phi(pixels: DataFrame) -> DataFrame:
    """``psi = sci / var``, ``phi = 1 / var`` of the pixels where both are finite and the variance isn't 0."""
    good = is_valid(F.col("sci")) & is_valid(F.col("var")) & (F.col("var") != 0)
    return pixels.where(good).select("t", "zt", "y", "x", (F.col("sci") / F.col("var")).alias("psi"), (1 / F.col("var")).alias("phi"))


def convolved(images: DataFrame, kernel: DataFrame, column: str) -> DataFrame:
    """Correlation of a column with a kernel ``(j, i, w)``, weights renormalised over valid neighbours.

    Pixels are sent to the neighbours that they add to, a shuffle of kernel size times pixels with partial sums.
    Only valid pixels get a value. The kernel is at most a few hundred rows by construction and is broadcast.
    """
    total = kernel.agg(F.sum("w").alias("total"))
    rays = images.where(is_valid(F.col(column))).crossJoin(F.broadcast(kernel)).select("t", (F.col("y") - F.col("j")).alias("y"), (F.col("x") - F.col("i")).alias("x"), (F.col(column) * F.col("w")).alias("v"), "w", F.when((F.col("j") == 0) & (F.col("i") == 0), 1).alias("here"))
    sums = rays.groupBy("t", "y", "x").agg(F.sum("v").alias("v"), F.sum("w").alias("w"), F.max("here").alias("here")).where("here = 1")
    return sums.crossJoin(F.broadcast(total)).select("t", "y", "x", F.when(F.col("w") == 0, None).otherwise(F.col("v") * F.col("total") / F.col("w")).alias(column))


def convolved_dense(images: DataFrame, kernel: np.ndarray, column: str, width: int, height: int) -> DataFrame:
    """As ``convolved``, one image at a time in numpy: no blow-up by the kernel's size."""
    k, r = np.asarray(kernel, float), len(kernel) // 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full((height + 2 * r, width + 2 * r), np.nan)
        a[pdf.y + r, pdf.x + r] = pdf[column]
        good = np.isfinite(a)
        a[~good] = 0
        v, w = np.zeros((height, width)), np.zeros((height, width))
        for j in range(len(k)):
            for i in range(len(k)):
                v += k[j, i] * a[j : j + height, i : i + width]
                w += k[j, i] * good[j : j + height, i : i + width]
        y, x = np.nonzero(good[r : r + height, r : r + width] & (w != 0))
        return pd.DataFrame({"t": pdf.t.iloc[0], "y": y, "x": x, column: v[y, x] * k.sum() / w[y, x]})

    return images.groupBy("t").applyInPandas(run, f"t int, y int, x int, {column} double")


def convolved_psi_phi(pixels: DataFrame, kernel: DataFrame) -> DataFrame:
    """psi correlated with the kernel, and phi with its squares."""
    base = psi_phi(pixels)
    psi = convolved(base, kernel, "psi")
    phi = convolved(base, kernel.withColumn("w", F.col("w") * F.col("w")), "phi")
    return base.select("t", "zt", "y", "x").join(psi, ["t", "y", "x"]).join(phi, ["t", "y", "x"])


def encode(df: DataFrame, column: str, n_bytes: int) -> DataFrame:
    """Adds ``code``, ``low`` and ``scale``: a column in 8 n_bytes bits, 0 for no data."""
    span = df.agg(F.min(F.when(is_valid(F.col(column)), F.col(column))).alias("low"), F.max(F.when(is_valid(F.col(column)), F.col(column))).alias("high"))
    span = span.select("low", "high", (F.greatest(F.col("high") - F.col("low"), F.lit(1e-6)) / (2 ** (8 * n_bytes) - 1)).alias("scale"))
    v = F.least(F.greatest(F.col(column), F.col("low")), F.col("high") - F.col("scale") / 100)
    return df.crossJoin(F.broadcast(span)).withColumn("code", F.when(is_valid(F.col(column)), ((v - F.col("low")) / F.col("scale") + 1).cast("int")).otherwise(0)).drop("high")


def decoded(code: Column, low: Column, scale: Column) -> Column:
    return F.when(code != 0, (code - 1) * scale + low)


def insert_object(pixels: DataFrame, kernel: DataFrame, x: int, y: int, vx: float, vy: float, flux: float) -> DataFrame:
    """Adds a moving object of a flux, spread by the kernel, to every image that it falls in."""
    times = pixels.select("t", "zt").distinct()
    at = lambda p, v, d: (F.floor(F.lit(p) + F.lit(v) * F.col("zt") + 0.5) + F.col(d)).cast("int")
    light = times.crossJoin(F.broadcast(kernel)).select("t", at(y, vy, "j").alias("y"), at(x, vx, "i").alias("x"), (F.col("w") * flux).alias("light"))
    return pixels.join(F.broadcast(light), ["t", "y", "x"], "left").withColumn("sci", F.col("sci") + F.coalesce("light", F.lit(0.0))).drop("light").select(pixels.columns)


def noise_stack(spark: SparkSession, times: list[float], width: int, height: int, noise: float, seed: int = 0) -> DataFrame:
    """A synthetic stack of Gaussian noise that depends on the seed and the pixel alone."""
    n = width * height
    u = lambda salt: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    normal = F.sqrt(-2 * F.log(u(0))) * F.cos(2 * math.pi * u(1))
    mjd = F.element_at(F.array(*map(F.lit, map(float, times))), (F.floor(F.col("id") / n) + 1).cast("int"))
    return spark.range(len(times) * n).select(F.floor(F.col("id") / n).cast("int").alias("t"), mjd.alias("mjd"), (mjd - times[0]).alias("zt"), F.floor(F.pmod("id", F.lit(n)) / width).cast("int").alias("y"), F.pmod("id", F.lit(width)).cast("int").alias("x"), (normal * noise).alias("sci"), F.lit(float(noise * noise)).alias("var"))


def mosaic(parts: DataFrame) -> DataFrame:
    """Sums ``parts(mjd, part, y, x, sci, var)`` of one time into one image. Parts must not overlap."""
    both = parts.where(is_valid(F.col("sci"))).groupBy("mjd", "y", "x").agg(F.count("*").alias("n"), F.sum("sci").alias("sci"), F.sum("var").alias("var"))
    return both.select("mjd", "y", "x", F.when(F.col("n") == 1, F.col("sci")).otherwise(F.raise_error(F.lit("footprints overlap")).cast("double")).alias("sci"), "var")


def reprojected(pixels: DataFrame, dx: float, dy: float, width: int, height: int) -> DataFrame:
    """Bilinear resampling onto a grid shifted by (dx, dy); pixels with weight under 0.8 of valid ones are masked."""

    def corner(j: int, i: int) -> DataFrame:
        wx, wy = dx - math.floor(dx), dy - math.floor(dy)
        w = (wx if i else 1 - wx) * (wy if j else 1 - wy)
        return pixels.select("t", "mjd", "zt", (F.col("y") - math.floor(dy) - j).cast("int").alias("y"), (F.col("x") - math.floor(dx) - i).cast("int").alias("x"), (F.col("sci") * w).alias("sci"), (F.col("var") * w).alias("var"), F.lit(w).alias("w"))

    rays = corner(0, 0).union(corner(0, 1)).union(corner(1, 0)).union(corner(1, 1)).where((F.col("w") > 0) & F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    return rays.groupBy("t", "mjd", "zt", "y", "x").agg((F.sum("sci") / F.sum("w")).alias("sci"), (F.sum("var") / F.sum("w")).alias("var"), F.sum("w").alias("w")).where("w >= 0.8").drop("w")


#: A stack is sent to every task as a dense cube only within this size.
DENSE_BYTES = 64 << 20


def dense(stack: DataFrame, times: list[str], values: list[str], limit: int = DENSE_BYTES) -> tuple[pd.DataFrame, int, int, list[np.ndarray]] | None:
    """``(times, y0, x0, cubes)``: the images in order of ``t``, their first row and column, and a cube of each value.

    The cubes have one row and one column more, of NaN, for what lies outside; NaN also stands where there is no data.
    None if they'd take more than ``limit`` bytes or if a pixel or an image has several rows.
    """
    stack = stack.where("t is not null and y is not null and x is not null")
    images = stack.select("t", *times).distinct().sort("t").limit(limit // 64).toPandas()
    box = stack.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")).first()
    if images.empty or not images["t"].is_unique or images.isna().any(axis=None):
        return None
    shape = len(images), box.y1 - box.y0 + 2, box.x1 - box.x0 + 2
    if 8 * len(values) * math.prod(shape) > limit:
        return None
    rows = stack.select("t", "y", "x", *values).limit(math.prod(shape)).toPandas()
    at = np.searchsorted(images["t"], rows["t"]), rows["y"].to_numpy() - box.y0, rows["x"].to_numpy() - box.x0
    cubes = [np.full(shape, np.nan) for _ in values]
    if len(np.unique(np.ravel_multi_index(at, shape))) < len(rows):
        return None
    for cube, v in zip(cubes, values, strict=True):
        cube[at] = rows[v].to_numpy(float)
    return images, box.y0, box.x0, cubes


def within(p: np.ndarray, first: int, size: int) -> np.ndarray:
    """Positions as indices into a dimension of a cube of ``dense``; outside, the last."""
    p = p - first
    return np.where((p >= 0) & (p < size - 1), p, size - 1).astype(np.int64)
