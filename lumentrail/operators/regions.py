"""Sky patches, image footprints, and metadata filters of image collections."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrail.functions.sky import day_of, separation


def patch_pixels(arcmin: float, pixel_scale: float) -> int:
    """Width of a patch in pixels of ``pixel_scale`` arcseconds, rounded up."""
    return math.ceil(arcmin * 60 / pixel_scale)


def patches(spark: SparkSession, arcmin: float, overlap_percent: float, dec_min: float = -90.0, dec_max: float = 90.0) -> DataFrame:
    """``(patch_id, ra, dec, size)``: a grid of square patches in degrees; ids count in the order of ra, then dec."""
    size = arcmin / 60
    step = size * (1 - overlap_percent / 100)
    n_ra, n_dec = int(360 / step), int(180 / step)
    first = max(0, math.ceil((dec_min + 90 - size / 2) / step))
    last = min(n_dec - 1, math.floor((dec_max + 90 - size / 2) / step))
    rows = max(0, last - first + 1)
    g = spark.range(n_ra * rows)
    return g.select(F.col("id").alias("patch_id"), (F.floor(F.col("id") / max(1, rows)) * step + size / 2).alias("ra"), ((F.pmod("id", F.lit(max(1, rows))) + first) * step - 90 + size / 2).alias("dec"), F.lit(size).alias("size"))


def contains(ra: Column, dec: Column, pra: Column, pdec: Column, size: Column) -> Column:
    """Whether a point lies strictly within a patch."""
    return (F.abs(ra - pra) < size / 2) & (F.abs(dec - pdec) < size / 2)


def locate(points: DataFrame, grid: DataFrame, cell: float) -> DataFrame:
    """Points ``(ra, dec)`` with the patches that contain them: an equi-join on cells at least as wide as a patch."""
    b = lambda c: F.floor(c / cell)
    p = points.withColumn("br", b(F.col("ra"))).withColumn("bd", b(F.col("dec") + 90))
    d = F.array(*map(F.lit, (-1, 0, 1)))
    g = grid.select("patch_id", F.col("ra").alias("pra"), F.col("dec").alias("pdec"), "size", F.explode(F.transform(d, lambda e: b(F.col("ra")) + e)).alias("br"))
    g = g.select("*", F.explode(F.transform(d, lambda e: b(F.col("pdec") + 90) + e)).alias("bd"))
    return p.join(g, ["br", "bd"]).where(contains(F.col("ra"), F.col("dec"), F.col("pra"), F.col("pdec"), F.col("size"))).drop("br", "bd")


def clip_area(subject: list[tuple[float, float]], ra: float, dec: float, size: float) -> float:
    """Area of a convex polygon within a patch: Sutherland and Hodgman's clipping, then the shoelace formula."""
    out = list(subject)
    for axis, bound, sign in ((0, ra - size / 2, 1), (0, ra + size / 2, -1), (1, dec - size / 2, 1), (1, dec + size / 2, -1)):
        src, out = out, []
        for i, p in enumerate(src):
            q = src[i - 1]
            a, b = sign * (q[axis] - bound), sign * (p[axis] - bound)
            if (a >= 0) != (b >= 0):
                f = a / (a - b)
                out.append((q[0] + f * (p[0] - q[0]), q[1] + f * (p[1] - q[1])))
            if b >= 0:
                out.append(p)
    return abs(sum(out[i - 1][0] * out[i][1] - out[i][0] * out[i - 1][1] for i in range(len(out)))) / 2


def overlaps(chips: DataFrame, grid: DataFrame, cell: float, min_overlap: float = 0.0) -> DataFrame:
    """``(patch_id, chip_id, overlap)``: area in square degrees of ``chips(chip_id, ra, dec, corners)`` in patches.

    Candidates by cells as wide as a patch and a chip together, then by bounds; only polygons that may overlap are
    clipped, in a pandas UDF.
    """

    def area(corners: pd.Series, ra: pd.Series, dec: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([clip_area([(c["ra"], c["dec"]) for c in cs], *rest) for cs, *rest in zip(corners, ra, dec, size, strict=True)])

    b = lambda c: F.floor(c / cell)
    d = F.array(*map(F.lit, (-1, 0, 1)))
    edge = lambda f, axis: f(F.col("corners")[axis]).alias(f"{axis}_{'lo' if f is F.array_min else 'hi'}")
    c = chips.select("chip_id", "corners", b(F.col("ra")).alias("br"), b(F.col("dec") + 90).alias("bd"), *[edge(f, x) for f in (F.array_min, F.array_max) for x in ("ra", "dec")])
    g = grid.select("patch_id", "ra", "dec", "size", F.explode(F.transform(d, lambda e: b(F.col("ra")) + e)).alias("br"))
    g = g.select("*", F.explode(F.transform(d, lambda e: b(F.col("dec") + 90) + e)).alias("bd"))
    half = F.col("size") / 2
    touch = (F.col("ra_lo") < F.col("ra") + half) & (F.col("ra_hi") > F.col("ra") - half) & (F.col("dec_lo") < F.col("dec") + half) & (F.col("dec_hi") > F.col("dec") - half)
    both = c.join(g, ["br", "bd"]).where(touch).withColumn("overlap", F.pandas_udf(area, "double")("corners", "ra", "dec", "size"))
    return both.where(F.col("overlap") > min_overlap).select("patch_id", "chip_id", "overlap")


def patch_report(images: DataFrame) -> DataFrame:
    """Per patch of ``images(patch_id, visit, mjd, overlap)``: area, visits, days with data, nights spanned."""
    day = F.floor(F.col("mjd")).cast("long")
    night = day_of(F.col("mjd") - 0.5)
    return images.groupBy("patch_id").agg(F.sum("overlap").alias("overlap"), F.countDistinct("visit").alias("visits"), F.countDistinct(day).alias("days"), (F.datediff(F.max(night), F.min(night)) + 1).alias("nights_spanned"))


def by_mjds(images: DataFrame, mjds: list[float], tolerance: float = 1e-4) -> DataFrame:
    """Images within a tolerance of any of a list of times."""
    at = F.array(*map(F.lit, map(float, mjds)))
    return images.where(F.exists(at, lambda m: F.abs(F.col("mjd") - m) <= tolerance))


def by_time_range(images: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    return images.where(F.col("mjd").between(start if start is not None else float("-inf"), end if end is not None else float("inf")))


def by_wcs_error(images: DataFrame, max_arcsec: float) -> DataFrame:
    """Images whose WCS error, in degrees, is within a number of arcseconds."""
    return images.where(F.col("wcs_err") <= max_arcsec / 3600)


def without_bands(images: DataFrame, bands: list[str]) -> DataFrame:
    return images.where(~F.col("band").isin(bands))


def cone(images: DataFrame, ra: float, dec: float, degrees: float) -> DataFrame:
    """Pointings within a radius; the band in declination can be pruned at the scan."""
    return images.where(F.col("dec").between(dec - degrees, dec + degrees) & (separation(F.col("ra"), F.col("dec"), F.lit(ra), F.lit(dec)) <= degrees))


def repeated_images(images: DataFrame, keys: list[str]) -> DataFrame:
    return images.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def stacked(a: DataFrame, b: DataFrame, index: str = "std_idx") -> DataFrame:
    """Two collections as one, the second's index moved past the first's."""
    top = a.agg(F.coalesce(F.max(index) + 1, F.lit(0)).alias("__top"))
    return a.unionByName(b.crossJoin(F.broadcast(top)).withColumn(index, (F.col(index) + F.col("__top")).cast(a.schema[index].dataType)).drop("__top"))


def bounding_box(images: DataFrame, width: int, height: int, scale: float) -> DataFrame:
    """Sky positions of the four corners around ``(ra, dec)`` in a tangent plane of ``scale`` degrees per pixel."""
    out = images
    for name, sx, sy in (("tl", -1, 1), ("tr", 1, 1), ("bl", -1, -1), ("br", 1, -1)):
        xi, eta = math.radians(sx * width / 2 * scale), math.radians(sy * height / 2 * scale)
        d0 = F.radians("dec")
        down = F.cos(d0) - eta * F.sin(d0)
        out = out.withColumn(f"ra_{name}", F.pmod(F.col("ra") + F.degrees(F.atan2(F.lit(xi), down)), F.lit(360.0))).withColumn(f"dec_{name}", F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.sqrt(xi * xi + down * down))))
    return out
