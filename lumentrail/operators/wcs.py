"""World coordinates as data: JSON headers, fits of planes, and images that a mosaic was made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = "CRVAL1 double, CRVAL2 double, CRPIX1 double, CRPIX2 double, CDELT1 double, NAXIS1 int, NAXIS2 int"


def serialized(ra: Column, dec: Column, scale: Column, width: Column, height: Column) -> Column:
    """A tangent-plane header as JSON: centre in degrees, degrees per pixel, size."""
    return F.to_json(F.struct(ra.alias("CRVAL1"), dec.alias("CRVAL2"), (width / 2).alias("CRPIX1"), (height / 2).alias("CRPIX2"), scale.alias("CDELT1"), width.cast("int").alias("NAXIS1"), height.cast("int").alias("NAXIS2")))


def deserialized(text: Column) -> Column:
    return F.from_json(text, HEADER)


def same_header(a: Column, b: Column, tolerance: float = 1e-8) -> Column:
    """Whether two JSON headers agree in all fields."""
    x, y = deserialized(a), deserialized(b)
    names = [f.split()[0] for f in HEADER.split(", ")]
    return F.forall(F.array(*[F.abs(x[n].cast("double") - y[n].cast("double")) for n in names]), lambda d: F.coalesce(d <= tolerance, F.lit(False)))


def pixel_in(header: Column, ra: Column, dec: Column) -> Column:
    """Struct of x and y of a sky position in the image of a parsed header; null behind the plane."""
    r, d, d0 = F.radians(ra - header["CRVAL1"]), F.radians(dec), F.radians(header["CRVAL2"])
    down = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(r)
    x = F.degrees(F.cos(d) * F.sin(r) / down) / header["CDELT1"] + header["CRPIX1"]
    y = F.degrees((F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(r)) / down) / header["CDELT1"] + header["CRPIX2"]
    return F.when(down > 0, F.struct(x.alias("x"), y.alias("y")))


def constituents(positions: DataFrame, members: DataFrame, headers: DataFrame) -> DataFrame:
    """Which original image each of ``positions(id, t, ra, dec)`` of a mosaic lies in.

    ``members(t, image_id)`` are the images of each time, ``headers(image_id, wcs)`` their JSON headers. A
    position outside all images has a null image; one in several has a row for each and is ``ambiguous``.
    """
    h = headers.select("image_id", deserialized(F.col("wcs")).alias("h"))
    near = positions.join(members, "t").join(h, "image_id").withColumn("p", pixel_in(F.col("h"), F.col("ra"), F.col("dec")))
    inside = near.where((F.col("p.x") >= 0) & (F.col("p.y") >= 0) & (F.col("p.x") < F.col("h.NAXIS1")) & (F.col("p.y") < F.col("h.NAXIS2"))).select("id", "t", "image_id", "p.x", "p.y")
    several = inside.groupBy("id", "t").agg((F.count("*") > 1).alias("ambiguous"))
    return positions.join(inside.join(several, ["id", "t"]), ["id", "t"], "left")


def fitted_plane(samples: DataFrame, value: str) -> DataFrame:
    """Least squares ``value = a x + b y + c`` per id of ``samples(id, x, y, ...)``, from sums alone.

    Sums are of differences from the mean, so that positions far from the origin lose no digits.
    """
    mean = samples.groupBy("id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg(value).alias("mv"))
    d = samples.join(mean, "id").select("id", "mx", "my", "mv", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"), (F.col(value) - F.col("mv")).alias("v"))
    s = d.groupBy("id", "mx", "my", "mv").agg(*[F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in ("xx", "xy", "yy", "xv", "yv")])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a, b = F.try_divide(F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy"), det), F.try_divide(F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy"), det)
    return s.select("id", a.alias("a"), b.alias("b"), "mx", "my", "mv").select("id", "a", "b", (F.col("mv") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("c"))
