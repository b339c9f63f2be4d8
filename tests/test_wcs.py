import pytest
from pyspark.sql import functions as F

from lumentrail.operators import wcs


def header(ra, dec, scale=0.01, w=100, h=80):
    return wcs.serialized(F.lit(float(ra)), F.lit(float(dec)), F.lit(scale), F.lit(w), F.lit(h))


def test_headers(spark):
    r = spark.range(1).select(wcs.same_header(header(1, 2), header(1, 2)), wcs.same_header(header(1, 2), header(1, 2.1)), wcs.same_header(header(1, 2), F.lit("{}")), wcs.deserialized(header(1, 2))["NAXIS2"]).first()
    assert tuple(r) == (True, False, False, 80)


def test_constituents(spark):
    heads = spark.range(1).select(F.lit(1).alias("image_id"), header(10, 0).alias("wcs")).union(spark.range(1).select(F.lit(2), header(10.5, 0)))
    members = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "t int, image_id int")
    at = spark.createDataFrame([("a", 0, 9.8, 0.0), ("b", 0, 10.25, 0.0), ("c", 0, 20.0, 0.0), ("d", 1, 10.8, 0.0), ("e", 0, 190.0, 0.0)], "id string, t int, ra double, dec double")
    got = {(r.id, r.image_id, r.ambiguous) for r in wcs.constituents(at, members, heads).collect()}
    assert got == {("a", 1, False), ("b", 1, True), ("b", 2, True), ("c", None, None), ("d", None, None), ("e", None, None)}


def test_plane(spark):
    df = spark.createDataFrame([(1, 1e6 + x, 2e6 + y, 3.0 * (1e6 + x) - 0.5 * (2e6 + y) + 7) for x in range(4) for y in range(3)] + [(2, 0.0, 0.0, 1.0)], "id int, x double, y double, u double")
    got = {r.id: (r.a, r.b, r.c) for r in wcs.fitted_plane(df, "u").collect()}
    assert got[1] == pytest.approx((3.0, -0.5, 7.0), rel=1e-6) and got[2][0] is None
