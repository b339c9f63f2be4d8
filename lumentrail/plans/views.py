"""Views of the general-purpose tables as the engine's inputs, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrail.functions.sky import mjd
from lumentrail.operators.graph import spread

SIZE = 32


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Line items as a stack of 32 x 32 images, one for each 210 days."""
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    p = table(spark, d, "lineitem").groupBy(F.floor(days / 210).cast("int").alias("t"), (F.col("l_orderkey") % SIZE).cast("int").alias("y"), (F.col("l_partkey") % SIZE).cast("int").alias("x")).agg((F.avg("l_quantity") - 25.5).alias("sci"), (210.0 / F.count("*")).alias("var"))
    return p.select("t", (F.lit(49718.0) + 210 * F.col("t")).alias("mjd"), F.col("t").cast("double").alias("zt"), "y", "x", "sci", "var")


PIXELS = """pix AS (SELECT CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 210.0) AS INT) AS t,
  CAST(l_orderkey % 32 AS INT) AS y, CAST(l_partkey % 32 AS INT) AS x, avg(l_quantity) - 25.5 AS sci, 210.0 / count(*) AS var FROM lineitem GROUP BY 1, 2, 3),
 pp AS (SELECT t, y, x, sci / var AS psi, 1 / var AS phi FROM pix WHERE var <> 0),
 tt AS (SELECT DISTINCT t FROM pix)"""


def trajectories(spark: SparkSession, d: str) -> DataFrame:
    """Parts as trajectories."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), (k % 97).cast("int").alias("x"), F.col("p_size").cast("int").alias("y"), (k % 13 - 6).cast("double").alias("vx"), (k % 11 - 5).cast("double").alias("vy"), F.col("p_retailprice").alias("lh"))


TRAJECTORIES = """tr AS (SELECT p_partkey AS id, CAST(p_partkey % 97 AS INT) AS x, p_size AS y, CAST(p_partkey % 13 - 6 AS DOUBLE) AS vx, CAST(p_partkey % 11 - 5 AS DOUBLE) AS vy, p_retailprice AS lh FROM part)"""


def slow_trajectories(spark: SparkSession, d: str) -> DataFrame:
    """Parts as trajectories that stay in the small images for a while."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), (k % SIZE).cast("int").alias("x"), (F.col("p_size") % SIZE).cast("int").alias("y"), ((k % 5 - 2) / 2.0).alias("vx"), ((k % 7 - 3) / 2.0).alias("vy"))


SLOW = """st AS (SELECT p_partkey AS id, CAST(p_partkey % 32 AS INT) AS x, CAST(p_size % 32 AS INT) AS y, (p_partkey % 5 - 2) / 2.0 AS vx, (p_partkey % 7 - 3) / 2.0 AS vy FROM part)"""


def curves(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as light curves of psi and phi."""
    e = F.col("embedding").cast("array<double>")
    phi = F.transform(F.sequence(F.lit(0), F.size(e) - 1), lambda i: 1 + 0.25 * (i % 4))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), e.alias("psi_curve"), phi.alias("phi_curve"))


CURVES = """cu AS (SELECT vec_id AS id, i, CAST(embedding[i + 1] AS DOUBLE) AS psi, 1 + 0.25 * (i % 4) AS phi, CAST(embedding[i + 1] AS DOUBLE) / sqrt(1 + 0.25 * (i % 4)) AS lh
  FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings))"""


def images(spark: SparkSession, d: str) -> DataFrame:
    """Orders as metadata of images."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("image_id"), mjd(F.col("o_orderdate")).alias("mjd"), (c % 360 + 0.5).alias("ra"), (k % 90 - 45 + 0.25).alias("dec"), F.col("o_orderpriority").alias("band"), c.alias("visit"), ((c % 37) / 100.0).alias("wcs_err"))


IMAGES = """im AS (SELECT o_orderkey AS image_id, epoch_us(o_orderdate) / 86400000000.0 + 40587 AS mjd, o_custkey % 360 + 0.5 AS ra, o_orderkey % 90 - 45 + 0.25 AS dec, o_orderpriority AS band, o_custkey AS visit, (o_custkey % 37) / 100.0 AS wcs_err FROM orders)"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Events as sightings of objects, one object per user."""
    u, e = F.col("user_id"), F.col("event_id")
    return table(spark, d, "events").select(e.alias("i"), u.alias("id"), mjd(F.col("ts")).alias("mjd"), (10 + (u % 10) * 0.01 + (e % 7) * 0.0001).alias("ra"), (-5 + F.floor(u / 10) * 0.01 + (e % 5) * 0.0001).alias("dec"), "value")


OBSERVATIONS = """ob AS (SELECT event_id AS i, user_id AS id, epoch_us(ts) / 86400000000.0 + 40587 AS mjd, 10 + (user_id % 10) * 0.01 + (event_id % 7) * 0.0001 AS ra, -5 + floor(user_id / 10) * 0.01 + (event_id % 5) * 0.0001 AS dec, value FROM events)"""


def known_objects(spark: SparkSession, d: str) -> DataFrame:
    """All customers as catalogued objects, seen on each of 30 days."""
    c = spread(table(spark, d, "customer").select(F.col("c_custkey").alias("name"))).select("name", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("k"))
    n = F.col("name")
    return c.select("name", (60310.0 + F.col("k")).alias("mjd"), (10 + (n % 10) * 0.01).alias("ra"), (-5 + F.floor(n / 10) * 0.01).alias("dec"))


KNOWN = """kn AS (SELECT c_custkey AS name, 60310.0 + k AS mjd, 10 + (c_custkey % 10) * 0.01 AS ra, -5 + floor(c_custkey / 10) * 0.01 AS dec FROM customer, (SELECT unnest(range(0, 30)) AS k))"""
HAVERSINE = "degrees(2 * asin(least(1.0, sqrt(pow(sin(radians({d2} - {d1}) / 2), 2) + cos(radians({d1})) * cos(radians({d2})) * pow(sin(radians({r2} - {r1}) / 2), 2)))))"
