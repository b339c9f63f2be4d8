"""All queries of the engine, each with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrail.functions import arrays, sky
from lumentrail.operators import candidates, cleanup, curves, images, match, regions, results, search, stamps
from lumentrail.plans import views as V
from lumentrail.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# --- search -------------------------------------------------------------------------------------------------

VEL = "ve AS (SELECT a * 0.5 - 2 AS vx, b * 0.5 - 2 AS vy FROM (SELECT unnest(range(0, 9)) AS a), (SELECT unnest(range(0, 9)) AS b))"
SCORES = f"""WITH {V.PIXELS}, {VEL},
 probe AS (SELECT x0, y0, vx, vy, t, CAST(floor(x0 + vx * t + 0.5) AS INT) AS px, CAST(floor(y0 + vy * t + 0.5) AS INT) AS py
  FROM (SELECT CAST(unnest(range(0, 32)) AS INT) AS x0), (SELECT CAST(unnest(range(0, 32)) AS INT) AS y0), ve, tt),
 sc AS (SELECT x0 AS x, y0 AS y, vx, vy, count(*) AS obs_count, sum(psi) AS psi, sum(phi) AS phi FROM probe JOIN pp ON pp.t = probe.t AND pp.x = px AND pp.y = py GROUP BY ALL),
 lh AS (SELECT x, y, vx, vy, CAST(obs_count AS INT) AS obs_count, CASE WHEN phi > 0 THEN psi / sqrt(phi) ELSE -1 END AS lh, CASE WHEN phi > 0 THEN psi / phi ELSE -1 END AS flux FROM sc)"""
TOP = SCORES + """, top AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY round(lh, 9) DESC, vx, vy) AS r FROM lh WHERE obs_count >= 8)
 SELECT x, y, vx, vy, obs_count, round(lh, 6) AS lh, round(flux, 6) AS flux FROM top WHERE r <= 3 AND lh >= 1"""


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return candidates.start_pixels(spark, (0, V.SIZE), (0, V.SIZE)), candidates.velocity_grid(spark, 9, -2, 2, 9, -2, 2), images.psi_phi(V.pixels(spark, d))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("x", "y", "vx", "vy", "obs_count", *r6("lh", "flux"))


@query(TOP)
def search_topk(spark, d):
    return _shown(search.search(*_parts(spark, d), k=3, min_obs=8, min_lh=1.0))


@query(TOP)
def search_dense(spark, d):
    return _shown(search.search_dense(*_parts(spark, d), V.SIZE, V.SIZE, k=3, min_obs=8, min_lh=1.0))


@query(SCORES + """, top AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY round(lh, 9) DESC, vx, vy) AS r FROM lh)
 SELECT x, y, vx, vy, obs_count, round(lh, 6) AS lh, round(flux, 6) AS flux FROM top WHERE r <= 3 AND obs_count >= 8 AND lh >= 1""")  # fmt: skip
def search_rank_then_filter(spark, d):
    return _shown(search.top_per_pixel(search.evaluate(*_parts(spark, d)), 3, 8, filter_first=False).where("lh >= 1"))


@query(TOP.replace(" SELECT x, y, vx, vy, obs_count, round(lh, 6) AS lh, round(flux, 6) AS flux FROM top WHERE r <= 3 AND lh >= 1", " SELECT x, y, vx, vy, obs_count, round(lh, 6) AS lh, round(flux, 6) AS flux FROM top WHERE r <= 3 AND lh >= 1 ORDER BY round(lh, 6) DESC, x, y, vx, vy LIMIT 100 OFFSET 50"))
def search_batch(spark, d):
    return search.batch(search_topk(spark, d), 50, 100)


@query(SCORES.replace("sc AS (SELECT", "raw AS (SELECT x0 AS x, y0 AS y, vx, vy, psi, phi, psi / phi AS f FROM probe JOIN pp ON pp.t = probe.t AND pp.x = px AND pp.y = py), sc0 AS (SELECT").replace("lh AS (SELECT x, y, vx, vy, CAST(obs_count AS INT) AS obs_count, CASE", "unused AS (SELECT x, y, vx, vy, CAST(obs_count AS INT) AS obs_count, CASE").replace("FROM sc)", "FROM sc0)") + """,
 li AS (SELECT x, y, vx, vy, count(*) AS n, list(f ORDER BY f) AS fs FROM raw GROUP BY ALL),
 bo AS (SELECT x, y, vx, vy, n, fs[CAST(ceil(n * 0.5 + 0.001) AS INT)] AS m, 0.7413 * (fs[CAST(ceil(n * 0.75 + 0.001) AS INT)] - fs[CAST(ceil(n * 0.25 + 0.001) AS INT)]) AS s FROM li),
 cl AS (SELECT x, y, vx, vy, any_value(n) AS n, sum(psi) AS psi, sum(phi) AS phi FROM raw JOIN bo USING (x, y, vx, vy) WHERE f >= m - 2 * s AND f <= m + 2 * s GROUP BY ALL)
 SELECT x, y, vx, vy, CAST(n AS INT) AS obs_count, round(psi / sqrt(phi), 6) AS lh, round(psi / phi, 6) AS flux FROM cl WHERE phi > 0""")  # fmt: skip
def search_clipped(spark, d):
    return _shown(search.evaluate_clipped(*_parts(spark, d), 25, 75, 0.7413))


@query(f"""WITH {V.PIXELS}, {V.SLOW}, dv AS (SELECT (a - 1) * 0.5 AS dvx, (b - 1) * 0.5 AS dvy FROM (SELECT unnest(range(0, 3)) AS a), (SELECT unnest(range(0, 3)) AS b)),
 probe AS (SELECT id, x + i AS x0, y + j AS y0, vx + dvx AS vx, vy + dvy AS vy, t, CAST(floor(x + i + (vx + dvx) * t + 0.5) AS INT) AS px, CAST(floor(y + j + (vy + dvy) * t + 0.5) AS INT) AS py
  FROM st, dv, tt, (SELECT CAST(unnest(range(-1, 2)) AS INT) AS i), (SELECT CAST(unnest(range(-1, 2)) AS INT) AS j)),
 sc AS (SELECT id, x0 AS x, y0 AS y, vx, vy, CAST(count(*) AS INT) AS obs_count, sum(psi) AS psi, sum(phi) AS phi FROM probe JOIN pp ON pp.t = probe.t AND pp.x = px AND pp.y = py GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(psi / sqrt(phi), 9) DESC, x, y, vx, vy) AS r FROM sc WHERE obs_count >= 3)
 SELECT id, x, y, vx, vy, obs_count, round(psi / sqrt(phi), 6) AS lh, round(psi / phi, 6) AS flux FROM rk WHERE r = 1""")  # fmt: skip
def search_refined(spark, d):
    near = candidates.velocity_grid(spark, 3, -0.5, 0.5, 3, -0.5, 0.5)
    return search.refine(V.slow_trajectories(spark, d), near, images.psi_phi(V.pixels(spark, d)), 1, 3).select("id", "x", "y", "vx", "vy", "obs_count", *r6("lh", "flux"))


# --- candidates ---------------------------------------------------------------------------------------------


@query("SELECT b * 9 + a AS vel_id, a * 0.5 - 2 AS vx, b * 0.5 - 2 AS vy FROM (SELECT unnest(range(0, 9)) AS a), (SELECT unnest(range(0, 9)) AS b)")
def velocities_grid(spark, d):
    return candidates.velocity_grid(spark, 9, -2, 2, 9, -2, 2)


POLAR = "SELECT o * {n} + i AS vel_id, round(cos({a}) * ({s}), 9) AS vx, round(sin({a}) * ({s}), 9) AS vy FROM (SELECT unnest(range(0, {m})) AS o), (SELECT unnest(range(0, {n})) AS i)"


def _r9(df: DataFrame) -> DataFrame:
    return df.select("vel_id", F.round("vx", 9).alias("vx"), F.round("vy", 9).alias("vy"))


@query(POLAR.format(n=5, m=4, a="-0.2 + o * 0.1", s="1 + i * 0.4"))
def velocities_polar(spark, d):
    return _r9(candidates.polar_grid(spark, 5, 1.0, 3.0, 4, -0.2, 0.2))


@query(POLAR.format(n=257, m=129, a="0.3 - pi() / 15 + o * (2 * pi() / 15 / 128)", s="92 + i * (434.0 / 256)"))
def velocities_ecliptic(spark, d):
    c = candidates
    return _r9(c.create(spark, {"name": "EclipticCenteredSearch", "velocities": [92.0, 526.0, 257], "angles": [-np.pi / 15, np.pi / 15, 129], "given_ecliptic": 0.3}))


@query(POLAR.format(n=21, m=15, a="atan2(3, 4) - 0.2618 + o * 0.035", s="0 + i * 0.5"))
def velocities_pencil(spark, d):
    return _r9(candidates.pencil(spark, 4.0, 3.0, max_vel_offset=5.0))


@query("SELECT CAST(id % 36 - 2 AS INT) AS x, CAST(id // 36 - 2 AS INT) AS y FROM (SELECT unnest(range(0, 36 * 36)) AS id)")
def start_pixels(spark, d):
    return candidates.start_pixels(spark, (-2, 34), (-2, 34))


@query("SELECT 20 AS n, true AS inside")
def velocities_random(spark, d):
    v = candidates.random_velocities(spark, -1, 1, -2, 2, 20, 5)
    return v.agg(F.count("*").cast("int").alias("n"), F.min(F.col("vx").between(-1, 1) & F.col("vy").between(-2, 2)).alias("inside"))


# --- images -------------------------------------------------------------------------------------------------


@query(f"WITH {V.PIXELS} SELECT t, y, x, round(psi, 6) AS psi, round(phi, 6) AS phi FROM pp")
def psi_phi(spark, d):
    return images.psi_phi(V.pixels(spark, d)).select("t", "y", "x", *r6("psi", "phi"))


CONVOLVED = f"""WITH {V.PIXELS}, k AS (SELECT j, i, w / sum(w) OVER () AS w FROM (SELECT j, i, exp(-(j * j + i * i) / 2.0) AS w FROM (SELECT unnest(range(-3, 4)) AS j), (SELECT unnest(range(-3, 4)) AS i))),
 s AS (SELECT p.t, p.y - j AS y, p.x - i AS x, sum(psi * w) AS v, sum(w) AS w FROM pp p, k GROUP BY ALL)
 SELECT pp.t, pp.y, pp.x, round(s.v / s.w, 6) AS psi FROM pp JOIN s ON pp.t = s.t AND pp.y = s.y AND pp.x = s.x"""


@query(CONVOLVED)
def convolved_psi(spark, d):
    k = images.kernel_table(spark, images.gaussian_kernel(1.0))
    return images.convolved(images.psi_phi(V.pixels(spark, d)), k, "psi").select("t", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *r6("psi"))


@query(CONVOLVED)
def convolved_psi_dense(spark, d):
    return images.convolved_dense(images.psi_phi(V.pixels(spark, d)), images.gaussian_kernel(1.0), "psi", V.SIZE, V.SIZE).select("t", "y", "x", *r6("psi"))


@query(f"""WITH {V.PIXELS}, r AS (SELECT min(psi) AS lo, max(psi) AS hi, greatest(max(psi) - min(psi), 1e-6) / 255 AS s FROM pp),
 c AS (SELECT t, y, x, CAST(trunc((least(greatest(psi, lo), hi - s / 100) - lo) / s + 1) AS INT) AS code, lo, s FROM pp, r)
 SELECT t, y, x, code, round((code - 1) * s + lo, 6) AS psi FROM c""")  # fmt: skip
def encoded_psi(spark, d):
    e = images.encode(images.psi_phi(V.pixels(spark, d)), "psi", 1)
    return e.select("t", "y", "x", "code", F.round(images.decoded(F.col("code"), F.col("low"), F.col("scale")), 6).alias("psi"))


@query(f"WITH {V.PIXELS} SELECT t, 1024 - count(*) AS masked, round(1 - count(*) / 1024.0, 6) AS fraction FROM pix WHERE sci BETWEEN -10 AND 10 GROUP BY t")
def masked_fraction(spark, d):
    return images.masked_fraction(images.mask_outside(V.pixels(spark, d), "sci", -10, 10), V.SIZE, V.SIZE).select("t", "masked", *r6("fraction"))


@query(f"WITH {V.PIXELS} SELECT t, round(min(sci), 6) AS sci_min, round(max(sci), 6) AS sci_max, round(avg(sci), 6) AS sci_mean, round(min(var), 6) AS var_min, round(max(var), 6) AS var_max, round(avg(var), 6) AS var_mean, round(1 - count(*) / 1024.0, 6) AS masked FROM pix GROUP BY t")
def image_statistics(spark, d):
    s = images.image_statistics(V.pixels(spark, d), V.SIZE, V.SIZE)
    return s.select("t", *r6(*[c for c in s.columns if c != "t"]))


@query(f"WITH {V.PIXELS}, k AS (SELECT t FROM pix GROUP BY t HAVING 1 - count(*) / 1024.0 <= 0.2) SELECT t, y, x, round(sci, 6) AS sci, round(210.0 * (t - (SELECT min(t) FROM k)), 6) AS zt FROM pix WHERE t IN (SELECT t FROM k)")
def images_kept(spark, d):
    p = V.pixels(spark, d)
    return images.keep_images(p, images.masked_fraction(p, V.SIZE, V.SIZE).where("fraction <= 0.2")).select("t", "y", "x", *r6("sci", "zt"))


@query(f"WITH {V.PIXELS} SELECT t, y, x, round(sci / pow(10, (t % 3) / 2.5), 6) AS sci, round(var / pow(pow(10, (t % 3) / 2.5), 2), 6) AS var FROM pix")
def color_scaled(spark, d):
    p = V.pixels(spark, d)
    names = p.select("t", F.concat(F.lit("f"), F.col("t") % 3).alias("filter")).distinct()
    return images.scale_by_filter(p, names, {"f0": 0.0, "f1": 1.0, "f2": 2.0}).select("t", "y", "x", *r6("sci", "var"))


@query(f"WITH {V.PIXELS}, s AS (SELECT t, max(sci) AS hi, 1 - count(*) / 1024.0 AS m FROM pix GROUP BY t) SELECT t, CASE WHEN m > 0.2 AND hi > 24 THEN 'masked,flux' WHEN m > 0.2 THEN 'masked' ELSE 'flux' END AS failed FROM s WHERE m > 0.2 OR hi > 24")
def images_invalid(spark, d):
    return images.bad_images(V.pixels(spark, d), V.SIZE, V.SIZE, masked=0.2, flux=(-1e8, 24.0)).select("t", F.concat_ws(",", "failed").alias("failed"))


@query(f"WITH {V.PIXELS}, m AS (SELECT DISTINCT t, y + j AS y, x + i AS x FROM pix, (SELECT unnest(range(-1, 2)) AS j), (SELECT unnest(range(-1, 2)) AS i) WHERE sci > 20) SELECT t, y, x FROM pix WHERE (t, y, x) NOT IN (SELECT t, y, x FROM m)")
def mask_grown(spark, d):
    p = V.pixels(spark, d)
    return images.grow_mask(p, p.where("sci > 20").select("t", "y", "x"), 1).select("t", "y", "x")


@query(f"""WITH {V.PIXELS}, w AS (SELECT j, i, (CASE WHEN i = 1 THEN 0.25 ELSE 0.75 END) * (CASE WHEN j = 1 THEN 0.5 ELSE 0.5 END) AS w FROM (SELECT unnest(range(0, 2)) AS j), (SELECT unnest(range(0, 2)) AS i))
 SELECT t, y - j - 1 AS y, x - i - 2 AS x, round(sum(sci * w) / sum(w), 6) AS sci, round(sum(var * w) / sum(w), 6) AS var FROM pix, w WHERE y - j - 1 BETWEEN 0 AND 29 AND x - i - 2 BETWEEN 0 AND 29 GROUP BY 1, 2, 3 HAVING sum(w) >= 0.8""")  # fmt: skip
def images_reprojected(spark, d):
    return images.reprojected(V.pixels(spark, d), 2.25, 1.5, 30, 30).select("t", "y", "x", *r6("sci", "var"))


@query(f"WITH {V.PIXELS} SELECT CAST(t // 2 AS DOUBLE) AS mjd, CASE WHEN t % 2 = 0 THEN y ELSE y + 32 END AS y, x, round(sci, 6) AS sci, round(var, 6) AS var FROM pix")
def images_mosaicked(spark, d):
    p = V.pixels(spark, d).select(F.floor(F.col("t") / 2).cast("double").alias("mjd"), (F.col("t") % 2).alias("part"), (F.col("y") + 32 * (F.col("t") % 2)).alias("y"), "x", "sci", "var")
    return images.mosaic(p).select("mjd", "y", "x", *r6("sci", "var"))


# --- curves -------------------------------------------------------------------------------------------------


@query(f"""WITH {V.PIXELS}, {V.SLOW}, pr AS (SELECT id, t, CAST(floor(x + vx * t + 0.5) AS INT) AS px, CAST(floor(y + vy * t + 0.5) AS INT) AS py FROM st, tt)
 SELECT id, CAST(pr.t AS INT) AS i, round(coalesce(psi, 0), 6) AS psi, round(coalesce(phi, 0), 6) AS phi FROM pr LEFT JOIN pp ON pp.t = pr.t AND pp.x = px AND pp.y = py""")  # fmt: skip
def psi_phi_curves(spark, d):
    c = curves.psi_phi_curves(V.slow_trajectories(spark, d), images.psi_phi(V.pixels(spark, d)))
    return c.select("id", F.posexplode(F.arrays_zip("psi_curve", "phi_curve")).alias("i", "c")).select("id", "i", F.round("c.psi_curve", 6).alias("psi"), F.round("c.phi_curve", 6).alias("phi"))


@query(f"""WITH {V.PIXELS}, {V.SLOW}, pr AS (SELECT id, t, CAST(trunc(x + vx * t + 0.5) AS INT) AS px, CAST(trunc(y + vy * t + 0.5) AS INT) AS py FROM st, tt)
 SELECT id, CAST(pr.t AS INT) AS i, round(sci, 6) AS sci, round(var, 6) AS var FROM pr LEFT JOIN pix ON pix.t = pr.t AND pix.x = px AND pix.y = py""")  # fmt: skip
def sci_var_curves(spark, d):
    c = curves.sci_var_curves(V.slow_trajectories(spark, d), V.pixels(spark, d))
    return c.select("id", F.posexplode(F.arrays_zip("sci_curve", "var_curve")).alias("i", "c")).select("id", "i", F.round("c.sci_curve", 6).alias("sci"), F.round("c.var_curve", 6).alias("var"))


def _lh(spark, d):
    return V.curves(spark, d).withColumn("lh_curve", arrays.likelihood_curve(F.col("psi_curve"), F.col("phi_curve")))


@query(f"WITH {V.CURVES} SELECT id, CAST(i AS INT) AS i, round(lh, 6) AS lh FROM cu")
def likelihood_curves(spark, d):
    return _lh(spark, d).select("id", F.posexplode("lh_curve").alias("i", "lh")).select("id", "i", *r6("lh"))


CLIP = f"""WITH {V.CURVES}, q AS (SELECT id, quantile_cont(lh, 0.25) AS a, quantile_cont(lh, 0.5) AS m, quantile_cont(lh, 0.75) AS b FROM cu WHERE {{where}} GROUP BY id),
 v AS (SELECT id, i, psi, phi, coalesce({{where}} AND lh > m - 2 * 0.7413 * greatest(b - a, {{floor}}) AND lh < m + 2 * 0.7413 * greatest(b - a, {{floor}}), false) AS valid FROM cu LEFT JOIN q USING (id))"""


@query(CLIP.format(where="true", floor="1e-8") + " SELECT id, CAST(i AS INT) AS i, valid FROM v")
def clip_curves(spark, d):
    return _lh(spark, d).select("id", F.posexplode(curves.clip_curve(F.col("lh_curve"), 25, 75, 0.7413)).alias("i", "valid"))


@query(CLIP.format(where="lh > 0", floor="1e-8") + " SELECT id, CAST(i AS INT) AS i, valid FROM v")
def clip_curves_positive(spark, d):
    return _lh(spark, d).select("id", F.posexplode(curves.clip_curve(F.col("lh_curve"), 25, 75, 0.7413, clip_negative=True)).alias("i", "valid"))


@query(CLIP.format(where="true", floor="1e-5") + " SELECT id, CAST(i AS INT) AS i, valid FROM v")
def clip_matrix(spark, d):
    long = _lh(spark, d).select("id", F.posexplode("lh_curve").alias("i", "lh"))
    return curves.clip_matrix(long, 25, 75, 0.7413).select("id", "i", "valid")


@query(CLIP.format(where="true", floor="1e-8") + " SELECT id, CAST(count(*) AS INT) AS obs_count, round(sum(psi) / sqrt(sum(phi)), 6) AS lh, round(sum(psi) / sum(phi), 6) AS flux FROM v WHERE valid GROUP BY id HAVING count(*) >= 10 AND sum(psi) / sqrt(sum(phi)) >= 0")
def clipped_results(spark, d):
    c = _lh(spark, d).withColumn("obs_valid", curves.clip_curve(F.col("lh_curve"), 25, 75, 0.7413))
    return curves.restated(c, 10, 0.0).select("id", "obs_count", *r6("lh", "flux"))


@query(f"WITH {V.CURVES} SELECT CAST(CASE WHEN psi / phi >= 1 THEN 19 ELSE least(19, floor((greatest(psi / phi, 0)) / 0.05)) END AS INT) AS bin, count(*) AS n FROM cu GROUP BY 1")
def flux_histogram(spark, d):
    f = V.curves(spark, d).select(F.explode(arrays.flux_curve(F.col("psi_curve"), F.col("phi_curve"))).alias("f"))
    return results.histogram(f, "f", 20, 0.0, 1.0)


@query(f"WITH {V.TRAJECTORIES}, r AS (SELECT min(lh) AS lo, max(lh) AS hi FROM tr) SELECT CAST(least(9, floor((lh - lo) / ((hi - lo) / 10))) AS INT) AS bin, count(*) AS n FROM tr, r GROUP BY 1")
def likelihood_histogram(spark, d):
    return results.histogram(V.trajectories(spark, d), "lh", 10)


# --- cleaning -----------------------------------------------------------------------------------------------

BINS = "CAST(trunc(x / {w}) AS INT) AS bx0, CAST(trunc(y / {w}) AS INT) AS by0, CAST(trunc((x + vx * {t}) / {w}) AS INT) AS bx1, CAST(trunc((y + vy * {t}) / {w}) AS INT) AS by1"
GRID = "WITH " + V.TRAJECTORIES + ", b AS (SELECT *, " + BINS + "), r AS (SELECT *, row_number() OVER (PARTITION BY bx0, by0, bx1, by1 ORDER BY lh DESC, id) AS r, count(*) OVER (PARTITION BY bx0, by0, bx1, by1) AS n FROM b) SELECT id, bx0, by0, bx1, by1, n FROM r WHERE r = 1"


@query(GRID.format(w="10.0", t="2.0").replace("AS by1)", "AS by1 FROM tr)"))
def grid_best(spark, d):
    return cleanup.grid_best(V.trajectories(spark, d), 10.0, 2.0).select("id", "bx0", "by0", "bx1", "by1", "n")


@query(GRID.format(w="6.0", t="0.0").replace("AS by1)", "AS by1 FROM tr)").replace("SELECT id, bx0, by0, bx1, by1, n FROM", "SELECT id FROM"))
def cluster_grid_start(spark, d):
    return cleanup.apply_clustering(V.trajectories(spark, d), "grid_start", 5.2, (0.0, 1.0, 2.0)).select("id")


PAIRS = "p AS (SELECT a.id AS a, b.id AS b, a.lh AS la, b.lh AS lb FROM tr a JOIN tr b ON a.id <> b.id AND {on})"
START_END = "pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.x + a.vx * 2 - b.x - b.vx * 2, 2) + pow(a.y + a.vy * 2 - b.y - b.vy * 2, 2) <= 25"


@query(f"WITH {V.TRAJECTORIES}, {PAIRS.format(on=START_END)} SELECT a, b FROM p")
def neighbour_pairs(spark, d):
    return cleanup.neighbours(cleanup.with_features(V.trajectories(spark, d), "start_end_position", (0.0, 1.0, 2.0)), 5.0, 4)


#: With all likelihoods different, the sweep keeps exactly those that no neighbour beats.
@query(f"WITH tr AS (SELECT id, x, y, vx, vy, lh + id * 1e-6 AS lh FROM ({V.TRAJECTORIES[7:-1]})), {PAIRS.format(on=START_END)} SELECT id FROM tr WHERE id NOT IN (SELECT a FROM p WHERE lb > la)")
def sweep_start_end(spark, d):
    t = V.trajectories(spark, d).withColumn("lh", F.col("lh") + F.col("id") * 1e-6)
    return cleanup.apply_clustering(t, "nn_start_end", 5.0, (0.0, 1.0, 2.0)).select("id")


CLUSTER = "WITH RECURSIVE " + V.TRAJECTORIES + ", " + PAIRS + ", reach AS (SELECT id AS a, id AS b FROM tr UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.b), c AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a) {out}"
POS_VEL = "pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.vx - b.vx, 2) + pow(a.vy - b.vy, 2) <= 4"


@query(CLUSTER.format(on=POS_VEL, out="SELECT id, cluster FROM c"))
def clusters(spark, d):
    return cleanup.clustered(V.trajectories(spark, d), "all", 2.0).select("id", "cluster")


@query(CLUSTER.format(on=POS_VEL, out=", r AS (SELECT id, row_number() OVER (PARTITION BY cluster ORDER BY lh DESC, id) AS r FROM c JOIN tr USING (id)) SELECT id FROM r WHERE r = 1"))
def cluster_best(spark, d):
    return cleanup.apply_clustering(V.trajectories(spark, d), "pos_vel", 2.0, (0.0, 1.0, 2.0)).select("id")


@query()
def line_clusters(spark, d):
    return cleanup.predictive_lines(V.trajectories(spark, d))


# --- stamps -------------------------------------------------------------------------------------------------

CUT = f"""WITH {V.PIXELS}, {V.SLOW}, st2 AS (SELECT * FROM st),
 cut AS (SELECT id, pix.t, 49718.0 + 210 * pix.t AS mjd, dy, dx, sci, var FROM (SELECT id, t, dy, dx, CAST(trunc(x + vx * t + 0.5) AS INT) + dx AS px, CAST(trunc(y + vy * t + 0.5) AS INT) + dy AS py FROM st2, tt, (SELECT CAST(unnest(range(-2, 3)) AS INT) AS dy), (SELECT CAST(unnest(range(-2, 3)) AS INT) AS dx)) JOIN pix ON pix.t = "t" AND pix.x = px AND pix.y = py)"""
CUT = CUT.replace('pix.t = "t" AND', "pix.t = q.t AND").replace("AS dx)) JOIN", "AS dx)) q JOIN").replace("SELECT id, pix.t, 49718", "SELECT q.id, pix.t, 49718").replace("dy, dx, sci, var FROM (SELECT id", "q.dy, q.dx, sci, var FROM (SELECT id")
COADD = """round(sum(sci), 6) AS "sum", round(avg(sci), 6) AS mean, round(list_sort(list(sci))[CAST((count(*) + 1) // 2 AS INT)], 6) AS median, round(sum(sci / var) / sum(1 / var), 6) AS weighted"""


def _cut(spark, d):
    return V.slow_trajectories(spark, d), V.pixels(spark, d), 2


@query(f"{CUT} SELECT id, dy, dx, {COADD} FROM cut GROUP BY id, dy, dx")
def coadds(spark, d):
    return stamps.coadds_at(*_cut(spark, d)).select("id", "dy", "dx", *r6("sum", "mean", "median", "weighted"))


@query(f"{CUT} SELECT id, dy, dx, CAST(DATE '1970-01-01' + CAST(floor(mjd) - 40587 AS INT) AS VARCHAR) AS day, {COADD} FROM cut GROUP BY ALL")
def coadds_nightly(spark, d):
    return stamps.coadds_at(*_cut(spark, d), by_day=True).select("id", "dy", "dx", F.col("day").cast("string").alias("day"), *r6("sum", "mean", "median", "weighted"))


@query(f"{CUT}, co AS (SELECT id, dy, dx, avg(sci) AS mean FROM cut GROUP BY id, dy, dx), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mean DESC, dy, dx) AS r FROM co) SELECT id, dy AS peak_dy, dx AS peak_dx, round(sqrt(dy * dy + dx * dx), 6) AS \"offset\" FROM r WHERE r = 1 AND sqrt(dy * dy + dx * dx) < 2")
def peak_offsets(spark, d):
    return stamps.peaks_at(*_cut(spark, d)).where("offset < 2").select("id", "peak_dy", "peak_dx", *r6("offset"))


@query(f"{CUT}, co AS (SELECT id, dy, dx, avg(sci) AS mean FROM cut GROUP BY id, dy, dx), n AS (SELECT id, min(mean) AS low, sum(mean) AS s, count(*) AS n FROM co GROUP BY id) SELECT id, dy, dx, round(CASE WHEN s - n * low = 0 THEN 0 ELSE (mean - low) / (s - n * low) END, 6) AS mean FROM co JOIN n USING (id)")
def stamps_normalised(spark, d):
    return stamps.normalised_at(*_cut(spark, d)).select("id", "dy", "dx", *r6("mean"))


@query(f"""WITH {V.CURVES}, b AS (SELECT vec_id AS id, 0.1 + (vec_id % 5) / 10.0 AS flux FROM embeddings), o AS (SELECT k, -1.0 + k * 0.5 AS "offset" FROM (SELECT unnest(range(0, 5)) AS k)),
 chi AS (SELECT id, flux, k, "offset", sum(pow(psi - flux * "offset", 2) / phi) AS chi2 FROM cu JOIN b USING (id), o GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(chi2, 9), k) AS r FROM chi) SELECT id, round(flux * "offset", 6) AS best_flux, "offset", round(chi2, 4) AS chi2 FROM r WHERE r = 1 AND k NOT IN (0, 4)""")  # fmt: skip
def brightness(spark, d):
    c = V.curves(spark, d).select("id", (0.1 + (F.col("id") % 5) / 10.0).alias("flux"), F.posexplode(F.arrays_zip("psi_curve", "phi_curve")).alias("i", "c")).select("id", "flux", "i", F.col("c.psi_curve").alias("sci"), F.col("c.phi_curve").alias("var"))
    return stamps.brightness_search(c, [-1.0, -0.5, 0.0, 0.5, 1.0]).select("id", *r6("best_flux"), "offset", F.round("chi2", 4).alias("chi2"))


@query(f"WITH {V.OBSERVATIONS} SELECT id, count(DISTINCT floor(mjd)) AS num_days FROM ob GROUP BY id")
def observing_days(spark, d):
    return stamps.observing_days(V.observations(spark, d))


# --- matching -----------------------------------------------------------------------------------------------


@query(f"""WITH {V.OBSERVATIONS}, tm AS (SELECT k AS time_id, 60310 + 0.15 * k AS mjd FROM (SELECT unnest(range(0, 200)) AS k)),
 h AS (SELECT ob.i, tm.time_id, row_number() OVER (PARTITION BY ob.i ORDER BY round(abs(ob.mjd - tm.mjd), 9), tm.mjd) AS r FROM ob JOIN tm ON abs(ob.mjd - tm.mjd) <= 0.05)
 SELECT ob.i, CAST(coalesce(h.time_id, -1) AS BIGINT) AS time_id FROM ob LEFT JOIN h ON h.i = ob.i AND h.r = 1""")  # fmt: skip
def nearest_in_time(spark, d):
    t = spark.range(200).select(F.col("id").alias("time_id"), (60310 + 0.15 * F.col("id")).alias("mjd"))
    return match.nearest_in_time(V.observations(spark, d), t, 0.05, key="i").select("i", "time_id")


SKY = f"WITH {V.OBSERVATIONS}, {V.KNOWN}, m AS (SELECT ob.id, ob.i, kn.name FROM ob JOIN kn ON abs(ob.mjd - kn.mjd) <= 0.05 AND {V.HAVERSINE.format(r1='ob.ra', d1='ob.dec', r2='kn.ra', d2='kn.dec')} <= 0.001)"


def _sky(spark, d):
    return match.on_sky(V.observations(spark, d), V.known_objects(spark, d), 0.001, 0.05)


@query(f"{SKY} SELECT id, i, name FROM m")
def sky_matches(spark, d):
    return _sky(spark, d).select("id", "i", "name")


@query(f"{SKY} SELECT id, name, count(DISTINCT i) AS n FROM m GROUP BY id, name HAVING count(DISTINCT i) >= 3")
def recovered_by_count(spark, d):
    return match.recovered_by_count(_sky(spark, d), 3)


@query(f"{SKY} SELECT id, name, round(count(DISTINCT i) / 30.0, 6) AS ratio FROM m GROUP BY id, name HAVING count(DISTINCT i) / 30.0 <= 0.15")
def recovered_by_ratio(spark, d):
    return match.recovered_by_ratio(_sky(spark, d), V.known_objects(spark, d), 0.15).select("id", "name", *r6("ratio"))


@query(f"{SKY} SELECT i FROM ob WHERE i NOT IN (SELECT i FROM m)")
def unmatched_observations(spark, d):
    return match.invalidate(V.observations(spark, d), _sky(spark, d)).select("i")


@query(f"{SKY} SELECT DISTINCT kn.name, kn.name IN (SELECT name FROM m) AS recovered FROM kn")
def recovered_and_missed(spark, d):
    return match.recovered_and_missed(V.known_objects(spark, d), _sky(spark, d))


@query(f"{SKY} SELECT id, name, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS observations FROM (SELECT DISTINCT id, name, i FROM m) GROUP BY id, name")
def matched_observations(spark, d):
    return match.matched_observations(_sky(spark, d)).select("id", "name", F.concat_ws(",", F.transform("observations", lambda i: i.cast("string"))).alias("observations"))


NEAR = f"""WITH {V.TRAJECTORIES}, q AS (SELECT * FROM tr WHERE id % 20 = 0), h AS (SELECT q.id AS query_id, tr.id, (sqrt(pow(tr.x - q.x, 2) + pow(tr.y - q.y, 2)) + sqrt(pow(tr.x + tr.vx * 2 - q.x - q.vx * 2, 2) + pow(tr.y + tr.vy * 2 - q.y - q.vy * 2, 2))) / 2 AS d FROM q, tr WHERE tr.id <> q.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS r FROM h) SELECT query_id, id, round(d, 6) AS distance FROM r WHERE r = 1"""


@query(NEAR)
def nearest_trajectories(spark, d):
    t = V.trajectories(spark, d)
    return match.nearest_trajectory(t.where("id % 20 = 0"), t, [0.0, 2.0]).select("query_id", "id", *r6("distance"))


@query("SELECT b * 9 + a AS vel_id FROM (SELECT unnest(range(0, 9)) AS a), (SELECT unnest(range(0, 9)) AS b) ORDER BY pow(a * 0.5 - 2 - 0.7, 2) + pow(b * 0.5 - 2 + 1.1, 2), vel_id LIMIT 1")
def nearest_velocity(spark, d):
    return match.nearest_velocity(candidates.velocity_grid(spark, 9, -2, 2, 9, -2, 2), 0.7, -1.1).select("vel_id")


@query()
def assigned_trajectories(spark, d):
    t = V.trajectories(spark, d)
    return match.match_sets(t.where("id % 2 = 0"), t.where("id % 2 = 1"), [0.0, 2.0], 8.0)


LINES = f"WITH {V.OBSERVATIONS}, z AS (SELECT id, mjd - 60310 AS zt, ra * 1000 AS x, dec * 1000 + value AS y FROM ob)"


def _lines(spark, d):
    return V.observations(spark, d).select("id", (F.col("mjd") - 60310).alias("zt"), (F.col("ra") * 1000).alias("x"), (F.col("dec") * 1000 + F.col("value")).alias("y"))


@query(f"{LINES} SELECT id, CAST(round(regr_intercept(x, zt) - 0.5) AS INT) AS x, CAST(round(regr_intercept(y, zt) - 0.5) AS INT) AS y, round(regr_slope(x, zt), 6) AS vx, round(regr_slope(y, zt), 6) AS vy FROM z GROUP BY id")
def fitted_lines(spark, d):
    return match.fit_lines(_lines(spark, d)).select("id", "x", "y", *r6("vx", "vy"))


@query(f"{LINES}, l AS (SELECT c_custkey AS id, 10000 + c_custkey % 10 AS x, -5000.0 AS y, 0.01 AS vx, 0.5 AS vy FROM customer) SELECT id, round(avg(pow(l.x + vx * zt + 0.5 - z.x, 2) + pow(l.y + vy * zt + 0.5 - z.y, 2)), 5) AS mse FROM z JOIN l USING (id) GROUP BY id")
def line_errors(spark, d):
    line = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (10000 + F.col("c_custkey") % 10).alias("x"), F.lit(-5000.0).alias("y"), F.lit(0.01).alias("vx"), F.lit(0.5).alias("vy"))
    return match.line_error(_lines(spark, d), line).select("id", F.round("mse", 5).alias("mse"))


@query(f"WITH {V.OBSERVATIONS}, l AS (SELECT i, id, mjd, lead(mjd) OVER w AS next_mjd, lead(ra) OVER w AS next_ra, lead(dec) OVER w AS next_dec FROM ob WINDOW w AS (PARTITION BY id ORDER BY mjd, i)) SELECT i, id, round(next_mjd - mjd, 6) AS gap, round(next_ra, 6) AS next_ra, round(next_dec, 6) AS next_dec FROM l WHERE next_mjd IS NOT NULL")
def tracklets(spark, d):
    return match.tracklets(V.observations(spark, d), "id", ["mjd", "i"]).select("i", "id", F.round(F.col("next_mjd") - F.col("mjd"), 6).alias("gap"), *r6("next_ra", "next_dec"))


# --- regions ------------------------------------------------------------------------------------------------


@query("SELECT a * 44 + b AS patch_id, a * 2 + 1.25 AS ra, b * 2 - 42.75 AS dec FROM (SELECT unnest(range(0, 180)) AS a), (SELECT unnest(range(0, 44)) AS b)")
def patch_grid(spark, d):
    return regions.patches(spark, 150, 20, -43, 45).select("patch_id", "ra", "dec")


@query(f"WITH {V.IMAGES}, g AS (SELECT a * 90 + b AS patch_id, a * 2 + 1.25 AS ra, b * 2 - 90 + 1.25 AS dec FROM (SELECT unnest(range(0, 180)) AS a), (SELECT unnest(range(0, 90)) AS b)) SELECT image_id, patch_id FROM im JOIN g ON abs(im.ra - g.ra) < 1.25 AND abs(im.dec - g.dec) < 1.25")
def located_images(spark, d):
    return regions.locate(V.images(spark, d), regions.patches(spark, 150, 20), 2.5).select("image_id", "patch_id")


OVERLAP = f"""WITH {V.IMAGES}, g AS (SELECT a * 90 + b AS patch_id, a * 2 + 1.0 AS ra, b * 2 - 90 + 1.0 AS dec FROM (SELECT unnest(range(0, 180)) AS a), (SELECT unnest(range(0, 90)) AS b)),
 o AS (SELECT patch_id, image_id AS chip_id, visit, mjd, greatest(0, least(im.ra + 0.6, g.ra + 1) - greatest(im.ra - 0.6, g.ra - 1)) * greatest(0, least(im.dec + 0.4, g.dec + 1) - greatest(im.dec - 0.4, g.dec - 1)) AS overlap FROM im JOIN g ON abs(im.ra - g.ra) < 1.6 AND abs(im.dec - g.dec) < 1.4)"""


def _overlaps(spark, d):
    im = V.images(spark, d)
    corner = lambda a, b: F.struct((F.col("ra") + a).alias("ra"), (F.col("dec") + b).alias("dec"))
    chips = im.select(F.col("image_id").alias("chip_id"), "ra", "dec", F.array(corner(-0.6, -0.4), corner(0.6, -0.4), corner(0.6, 0.4), corner(-0.6, 0.4)).alias("corners"))
    return regions.overlaps(chips, regions.patches(spark, 120, 0), 2.0, 0.05).join(im.select(F.col("image_id").alias("chip_id"), "visit", "mjd"), "chip_id")


@query(f"{OVERLAP} SELECT patch_id, chip_id, round(overlap, 6) AS overlap FROM o WHERE overlap > 0.05")
def overlaps(spark, d):
    return _overlaps(spark, d).select("patch_id", "chip_id", *r6("overlap"))


@query(f"{OVERLAP} SELECT patch_id, round(sum(overlap), 5) AS overlap, count(DISTINCT visit) AS visits, count(DISTINCT CAST(floor(mjd) AS BIGINT)) AS days, CAST(max(floor(mjd - 0.5)) - min(floor(mjd - 0.5)) + 1 AS INT) AS nights_spanned FROM o WHERE overlap > 0.05 GROUP BY patch_id")
def patch_report(spark, d):
    return regions.patch_report(_overlaps(spark, d)).select("patch_id", F.round("overlap", 5).alias("overlap"), "visits", "days", "nights_spanned")


@query(f"WITH {V.IMAGES} SELECT image_id FROM im WHERE mjd BETWEEN 50000 AND 51000 AND wcs_err <= 900 / 3600.0 AND band NOT IN ('1-URGENT', '5-LOW')")
def images_filtered(spark, d):
    return regions.without_bands(regions.by_wcs_error(regions.by_time_range(V.images(spark, d), 50000, 51000), 900), ["1-URGENT", "5-LOW"]).select("image_id")


@query(f"WITH {V.IMAGES} SELECT image_id FROM im WHERE least(abs(mjd - 50000), abs(mjd - 50500.3), abs(mjd - 51000)) <= 0.5")
def images_by_mjds(spark, d):
    return regions.by_mjds(V.images(spark, d), [50000, 50500.3, 51000], 0.5).select("image_id")


@query(f"WITH {V.IMAGES} SELECT image_id FROM im WHERE {V.HAVERSINE.format(r1='ra', d1='dec', r2='120.0', d2='10.0')} <= 15")
def images_in_cone(spark, d):
    return regions.cone(V.images(spark, d), 120.0, 10.0, 15.0).select("image_id")


@query(f"WITH {V.IMAGES} SELECT visit, mjd, count(*) AS n FROM im GROUP BY visit, mjd HAVING count(*) > 1")
def images_repeated(spark, d):
    return regions.repeated_images(V.images(spark, d), ["visit", "mjd"])


@query(f"WITH {V.IMAGES} SELECT mjd, count(*) AS n, min(image_id) AS first_image FROM im GROUP BY mjd")
def unique_times(spark, d):
    return V.images(spark, d).groupBy("mjd").agg(F.count("*").alias("n"), F.min("image_id").alias("first_image"))


@query(f"WITH {V.IMAGES} SELECT visit, CAST(max(floor(mjd - 0.5)) - min(floor(mjd - 0.5)) + 1 AS INT) AS nights, strftime(max(DATE '1970-01-01' + CAST(floor(mjd - 0.5) - 40587 AS INT)), '%Y%m%d') AS last_night FROM im GROUP BY visit")
def nights_by_visit(spark, d):
    n = sky.day_of(F.col("mjd") - 0.5)
    return V.images(spark, d).groupBy("visit").agg((F.datediff(F.max(n), F.min(n)) + 1).alias("nights"), F.max(sky.observing_day(F.col("mjd"))).alias("last_night"))


# --- sky ----------------------------------------------------------------------------------------------------


@query(f"""WITH {V.OBSERVATIONS}, a AS (SELECT i, radians(ra - 10.05) AS r, radians(dec) AS d, radians(-4.95) AS z FROM ob), b AS (SELECT *, sin(d) * sin(z) + cos(d) * cos(z) * cos(r) AS w FROM a)
 SELECT i, round(degrees(cos(d) * sin(r) / w) / 0.0001 + 500, 6) AS px, round(degrees((sin(d) * cos(z) - cos(d) * sin(z) * cos(r)) / w) / 0.0001 + 500, 6) AS py FROM b""")  # fmt: skip
def projected(spark, d):
    px, py = sky.tan_to_pixel(F.col("ra"), F.col("dec"), 10.05, -4.95, 0.0001, 500, 500)
    return V.observations(spark, d).select("i", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


@query(f"WITH {V.OBSERVATIONS} SELECT i, round(ra, 6) AS ra, round(dec, 6) AS dec FROM ob")
def projected_back(spark, d):
    px, py = sky.tan_to_pixel(F.col("ra"), F.col("dec"), 10.05, -4.95, 0.0001, 500, 500)
    p = V.observations(spark, d).select("i", px.alias("px"), py.alias("py"))
    ra, dec = sky.tan_to_sky(F.col("px"), F.col("py"), 10.05, -4.95, 0.0001, 500, 500)
    return p.select("i", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"))


@query(f"WITH {V.OBSERVATIONS} SELECT i, round(ra, 6) AS ra, round(dec, 6) AS dec FROM ob")
def parallax_round_trip(spark, d):
    earth = (0.3 * F.cos(F.col("mjd")), 0.3 * F.sin(F.col("mjd")), F.lit(0.1))
    ra, dec, _ = sky.parallax_corrected(F.col("ra"), F.col("dec"), earth, F.lit(40.0))
    o = V.observations(spark, d).select("i", "mjd", ra.alias("ra"), dec.alias("dec"))
    ra, dec = sky.parallax_inverted(F.col("ra"), F.col("dec"), earth, F.lit(40.0))
    return o.select("i", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"))


@query(f"WITH {V.OBSERVATIONS}, z AS (SELECT avg(27 + value / 1000) AS zp FROM ob) SELECT i, round(-2.5 * log10(value) + zp, 6) AS mag FROM ob, z WHERE value > 0")
def magnitudes(spark, d):
    o = V.observations(spark, d)
    return o.crossJoin(F.broadcast(o.agg(F.avg(27 + F.col("value") / 1000).alias("zp")))).select("i", F.round(sky.magnitude(F.col("value"), F.col("zp")), 6).alias("mag")).where("mag is not null")


# --- results ------------------------------------------------------------------------------------------------


def _tracked(spark, d):
    t = results.tracked(V.trajectories(spark, d))
    return results.filter_rows(results.filter_rows(t, F.col("lh") >= 950, "lh"), F.col("x") < 60, "position")


@query(f"WITH {V.TRAJECTORIES} SELECT CASE WHEN lh < 950 THEN 'lh' WHEN x >= 60 THEN 'position' ELSE 'unfiltered' END AS label, count(*) AS n FROM tr GROUP BY 1")
def filter_statistics(spark, d):
    return results.filter_statistics(_tracked(spark, d))


@query(f"WITH {V.TRAJECTORIES} SELECT id, CASE WHEN lh >= 950 AND x >= 60 THEN 'position' ELSE 'unfiltered' END AS reason FROM tr WHERE lh >= 950")
def filter_reverted(spark, d):
    return results.current(results.revert(_tracked(spark, d), "position", "reason")).select("id", "reason")


@query(f"WITH {V.TRAJECTORIES} SELECT id, x, y, lh FROM tr ORDER BY lh DESC, id LIMIT 100")
def best_results(spark, d):
    return results.best(V.trajectories(spark, d), 100).select("id", "x", "y", "lh")


@query(f"WITH {V.TRAJECTORIES} SELECT id, lh FROM tr WHERE x < 30 UNION ALL SELECT id + 1000000, lh FROM tr WHERE x >= 60")
def results_extended(spark, d):
    t = V.trajectories(spark, d).select("id", "lh", "x")
    return results.extend(t.where("x < 30"), t.where("x >= 60").withColumn("id", F.col("id") + 1000000)).select("id", "lh")


@query(f"WITH {V.CURVES}, v AS (SELECT id, i, 60000 + i * 0.5 AS mjd FROM cu WHERE psi > 0), e AS (SELECT id, min(mjd) AS a, max(mjd) AS b FROM v GROUP BY id) SELECT id, CAST(i AS INT) AS i, mjd FROM v JOIN e USING (id) WHERE mjd = a OR mjd = b")
def first_and_last(spark, d):
    r = V.curves(spark, d).select("id", F.transform("psi_curve", lambda p: p > 0).alias("obs_valid"))
    times = spark.range(64).select(F.col("id").cast("int").alias("i"), (60000 + F.col("id") * 0.5).alias("mjd"))
    return results.observations(r, times, ends=True).select("id", "i", "mjd")


@query(f"WITH {V.TRAJECTORIES} SELECT CAST(lh AS DOUBLE) AS lh, x, y, vx, vy, CAST(id % 20 AS INT) AS obs_count FROM tr")
def trajectory_text(spark, d):
    line = F.format_string("lh: %s flux: %s x: %d y: %d vx: %s vy: %s obs_count: %d", F.col("lh").cast("string"), F.lit("1.5"), "x", "y", F.col("vx").cast("string"), F.col("vy").cast("string"), (F.col("id") % 20).cast("int"))
    return tables.trajectory_lines(V.trajectories(spark, d).select(line.alias("value"))).drop("flux")
