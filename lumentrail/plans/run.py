"""A whole search: from a stack of images to decorated results."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentrail.config import SearchConfig
from lumentrail.functions import arrays, sky
from lumentrail.operators import candidates, cleanup, curves, images, results, search, stamps
from lumentrail.operators.graph import materialised


@dataclass
class Frame:
    """A tangent-plane image: size, centre in degrees, degrees per pixel."""

    width: int
    height: int
    ra: float = 0.0
    dec: float = 0.0
    scale: float = 1 / 3600

    def to_sky(self, x, y):
        return sky.tan_to_sky(x, y, self.ra, self.dec, self.scale, self.width / 2, self.height / 2)

    def to_pixel(self, ra, dec):
        return sky.tan_to_pixel(ra, dec, self.ra, self.dec, self.scale, self.width / 2, self.height / 2)


def prepared(pixels: DataFrame, frame: Frame, config: SearchConfig) -> DataFrame:
    """The images with few enough masked pixels, times from the first of them."""
    good = images.masked_fraction(pixels, frame.width, frame.height).where(F.col("fraction") <= config.max_masked_pixels)
    return images.keep_images(pixels, good)


def core_search(images_pp: DataFrame, frame: Frame, config: SearchConfig) -> DataFrame:
    """Scored lines of all start pixels, best first, numbered by ``id``."""
    spark = images_pp.sparkSession
    starts = candidates.start_pixels(spark, config.start_bounds("x", frame.width), config.start_bounds("y", frame.height))
    found = search.search_auto(starts, candidates.create(spark, config.generator_config), images_pp, frame.width, frame.height, k=config.results_per_pixel, min_obs=config.num_obs, min_lh=config.lh_level)
    # ids count within ranges of likelihood, which a sort by ranges makes in parallel
    best = found.drop("rank", "psi", "phi").repartitionByRange(F.desc("lh")).sortWithinPartitions(F.desc("lh"), "x", "y", "vx", "vy")
    return best.withColumn("id", F.monotonically_increasing_id())


def clipped(found: DataFrame, images_pp: DataFrame, config: SearchConfig) -> DataFrame:
    """Light curves of the results, outliers marked in ``obs_valid``, statistics restated, weak results dropped."""
    low, high = config.sigmaG_lims
    df = curves.psi_phi_curves(found, images_pp)
    there = F.zip_with("psi_curve", "phi_curve", lambda p, q: q > 0)
    valid = curves.clip_curve(arrays.likelihood_curve(F.col("psi_curve"), F.col("phi_curve")), low, high, sky.clip_coefficient(low, high), clip_negative=config.clip_negative)
    mask = F.zip_with(there, valid, lambda a, b: a & b) if config.sigmaG_filter else there
    return curves.restated(df.withColumn("obs_valid", mask), config.num_obs, config.lh_level)


def with_positions(found: DataFrame, times: DataFrame, frame: Frame) -> DataFrame:
    """Predicted pixel and sky positions per image, as arrays in time order."""
    zt = [r.zt for r in times.select("t", "zt").distinct().sort("t").collect()]
    at = F.array(*map(F.lit, zt))
    x, y = F.transform(at, lambda t: sky.predicted(F.col("x"), F.col("vx"), t, centered=False)), F.transform(at, lambda t: sky.predicted(F.col("y"), F.col("vy"), t, centered=False))
    df = found.withColumn("pred_x", x).withColumn("pred_y", y)
    return df.withColumn("global_ra", F.zip_with("pred_x", "pred_y", lambda a, b: frame.to_sky(a, b)[0])).withColumn("global_dec", F.zip_with("pred_x", "pred_y", lambda a, b: frame.to_sky(a, b)[1]))


def run(pixels: DataFrame, frame: Frame, config: SearchConfig, kernel: np.ndarray | None = None) -> DataFrame:
    """All phases: image filter, psi and phi, search, near-duplicates, clipping, clusters, best, stamps, positions.

    Each phase is written to the checkpoint folder: later ones read it several times, and plans stay small.
    """
    spark = pixels.sparkSession
    kept = materialised(prepared(pixels, frame, config))
    k = images.kernel_table(spark, images.gaussian_kernel(config.psf_val) if kernel is None else kernel)
    pp = materialised(images.convolved_psi_phi(kept, k))
    zt = [r.zt for r in kept.select("zt").distinct().sort("zt").collect()]
    span = (zt[0], zt[len(zt) // 2], zt[-1])
    found = materialised(core_search(pp, frame, config))
    if config.near_dup_thresh:
        found = cleanup.grid_best(found, float(config.near_dup_thresh), span[2]).select(found.columns)
    found = materialised(clipped(found, pp, config))
    if config.do_clustering:
        found = cleanup.apply_clustering(found, config.cluster_type, config.cluster_eps, span, config.cluster_v_scale)
    found = materialised(results.best(found, config.max_results))
    if config.pred_line_cluster:
        found = cleanup.predictive_lines(found, config.pred_line_params[0], int(config.pred_line_params[1]), config.pred_line_params[2])
    kinds = set(config.coadds) | {config.stamp_type} | ({"mean"} if config.peak_offset_max is not None else set())
    cuts = materialised(stamps.coadds(stamps.cutouts(found, kept, config.stamp_radius)))
    if config.peak_offset_max is not None:
        near = stamps.peak_offset(cuts).where(F.col("offset") < config.peak_offset_max).select("id")
        found = found.join(near, "id", "left_semi")
    for kind in sorted(kinds):
        found = found.join(stamps.as_arrays(cuts, kind, config.stamp_radius), "id", "left")
    found = found.withColumn("stamp", F.col(f"coadd_{config.stamp_type}"))
    if config.compute_ra_dec:
        found = with_positions(found, kept, frame)
    uuid = F.substring(F.sha2(F.concat_ws(",", "x", "y", "vx", "vy"), 256), 1, 32)
    return found.withColumn("uuid", uuid).drop(*config.drop_columns)


def injection_catalog(spark, n: int, times: DataFrame, velocities: DataFrame, frame: Frame, mag: tuple[float, float], seed: int = 0) -> DataFrame:
    """``(injection_id, mjd, ra, dec, mag)``: n objects of seeded start, magnitude and velocity at every time.

    ``times(mjd, zt)``; each object moves with one of ``velocities(vel_id, vx, vy)``.
    """
    u = lambda salt: F.pmod(F.xxhash64("injection_id", F.lit(seed), F.lit(salt)), F.lit(1 << 53)) / float(1 << 53)
    m = velocities.count()
    o = spark.range(n).select(F.col("id").alias("injection_id")).select("injection_id", (u(0) * frame.width).alias("x"), (u(1) * frame.height).alias("y"), (mag[0] + u(2) * (mag[1] - mag[0])).alias("mag"), F.floor(u(3) * m).alias("k"))
    v = velocities.withColumn("k", F.row_number().over(Window.orderBy("vel_id")) - 1)
    p = o.join(F.broadcast(v), "k").crossJoin(F.broadcast(times.select("mjd", "zt").distinct())).withColumn("px", F.col("x") + F.col("vx") * F.col("zt")).withColumn("py", F.col("y") + F.col("vy") * F.col("zt"))
    ra, dec = frame.to_sky(F.col("px"), F.col("py"))
    return p.select("injection_id", "mjd", ra.alias("ra"), dec.alias("dec"), "mag", F.col("px").alias("plot_x"), F.col("py").alias("plot_y"))
