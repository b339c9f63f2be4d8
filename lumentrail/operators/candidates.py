"""Candidate velocities and start pixels as tables.

Every generator makes its grid from ``range`` and column arithmetic, so that it is a plan and no list on
the driver, and numbers its rows in the order of generation.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _grid(spark: SparkSession, outer: int, inner: int) -> DataFrame:
    """``(vel_id, o, i)``: numbers of an outer and an inner loop."""
    return spark.range(outer * inner).select(F.col("id").alias("vel_id"), F.floor(F.col("id") / inner).alias("o"), F.pmod("id", F.lit(inner)).alias("i"))


def _polar(df: DataFrame, angle: Column, speed: Column) -> DataFrame:
    return df.select("vel_id", (F.cos(angle) * speed).alias("vx"), (F.sin(angle) * speed).alias("vy"))


def single(spark: SparkSession, vx: float, vy: float) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("vel_id"), F.lit(float(vx)).alias("vx"), F.lit(float(vy)).alias("vy"))


def velocity_grid(spark: SparkSession, vx_steps: int, vx_min: float, vx_max: float, vy_steps: int, vy_min: float, vy_max: float) -> DataFrame:
    """A grid of velocities, both ends included; vy outer, vx inner."""
    if vx_steps < 2 or vy_steps < 2:
        raise ValueError("a grid needs two steps or more on each axis")
    if vx_max < vx_min or vy_max < vy_min:
        raise ValueError("bounds must be in order")
    return _grid(spark, vy_steps, vx_steps).select("vel_id", (vx_min + F.col("i") * ((vx_max - vx_min) / (vx_steps - 1))).alias("vx"), (vy_min + F.col("o") * ((vy_max - vy_min) / (vy_steps - 1))).alias("vy"))


def pencil(spark: SparkSession, vx: float, vy: float, max_ang_offset: float = 0.2618, ang_step: float = 0.035, max_vel_offset: float = 10.0, vel_step: float = 0.5) -> DataFrame:
    """Angles and speeds around a velocity; speeds don't fall below 0. Both ends included."""
    if min(max_ang_offset, ang_step, max_vel_offset, vel_step) <= 0:
        raise ValueError("offsets and steps must be positive")
    angle, speed = math.atan2(vy, vx), math.hypot(vx, vy)
    least = max(0.0, speed - max_vel_offset)
    angles, speeds = int(math.floor((2 * max_ang_offset + 1e-8) / ang_step)) + 1, int(math.floor((speed + max_vel_offset - least + 1e-8) / vel_step)) + 1
    return _polar(_grid(spark, angles, speeds), angle - max_ang_offset + F.col("o") * ang_step, least + F.col("i") * vel_step)


def polar_grid(spark: SparkSession, vel_steps: int, min_vel: float, max_vel: float, ang_steps: int, min_ang: float, max_ang: float) -> DataFrame:
    """Angles (outer) and speeds (inner), upper ends excluded."""
    if vel_steps < 1 or ang_steps < 1 or max_vel < min_vel or max_ang < min_ang:
        raise ValueError("steps must be positive and bounds in order")
    return _polar(_grid(spark, ang_steps, vel_steps), min_ang + F.col("o") * ((max_ang - min_ang) / ang_steps), min_vel + F.col("i") * ((max_vel - min_vel) / vel_steps))


def polar_around(spark: SparkSession, v_arr: list[float], ang_arr: list[float], average_angle: float | None) -> DataFrame:
    """``polar_grid`` with offsets around an average angle: speeds (min, max, steps), angles (below, above, steps)."""
    if average_angle is None:
        raise ValueError("an average angle is needed")
    return polar_grid(spark, int(v_arr[2]), v_arr[0], v_arr[1], int(ang_arr[2]), average_angle - ang_arr[0], average_angle + ang_arr[1])


def ecliptic_centered(spark: SparkSession, velocities: list[float], angles: list[float], ecliptic: float = 0.0, angle_units: str = "radian", velocity_units: str = "pix / d") -> DataFrame:
    """Angles (outer) around the ecliptic and speeds (inner), both ends included. One step means the lower end."""
    if velocity_units != "pix / d":
        raise ValueError("velocities are in pixels per day")
    if angle_units not in ("radian", "degree"):
        raise ValueError("angles are in radian or degree")
    unit = 1.0 if angle_units == "radian" else math.pi / 180
    (v0, v1, nv), (a0, a1, na) = velocities, angles
    nv, na = int(nv), int(na)
    if nv < 1 or na < 1 or v1 < v0 or a1 < a0:
        raise ValueError("steps must be positive and bounds in order")
    return _polar(_grid(spark, na, nv), F.lit(ecliptic + a0 * unit) + F.col("o") * ((a1 - a0) * unit / max(1, na - 1)), F.lit(float(v0)) + F.col("i") * ((v1 - v0) / max(1, nv - 1)))


def random_velocities(spark: SparkSession, vx_min: float, vx_max: float, vy_min: float, vy_max: float, n: int, seed: int = 0) -> DataFrame:
    """Uniform velocities. They depend on the row number and the seed alone, not on partitions."""
    u = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 53)) / float(1 << 53)
    return spark.range(n).select(F.col("id").alias("vel_id"), (vx_min + u(0) * (vx_max - vx_min)).alias("vx"), (vy_min + u(1) * (vy_max - vy_min)).alias("vy"))


GENERATORS: dict[str, Callable[..., DataFrame]] = {
    "SingleVelocitySearch": single, "VelocityGridSearch": velocity_grid, "PencilSearch": pencil, "PolarSearch": polar_grid, "PolarAroundSearch": polar_around, "EclipticCenteredSearch": ecliptic_centered, "RandomVelocitySearch": random_velocities,
}


def register(name: str, make: Callable[..., DataFrame]) -> None:
    """Adds a generator of one's own: any function of a session and parameters to ``(vel_id, vx, vy)``."""
    GENERATORS[name] = make


def create(spark: SparkSession, config: dict) -> DataFrame:
    params = {k: v for k, v in config.items() if k != "name"}
    if params.get("given_ecliptic", 0) is None or "given_ecliptic" in params:
        params["ecliptic"] = params.pop("given_ecliptic") or 0.0
    if config["name"] not in GENERATORS:
        raise KeyError(f"unknown generator {config['name']}; there are {sorted(GENERATORS)}")
    return GENERATORS[config["name"]](spark, **params)


def start_pixels(spark: SparkSession, x_bounds: tuple[int, int], y_bounds: tuple[int, int]) -> DataFrame:
    """``(x, y)`` of all start pixels; upper bounds excluded, negative ones allowed."""
    w, h = x_bounds[1] - x_bounds[0], y_bounds[1] - y_bounds[0]
    return spark.range(w * h).select((F.pmod("id", F.lit(w)) + x_bounds[0]).cast("int").alias("x"), (F.floor(F.col("id") / w) + y_bounds[0]).cast("int").alias("y"))
