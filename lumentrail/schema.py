"""Schemas of the engine's tables, and checks of required columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

TRAJECTORY = "x int, y int, vx double, vy double, lh double, flux double, obs_count int"
PIXELS = "t int, mjd double, zt double, y int, x int, sci double, var double"
PSI_PHI = "t int, zt double, y int, x int, psi double, phi double"
PSF = "t int, j int, i int, w double"
VELOCITIES = "vel_id long, vx double, vy double"
RESULTS = "uuid string, x int, y int, vx double, vy double, likelihood double, flux double, obs_count int"
COLLECTION = "mjd_mid double, ra double, dec double, wcs string, obs_lon double, obs_lat double, obs_elev double"
CATALOG = "name string, ra double, dec double, mjd double"


def require(df: DataFrame, schema: str) -> DataFrame:
    """``df`` itself, if it has the columns of ``schema``; extra columns are allowed."""
    if missing := [f.name for f in StructType.fromDDL(schema).fields if f.name not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def same_columns(a: DataFrame, b: DataFrame) -> None:
    if set(a.columns) != set(b.columns):
        raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
