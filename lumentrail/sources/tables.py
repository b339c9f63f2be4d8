"""Reading and writing of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrail.operators.results import split_columns


def write_stack(pixels: DataFrame, meta: DataFrame, path: str) -> None:
    """A stack as a folder per image, with the images' metadata beside; reading a few images reads their folders alone."""
    pixels.repartition("t").write.mode("overwrite").partitionBy("t").parquet(f"{path}/pixels")
    meta.write.mode("overwrite").parquet(f"{path}/images")


def read_stack(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/pixels"), spark.read.parquet(f"{path}/images")


def write_results(results: DataFrame, path: str, meta: dict[str, str] | None = None, separate: list[str] | None = None, drop: list[str] | None = None) -> None:
    """Results as Parquet; columns that match a pattern of ``separate`` go to files of their own, by id."""
    main, apart = split_columns(results.drop(*(drop or [])), separate or [])
    main.write.mode("overwrite").parquet(f"{path}/main")
    for name, table in apart.items():
        table.write.mode("overwrite").parquet(f"{path}/column={name}")
    spark = results.sparkSession
    rows = [*(meta or {}).items(), *(("separate_column", c) for c in apart), *(("dropped_column", c) for c in drop or [])]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_results(spark: SparkSession, path: str, columns: bool = True) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Results with their separate columns joined back, and the metadata."""
    meta = [tuple(r) for r in spark.read.parquet(f"{path}/meta").collect()]
    df = spark.read.parquet(f"{path}/main")
    for key, name in meta:
        if key == "separate_column" and columns:
            df = df.join(spark.read.parquet(f"{path}/column={name}"), "id", "left")
    return df, meta


def write_statistics(statistics: DataFrame, path: str) -> None:
    statistics.orderBy(F.col("label") != "unfiltered", "label").coalesce(1).write.mode("overwrite").csv(path, header=True)


LINE = {"lh": "double", "flux": "double", "x": "int", "y": "int", "vx": "double", "vy": "double", "obs_count": "int"}


def trajectory_lines(lines: DataFrame) -> DataFrame:
    """Rows of ``lines(value)`` of the form ``lh: 1.0 flux: 2.0 x: 3 ...``; other lines are left out."""
    out = [F.regexp_extract("value", rf"(?:^|\s){k}:\s*(\S+)", 1).try_cast(t).alias(k) for k, t in LINE.items()]
    return lines.select(*out).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def read_trajectory_file(spark: SparkSession, path: str) -> DataFrame:
    return trajectory_lines(spark.read.text(path))


def read_ecsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of white-space separated columns under comment lines and a line of names."""
    return spark.read.csv(path, sep=" ", comment="#", header=True, schema=schema, mode="FAILFAST")


def packed(table: DataFrame) -> tuple[DataFrame, dict[str, object]]:
    """Constant columns moved to a dictionary. One pass counts the values of all columns."""
    row = table.agg(*[F.struct(F.min(c).alias("v"), F.coalesce(F.min(c).eqNullSafe(F.max(c)), F.lit(False)).alias("one"), (F.count(c) == F.count("*")).alias("full"), (F.count(c) == 0).alias("none")).alias(c) for c in table.columns]).first()
    constant = {c: row[c]["v"] for c in table.columns if row[c]["none"] or row[c]["one"] and row[c]["full"]}
    return table.drop(*constant), constant


def unpacked(table: DataFrame, constant: dict[str, object]) -> DataFrame:
    return table.select("*", *[F.lit(v).alias(c) for c, v in constant.items()])
