"""The results table: filters that keep track of what they remove, sets, sorting, and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lumentrail.functions.sky import is_valid
from lumentrail.schema import same_columns

REMOVED = "removed_by"


def tracked(results: DataFrame) -> DataFrame:
    """Adds ``removed_by``, null for rows that are still in."""
    return results.withColumn(REMOVED, F.lit(None).cast("string"))


def filter_rows(results: DataFrame, keep: Column, label: str = "") -> DataFrame:
    """Marks rows that fail ``keep`` (or leave it null) as removed under a label; earlier removals stay."""
    return results.withColumn(REMOVED, F.when(F.col(REMOVED).isNull() & ~F.coalesce(keep, F.lit(False)), F.lit(label)).otherwise(F.col(REMOVED)))


def filter_ids(results: DataFrame, kept: DataFrame, label: str = "", id_col: str = "id") -> DataFrame:
    """As ``filter_rows``, keeping the ids of a table; an empty table removes all rows."""
    k = kept.select(id_col).distinct().withColumn("__kept", F.lit(True))
    return filter_rows(results.join(k, id_col, "left"), F.col("__kept"), label).drop("__kept")


def current(results: DataFrame) -> DataFrame:
    return results.where(F.col(REMOVED).isNull()).drop(REMOVED)


def removed(results: DataFrame, label: str | None = None) -> DataFrame:
    return results.where(F.col(REMOVED).isNotNull() if label is None else F.col(REMOVED) == label)


def revert(results: DataFrame, label: str | None = None, reason_col: str | None = None) -> DataFrame:
    """Takes back removals, all or those of a label, optionally noting the label in a column."""
    hit = F.col(REMOVED).isNotNull() if label is None else F.coalesce(F.col(REMOVED) == label, F.lit(False))
    out = results.withColumn(reason_col, F.when(hit, F.col(REMOVED)).otherwise(F.lit("unfiltered"))) if reason_col else results
    return out.withColumn(REMOVED, F.when(hit, F.lit(None)).otherwise(F.col(REMOVED)))


def filter_statistics(results: DataFrame) -> DataFrame:
    """``(label, n)``: rows still in as ``unfiltered``, and rows removed under each label."""
    return results.groupBy(F.coalesce(F.col(REMOVED), F.lit("unfiltered")).alias("label")).agg(F.count("*").alias("n"))


def extend(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of the same set of columns as one."""
    same_columns(a, b)
    return a.unionByName(b)


def sorted_by(results: DataFrame, column: str, descending: bool = True, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    return results.orderBy(F.desc(column) if descending else F.asc(column), *ties)


def best(results: DataFrame, n: int, lh_col: str = "lh") -> DataFrame:
    """The n most likely, or all for -1."""
    return results if n < 0 else sorted_by(results, lh_col).limit(n)


def is_empty(df: DataFrame, column: str) -> Column:
    """Null, or an array without elements."""
    c = F.col(column)
    return c.isNull() | (F.size(c) == 0) if isinstance(df.schema[column].dataType, ArrayType) else c.isNull()


def depth(df: DataFrame, column: str) -> int:
    """How many arrays deep a column is."""
    kind, n = df.schema[column].dataType, 0
    while isinstance(kind, ArrayType):
        kind, n = kind.elementType, n + 1
    return n


def stripped(df: DataFrame, max_depth: int = 3, keep: tuple[str, ...] = (), drop: tuple[str, ...] = (), all_null: bool = False) -> DataFrame:
    """Drops named columns, columns of arrays deeper than ``max_depth`` and, if asked for, columns of nulls alone."""
    gone = {c for c in df.columns if c not in keep and (c in drop or depth(df, c) > max_depth)}
    if all_null and (left := [c for c in df.columns if c not in gone and c not in keep]):
        counts = df.agg(*[F.count(F.when(~is_empty(df, c), 1)).alias(c) for c in left]).first()
        gone |= {c for c in left if not counts[c]}
    return df.drop(*gone)


def split_columns(df: DataFrame, patterns: list[str], key: str = "id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Columns that fully match a pattern as tables of their own, with the key, and the rest."""
    apart = [c for c in df.columns if c != key and any(re.fullmatch(p, c) for p in patterns)]
    return df.drop(*apart), {c: df.select(key, c) for c in apart}


def observations(results: DataFrame, times: DataFrame, only_valid: bool = True, ends: bool = False) -> DataFrame:
    """One row per observation of ``results(id, obs_valid, ...)``, with ``times(i, mjd)``; with ``ends`` first and last."""
    o = results.select("*", F.posexplode("obs_valid").alias("i", "valid"))
    o = o.where("valid") if only_valid else o
    o = o.join(F.broadcast(times.select("i", "mjd")), "i")
    if ends:
        e = o.groupBy("id").agg(F.min("mjd").alias("first"), F.max("mjd").alias("last"))
        o = o.join(e, "id").where("mjd = first or mjd = last").drop("first", "last")
    return o.drop("obs_valid")


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """``(bin, n)`` over equal bins; the last includes its upper end. Bounds are those of the data, or clamp it."""
    v = F.col(column)
    src = df.where(is_valid(v)).select(v.cast("double").alias("v"))
    if low is None or high is None:
        src = src.crossJoin(F.broadcast(src.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))))
    else:
        src = src.withColumn("lo", F.lit(float(low))).withColumn("hi", F.lit(float(high))).withColumn("v", F.greatest(F.least("v", "hi"), "lo"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(0)
    return src.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def merged(parts: list[DataFrame], keep) -> DataFrame:
    """Several result tables as one, of which ``keep`` (a function of a table to one of ids) says what stays."""
    out = parts[0]
    for p in parts[1:]:
        both = extend(out, p)
        out = both.join(keep(both).select("id").distinct(), "id", "left_semi")
    return out
