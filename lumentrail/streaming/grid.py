"""The near-duplicate grid over a stream of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumentrail.operators.cleanup import bins


def best_per_cell(trajectories: DataFrame, width: float, max_dt: float) -> DataFrame:
    """As a streaming aggregation: the best trajectory so far of each cell of start and end.

    The state has one row per cell met; the update mode sends on the cells that a batch improved.
    """
    best = F.max(F.struct("lh", (-F.col("id")).alias("nid"), "x", "y", "vx", "vy")).alias("b")
    cells = trajectories.select("*", *bins(width, max_dt)).groupBy("bx0", "by0", "bx1", "by1").agg(best, F.count("*").alias("n"))
    return cells.select("bx0", "by0", "bx1", "by1", (-F.col("b.nid")).alias("id"), "b.x", "b.y", "b.vx", "b.vy", "b.lh", "n")


def nightly_counts(events: DataFrame, ts: str = "ts", late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Observations per night with a watermark: rows later than ``late`` are left out and old nights leave the state."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("night"), "n")


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Processes what there is and stops; the result is an in-memory table."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
