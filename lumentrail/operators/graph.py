"""Connected components of a table of edges."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def materialised(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that the cluster names; a local one only where none is named."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="graph-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores: one small file is read by one task, which would do all that follows."""
    return df.repartition(2 * max(2, df.sparkSession.sparkContext.defaultParallelism))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for all ends of ``edges(u, v)``; the root is the least node reachable.

    Every round, each node takes the least label among itself and its neighbours and then its label's label, so
    labels travel twice as far each time. Rounds end when a checksum of the labels stays.
    """
    both = materialised(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct())
    labels = materialised(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("root")))
    last = None
    while (now := labels.agg(F.count("*"), F.sum(F.col("root").cast("decimal(38,0)"))).first()) != last:
        last = now
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        one = labels.join(near, labels["node"] == near["u"]).select("node", F.least("root", "near").alias("root"))
        two = one.join(one.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left")
        labels = materialised(two.select("node", F.least("root", F.coalesce("far", "root")).alias("root")))
    return labels
