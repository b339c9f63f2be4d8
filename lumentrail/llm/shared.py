"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most so many bytes; beyond that the same join shuffles.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session leaves it unset (single-machine tests) a temporary folder is used.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lumentrail-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, after making Arrow batches small enough for long texts, unless the session has its own size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, "1000")
    return df


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared folder."""
    return os.path.join(shared_dir(spark), f"{kind}-{uuid.uuid4().hex}")


def maybe_broadcast(df: DataFrame, size: int) -> DataFrame:
    """Broadcast ``df``, of ``size`` bytes by count, if that is within the bound; otherwise leave it to shuffle."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("merge")


def shielded(docs: DataFrame, *named: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named by number, so that none clashes with an operator's own, and the new names of some."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), [f"c{docs.columns.index(n)}" for n in named]
