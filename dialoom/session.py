"""Session helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "dialoom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE); cluster settings win over these."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    return b.config(map=base | conf).getOrCreate()


def _sibling(spark: SparkSession) -> SparkSession:
    s = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes"):
        s.conf.set(k, spark.conf.get(k))
    return s


def wide_session(spark: SparkSession, rows: int = 32) -> SparkSession:
    """A session of the same application that reads and passes on few rows at a time, for tables whose rows have
    megabytes: Spark counts its batches in rows (4,096 of parquet, 10,000 of Arrow), whatever their size."""
    s = _sibling(spark)
    s.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))
    s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return s


def prefix_session(spark: SparkSession, column: str) -> SparkSession:
    """A session of the same application whose parquet files hold of each value of `column` what differs from the row
    before (DELTA_BYTE_ARRAY), for texts that go on from row to row. A page begins with a whole value, so pages are
    large; the column has no dictionary, whose writer ends pages by the values' whole size, and no statistics."""
    s = _sibling(spark)
    for k, v in {"parquet.writer.version": "PARQUET_2_0", "parquet.page.size": str(64 << 20), f"parquet.enable.dictionary#{column}": "false", f"parquet.column.statistics.enabled#{column}": "false"}.items():
        s.conf.set(k, v)
    return s


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the shared one that the session names (spark.checkpoint.dir). Where it names none, a folder of this
    machine serves in local mode, as in tests; on a cluster that is an error, as other machines couldn't read it.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "dialoom-checkpoints"))
    return df.checkpoint()


def read_table(spark: SparkSession, folder: str, name: str, wide: bool = False) -> DataFrame:
    return (wide_session(spark) if wide else spark).read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows spread over enough tasks for work in Python.

    The splits of a scan serve as they are, unless the input is so small that they would leave cores idle (under four
    splits a core): only then are rows moved by key, to twice as many tasks as there are cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if int(str(plan.stats().sizeInBytes())) >= 4 * cores * split:
        return df
    return df.repartition(2 * cores, *keys)


def sized_broadcast(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table to be sent with the tasks if it has at most `most` rows (counted), else as it is, to be joined by shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
