"""Session settings and the shared folder used to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture costs a round trip per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

TASKS_PER_SLOT = 3


def local_session(cores: int | str = "*", name: str = "riskloom", **extra: str) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings one."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session that names none, as in tests, gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        known = context._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="riskloom-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows evenly to a few tasks for each slot.

    For steps that take long for every row: a table of one file, or of one row group, would go
    through them in a single task.
    """
    return df.repartition(TASKS_PER_SLOT * df.sparkSession.sparkContext.defaultParallelism)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Used where a result feeds several later jobs, so that they neither recompute it nor
    lose it together with an executor. Later jobs read only the columns they need. The files
    stay until the folder is cleared, as the cluster does with its checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
