"""Session helpers.

The library never creates its own session inside an operator; callers pass a
SparkSession. ``get_spark`` is for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "weft", cpus: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session with the settings the operators are designed for.

    On a cluster the same keys belong in the job's spark-defaults; nothing here
    is required for correctness except the UTC session time zone.
    """
    parts = shuffle_partitions or (8 if cpus == "*" else max(int(cpus), 1))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("WEFT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.ansi.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``, or the context's own setting).

    Where none is set, a local session gets a fresh folder under the system temp dir; on a cluster, where executors
    would not see such a folder, that is an error.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="weft-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, plain: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: computed once, and a lost executor repeats nothing of it.

    Spark estimates a table by its files. ``plain`` (neither compressed nor with dictionaries) is for tables that are joined and
    whose values repeat: their files are as large as their rows, so only a table that is small in memory is broadcast.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/weft-tables/{uuid.uuid4().hex}/{name}"
    (df.write.options(**{"compression": "none", "parquet.enable.dictionary": "false"}) if plain else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
