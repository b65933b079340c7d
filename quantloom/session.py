"""Session settings shared by the entry points, the bench and the tests."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "quantloom") -> SparkSession:
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only a local master without that setting (tests) gets a folder of its own, the same for the whole application."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = os.path.join(tempfile.gettempdir(), f"spark-{spark.sparkContext.applicationId}")
    return path.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables; `clean` removes it."""
    return f"{checkpoint_dir(spark)}/quantloom-{spark.sparkContext.applicationId}"


def kept(df, name: str):
    """Writes a table into the shared folder and reads it back: computed once, whatever reads it; survives the loss of executors."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df, name: str):
    """`kept` for a small table, in one file, so that later plans see its real size."""
    return kept(df.coalesce(1), name)


def clean(spark: SparkSession) -> None:
    """Removes the intermediate tables of this application; call it when no DataFrame of it is read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
