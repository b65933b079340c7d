"""Tables that several jobs of one operator share, and column helpers of the subpackage."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.session import checkpoint_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_scopes: list[list[str]] = []


def fresh(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it: computed once, cuts the lineage, outlives executors."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    for made in _scopes[-1:]:
        made.append(path)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # the shuffles of the job go once its table stands, else they stay on disk as long as the driver likes
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[list[str]]:
    """Folders of the tables stored inside, oldest first; those still in the list at the end are removed, so a caller takes out what has to stay."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)
        for path in made:
            _remove(path)


def _remove(path: str) -> None:
    """Deletes a folder through Spark's own file systems, whatever their scheme. What can't be removed stays and is told."""
    spark = SparkSession.getActiveSession()
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception as failed:  # noqa: BLE001
        warnings.warn(f"{path} was not removed: {failed}", stacklevel=2)


def drop(*tables: DataFrame) -> None:
    """Removes stored tables that no later step reads."""
    for table in tables:
        for path in {x.rpartition("/")[0] for x in table.inputFiles()}:
            _remove(path)


def stored_bytes(df: DataFrame) -> int:
    """Size of the files that are read, as Spark's optimizer sees it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
