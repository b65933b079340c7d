"""Report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def no_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every floating column."""
    def fix(f):
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c).alias(f.name)
        return F.col(f.name)

    return df.select(*[fix(f) for f in df.schema.fields])


def board_json(df: DataFrame, key: str, fields) -> DataFrame:
    """(key, board): one JSON document per row."""
    return no_nan(df).select(key, F.to_json(F.struct(*fields)).alias("board"))


def write_board(df: DataFrame, path: str, key: str | None = None, fmt: str = "json") -> None:
    """Replaces a board. With a key, one partition per key; partitions of keys that are gone disappear with the overwrite."""
    w = no_nan(df)
    if key is None:
        w.write.mode("overwrite").option("partitionOverwriteMode", "static").format(fmt).save(path)
        return
    w.withColumn(f"{key}_key", F.col(key)).repartition(f"{key}_key").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(f"{key}_key").format(fmt).save(path)
