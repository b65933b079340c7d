"""A table that a stream keeps up to date: parts in immutable folders, and numbered manifests that say which folders are the table.

    manifest/00000000000000000007.json   {"parts": {"2024-01": "parts/2024-01-<uuid>"}, "through": 41}
    parts/2024-01-<uuid>/                the newest row per key of that part
    open/batch=42/                       batches that no manifest has taken in yet

A manifest is renamed into place once everything it names stands, so a reader or a restart sees the old table or the new one.
Folders that no manifest names (a crash in between) are never read. Compaction rewrites only the parts that open batches touch.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.prices import dedupe_last


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def manifest(spark: SparkSession, path: str) -> dict:
    """The newest manifest; an empty table has number 0."""
    done = [n for n in _names(spark, f"{path}/manifest") if n.endswith(".json") and not n.startswith((".", "_"))]
    if not done:
        return {"number": 0, "parts": {}, "through": -1}
    p, fs = _fs(spark, f"{path}/manifest/{done[-1]}")
    stream = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {"number": int(done[-1].split(".")[0]), **json.loads(text)}


def _publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Writes a manifest beside its place and renames it there. A number that exists already is another writer's: that is an error."""
    target, fs = _fs(spark, f"{path}/manifest/{number:020d}.json")
    draft, _ = _fs(spark, f"{path}/manifest/_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        raise RuntimeError(f"manifest {number} of {path} was written by another job")


def open_batches(spark: SparkSession, path: str, through: int) -> list[int]:
    ids = [int(n.split("=")[1]) for n in _names(spark, f"{path}/open") if n.startswith("batch=")]
    return sorted(i for i in ids if i > through)


def append(df: DataFrame, path: str, batch_id: int, keys, seq: str) -> None:
    """Stores the newest row per key of one batch; a replay of the batch replaces it, and one that a manifest holds already is left out."""
    if batch_id > manifest(df.sparkSession, path)["through"]:
        dedupe_last(df, list(keys), seq).write.mode("overwrite").parquet(f"{path}/open/batch={batch_id}")


def _read_open(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/open/batch={i}" for i in ids])


def read(spark: SparkSession, path: str, keys, seq: str) -> DataFrame:
    """The table now: the folders of one manifest, and the few batches after it."""
    now = manifest(spark, path)
    waiting = open_batches(spark, path, now["through"])
    frames = [spark.read.parquet(*[f"{path}/{p}" for p in now["parts"].values()])] if now["parts"] else []
    frames += [_read_open(spark, path, waiting)] if waiting else []
    if not frames:
        raise ValueError(f"no table at {path}")
    both = reduce(DataFrame.unionByName, frames)
    return dedupe_last(both, list(keys), seq) if waiting else both


def compact(spark: SparkSession, path: str, keys, seq: str, part: Column) -> int:
    """Takes all open batches into the parts they touch and publishes the next manifest; returns its number.

    `part` must follow from the keys (a month, a bucket of a hash): rows of one key are in one part. A part is one Spark write partitioned by the rest,
    so old rows of untouched parts are neither read nor written.
    """
    now = manifest(spark, path)
    waiting = open_batches(spark, path, now["through"])
    if not waiting:
        return now["number"]
    fresh = _read_open(spark, path, waiting).withColumn("_part", part.cast("string"))
    touched = sorted(r["_part"] for r in fresh.select("_part").distinct().collect())  # parts, not rows
    old = [f"{path}/{now['parts'][p]}" for p in touched if p in now["parts"]]
    rows = fresh if not old else spark.read.parquet(*old).withColumn("_part", part.cast("string")).unionByName(fresh)
    folder = f"parts/{uuid.uuid4().hex}"
    dedupe_last(rows, [*keys, "_part"], seq).write.partitionBy("_part").parquet(f"{path}/{folder}")
    made = {n.split("=", 1)[1]: f"{folder}/{n}" for n in _names(spark, f"{path}/{folder}") if n.startswith("_part=")}
    _publish(spark, path, now["number"] + 1, {"parts": now["parts"] | made, "through": waiting[-1]})
    return now["number"] + 1


def vacuum(spark: SparkSession, path: str) -> None:
    """Removes what the newest manifest no longer names. Only for times without readers of older manifests."""
    now = manifest(spark, path)
    used = {p.split("/")[1] + "/" + p.split("/")[2] for p in now["parts"].values()}
    for folder in _names(spark, f"{path}/parts"):
        for part in _names(spark, f"{path}/parts/{folder}"):
            if part.startswith("_part=") and f"{folder}/{part}" not in used:
                p, fs = _fs(spark, f"{path}/parts/{folder}/{part}")
                fs.delete(p, True)
    for i in _names(spark, f"{path}/open"):
        if i.startswith("batch=") and int(i.split("=")[1]) <= now["through"]:
            p, fs = _fs(spark, f"{path}/open/{i}")
            fs.delete(p, True)
