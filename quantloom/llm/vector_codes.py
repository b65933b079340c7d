"""Short codes for vectors: a small codebook for each part of a vector, fitted over value dictionaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import store

BLOCK = 1 << 20  # components of a block
BLOCK_ROWS = 1 << 14
SALTS = 1024

BLOCKS = "ids array<long>, labels array<int>, dictionary array<array<long>>, places array<binary>"


def integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vector of integers floor(scale * x)) of the rows with a whole, finite vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where((F.size("x") > 0) & good).select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("v"))


def checked(rows: DataFrame, width: int) -> DataFrame:
    """Stops the job at a vector of another length, or with a component so large that a sum of squares would not fit a long."""
    most = isqrt((2**63 - 1) // (4 * width))
    fault = F.when(F.size("v") != width, F.lit(f"vectors must all have {width} components")).when(
        F.exists("v", lambda c: ~c.between(-most, most)), F.lit(f"components beyond {most} after scaling"))
    return rows.withColumn("v", F.when(fault.isNull(), F.col("v")).otherwise(F.raise_error(fault)))


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """Rows in blocks, column by column: a dictionary of the distinct integers of each dimension, and each row's place in it (16 bits)."""
    size = max(1, min(BLOCK_ROWS, BLOCK // width))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                x = np.asarray(part.column(2).flatten(), dtype=np.int64).reshape(part.num_rows, width)
                pairs = [np.unique(x[:, d], return_inverse=True) for d in range(width)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(1).to_pylist()], pa.list_(pa.int32())),
                    pa.array([[values for values, _ in pairs]], pa.list_(pa.list_(pa.int64()))), pa.array([[at.astype("<u2").tobytes() for _, at in pairs]], pa.list_(pa.binary())),
                ], ["ids", "labels", "dictionary", "places"])

    return rows.mapInArrow(work, BLOCKS)


def nearest(dictionary: list[np.ndarray], places: list[np.ndarray], books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's nearest entry (ties: the first) and its squared distance, (rows, parts). `books`: parts x entries x components.

    A dimension's squared differences are tabulated once for every distinct integer and entry; a row's distances are gathered from the tables and added.
    """
    parts, entries, wide = books.shape
    n = len(places[0])
    entry, error = np.empty((n, parts), dtype=np.int64), np.empty((n, parts), dtype=np.int64)
    for p in range(parts):
        total = np.zeros((n, entries), dtype=np.int64)
        for c in range(wide):
            table = (dictionary[p * wide + c][:, None] - books[p, :, c][None, :]) ** 2
            total += table[places[p * wide + c]]
        entry[:, p] = total.argmin(axis=1)
        error[:, p] = total[np.arange(n), entry[:, p]]
    return entry, error


def _block(batch: pa.RecordBatch, i: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    names = batch.schema.names
    dictionary = batch.column(names.index("dictionary"))[i].values
    values, ends = np.asarray(dictionary.flatten(), dtype=np.int64), np.cumsum(np.asarray(dictionary.value_lengths()))
    return np.split(values, ends[:-1]), [np.frombuffer(b, dtype="<u2") for b in batch.column(names.index("places"))[i].as_py()]


def sums(table: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, component, n, total) over all rows, by nearest entry: added up in each task, then over tasks."""
    parts, entries, wide = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, wide), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                dictionary, places = _block(batch, i)
                entry, _ = nearest(dictionary, places, books)
                for p in range(parts):
                    count[p] += np.bincount(entry[:, p], minlength=entries)
                    for c in range(wide):
                        values = dictionary[p * wide + c]
                        often = np.bincount(entry[:, p] * len(values) + places[p * wide + c], minlength=entries * len(values)).reshape(entries, len(values))
                        total[p, :, c] += often @ values
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "totals"])

    made = table.select("dictionary", "places").mapInArrow(work, "part int, entry int, n long, totals array<long>")
    return made.select("part", "entry", "n", F.posexplode("totals").alias("component", "total")).groupBy("part", "entry", "component").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, label, code, error; codebooks: part, entry, components). `code` holds one byte a part; `error` is the row's squared distance to its entries.

    Components become integers floor(scale * x), so all sums are exact. Rows are stored once, as blocks of per-dimension dictionaries; each of the `rounds`
    reads them, assigns every part to the nearest entry of its codebook and moves each entry to the floor of its parts' mean. Codebooks start with the
    parts of the smallest ids. The driver holds the codebooks alone (entries x components).

    Null vectors, vectors without components or with a null or non-finite one are left out. Null ids come after all others; equal ids are ordered by their
    vectors. Distances that tie go to the lower entry; an entry without parts stays. With fewer rows than entries there are as many entries as rows.
    Repeated rows are coded each. An empty table gives empty tables. Vectors of different lengths, a length that `parts` does not divide, or components
    that would overflow stop the job with a message. Extra columns are ignored, whatever their names.
    """
    if entries > 256:
        raise ValueError("a code has one byte a part: at most 256 entries")
    spark = vectors.sparkSession
    rows = integers(vectors, scale, id_col, vector_col, label_col)
    seeds = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    if not seeds:
        return spark.createDataFrame([], "vec_id long, label int, code binary, error long"), spark.createDataFrame([], "part int, entry int, components array<long>")
    width = len(seeds[0])
    if width % parts:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    table = store.stored(blocks(checked(rows, width), width), "blocks")
    books = np.array([s for s in seeds if len(s) == width], dtype=np.int64).reshape(-1, parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        moved = books.copy()
        for r in sums(table, books).collect():
            moved[r["part"], r["entry"], r["component"]] = int(r["total"]) // r["n"]
        books = moved

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                entry, error = nearest(*_block(batch, i), books)
                n = len(entry)
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), n, [None, pa.py_buffer(entry.astype(np.uint8).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, codes, pa.array(error.sum(axis=1))], ["vec_id", "label", "code", "error"])

    coded = table.mapInArrow(code, "vec_id long, label int, code binary, error long")
    flat = [(p, e, books[p, e].tolist()) for p in range(parts) for e in range(books.shape[1])]
    return coded, spark.createDataFrame(flat, "part int, entry int, components array<long>")


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the sum of error over rows of an equal label (nulls together).

    Sums go by (label, salt) first; the labels' totals meet these few sums, and rows meet their own (label, salt), so a hot label is spread over tasks.
    """
    rows = coded.withColumn("none", F.col("label").isNull()).withColumn("key", F.coalesce("label", F.lit(0))).withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    partial = rows.groupBy("none", "key", "salt").agg(F.sum("error").alias("part"))
    partial = store.stored(partial, "label_errors")
    totals = partial.groupBy("none", "key").agg(F.sum("part").alias("label_error"))
    return rows.join(partial.join(totals, ["none", "key"]).drop("part"), ["none", "key", "salt"]).drop("none", "key", "salt")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(store.read(spark, sf_dir, "embeddings"))
    numbers = [str(c) for r in books.orderBy("part", "entry").collect() for c in r["components"]]  # entries x components, whatever the rows
    digest = hashlib.sha256(",".join(numbers).encode()).hexdigest()
    rows = with_label_error(store.stored(coded, "coded"))
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
