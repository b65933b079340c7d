"""Substring dedup over bytes, by seed and extend: byte strings past a threshold that stand in an earlier document are cut out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import arrays, seeds, store

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(placed: DataFrame, seed: int, length: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, settled, copy = seeds.items(batch.column(3)), seeds.items(batch.column(4)), batch.column(5).to_pylist()
            for lo, hi, data, offsets in arrays.chunks(batch.column(2)):
                rows = []
                for i in range(hi - lo):
                    own = data[offsets[i]:offsets[i + 1]]
                    gone = seeds.covered(len(own), length, seed, found[lo + i], settled[lo + i], copy[lo + i])
                    rows.append((len(own), int(np.count_nonzero(gone)), [{"start": s, "end": e} for s, e in seeds.runs(gone).tolist()], own[~gone].tobytes()))
                n, removed, spans, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary())],
                                                 ["row", "doc_id", "n_bytes", "n_removed", "removed", "kept"])

    return placed.select("row", "doc_id", "text", "found", "settled", "copy").mapInArrow(work, "row long, doc_id long, n_bytes long, n_removed long, removed array<struct<start: long, end: long>>, kept binary")


def cut_suffixes(docs: DataFrame, length: int = 50, start: int = 16, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, removed (maximal runs, [start, end) in bytes), kept (remaining bytes).

    A byte goes when a string of `length` bytes that covers it also starts in a document with a smaller id; matches never cross documents.
    Seed and extend, as in `cut_repeats`, over bytes: no suffix array, no ranks and no doubling. Winnowing picks the `start`-byte anchors, so that each string of
    `length` bytes holds one; anchors that stand twice are grouped by hashes of everything around them, which settles those that repeat as a whole; the others
    by hashes of about two thirds of the threshold to either side; and every position that is still open by its `length` bytes.

    A text equal to one with a smaller id repeats as a whole and is not searched. Null text counts as empty. Null id: compared as -1. Rows that share an id are
    one document: they don't repeat each other. `row_col`: a unique key of the rows, handed on as a first column. An empty table gives an empty table. Extra columns are ignored.
    """
    keys = [row_col] if row_col else []
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keys)
    marked = seeds.first_texts(docs, row_col)
    found = seeds.repeated(marked.filter("not copy"), seeds.byte_units, start, length, ("doc_id",))
    out = _cut(marked.join(found, "row", "left"), start, length)
    return out.withColumnRenamed("row", row_col) if row_col else out.drop("row")


def op7_suffixes(spark, sf_dir: str) -> DataFrame:
    out = cut_suffixes(store.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
