"""Substring dedup by seed and extend: runs of words that stand earlier in the corpus are cut out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm import arrays, seeds, store

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(placed: DataFrame, seed: int, length: int, keep: tuple[str, ...]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, settled, copy = seeds.items(batch.column(3)), seeds.items(batch.column(4)), batch.column(5).to_pylist()
            for lo, hi, data, offsets in arrays.chunks(batch.column(2)):
                starts, ends, first = arrays.word_bounds(data, offsets)
                rows = []
                for i in range(hi - lo):
                    n = int(first[i + 1] - first[i])
                    gone = seeds.covered(n, length, seed, found[lo + i], settled[lo + i], copy[lo + i])
                    left = (~gone).nonzero()[0] + first[i]
                    kept = b" ".join(data[s:e].tobytes() for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True))
                    rows.append((n, int(gone.sum()), [{"start": s, "end": e} for s, e in seeds.runs(gone).tolist()], kept.decode()))
                n, removed, spans, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.string()), *[batch.column(6 + i).slice(lo, hi - lo) for i in range(len(keep))]],
                                                 ["row", "doc_id", "n_words", "n_removed", "removed", "kept", *keep])

    span = T.StructType().add("start", "long").add("end", "long")
    out = T.StructType().add("row", "long").add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("removed", T.ArrayType(span)).add("kept", "string")
    out = T.StructType([*out.fields, *[placed.schema[c] for c in keep]])
    return placed.select("row", "doc_id", "text", "found", "settled", "copy", *keep).mapInArrow(work, out)


def cut_repeats(docs: DataFrame, length: int = 20, seed: int = 10, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, removed (maximal repeated runs of words, as [start, end)), kept (remaining words, one space between).

    A word goes when a window of `length` consecutive words that covers it also starts earlier: in a smaller doc_id, or sooner in the same document.
    Seed: winnowing picks, in every window of `length` words, the `seed`-word anchor of least hash, so equal windows share an anchor at the same offset; a join
    on the anchors tells which stand twice. Extend: around each shared anchor the match is carried to both sides, first by all that windows over it can hold, and
    where that is new, window by window; all but the first occurrence fall. Overlapping ones join to maximal runs. No pairs are formed, so a passage that a
    third of the documents hold costs its own length in each.

    A text equal to one with a smaller id repeats as a whole and is not searched. Null or empty text: no words, kept is ''. Null id: compared as -1. Rows that
    share an id are ordered by position alone: of a window they share, the later positions fall, equal ones stay. So rows that share id and text repeat each
    other's cut. `row_col`: a unique key of the rows, handed on as a first column. `keep`: columns that are handed on as the last ones; "text" is
    the text itself, a null one empty. An empty table gives an empty table. Other columns are ignored.
    """
    keys = [*([row_col] if row_col else []), *[c for c in keep if c != "text"]]
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keys)
    marked = seeds.first_texts(docs, row_col, tuple(c for c in keep if c != "text"))
    found = seeds.repeated(marked.filter("not copy"), arrays.word_hashes, seed, length, ("doc_id", "pos"))
    out = _cut(marked.join(found, "row", "left"), seed, length, keep)
    return out.withColumnRenamed("row", row_col) if row_col else out.drop("row")


def op3_repeats(spark, sf_dir: str) -> DataFrame:
    return cut_repeats(store.read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
