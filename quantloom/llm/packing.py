"""Packing of tokenised documents into sequences, best fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import store
from quantloom.llm.bpe import Encoder, groups

TOKENIZER = "word_bpe_49k.json"
SHARD = 20_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, longest first (ties in the given order), each into the open sequence with the least room that takes it.

    `tree` is a segment tree over room 0..window: a node tells how many open sequences have a room in its range.
    """
    size = 1 << int(window).bit_length()
    tree = [0] * (2 * size)
    open_by_room: list[list[int]] = [[] for _ in range(window + 1)]

    def count(room: int, by: int) -> None:
        node = room + size
        while node:
            tree[node] += by
            node >>= 1

    def tightest(need: int) -> int:
        node = need + size
        if tree[node]:
            return need
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < size:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - size
            node >>= 1
        return -1

    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tightest(need)
        if room < 0:
            room, which = window, opened
            opened += 1
        else:
            which = open_by_room[room].pop()
            count(room, -1)
        sequence[i], offset[i] = which, window - room
        if room > need:
            open_by_room[room - need].append(which)
            count(room - need, 1)
    return sequence, offset


def tokenized(docs: DataFrame, window: int, tokenizer: str, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces: every document's ids (the tokenizers library's, see `bpe`) and the end id, cut into full windows from its start, and the rest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = Encoder(public_tokenizers.path(tokenizer))
        for batch in batches:
            keys = batch.column(0)
            for lo, texts in groups(batch.column(1)):
                flat, bounds = encoder.encode(texts)
                rows = []
                for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    ids = np.append(flat[a:b], end_id).astype("<u4")
                    for start in range(0, len(ids), window):
                        part = ids[start:start + window]
                        rows.append((keys[lo + i].as_py(), start, len(part), zlib.crc32(part.tobytes()), len(ids), part.astype(np.int32) if with_ids else None))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.mapInArrow(work, PIECE)


def pack(docs: DataFrame, window: int = 4096, tokenizer: str = TOKENIZER, end_id: int = 2, with_ids: bool = True, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids (null without `with_ids`), sequence_id, offset.

    Documents longer than a window are first cut into full windows. Pieces are dealt by a hash of (id, start, content) into shards of about `shard` pieces,
    and each shard is packed by best fit decreasing, so its task holds a bounded number of lengths (ids stay out of it and join later); a shard leaves few
    sequences open, which is little padding against its thousands of pieces. Sequence ids number (shard, sequence); offsets have no gaps. Ties are packed in
    order of id, start and checksum, so reruns agree.

    `tokenizer` is a file that `bpe.Encoder` takes; it gives the ids of the tokenizers library.

    Null or empty text: the end id alone. Null id: packed like others. Repeated rows are packed each. An empty table gives an empty table. Extra columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # row: tells equal pieces of repeated rows apart; written once, so it holds for both readers
    pieces = store.stored(tokenized(docs, window, tokenizer, end_id, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = pieces.count() // shard + 1
    light = pieces.select("row", "doc_id", "start", "length", "ids_crc32", "doc_tokens").withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row"), F.lit(shards)))

    def place(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc_id", "start", "ids_crc32", "row"]).reset_index(drop=True)
        which, offset = best_fit_decreasing(f["length"].to_numpy(dtype=np.int64), window)
        f["sequence_id"], f["offset"] = (f["shard"].to_numpy(dtype=np.int64) << 32) + which, offset
        return f[["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    placed = light.groupBy("shard").applyInPandas(place, "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    if not with_ids:
        return placed.drop("row")
    return placed.join(pieces.select("row", "ids"), "row").drop("row")


def op2_pack(spark, sf_dir: str) -> DataFrame:
    return pack(store.read(spark, sf_dir, "documents"), with_ids=False)
