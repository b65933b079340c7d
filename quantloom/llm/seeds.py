"""Shared anchors and windows of long equal runs, for units of words or bytes. Used by the two substring operators.

`row` is a unique key of a row of the input: places are gathered and joined back by it. `doc_id` may be shared and only orders places.

A window is `length` consecutive units of one document. Winnowing picks anchors of `seed` units so that equal windows hold an anchor at the same offset.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import arrays, store

#: units(data, offsets) -> (one 64-bit symbol per unit, index of each document's first unit)
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: what is kept of an anchor that repeats
MARK = {"row": np.int64, "doc_id": np.int64, "pos": np.int32, "around": np.int64}
#: places in one packed array of known anchors, at most; MB of stored texts in a part
PIECE, PART_MB = 1 << 16, 8
#: windows are named and grouped in so many turns: the table of a turn and its shuffle are what takes most disk
TURNS = 2


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return arrays.byte_symbols(data), offsets


def _twice(names: np.ndarray) -> np.ndarray:
    """Whether a value stands more than once."""
    order = np.argsort(names)
    ranked = names[order]
    same = np.zeros(len(names) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.empty(len(names), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of an array that end at `ends`, as binary values."""
    at = np.concatenate([[0], ends]).astype(np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _flat(packed: pa.Array, kind) -> np.ndarray:
    """The arrays of a binary column, one after the other."""
    at = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset:packed.offset + len(packed) + 1] if len(packed) else [0, 0]
    return np.frombuffer(packed.buffers()[2], dtype=np.uint8)[at[0]:at[-1]].view(kind) if at[-1] > at[0] else np.empty(0, dtype=kind)


def anchors(docs: DataFrame, units: Units, seed: int, length: int, parts: int) -> DataFrame:
    """Anchors of chunks of documents, dealt into parts by name: part, known, told, anchor, and `MARK`, all packed arrays.

    `around` names all units that some window over the anchor can hold, cut at the document's ends. An anchor that its chunk holds more than once is known to
    repeat: its places go to any part, and only its name is told to the part of its own. So a part gets a name at most once from a chunk, however common it is.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc_id = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, _, data, offsets in arrays.chunks(batch.column(2)):
                symbols, first = units(data, offsets)
                pre = arrays.prefix(symbols)
                many = np.maximum(np.diff(first) - seed + 1, 0)
                inside = arrays.ragged(first[:-1], many)
                grams = arrays.grams(pre, seed)
                chosen = inside[arrays.winnowed(grams[inside], np.concatenate([[0], np.cumsum(many)]), length - seed + 1)]
                if not len(chosen):
                    continue
                name = grams[chosen]
                twice = _twice(name)
                told, home = np.unique(name[twice]), (name % np.uint64(parts)).astype(np.int32)
                for known in (False, True):
                    at = np.flatnonzero(twice == known)
                    if known:
                        ends = np.unique(np.append(np.arange(PIECE, len(at), PIECE), len(at)))
                        part = ((int(row[lo]) % 1000003 + np.arange(len(ends))) % parts).astype(np.int32)
                        tells = _packed(told[:0], np.zeros(len(ends)))
                    else:
                        at, told = at[np.argsort(home[at], kind="stable")], told[np.argsort(told % np.uint64(parts), kind="stable")]
                        part = np.union1d(home[at], told % np.uint64(parts)).astype(np.int32)
                        ends = np.searchsorted(home[at], part, side="right")
                        tells = _packed(told, np.searchsorted((told % np.uint64(parts)).astype(np.int32), part, side="right"))
                    if not len(part) or known and not len(at):
                        continue
                    place = chosen[at]
                    doc = np.searchsorted(first, place, side="right") - 1
                    low, high = np.maximum(place - (length - seed), first[doc]), np.minimum(place + length, first[doc + 1])
                    around = arrays.mix(arrays.spans(pre, low, high) + (place - low).astype(np.uint64))
                    columns = [name[at[:0] if known else at], row[doc + lo], doc_id[doc + lo], (place - first[doc]).astype(np.int32), around]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part), pa.array(np.full(len(part), known)), tells, *[_packed(x, ends * (len(x) > 0)) for x in columns]],
                        ["part", "known", "told", "anchor", *MARK],
                    )

    return docs.select("row", "doc_id", "text").mapInArrow(work, "part int, known boolean, told binary, anchor binary, " + ", ".join(f"{c} binary" for c in MARK))


def repeated_anchors(dealt: DataFrame) -> DataFrame:
    """(row, doc_id, pos, around) of the anchors that stand more than once. Input: `anchors`, a part's rows together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marks(columns):
            step = 1 << 20
            for lo in range(0, len(columns[0]), step):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo:lo + step]) for x in columns], list(MARK))

        held, told = [], []
        for batch in batches:
            known = batch.column(1)
            yield from marks([_flat(x, kind) for x, kind in zip(batch.filter(known).columns[4:], MARK.values(), strict=True)])
            rest = batch.filter(pa.compute.invert(known))
            told.append(_flat(rest.column(2), np.int64).copy())
            held.append([_flat(x, kind).copy() for x, kind in zip(rest.columns[3:], (np.int64, *MARK.values()), strict=True)])
        if held:
            name, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            again = _twice(np.concatenate([name, *told]))[:len(name)]
            yield from marks([x[again] for x in columns])

    return dealt.mapInArrow(work, "row long, doc_id long, pos int, around long")


def _places(lists: pa.Array, lo: int, hi: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row in the chunk, unit in the chunk) of every place in the lists of rows lo to hi."""
    part = lists.slice(lo, hi - lo)
    doc = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy(zero_copy_only=False))
    return doc, part.flatten().to_numpy(zero_copy_only=False) + first[doc]


def halves(seeded: DataFrame, units: Units, seed: int, length: int) -> DataFrame:
    """(half, row, doc_id, pos, ahead) for every seed: each window over a seed holds the units up to `cut` before it, or (`ahead`) those that follow it. Input: row, doc_id, text, seeds."""
    cut = (length - seed + 1) // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in arrays.chunks(batch.column(2)):
                symbols, first = units(data, offsets)
                pre = arrays.prefix(symbols)
                doc, at = _places(batch.column(3), lo, hi, first)
                for ahead, ok, low, high in ((False, at - cut >= first[doc], at - cut, at + seed), (True, at + length - cut < first[doc + 1], at, at + length - cut + 1)):
                    name, own = arrays.spans(pre, low[ok], high[ok]), doc[ok]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name.view(np.int64)), batch.column(0).take(pa.array(own + lo)), batch.column(1).take(pa.array(own + lo)), pa.array((at[ok] - first[own]).astype(np.int32)), pa.array(np.full(len(own), ahead))],
                        ["half", "row", "doc_id", "pos", "ahead"],
                    )

    return seeded.select("row", "doc_id", "text", "seeds").mapInArrow(work, "half long, row long, doc_id long, pos int, ahead boolean")


def windows(seeded: DataFrame, units: Units, seed: int, length: int, turn: int) -> DataFrame:
    """Every window over a seed on its repeated side whose name falls to this of `TURNS` turns, as (window, row, doc_id, pos). Input: row, doc_id, text, before, ahead (places of seeds).
    The window's name pairs those of its halves."""
    half, cut = length // 2, (length - seed + 1) // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in arrays.chunks(batch.column(2)):
                symbols, first = units(data, offsets)
                names = arrays.grams(arrays.prefix(symbols), half)
                starts = []
                for column, back, upto in ((3, length - seed, cut), (4, cut - 1, 0)):
                    doc, at = _places(batch.column(column), lo, hi, first)
                    low, high = np.maximum(at - back, first[doc]), np.minimum(at - upto, first[doc + 1] - length)
                    starts.append(arrays.ragged(low, np.maximum(high - low + 1, 0)))
                place = np.unique(np.concatenate(starts))
                doc = np.searchsorted(first, place, side="right") - 1
                pair = arrays.mix(names[place] * np.uint64(0x9E3779B97F4A7C15) + names[place + length - half])
                due = pair % np.uint64(TURNS) == turn
                pair, place, doc = pair[due], place[due], doc[due]
                yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), batch.column(0).take(pa.array(doc + lo)), batch.column(1).take(pa.array(doc + lo)), pa.array((place - first[doc]).astype(np.int32))], ["window", "row", "doc_id", "pos"])

    return seeded.select("row", "doc_id", "text", "before", "ahead").mapInArrow(work, "window long, row long, doc_id long, pos int")


def covered(n: int, length: int, seed: int, found, settled, whole: bool) -> np.ndarray:
    """Which of a document's n units fall: those in windows that start at `found`, and all around the anchors `settled`; all of them if `whole`."""
    mark = np.zeros(n + 1, dtype=np.int32)
    if whole and n >= length:
        mark[0] = 1
    if found is not None:
        np.add.at(mark, found, 1)
        np.add.at(mark, found + length, -1)
    if settled is not None:
        np.add.at(mark, np.maximum(settled - (length - seed), 0), 1)
        np.add.at(mark, np.minimum(settled + length, n), -1)
    return np.cumsum(mark[:n]) > 0


def runs(gone: np.ndarray) -> np.ndarray:
    """[start, end) of the maximal runs that are set."""
    return np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)


def items(array: pa.Array) -> list:
    """The lists of a list array as NumPy arrays; None where null."""
    return [x.values.to_numpy(zero_copy_only=False).astype(np.int64) if x.is_valid else None for x in array]


def first_texts(docs: DataFrame, row_col: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, text, copy, and the columns `keep`), stored: whether an equal text stands under a smaller id. Texts are compared by a 128-bit digest; a hot text is combined before the shuffle.

    `row` is `row_col`, or else a number that is given when the table is written."""
    named = docs.withColumn("name", F.md5("text"))
    first = named.groupBy("name").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("name", "least")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return store.stored(named.join(first, "name", "left").select(row.alias("row"), "doc_id", "text", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copy"), *keep), "marked")


def repeated(fresh: DataFrame, units: Units, seed: int, length: int, place: tuple[str, ...]) -> DataFrame:
    """(row, found, settled): starts of windows, and anchors, whose content stands earlier; `place` orders occurrences.

    1. Anchors are grouped by name; an anchor that stands once ends there. 2. The rest are grouped by all that surrounds them: where that stands earlier, the
    anchor is settled, and no window near it is looked at. 3. The others are carried on by half a window to either side, and grouped by what they then hold.
    4. The windows on a side that two of them share are grouped by name, in `TURNS` turns. The first occurrence of a window never has a settled anchor (all around it would stand
    earlier still), so steps 3 and 4 see every first occurrence, and a later one that is not settled shares a half with it.
    """
    at = F.struct(*place) if len(place) > 1 else F.col(*place)  # a minimum of structs takes a sort
    parts = max(int(fresh.sparkSession.conf.get("spark.sql.shuffle.partitions")), store.stored_bytes(fresh) // (PART_MB << 20))
    # tens of millions of anchors a GB: they travel as packed arrays, a row for each part and chunk
    kept = store.stored(repeated_anchors(anchors(fresh, units, seed, length, parts).repartitionById(parts, F.col("part"))), "shared")
    # tables that are joined back are written first: a join between plain shuffles lets Spark split a hot key, one on top of an aggregate does not
    first = store.stored(kept.groupBy("around").agg(F.count(F.lit(1)).alias("many"), F.min(at).alias("first")).filter("many > 1").select("around", "first"), "first-around")
    ranked = kept.join(first, "around", "left").select("row", "pos", F.coalesce(at > F.col("first"), F.lit(False)).alias("later"))
    split = store.stored(ranked.groupBy("row").agg(F.collect_set(F.when(~F.col("later"), F.col("pos"))).alias("seeds"), F.collect_set(F.when(F.col("later"), F.col("pos"))).alias("settled")), "seeds")
    store.drop(kept, first)
    made = store.stored(halves(fresh.join(split.filter(F.size("seeds") > 0).select("row", "seeds"), "row"), units, seed, length), "halves")
    twice = store.stored(made.groupBy("half").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first < last").select("half"), "twice")
    sides = made.join(twice, "half", "left_semi").groupBy("row").agg(F.collect_set(F.when(~F.col("ahead"), F.col("pos"))).alias("before"), F.collect_set(F.when(F.col("ahead"), F.col("pos"))).alias("ahead"))
    sides = store.stored(sides, "sides")
    store.drop(made, twice)
    found = []
    for turn in range(TURNS):
        made = store.stored(windows(fresh.join(sides, "row"), units, seed, length, turn), "windows")
        first = store.stored(made.groupBy("window").agg(F.count(F.lit(1)).alias("many"), F.min(at).alias("first")).filter("many > 1").select("window", "first"), "first-windows")
        found.append(store.stored(made.join(first, "window").filter(at > F.col("first")).groupBy("row").agg(F.collect_set("pos").alias("found")), "found"))
        store.drop(made, first)
    store.drop(sides)
    found = reduce(DataFrame.unionAll, found).groupBy("row").agg(F.flatten(F.collect_list("found")).alias("found"))
    return split.select("row", "settled").join(found, "row", "left").select("row", "found", "settled")
