"""N-gram Jaccard join: documents whose shingle sets overlap enough, by T-occurrence search over inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import arrays, store
from quantloom.llm.components import components

SKETCH_BITS, SLICE = 20, 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each document, ascending, and the index of each document's first one.

    A document with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    words, first = arrays.word_hashes(_LOWER[data] if lower else data, offsets)
    count = np.diff(first)
    pre = arrays.prefix(words)
    n = len(words)
    doc = np.repeat(np.arange(len(count)), count)
    place = np.flatnonzero(np.arange(n) + k <= first[1:][doc]) if n else np.empty(0, dtype=np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    values = np.concatenate([arrays.grams(pre, k)[place] if len(place) else np.empty(0, dtype=np.uint64), arrays.spans(pre, first[short], first[short + 1])])
    owner = np.concatenate([doc[place], short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(len(count) + 1))


def node_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit name of each set: equal sets have equal names."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(arrays.mix(values ^ np.uint64(0x5851F42D4C957F2D)))])
    return arrays.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def _list_array(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))


def _slots(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """How often shingles occur over all documents by the top bits of their hash, as a 16-bit logarithm: a table of fixed size, whatever the input. Tasks send slices of it, which are summed as they come."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in arrays.chunks(batch.column(0)):
                values, _ = shingle_sets(data, offsets, k)
                total += np.bincount(_slots(values), minlength=len(total))
        used = np.flatnonzero(total)
        slices, starts = np.unique(used // SLICE, return_index=True)
        ends = pa.array(np.append(starts, len(used)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(slices), pa.ListArray.from_arrays(ends, pa.array(used)), pa.ListArray.from_arrays(ends, pa.array(total[used]))], ["slice", "slot", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(1 << SKETCH_BITS, dtype=np.int64), np.zeros((1 << SKETCH_BITS) // SLICE, dtype=bool)
        for batch in batches:
            seen[batch.column(0).to_numpy()] = True
            np.add.at(total, batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy())
        rare = np.minimum(np.log1p(total) * 2000, 65535).astype(np.uint16).reshape(-1, SLICE)
        slices = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(slices), pa.array([rare[i].tobytes() for i in slices], pa.binary())], ["slice", "rare"])

    parts = docs.select("text").mapInArrow(count, "slice long, slot array<long>, n array<long>").repartition("slice")
    summed = store.stored(parts.mapInArrow(add, "slice long, rare binary"), "rarity")
    out = np.zeros(((1 << SKETCH_BITS) // SLICE, SLICE), dtype=np.uint16)
    for i, rare in summed.toPandas().itertuples(index=False):
        out[i] = np.frombuffer(rare, dtype=np.uint16)
    store.drop(summed)
    return out.ravel()


def _summaries(docs: DataFrame, k: int, percent: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n, node, short): `short` are the shingles whose lists are merged, the rarest n - T + 1, rarest first, with T the least overlap of any link."""
    often = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, k))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in arrays.chunks(batch.column(1)):
                values, first = shingle_sets(data, offsets, k)
                n = np.diff(first)
                rare = often.value[_slots(values)]
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((values, rare, owner))
                take = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                chosen = values[order][arrays.ragged(first[:-1], take)]
                ends = np.concatenate([[0], np.cumsum(take)])
                kept = [batch.column(2 + i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(node_of(values, first), mask=n == 0), _list_array(chosen, ends), *kept], ["doc_id", "n", "node", "short", *keep]
                )

    return docs.select("doc_id", "text", *keep).mapInArrow(work, ", ".join(["doc_id long, n long, node long, short array<long>", *[f"{c} {dict(docs.dtypes)[c]}" for c in keep]]))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in arrays.chunks(batch.column(0)):
                values, first = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([pa.array(node_of(values, first)), _list_array(values.view(np.int64), first)], ["node", "shingles"])

    return docs.select("text").mapInArrow(work, "node long, shingles array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the overlap: the lists that were not merged are probed by binary search in the partner's sorted set."""

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            good = []
            for x, y in zip(f["x"], f["y"], strict=True):
                x, y = (x.view(np.uint64), y.view(np.uint64)) if len(x) < len(y) else (y.view(np.uint64), x.view(np.uint64))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield f.loc[np.array(good, dtype=bool), ["a", "b"]]

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(probe, "a long, b long")


def _probed(pairs: DataFrame, docs: DataFrame, summary: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, stored. Whole sets are made again from the texts, for the nodes of these pairs only, and go when their links stand."""
    pairs = store.stored(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = summary.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    asked = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    sets = store.stored(_sets(asked, k).dropDuplicates(["node"]), "shingles")
    links = store.stored(_linked(pairs, sets, percent), "links")
    store.drop(pairs, sets)
    return links


def link_documents(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id. Two documents link when 100 * intersection >= percent * union of their k-word shingle sets.

    T-occurrence search in the DivideSkip manner. A set of n shingles needs T = ceil(percent * n / 100) of them in a partner, so T - 1 of its lists may be
    left for probing; the n - T + 1 rarest are the short lists. Short lists are merged by Spark's sort (the shuffle on the shingle takes the heap's place),
    the long ones are probed by binary search. Rarity comes from a count sketch of fixed size over all documents; any order gives the same links.

    Equal sets are one node. Sets of a and b shingles link with an overlap of o = ceil(percent * (a + b) / (100 + percent)) at least, so their rarest common shingle
    has o - 1 others behind it in both. With the place of a shingle in a set this gives the largest partner (`cap`) that the set may meet first in this list;
    a node leaves lists in which no member is that small, and pairs above either cap are not made: near copies that do not link mostly meet too late.

    A first round tries each node against one node of each of its lists, the one with the fewest rarer shingles of its own, which of a family is the nearest to
    all; the second takes the pairs of a list that the first did not connect. Both count the short lists that a pair shares and probe only those that share enough, so whole sets are made for the nodes of these
    pairs alone. A list of many near copies costs one try a member, and no link between different components is lost.

    Null or empty text, or text without words: 0 shingles, its own component. Null id: component of the others, null when alone. Repeated rows are equal
    sets. A repeated id with different texts: a node per text. An empty table gives an empty table. Extra columns are ignored.
    """
    return linked(docs, k, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def linked(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`link_documents` with the columns `keep` and node_group: the component itself, which ids can't tell where they are null or repeated; null without words."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    summary = store.stored(_summaries(docs, k, percent, keep), "sets")
    nodes = summary.filter("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("short").alias("short"), F.min("doc_id").alias("least_id"))
    nodes = store.stored(nodes, "nodes")
    cap = F.expr(f"({100 + percent} * (n - pos) - {percent} * n) div {percent}")
    posted = nodes.select(F.posexplode("short").alias("pos", "shingle"), "node", "n").select("shingle", "pos", "node", "n", cap.alias("cap"))
    lead = F.min(F.struct("pos", "node", "n", "cap")).alias("lead")
    leaders = posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("many"), F.min("n").alias("least_n"), lead).filter("many > 1")
    lists = posted.join(leaders.select("shingle", "least_n", "lead"), "shingle").filter("cap >= least_n").drop("pos", "least_n")
    lists = store.stored(lists, "lists")
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    # a partner of the needed overlap stands in at least overlap + 1 - T of the merged lists, T being that of the larger set
    least = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent} + 1 - ({percent} * greatest(na, nb) + 99) div 100")

    def enough(pairs: DataFrame) -> DataFrame:
        a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("short").alias("x"))
        b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("short").alias("y"))
        return pairs.join(a, "a").join(b, "b").filter(F.size(F.array_intersect("x", "y")) >= least).select("a", "b")

    may_meet = (F.col("n") <= F.col("lead.cap")) & (F.col("lead.n") <= F.col("cap"))
    led = lists.filter(fits(F.col("n"), F.col("lead.n")) & may_meet & (F.col("node") != F.col("lead.node")))
    first = _probed(enough(led.select(F.col("node").alias("a"), F.col("lead.node").alias("b")).distinct()), docs, summary, k, percent)

    roots = components(first)
    placed = lists.join(roots, "node", "left").select("shingle", "node", "n", "cap", F.coalesce("root", "node").alias("root"))
    open_lists = placed.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("shingle")
    placed = store.stored(placed.join(open_lists, "shingle"), "open")
    store.drop(lists, roots)
    heads = placed.groupBy("shingle", "root").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("cap").alias("most"))
    x, y = heads.alias("x"), heads.alias("y")
    near = (F.col("x.root") < F.col("y.root")) & (100 * F.col("x.hi") >= percent * F.col("y.lo")) & (100 * F.col("y.hi") >= percent * F.col("x.lo"))
    near = near & (F.col("x.most") >= F.col("y.lo")) & (F.col("y.most") >= F.col("x.lo"))
    facing = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & near)
    facing = facing.select(F.col("x.shingle").alias("shingle"), F.col("x.root").alias("r"), F.col("y.root").alias("s"), F.col("y.lo").alias("lo"), F.col("y.hi").alias("hi"), F.col("y.most").alias("most")).alias("f")
    a, b = placed.alias("a"), placed.alias("b")
    of_x = (F.col("f.shingle") == F.col("a.shingle")) & (F.col("r") == F.col("a.root")) & (F.col("a.cap") >= F.col("lo")) & (F.col("most") >= F.col("a.n"))
    of_x = of_x & (100 * F.col("a.n") >= percent * F.col("lo")) & (100 * F.col("hi") >= percent * F.col("a.n"))
    of_y = (F.col("f.shingle") == F.col("b.shingle")) & (F.col("s") == F.col("b.root")) & (F.col("a.cap") >= F.col("b.n")) & (F.col("b.cap") >= F.col("a.n")) & fits(F.col("a.n"), F.col("b.n"))
    rest = facing.join(a, of_x).join(b, of_y).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    second = _probed(enough(rest), docs, summary, k, percent)
    store.drop(placed)

    roots = components(first.union(second))
    named = nodes.select("node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = store.stored(named.join(smallest, "root").select("node", "component_id", F.col("root").alias("node_group")), "named")
    store.drop(first, second, roots, nodes)
    return summary.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "node_group", *keep)


def op1_jaccard(spark, sf_dir: str) -> DataFrame:
    return link_documents(store.read(spark, sf_dir, "documents"))
