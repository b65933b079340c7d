"""Document fingerprints by a randomised edit embedding, and near pairs by bit-sampled bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import store
from quantloom.llm.components import components

LANES, PERIOD, KINDS = 128, 8192, 65536
GROUP_CHARS = 8_000_000
CELL, LOT = 1024, 20_000
_rng = np.random.default_rng(77)
_MOVES = _rng.integers(0, 2, (PERIOD, 256)).astype(np.int64)
_STEP = _rng.integers(0, 1 << 40, PERIOD, dtype=np.uint64)
_LANE = _rng.permutation(np.arange(PERIOD) % LANES)
_KIND = _rng.integers(0, 1 << 40, KINDS, dtype=np.uint64)
_KIND[0] = 1 << 50  # past the end: never the least of a lane
_LAP = np.uint64(0x9E3779B97F4A7C15)


def _walk(codes: list[np.ndarray]) -> np.ndarray:
    """(texts, LANES) bytes. All texts take the same walk: at step j the character c under the head is written down, then the head stays or moves by a
    random bit that depends on j and c alone. So texts that differ by an edit fall back into step soon after it, and edit distance becomes Hamming distance
    of what is written. A lane samples the steps that are dealt to it: it keeps the (step, character) of least random value; 0 marks an empty lane."""
    n = np.array([len(c) for c in codes], dtype=np.int64)
    order = np.argsort(-n, kind="stable")
    tape = np.zeros(int(n.sum()) + len(n), dtype=np.uint16)
    ends = np.cumsum(n[order] + 1)
    head = ends - n[order] - 1
    for k, at in zip(order.tolist(), head.tolist(), strict=True):
        tape[at:at + n[k]] = codes[k] % (KINDS - 1) + 1
    last = ends - 1
    least = np.full((LANES, len(n)), np.uint64(1 << 50), dtype=np.uint64)
    live = len(n)
    j = 0
    while live:
        if j % 32 == 0:
            going = np.flatnonzero(head[:live] < last[:live])
            live = int(going[-1]) + 1 if len(going) else 0
            if not live:
                break
            at, end = head[:live], last[:live]
        k = j % PERIOD
        c = tape.take(at)
        value = _KIND.take(c)
        value ^= _STEP[k] ^ np.uint64((j // PERIOD * int(_LAP)) & ((1 << 40) - 1))
        row = least[_LANE[k], :live]
        np.minimum(row, value, out=row)
        at += _MOVES[k].take(c & 255)
        np.minimum(at, end, out=at)
        j += 1
    kept = least.T
    out = ((kept * _LAP >> np.uint64(40)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    out[kept >= np.uint64(1 << 50)] = 0
    back = np.empty_like(out)
    back[order] = out
    return back


def embed(texts: list[str]) -> np.ndarray:
    """Fingerprints of whole texts, in groups of bounded size (or one text). Equal texts have equal fingerprints."""
    out, lo = np.zeros((len(texts), LANES), dtype=np.uint8), 0
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    while lo < len(order):
        hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(lengths[order[lo:]]), GROUP_CHARS)))
        rows = order[lo:hi]
        out[rows] = _walk([np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), dtype="<u4") for i in rows.tolist()])
        lo = hi
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of equal steps of two fingerprints, 0 to 1. A lane agrees with the Jaccard share of the steps it sampled from; 1 for two empty texts."""
    used = ((a > 0) | (b > 0)).sum(axis=-1)
    share = ((a == b) & (a > 0)).sum(axis=-1) / np.maximum(used, 1)
    share = np.clip((share - 1 / 255) / (1 - 1 / 255), 0, 1)
    return np.where(used == 0, 1.0, 2 * share / (1 + share))


def edited(text: str, following: str) -> str:
    """The last floor(n/4) code points replaced by the first as many (or all) of the next text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _judged(texts: list[str], changed: list[str], codes: np.ndarray, next_codes: np.ndarray, e: np.ndarray) -> dict:
    return {
        "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode()).digest() for t in changed],
        "fingerprint": [x.tobytes() for x in codes], "edited_fingerprint": [x.tobytes() for x in e],
        "near_edited": likeness(codes, e), "near_next": likeness(codes, next_codes),
    }


RESULT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next.

    Rows are range-partitioned and sorted by id (then text); a task streams through its range and carries one row over between batches. Only the first and last
    row of each range keep their text, and the last ones are completed by a join with the head of the next range.

    Null or empty text: an empty fingerprint (all 00), likeness 1 to another empty one. Null id: first in order. Ties and repeated rows follow each other.
    A table of one row is its own next. An empty table gives an empty table. Extra columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = docs.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, first = TaskContext.get().partitionId(), None, True
        for f in frames:
            for lo in range(0, len(f), 2048):
                ids, texts = f["doc_id"].astype(object).where(f["doc_id"].notna(), None).tolist()[lo:lo + 2048], f["text"].tolist()[lo:lo + 2048]
                new = len(texts)
                if held is not None:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
                codes = embed(texts[-new:] + changed)  # one walk for both
                codes, e = codes[:new], codes[new:]
                if held is not None:
                    codes = np.concatenate([held[2], codes])
                if len(texts) > 1:
                    out = pd.DataFrame({"part": part, "head": False, "tail": False, "doc_id": pd.array(ids[:-1], dtype="Int64"), "text": None, **_judged(texts[:-1], changed, codes[:-1], codes[1:], e)})
                    if first:
                        out.loc[0, "head"], out.loc[0, "text"], first = True, texts[0], False
                    yield out
                held = ids[-1], texts[-1], codes[-1:]
        if held is not None:
            yield pd.DataFrame({"part": [part], "head": [first], "tail": [True], "doc_id": pd.array([held[0]], dtype="Int64"), "text": [held[1]], "n_chars": [len(held[1])], "edited_sha256": [None],
                                "fingerprint": [held[2].tobytes()], "edited_fingerprint": [None], "near_edited": [None], "near_next": [None]})

    made = store.stored(ordered.mapInPandas(work, f"part long, head boolean, tail boolean, doc_id long, text string, {RESULT}"), "fingerprints")
    heads = made.filter("head").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    turn = Window.orderBy("part")  # one row per range, without texts
    turns = made.filter("head").select("part").withColumn("next_part", F.coalesce(F.lead("part").over(turn), F.min("part").over(Window.partitionBy(F.lit(1)))))
    open_rows = made.filter("tail").select("part", "doc_id", "text", "fingerprint").join(turns, "part").join(heads, "next_part")

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            codes, after = (np.array([np.frombuffer(x, dtype=np.uint8) for x in f[c]]).reshape(-1, LANES) for c in ("fingerprint", "next_fingerprint"))
            texts, changed = f["text"].tolist(), [edited(a, b) for a, b in zip(f["text"], f["next_text"], strict=True)]
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), **_judged(texts, changed, codes, after, embed(changed))})

    done = open_rows.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInPandas(finish, f"doc_id long, {RESULT}")
    out = made.filter("not tail").select("doc_id", *COLUMNS).union(done)  # stored as bytes, given as hex
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def _codes(column) -> np.ndarray:
    return np.array([np.frombuffer(bytes.fromhex(v), dtype=np.uint8) for v in column], dtype=np.uint8).reshape(-1, LANES)


def sketch(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bit of every lane, in two 64-bit numbers, and the number of used lanes. Bits differ only where lanes do."""
    bits = np.packbits(codes & 1, axis=1).view(np.int64).reshape(-1, 2)
    return bits[:, 0].copy(), bits[:, 1].copy(), np.count_nonzero(codes, axis=1).astype(np.int32)


def _equal_share(threshold: float) -> float:
    """The least share of equal lanes among the used ones at which `likeness` reaches the threshold."""
    share = max(threshold, 0.0) / (2 - max(threshold, 0.0))
    return share and share * (1 - 1 / 255) + 1 / 255


def may_be_near(x0, x1, xn, y0, y1, yn, threshold: float) -> np.ndarray:
    """False only where the likeness is below the threshold, told by sketches. A near pair of at most m used lanes has (1 - share) * m unequal ones at most, and
    m is at most the used lanes of either side divided by the share."""
    share = _equal_share(threshold)
    lanes = np.minimum(LANES, np.minimum(xn, yn) / share) if share else LANES
    unlike = np.bitwise_count((x0 ^ y0).view(np.uint64)) + np.bitwise_count((x1 ^ y1).view(np.uint64))  # of signed numbers it would count the absolute value's bits
    return unlike <= (1 - share) * lanes + 1e-6


def _nodes(prints: DataFrame) -> DataFrame:
    """(node, fingerprint, least_id, s0, s1, used): equal fingerprints are one node; the last three are its sketch."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s0, s1, used = sketch(_codes(f["fingerprint"]))
            yield f.assign(least_id=f["least_id"].astype("Int64"), s0=s0, s1=s1, used=used)

    least = prints.groupBy("fingerprint").agg(F.min("doc_id").cast("long").alias("least_id")).withColumn("node", F.monotonically_increasing_id())
    return store.stored(least.mapInPandas(add, "fingerprint string, least_id long, node long, s0 long, s1 long, used int"), "nodes")


def hopeful(f: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The rows that may be near to one of another root in their bucket. Columns: bucket, node, root, s0, s1, used. All pairs are tried, one distance in the bucket at a time."""
    f = f.sort_values("bucket", kind="stable")
    bucket, root, x0, x1, used = (f[c].to_numpy() for c in ("bucket", "root", "s0", "s1", "used"))
    end, good, at, far = np.searchsorted(bucket, bucket, side="right"), np.zeros(len(f), dtype=bool), np.arange(len(f)), 1
    while len(at := at[at + far < end[at]]):
        a = at[root[at] != root[at + far]]
        b = a + far
        near = may_be_near(x0[a], x1[a], used[a], x0[b], x1[b], used[b], threshold)
        good[a[near]] = good[b[near]] = True
        far += 1
    return f.loc[good, ["bucket", "node", "root"]]


def across(x: pd.DataFrame, y: pd.DataFrame | None, threshold: float) -> list[tuple[int, int, float]]:
    """Links between rows of x and y (of x with itself if y is None) that join different roots: all pairs are tried, and a forest of the near ones is returned. Columns: node, root, fingerprint."""
    a, na, ra = _codes(x["fingerprint"]), x["node"].tolist(), x["root"].to_numpy(dtype=np.int64).copy()
    b, nb, rb = (a, na, ra) if y is None else (_codes(y["fingerprint"]), y["node"].tolist(), y["root"].to_numpy(dtype=np.int64).copy())
    out, step = [], max(1, (1 << 15) // max(len(b), 1))
    for lo in range(0, len(a), step):
        near = likeness(a[lo:lo + step, None, :], b[None, :, :])
        for i, j in np.argwhere((near >= threshold) & (ra[lo:lo + step, None] != rb[None, :])).tolist():
            if (old := rb[j]) != (new := ra[lo + i]):
                out.append((na[lo + i], nb[j], float(near[i, j])))
                ra[ra == old] = new
                rb[rb == old] = new
    return out


def _links(nodes: DataFrame, threshold: float, bands: int) -> DataFrame:
    """(a, b, near) between nodes: their components are those of all near pairs that share a bucket.

    Pairs are tried by sketches first, 20 bytes beside the node, which rule out no near pair; whole fingerprints go only to what is left.
    Round one tries each member of a bucket against the bucket's least node. In a bucket that still holds several components, round two tries all pairs
    across them: by sketches in buckets of up to CELL members, then what is left by fingerprints. There, a component with CELL members or more is dealt
    into cells of its own, the small ones are dealt together, and a task gets pairs of cells; cells of one component don't meet. A task returns a forest, so
    the links grow with the members, though the tries in a bucket of far documents grow with its square. Buckets are named by a 64-bit hash.
    """
    width = 2 * LANES // bands
    key = ["bucket"]
    sketched = nodes.select("node", "s0", "s1", "used")
    sliced = nodes.select("node", "s0", "s1", "used", F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("fingerprint", 1 + width * i, width)) for i in range(bands)])).alias("bucket"))
    lead = sliced.groupBy(*key).agg(F.min("node").alias("a"), F.max("node").alias("most")).filter("a < most").select(*key, "a")
    lead = store.stored(lead.join(sketched.toDF("a", "a0", "a1", "an"), "a"), "leads")
    share = _equal_share(threshold)
    lanes = F.least(F.lit(float(LANES)), F.least("used", "an") / share) if share else F.lit(float(LANES))
    hope = (F.col("node") > F.col("a")) & (F.bit_count(F.col("s0").bitwiseXOR(F.col("a0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("a1"))) <= (1 - share) * lanes + 1e-6)
    lists = store.stored(sliced.join(lead, key).select(*key, "node", "s0", "s1", "used", F.when(hope, F.col("a")).alias("a")), "buckets")
    store.drop(lead)
    tries = store.stored(lists.filter("a is not null").select("a", F.col("node").alias("b")).distinct(), "tries")
    codes = nodes.select("node", "fingerprint")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            near = likeness(_codes(f["fa"]), _codes(f["fb"]))
            yield f[["a", "b"]].assign(near=near)[near >= threshold]

    tries = tries.join(codes.toDF("a", "fa"), "a").join(codes.toDF("b", "fb"), "b")
    first = store.stored(tries.select("a", "b", "fa", "fb").mapInPandas(verify, "a long, b long, near double"), "near")

    placed = store.stored(lists.drop("a").join(components(first), "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    several = store.stored(placed.groupBy(*key).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("many")).filter("lo < hi").select(*key, "many"), "several")
    store.drop(lists)
    met = store.stored(placed.join(several, key), "met")
    store.drop(placed, several)
    lots = met.count() // LOT + 1
    little = met.filter(F.col("many") <= CELL).select(*key, "node", "root", "s0", "s1", "used", F.pmod(F.xxhash64(*key), F.lit(lots)).alias("lot"))
    left = little.groupBy("lot").applyInPandas(lambda f: hopeful(f, threshold), "bucket long, node long, root long")
    left = store.stored(left.union(met.filter(F.col("many") > CELL).select(*key, "node", "root")), "open")
    store.drop(met)
    heads = store.stored(left.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("own")), "heads")
    small = store.stored(heads.filter(F.col("own") < CELL).groupBy(*key).agg(F.sum("own").alias("rest")), "small")
    large = F.col("own") >= CELL
    cells = left.join(heads, [*key, "root"]).join(small, key, "left").select(
        *key, "node", "root", F.when(large, F.col("root")).otherwise(F.lit(-1)).alias("part"),
        F.pmod(F.when(large, F.xxhash64("node")).otherwise(F.xxhash64("root")), F.ceil(F.when(large, F.col("own")).otherwise(F.col("rest")) / CELL)).alias("salt"))
    cells = store.stored(cells, "cells")
    store.drop(left, heads, small)
    names = store.stored(cells.select(*key, "part", "salt").distinct(), "names")
    x, y = names.toDF(*key, "xp", "xs"), names.toDF(*key, "yp", "ys")
    meet = store.stored(x.join(y, key).filter("xp < yp or xp = -1 and yp = -1 and xs <= ys"), "meet")
    pair = [*key, "xp", "xs", "yp", "ys"]
    one = meet.join(cells.toDF(*key, "node", "root", "xp", "xs"), [*key, "xp", "xs"]).select(*pair, "node", "root", F.lit(False).alias("other"))
    two = meet.filter("xp != yp or xs != ys").join(cells.toDF(*key, "node", "root", "yp", "ys"), [*key, "yp", "ys"]).select(*pair, "node", "root", F.lit(True).alias("other"))
    sides = store.stored(one.union(two), "sides")
    lots = sides.count() // LOT + 1

    def settle(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in f.groupby(pair, sort=False):
            y = g[g["other"]]
            out += across(g[~g["other"]], y if len(y) else None, threshold)
        return pd.DataFrame(out, columns=["a", "b", "near"])

    dealt = sides.join(codes, "node").withColumn("lot", F.pmod(F.xxhash64(*pair), F.lit(lots)))
    second = store.stored(dealt.groupBy("lot").applyInPandas(settle, "a long, b long, near double"), "near")
    store.drop(cells, names, meet, sides)
    return first.union(second)


def near_pairs(prints: DataFrame, threshold: float = 0.8, bands: int = 32) -> DataFrame:
    """(a, b, near), a < b: links with likeness at least `threshold` whose components are those of all such pairs that share a bucket. Input: doc_id, fingerprint.

    A band samples LANES / bands lanes; documents equal in a band share a bucket. No pair of a bucket is left out unless other links already connect it, so
    not every near pair is a row. Documents with equal fingerprints (also empty ones, all 00) link to the least id among them, which stands for them.
    Null ids have no row; `near_groups` places them.
    """
    prints = store.stored(prints.select("doc_id", "fingerprint"), "prints")
    nodes = _nodes(prints)
    ids = nodes.select("node", "least_id")
    named = _links(nodes, threshold, bands).join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").filter("x != y")
    copies = prints.join(nodes, "fingerprint").filter("doc_id > least_id").select(F.col("least_id").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("near")).distinct()
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "near").union(copies)


def near_groups(prints: DataFrame, threshold: float = 0.8, bands: int = 32) -> DataFrame:
    """The rows of `prints` with near_group: the least doc_id of the row's component of near documents (see `near_pairs`); null where all ids of it are null."""
    nodes = _nodes(prints)  # prints is read again below, rows find their group by fingerprint
    roots = components(_links(nodes, threshold, bands))
    named = store.stored(nodes.join(roots, "node", "left").select("fingerprint", "least_id", F.coalesce("root", "node").alias("root")), "named")
    store.drop(nodes, roots)
    least = named.groupBy("root").agg(F.min("least_id").alias("near_group"))
    groups = store.stored(named.join(least, "root").select("fingerprint", "near_group"), "groups")
    store.drop(named)
    return prints.join(groups, "fingerprint").select(*prints.columns, "near_group")


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return near_groups(fingerprints(store.read(spark, sf_dir, "documents")))
