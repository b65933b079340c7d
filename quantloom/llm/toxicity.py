"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import arrays, store
from quantloom.llm.jaccard import _LOWER

WORDS, CHARS, DIM, HIDDEN = 4096, 8192, 16, 12
WINDOW, STRIDE = 64, 48
SAMPLE = 1500  # labelled documents per class that the network is fitted on, at most
PASSAGES = 64  # passages of WINDOW words, evenly spaced, that a longer document of that sample is fitted on
LONGEST = 1 << 16  # bytes of passages beyond which a document is not fitted on
CHUNK = 1 << 19  # bytes of text whose words are found at a time while fitting
EPOCHS, BATCH, RATE = 4, 256, 4e-3


def inputs(data: np.ndarray, offsets: np.ndarray):
    """Words of a chunk as (index into the distinct words, first word of each document), and per distinct word its word slot and its character-run slots."""
    data = _LOWER[data]
    starts, ends, first = arrays.word_bounds(data, offsets)
    pre = arrays.prefix(arrays.byte_symbols(data))
    _, pick, which = np.unique(arrays.spans(pre, starts, ends), return_index=True, return_inverse=True)
    a, b = starts[pick], ends[pick]
    word = (arrays.spans(pre, a, b) % np.uint64(WORDS)).astype(np.int64)
    size, owners, slots = b - a, [], []
    for salt, (begin, many, width) in enumerate(((a, np.ones(len(a), dtype=np.int64), np.minimum(size, 4)), (a, np.ones(len(a), dtype=np.int64), np.minimum(size, 6)), (a, np.maximum(size - 3, 0), 4))):
        at, owner = arrays.ragged(begin, many), np.repeat(np.arange(len(a)), many)
        end = at + (width[owner] if isinstance(width, np.ndarray) else width)
        slots.append(((arrays.spans(pre, at, end) + np.uint64(salt * 0x9E3779B9)) % np.uint64(CHARS)).astype(np.int64))
        owners.append(owner)
    owner, slot = np.concatenate(owners), np.concatenate(slots)
    order = np.argsort(owner, kind="stable")
    return which, first, word, owner[order], slot[order]


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of all overlapping windows; the last one of a document may be short."""
    n = np.diff(first)
    many = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
    doc = np.repeat(np.arange(len(n)), many)
    start = arrays.ragged(np.zeros(len(n), dtype=np.int64), many) * STRIDE
    return doc, first[doc] + start, np.minimum(n[doc] - start, WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Word vectors (word slot plus mean of character slots) -> forward and backward gated units -> attention -> one logit per window."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.normal(size=s) * scale).astype(np.float32)
        self.p = {"word": f(WORDS, DIM, scale=0.3), "char": f(CHARS, DIM, scale=0.3), "att": f(2 * HIDDEN, scale=0.3), "out": f(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": f(DIM, 3 * HIDDEN, scale=0.25), f"u{d}": f(HIDDEN, 3 * HIDDEN, scale=0.25), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.t = 0

    def vectors(self, word, owner, slot):
        count = np.bincount(owner, minlength=len(word)).astype(np.float32)
        mean = np.add.reduceat(self.p["char"][slot], np.searchsorted(owner, np.arange(len(word))), axis=0) / count[:, None] if len(word) else np.zeros((0, DIM), np.float32)
        return self.p["word"][word] + mean, count

    def run(self, x, index, mask, d: str, keep: bool):
        """States (time, window, HIDDEN) of one direction; `index` (time, window) points into the distinct words' vectors x."""
        proj = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        u, (steps, size) = self.p[f"u{d}"], index.shape
        h, states, tape = np.zeros((size, HIDDEN), np.float32), np.empty((steps, size, HIDDEN), np.float32), {}
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g, v = proj[index[t]], h @ u
            zr = _sigmoid(g[:, :2 * HIDDEN] + v[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN:] + r * v[:, 2 * HIDDEN:])
            if keep:
                tape[t] = h, z, r, n, v[:, 2 * HIDDEN:]
            h = h + mask[t][:, None] * (1 - z) * (n - h)
            states[t] = h
        return states, tape

    def forward(self, x, index, mask, keep=False):
        sf, tf = self.run(x, index, mask, "f", keep)
        sb, tb = self.run(x, index, mask, "b", keep)
        s = np.concatenate([sf, sb], axis=2)
        e = np.where(mask > 0, s @ self.p["att"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", a, s)
        return pooled @ self.p["out"] + self.p["bias"][0], (s, a, pooled, tf, tb)

    def learn(self, word, owner, slot, index, mask, y, weight):
        x, count = self.vectors(word, owner, slot)
        logit, (s, a, pooled, tf, tb) = self.forward(x, index, mask, keep=True)
        dl = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        g = {"bias": np.array([dl.sum()], np.float32), "out": pooled.T @ dl}
        dp = dl[:, None] * self.p["out"]
        da = np.einsum("tbh,bh->tb", s, dp)
        de = a * (da - (a * da).sum(axis=0))
        g["att"] = np.einsum("tb,tbh->h", de, s)
        ds = a[:, :, None] * dp + de[:, :, None] * self.p["att"]
        dx = np.zeros_like(x)
        for d, tape, part in (("f", tf, ds[:, :, :HIDDEN]), ("b", tb, ds[:, :, HIDDEN:])):
            u, steps = self.p[f"u{d}"], len(index)
            dproj, du, dh = np.zeros((len(x), 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros(part.shape[1:], np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, z, r, n, v = tape[t]
                dh = dh + part[t]
                m = mask[t][:, None]
                dn = dh * m * (1 - z) * (1 - n * n)
                dz = -dh * m * (n - h) * z * (1 - z)
                dr = dn * v * r * (1 - r)
                dg, dv = np.concatenate([dz, dr, dn], axis=1), np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(dproj, index[t], dg)
                du += h.T @ dv
                dh = dh * (1 - m * (1 - z)) + dv @ u.T
            g |= {f"u{d}": du, f"w{d}": x.T @ dproj, f"c{d}": dproj.sum(axis=0)}
            dx += dproj @ self.p[f"w{d}"].T
        g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(g["word"], word, dx)
        np.add.at(g["char"], slot, (dx / count[:, None])[owner])
        self.t += 1
        for k, v in g.items():
            m1, m2 = self.m[k]
            m1 += 0.1 * (v - m1)
            m2 += 0.01 * (v * v - m2)
            self.p[k] -= RATE * (m1 / (1 - 0.9**self.t)) / (np.sqrt(m2 / (1 - 0.99**self.t)) + 1e-6)


def grid(which: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(int(size.max()))[:, None]
    mask = steps < size
    return which[np.minimum(start + steps * mask, len(which) - 1)], mask.astype(np.float32)


def window_logits(net: Network, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, logit) of every window of a chunk."""
    which, first, word, owner, slot = inputs(data, offsets)
    doc, start, size = windows(first)
    return doc, logits_of(net, which, word, owner, slot, start, size)


def logits_of(net: Network, which, word, owner, slot, start, size) -> np.ndarray:
    out = np.zeros(len(start), np.float32)
    x, _ = net.vectors(word, owner, slot)
    order = np.argsort(size, kind="stable")
    for lo in range(0, len(order), 1024):
        rows = order[lo:lo + 1024]
        out[rows] = net.forward(x, *grid(which, start[rows], size[rows]))[0]
    return out


def highest(doc: np.ndarray, logits: np.ndarray, docs: int, empty: float) -> np.ndarray:
    out = np.full(docs, -np.inf, dtype=np.float64)
    np.maximum.at(out, doc, logits)
    return np.where(np.isneginf(out), empty, out)


def encoded(texts: list[str]):
    """What `inputs` gives for all texts, found CHUNK bytes at a time; a word of several chunks has an entry for each, which changes no sum over slots."""
    parts, words, seen = [], 0, 0
    for _, _, data, offsets in arrays.chunks(pa.array(texts, pa.large_string()), CHUNK):
        which, first, word, owner, slot = inputs(data, offsets)
        parts.append(((which + words).astype(np.int32), first[:-1] + seen, word.astype(np.int32), (owner + words).astype(np.int32), slot.astype(np.int32)))
        words, seen = words + len(word), seen + len(which)
    which, first, word, owner, slot = (np.concatenate(x) for x in zip(*parts))
    return which, np.append(first, seen), word, owner, slot


def fit(texts: list[str], toxic: np.ndarray, share: float, seed: int = 5) -> tuple[Network, float, float]:
    """Network, slope and shift. The first epoch gives every window its document's label; later ones give a toxic document's to its more suspect windows only.

    Slope and shift make the highest window logit of a document a probability, at the `share` of toxic documents among all labelled ones.
    """
    net = Network(seed)
    if not len(texts) or toxic.min() == toxic.max():
        return net, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    which, first, word, owner, slot = encoded(texts)
    doc, start, size = windows(first)
    begin = np.searchsorted(owner, np.arange(len(word) + 1))
    y, r, use = toxic[doc].astype(np.float32), np.random.default_rng(seed), np.arange(len(doc))
    for epoch in range(EPOCHS):
        if epoch:
            logits = logits_of(net, which, word, owner, slot, start, size)
            top = highest(doc, logits, len(texts), -9.0)
            use = np.flatnonzero((y == 0) | (logits >= top[doc] - 1.0))
        balance = np.where(y == 1, (y[use] == 0).sum() / max(1, (y[use] == 1).sum()), 1.0).clip(0.2, 5)
        size_of_batch = int(np.clip(len(use) // 40, 16, BATCH))  # few windows: smaller batches, so that there are enough steps
        for rows in np.array_split(r.permutation(use), max(1, len(use) // size_of_batch)):
            index, mask = grid(which, start[rows], size[rows])
            seen, local = np.unique(index, return_inverse=True)
            many = begin[seen + 1] - begin[seen]
            net.learn(word[seen], np.repeat(np.arange(len(seen)), many), slot[arrays.ragged(begin[seen], many)], local.reshape(index.shape), mask, y[rows], balance[rows])
    top = highest(doc, logits_of(net, which, word, owner, slot, start, size), len(texts), float(net.p["bias"][0]))
    weight = np.where(toxic == 1, share / max(1, (toxic == 1).sum()), (1 - share) / max(1, (toxic == 0).sum())) * len(texts)
    a, c = 1.0, 0.0
    for _ in range(50):
        q = _sigmoid(a * top + c)
        e, v = weight * (toxic - q), weight * q * (1 - q) + 1e-9
        hessian = np.array([[(v * top * top).sum() + 1.0, (v * top).sum()], [(v * top).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(hessian, [(e * top).sum() - (a - 1.0), e.sum() - 0.1 * c])
        a, c = a + float(np.clip(step[0], -1, 1)), c + float(np.clip(step[1], -2, 2))
    return net, max(a, 0.0), c


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Network, float, float]:
    """Fits on at most `sample` documents a class, those of least hash among all labelled rows of `labels` (doc_id, toxic).

    Of a drawn document with more than PASSAGES * WINDOW words the fit takes that many evenly spaced passages, and none if they exceed LONGEST bytes: the
    driver holds at most 2 * sample * LONGEST bytes of text, whatever the tables hold. Scoring takes every window of every text.
    """
    marked = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {x["toxic"]: x["n"] for x in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = None
    for label in (0, 1):
        some = marked.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        drawn = some if drawn is None else drawn.union(some)
    drawn = store.stored(drawn, "drawn")
    words = F.split(F.trim(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " ")), " ")
    places = F.sequence(F.lit(0), F.lit(PASSAGES - 1))
    spread = F.flatten(F.transform(places, lambda k: F.slice(F.col("words"), (k * (F.size("words") - WINDOW) / (PASSAGES - 1)).cast("int") + 1, F.lit(WINDOW))))
    few = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    few = few.withColumn("words", words).withColumn("text", F.when(F.size("words") > PASSAGES * WINDOW, F.concat_ws(" ", spread)).otherwise(F.col("text")))
    few = store.stored(few.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).select("doc_id", "text", "toxic"), "fitted")
    rows = few.orderBy(F.xxhash64("doc_id")).toPandas()
    store.drop(drawn, few)
    return fit([t or "" for t in rows["text"]], rows["toxic"].to_numpy(dtype=np.int64), counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, model: tuple[Network, float, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: probability from the highest logit of all overlapping windows of the whole text.

    Null or empty text: the score of a document without evidence. Null ids and repeated rows are scored like others. An empty table gives an empty table.
    """
    net, slope, shift = model
    sent = docs.sparkSession.sparkContext.broadcast((net.p, slope, shift))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, a, c = sent.value
        own = Network()
        own.p = weights
        for batch in batches:
            for lo, hi, data, offsets in arrays.chunks(batch.column(1), 1 << 20):
                doc, logits = window_logits(own, data, offsets)
                top = highest(doc, logits, hi - lo, float(weights["bias"][0]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(_sigmoid(a * top + c))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = store.read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = train(docs, store.read(spark, sf_dir, "labels").filter(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
