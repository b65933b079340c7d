"""Periodic runs of words, found in a grammar of the repeated stretches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm import store
from quantloom.llm.arrays import CHUNK_BYTES, chunks, grams, mix, prefix, ragged, spans
from quantloom.llm.bpe import Numbers, every_other

LEAST = 12
CELLS = 1 << 20  # periods tried at once
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def stretches(words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that can hold runs: words under some half-length gram that its document repeats.

    A run of period q and length >= max(least, 2 q) has at least least / 2 words in a row that equal those q further on, so all its words lie in one stretch.
    """
    k = (least + 1) // 2
    names = grams(prefix(mix(words.astype(np.uint64) + np.uint64(1))), k)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(doc[: len(names)] == doc[k - 1: k - 1 + len(names)])
    names = mix(names[inside] + doc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by = np.argsort(names)
    same = names[by[1:]] == names[by[:-1]]
    at = inside[by[np.r_[same, False] | np.r_[False, same]]] if len(by) else inside
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge += np.bincount(at, minlength=len(edge)) - np.bincount(at + k, minlength=len(edge))
    covered = np.cumsum(edge)[:-1] > 0
    border = np.zeros(len(words) + 1, dtype=bool)
    border[first] = True
    starts = np.flatnonzero(covered & np.r_[True, ~covered[:-1] | border[1:-1]])
    ends = np.flatnonzero(covered & np.r_[~covered[1:] | border[1:-1], True]) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


class Grammar:
    """Binary rules over the stretches of a chunk: where each rule stands first (start, middle, end), and all its places in the text."""

    def __init__(self, words: np.ndarray, segment: np.ndarray):
        self._made: list[tuple[np.ndarray, ...]] = []
        self._places: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0
        self._halve(*self._repair(words.astype(np.int64), segment))
        self.start, self.middle, self.end = _columns(self._made, 3)
        self.rule, self.place = _columns(self._places, 2)

    def _add(self, rule: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> None:
        """Places of new rules, numbered from 0."""
        one = np.zeros(int(rule.max()) + 1, dtype=np.int64)
        one[rule[::-1]] = np.arange(len(rule))[::-1]
        self._made.append((start[one], middle[one], end[one]))
        self._places.append((self._n + rule, start))
        self._n += len(one)

    def _repair(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Re-Pair in rounds: a pair that stands twice becomes a rule wherever no pair that overlaps it there is more frequent (ties: an order by hash).

        Stretches without a repeated pair leave. Returned: stretch, start and end of the symbols that are left.
        """
        start = np.arange(len(sym))
        end = start + 1
        ids = int(sym.max()) + 1 if len(sym) else 0
        left = []
        while len(sym):
            valid = np.flatnonzero(seg[1:] == seg[:-1])
            pairs, which, often = np.unique(sym[valid] * ids + sym[valid + 1], return_inverse=True, return_counts=True)
            order = np.empty(len(pairs), dtype=np.int64)
            order[np.lexsort((mix(pairs.astype(np.uint64)), often))] = np.arange(1, len(pairs) + 1)
            power, kind = np.zeros(len(sym) + 1, dtype=np.int64), np.full(len(sym) + 1, -1)
            power[valid], kind[valid] = np.where(often[which] > 1, order[which], 0), which
            live = np.flatnonzero(power)
            active = np.zeros(int(seg[-1]) + 1, dtype=bool)
            active[seg[live]] = True
            idle = ~active[seg]
            left.append((seg[idle], start[idle], end[idle]))
            if not len(live):
                break
            power[live[~every_other((live[1:] == live[:-1] + 1) & (kind[live[1:]] == kind[live[:-1]]))]] = 0
            live = live[(power[live] > power[live - 1]) & (power[live] > power[live + 1])]
            new, rule = np.unique(kind[live], return_inverse=True)
            self._add(rule, start[live], end[live], end[live + 1])
            sym[live], end[live] = ids + rule, end[live + 1]
            ids += len(new)
            stay = ~idle
            stay[live + 1] = False
            sym, seg, start, end = sym[stay], seg[stay], start[stay], end[stay]
        seg, start, end = _columns(left, 3)
        by = np.argsort(start)
        return seg[by], start[by], end[by]

    def _halve(self, seg: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """A balanced tree over each stretch's symbols; its rules stand once."""
        while len(seg):
            begin = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            index = np.arange(len(seg)) - np.repeat(begin, np.diff(np.r_[begin, len(seg)]))
            pair = np.flatnonzero((index[:-1] % 2 == 0) & (seg[1:] == seg[:-1]))
            if not len(pair):
                break
            self._add(np.arange(len(pair)), start[pair], end[pair], end[pair + 1])
            end = end.copy()
            end[pair] = end[pair + 1]
            stay = np.ones(len(seg), dtype=bool)
            stay[pair + 1] = False
            seg, start, end = seg[stay], start[stay], end[stay]


def _columns(parts: list[tuple[np.ndarray, ...]], n: int) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, dtype=np.int64)] * n


class Matches:
    """How far two places of a word array agree, by hashes of doubling blocks, or word by word (`exact`)."""

    def __init__(self, words: np.ndarray, exact: bool = False):
        self.words, self.exact = words, exact
        self.pre = prefix(mix(words.astype(np.uint64) + np.uint64(1)))

    def ahead(self, a: np.ndarray, b: np.ndarray, bound: np.ndarray, step: int = 1) -> np.ndarray:
        """Number of i < bound with words[a + i] == words[b + i]; with step -1 of words[a - 1 - i] == words[b - 1 - i]."""
        got = np.zeros(len(a), dtype=np.int64)
        if self.exact:
            at = np.flatnonzero(bound > 0)
            shift = 0 if step > 0 else -1
            while len(at):
                at = at[self.words[a[at] + shift + step * got[at]] == self.words[b[at] + shift + step * got[at]]]
                got[at] += 1
                at = at[got[at] < bound[at]]
            return got
        power = 1 << int(bound.max(initial=0)).bit_length()
        while power:
            at = np.flatnonzero(got + power <= bound)
            x, y = a[at] + step * got[at], b[at] + step * got[at]
            if step < 0:
                x, y = x - power, y - power
            got[at[spans(self.pre, x, x + power) == spans(self.pre, y, y + power)]] += power
            power >>= 1
        return got


def crossing(words: np.ndarray, match: Matches, start: np.ndarray, middle: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(rule, start, end, period) of all runs that cross the middles, as far as they reach within start and end.

    A run over the middle has a whole period right of it, or left of it. So its period q is tried once between the middle and q words on, and once between
    q words back and the middle; the places agree around there for length - q words.
    """
    out = []
    k = (least + 1) // 2
    for right in (True, False):
        size = end - middle if right else middle - start
        rule = np.repeat(np.arange(len(start)), size)
        at = ragged(middle if right else start, size)
        hit = words[at] == words[(middle - 1 if right else middle)[rule]]
        rule, at = rule[hit], at[hit]
        x = middle[rule] if right else at
        q = at - middle[rule] + 1 if right else middle[rule] - at
        near = _short(words, x, x + q, np.minimum(end[rule] - x - q, k), 1) + _short(words, x, x + q, np.minimum(x - start[rule], k), -1)
        rule, x, q = (c[near >= k] for c in (rule, x, q))
        after, before = match.ahead(x, x + q, end[rule] - x - q), match.ahead(x, x + q, x - start[rule], -1)
        ok = (after + before >= q) & (after + before + q >= least)
        out.append((rule[ok], (x - before)[ok], (x + q + after)[ok], q[ok]))
    rule, s, e, q = _columns(out, 4)
    by = np.lexsort((q, e, s, rule))  # of several periods of one stretch the least counts
    rule, s, e, q = rule[by], s[by], e[by], q[by]
    first = np.r_[True, (rule[1:] != rule[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])][: len(rule)]
    return rule[first], s[first], e[first], q[first]


def _short(words: np.ndarray, a: np.ndarray, b: np.ndarray, bound: np.ndarray, step: int) -> np.ndarray:
    got = np.zeros(len(a), dtype=np.int64)
    at, shift = np.flatnonzero(bound > 0), 0 if step > 0 else -1
    while len(at):
        at = at[words[a[at] + shift + step * got[at]] == words[b[at] + shift + step * got[at]]]
        got[at] += 1
        at = at[got[at] < bound[at]]
    return got


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + CELLS, side="right")))
        yield lo, hi
        lo = hi


def _periodic(words: np.ndarray, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> bool:
    """Whether every stretch [s, e) really has period q."""
    for lo, hi in _slices(e - s - q):
        at = ragged(s[lo:hi], (e - s - q)[lo:hi])
        if (words[at] != words[at + np.repeat(q[lo:hi], (e - s - q)[lo:hi])]).any():
            return False
    return True


def find_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs in an array of word ids, ordered by start and period. `first`: each document's first word, one longer than the documents."""
    none = np.empty(0, dtype=np.int64)
    begin, finish = stretches(words, first, least) if len(words) >= least else (none, none)
    if not len(begin):
        return none, none, none
    size = finish - begin
    segment = np.repeat(np.arange(len(begin)), size)
    text = words[ragged(begin, size)]
    grammar = Grammar(text, segment)
    long = np.flatnonzero(grammar.end - grammar.start >= least)
    start, middle, end = grammar.start[long], grammar.middle[long], grammar.end[long]
    for exact in (False, True):
        match = Matches(text, exact)
        found = [(long[lo:hi][r], s, e, q) for lo, hi in _slices(end - start) for r, s, e, q in [crossing(text, match, start[lo:hi], middle[lo:hi], end[lo:hi], least)]]
        rule, s, e, q = _columns(found, 4)
        if exact or _periodic(text, s, e, q):  # else two blocks had one hash
            break
    # to all places of the rules
    by = np.argsort(grammar.rule, kind="stable")
    place, count = grammar.place[by], np.bincount(grammar.rule, minlength=len(grammar.start))
    head = np.cumsum(count) - count
    moved = place[ragged(head[rule], count[rule])] - np.repeat(grammar.start[rule], count[rule])
    s, e, q = np.repeat(s, count[rule]) + moved, np.repeat(e, count[rule]) + moved, np.repeat(q, count[rule])
    # a part of a run, cut by its rule's ends, lies in the whole one, which a larger rule has
    by = np.lexsort((-e, s, q))
    s, e, q = s[by], e[by], q[by]
    reach = e + np.cumsum(np.r_[False, q[1:] != q[:-1]])[: len(q)] * (len(text) + 1)
    whole = np.r_[True, reach[1:] > np.maximum.accumulate(reach)[:-1]][: len(reach)]
    s, e, q = s[whole], e[whole], q[whole]
    shift = begin - (np.cumsum(size) - size)
    s, e = s + shift[segment[s]], e + shift[segment[s]]
    by = np.lexsort((q, s))
    return s[by], e[by], q[by]


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, runs (start, length, period; by start and period), collapsed.

    A run is a stretch of words with smallest period q and length >= max(least, 2 q) that no neighbouring word extends. `collapsed` holds the words that no
    run contains after its first q words, joined by one space. Each task numbers the words of a chunk of documents, narrows them to stretches of repeated
    half-length grams, and compresses these by Re-Pair into one grammar; copies share its rules. Runs over a rule's middle are found once, moved to all
    places of the rule, and cut ones dropped for the whole ones.

    Null, empty or blank text: no words, no runs, empty text. Null or repeated doc_id: rows are judged each on its own. Very long texts: whole, in one
    chunk; memory follows the chunk or the longest text. Periods that tie: the smallest is the run's. An empty table gives an empty table. Extra columns
    are ignored, whatever their names.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1), CHUNK_BYTES):
                raw, bounds = data.tobytes(), offsets.tolist()
                words = [raw[a:b].split() for a, b in zip(bounds, bounds[1:])]
                sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                first = np.r_[0, np.cumsum(sizes)]
                ids = np.fromiter(map(Numbers().__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(first[-1]))
                s, e, q = find_runs(ids, first, least)
                drop = np.zeros(len(ids) + 1, dtype=np.int64)
                np.add.at(drop, s + q, 1)
                np.add.at(drop, e, -1)
                keep = np.cumsum(drop)[:-1] == 0
                of = np.searchsorted(first, s, side="right") - 1
                hit = set(of.tolist())
                texts = [b" ".join(compress(w, keep[first[i]:first[i + 1]].tolist()) if i in hit else w) for i, w in enumerate(words)]
                runs = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of, np.arange(len(words) + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(s - first[of]), pa.array(e - s), pa.array(q)], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes), runs, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), store.text_of(text_col).alias("text")).mapInArrow(work, RUNS)


def with_periods(doc_id: Column, text: Column) -> Column:
    """The text, with the tail of every tenth document made periodic, as the query's contract has it. Null id: as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def made(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.floor((n - a) / (F.lit(3) + g % 8)).cast("long") + 1
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.filter(F.split(text, store.SPACE + "+"), lambda w: w != "")
    tail = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, made(w)))[0]  # binds the words once
    return F.when(h % 10 == 0, F.coalesce(tail, text)).otherwise(text)


def op13_runs(spark, sf_dir: str) -> DataFrame:
    docs = store.read(spark, sf_dir, "documents").select("doc_id", with_periods(F.col("doc_id"), store.text_of()).alias("text"))
    rows = periodic_runs(docs)
    longest = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(line, ""), "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))
