"""Structured Streaming jobs: news windows, event dedupe with state, snapshot upsert, move alerts with state.

Sinks are append-only batch partitions that a replay of the same batch overwrites, so a lost executor or a restarted
driver cannot duplicate rows. Keyed state lives in Spark's state store (RocksDB) under the query's checkpoint.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quantloom.functions import cols as C
from quantloom.functions import rules as R
from quantloom.operators import news as N
from quantloom.session import scratch
from quantloom.streaming import store

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def batch_writer(path: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> Callable:
    def write(df: DataFrame, batch_id: int) -> None:
        d = shape(df) if shape else df
        d.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_available(stream: DataFrame, path: str, write: Callable | None = None, mode: str = "append") -> None:
    """Drains what is available into batch partitions under `path` (or through `write`) and stops."""
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
             .foreachBatch(write or batch_writer(path)).start())
        q.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE[0], before)


def work_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


# ---- R1 news intake ----

def news_stream(raw: DataFrame, cal: DataFrame, delay: str = "4 days") -> DataFrame:
    """(code, tday, closed, n): articles per code and event-time window from 15:30 to 15:30, once the watermark has passed the window. raw: (id, dt, code, title).

    Each article id counts once; automatic headlines are left out; repeats of a normalised title per code and trading day count once, as in
    `news.daily_news_table`. `delay` bounds how late a row may come and how far repeats may lie apart: it must cover the longest trading day (a weekend).
    Rows behind the watermark are dropped. A trading day after a holiday has several windows; `read_news_counts` adds them up.
    """
    d = raw.withWatermark("dt", delay).dropDuplicatesWithinWatermark(["id"]).where(~R.is_market_auto("title"))
    d = N.assign_trade_date(d, cal).where("tday is not null").withColumn("title", C.squeeze("title"))
    d = d.dropDuplicatesWithinWatermark(["code", "tday", "title"])
    span = F.window("dt", "1 day", startTime="15 hours 30 minutes")
    return d.groupBy(span.alias("w"), "code", "tday").agg(F.count("*").alias("n")).select("code", "tday", F.col("w.end").alias("closed"), "n")


def read_news_counts(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path).groupBy("code", "tday").agg(F.sum("n").alias("n"))


# ---- R2 event dedupe with per-key state ----

def _frame(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(frames)
    return pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]


class QuietPeriod(StatefulProcessor):
    """State of a key: position of the last kept event, newest position seen, and when the quiet period ends (ms, -1: past the calendar)."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "last int, seen int, until bigint")

    def handleInputRows(self, key, rows, timerValues):
        # the first row of each position is all that can count: memory follows the days, not the rows
        last, seen, until = self.state.get() or (None, None, -1)
        first = {}
        for r in rows:
            if seen is not None and r.tpos < seen:
                yield Row(event=r.event, code=r.code, tpos=r.tpos, rcept_dt=r.rcept_dt, rcept_no=r.rcept_no, late=True)
                continue
            order = (r.rcept_dt is None, r.rcept_dt, r.rcept_no is None, r.rcept_no)
            if r.tpos not in first or order < first[r.tpos][0]:
                first[r.tpos] = order, r
        if not first:
            return
        kept = None
        for pos in sorted(first):
            if last is None or pos >= last + self.quiet:
                last, kept = pos, first[pos][1]
                yield Row(event=kept.event, code=kept.code, tpos=pos, rcept_dt=kept.rcept_dt, rcept_no=kept.rcept_no, late=False)
        if kept is not None:
            until = kept.until
            if until >= 0:
                self.handle.registerTimer(until)
        self.state.update((last, pos, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Rows that can still come lie behind the quiet period: the next is kept whatever the state says."""
        held = self.state.get()
        if held and 0 <= held[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class QuietPeriods(StatefulProcessor):
    """`QuietPeriod` for all keys of a bucket at once: the state is one list per field, a timer waits for the quiet period that ends next."""

    KEY, FIELDS = ["event", "code"], ["event", "code", "last", "seen", "until"]

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "event array<string>, code array<string>, last array<int>, seen array<int>, until array<bigint>, timer bigint")

    def _held(self, now: int) -> tuple[pd.DataFrame, int]:
        """The keys whose quiet period has not ended at `now`, and the timer that is set."""
        *lists, timer = self.state.get() or ([], [], [], [], [], -1)
        held = pd.DataFrame({c: pd.Series(list(x), dtype="object" if c in self.KEY else "int64") for c, x in zip(self.FIELDS, lists, strict=True)})
        return held[(held["until"] < 0) | (held["until"] > now)], timer

    def _keep(self, held: pd.DataFrame, timer: int) -> None:
        ends = held["until"][held["until"] >= 0]
        if len(ends) and int(ends.min()) != timer:
            timer = int(ends.min())
            self.handle.registerTimer(timer)
        if len(held):
            self.state.update((*[held[c].tolist() for c in self.FIELDS], timer))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues):
        held, timer = self._held(timerValues.getCurrentWatermarkInMs())
        columns, first = ["event", "code", "tpos", "rcept_dt", "rcept_no", "late"], None
        for f in rows:
            f = f.merge(held[[*self.KEY, "last", "seen"]], on=self.KEY, how="left")
            late = f["tpos"] < f["seen"]
            if late.any():
                yield f[late].assign(late=True)[columns]
            first = f[~late] if first is None else pd.concat([first, f[~late]], ignore_index=True)
            first = first.sort_values([*self.KEY, "tpos", "rcept_dt", "rcept_no"]).drop_duplicates([*self.KEY, "tpos"])
        if len(first):
            group = first.groupby(self.KEY, sort=False, dropna=False).ngroup().to_numpy()
            pos, begin = first["tpos"].to_numpy(dtype=np.int64), np.flatnonzero(np.diff(group, prepend=-1))
            end, low, span = np.append(begin[1:], len(pos)), pos.min(), pos.max() - pos.min()
            place, number = group * (span + 2) + pos - low, np.arange(len(begin))  # ascending: one search finds the next position of every key

            def after(last, of):
                return np.searchsorted(place, of * (span + 2) + np.clip(last + self.quiet - low, 0, span + 1))

            last = first["last"].to_numpy(dtype=float)[begin]
            at = np.where(np.isnan(last), begin, after(np.where(np.isnan(last), 0, last).astype(np.int64), number))
            kept, latest = [], np.full(len(begin), -1)
            while len(open_ := np.flatnonzero(at < end)):  # one step per kept event of the key that keeps most
                latest[open_] = at[open_]
                kept.append(at[open_])
                at[open_] = after(pos[at[open_]], open_)
            if kept:
                yield first.iloc[np.sort(np.concatenate(kept))].assign(late=False)[columns]
            now = first.iloc[begin][[*self.KEY, "last"]].assign(seen=pos[end - 1]).merge(held[[*self.KEY, "until"]], on=self.KEY, how="left")
            some = latest >= 0
            now["last"] = np.where(some, pos[latest], now["last"].fillna(-1)).astype(np.int64)
            now["until"] = np.where(some, first["until"].to_numpy()[latest], now["until"].fillna(-1)).astype(np.int64)
            held = pd.concat([held, now[self.FIELDS]], ignore_index=True).drop_duplicates(self.KEY, keep="last")
        self._keep(held, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            self._keep(*self._held(expiredTimerInfo.getExpiryTimeInMs()))
        return iter(())

    def close(self) -> None:
        pass


def dedupe_event_stream(events: DataFrame, cal: DataFrame, quiet: int = 20, delay: str = "3 days", buckets: int | None = None) -> DataFrame:
    """(event, code, tpos, rcept_dt, rcept_no, late). events: (event, code, tpos, rcept_dt, rcept_no) arriving in date order for each key across batches.

    Within a batch any order will do. A row before the newest position its key has seen comes too late to be judged and is put out with late = true;
    rows more than `delay` behind the newest receipt of the stream are dropped by the watermark. State is cleared by a timer when the watermark passes
    the day on which the quiet period ends.

    A call into Python and its state costs milliseconds. With `buckets`, keys are dealt by hash into so many groups, which are judged and held as a whole: choose
    it so that the rows a batch has for a bucket, and its keys, fit a task with ease. It must stay as it is for the life of a checkpoint.
    """
    ends = cal.select((F.col("pos") - quiet).alias("tpos"), F.col("date").alias("_end"))
    d = events.select("event", "code", "tpos", "rcept_dt", "rcept_no", F.col("rcept_dt").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    d = d.join(ends, "tpos", "left").withColumn("until", F.coalesce(F.unix_millis(F.col("_end").cast("timestamp")), F.lit(-1))).drop("_end")
    shape = "event string, code string, tpos int, rcept_dt date, rcept_no string, late boolean"
    if buckets is None:
        return d.groupBy("event", "code").transformWithState(QuietPeriod(quiet), shape, "append", "eventTime")
    d = d.withColumn("bucket", F.pmod(F.xxhash64("event", "code"), F.lit(buckets)))
    return d.groupBy("bucket").transformWithStateInPandas(QuietPeriods(quiet), shape, "append", "eventTime")


def event_writer(path: str) -> Callable:
    """Kept events under path/batch=…, rows that came too late under path-late/batch=…."""

    def write(df: DataFrame, batch_id: int) -> None:
        df = df.persist()  # a replay of the state step for the second sink would read the same state again
        try:
            batch_writer(path, lambda d: d.where("not late").drop("late"))(df, batch_id)
            batch_writer(f"{path}-late", lambda d: d.where("late").drop("late"))(df, batch_id)
        finally:
            df.unpersist()

    return write


# ---- R3 snapshot upsert ----

def upsert_stream(stream: DataFrame, path: str, keys, seq: str, part: Column, every: int = 8) -> None:
    """Late or restated rows replace old ones: each batch keeps its newest row per key; every `every` open batches are taken into the table (see `store`)."""

    def write(df: DataFrame, batch_id: int) -> None:
        store.append(df, path, batch_id, keys, seq)
        now = store.manifest(df.sparkSession, path)
        if len(store.open_batches(df.sparkSession, path, now["through"])) >= every:
            store.compact(df.sparkSession, path, keys, seq, part)

    run_available(stream, path, write)


# ---- R4 move alerts ----

def _over(a: float, b: float) -> float:
    """a / b as SQL divides doubles: over zero it is infinite, and zero over zero is NaN."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.float64(a) / np.float64(b))


class MoveAlerts(StatefulProcessor):
    """State of a code: the open day with sum and number of its prices, the close before it, the number of returns, and the EWMA of return, square and weight."""

    def __init__(self, k: float, floor: float, cap: float, min_obs: int, beta: float):
        self.k, self.floor, self.cap, self.min_obs, self.beta = k, floor, cap, min_obs, beta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("days", "day int, total double, n bigint, prev double, seen int, m double, q double, s2 double")

    def close_day(self, s: tuple, day: int) -> tuple:
        """The state when `day` opens: the open day's mean price becomes the close, its return enters the averages."""
        _, total, n, prev, seen, m, q, s2 = s
        close = total / n
        if prev is not None:
            ret, b = _over(close, prev) - 1, self.beta
            m, q, s2 = (ret, ret * ret, 1.0) if not seen else (b * m + (1 - b) * ret, b * q + (1 - b) * ret * ret, b * b * s2 + (1 - b) ** 2)
            seen += 1
        return day, 0.0, 0, close, seen, m, q, s2

    def threshold(self, s: tuple) -> float | None:
        _, _, _, _, seen, m, q, s2 = s
        if seen < self.min_obs or s2 >= 1:
            return None
        var = (q - m * m) / (1 - s2)
        if math.isnan(var):  # after a close of zero the averages are not finite: as large as it gets
            return self.cap
        return min(max(self.k * math.sqrt(max(var, 0.0)), self.floor), self.cap)

    def handleInputRows(self, key, rows, timerValues):
        f = _frame(rows)
        f["day"] = (pd.to_datetime(f["date"]) - pd.Timestamp(0)).dt.days
        f = f.sort_values("event_id", kind="stable")  # doubles are added in this order, not in that of the shuffle: the last digit decides where a move equals its threshold
        s = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for day, g in f.groupby("day", sort=True):
            if s is not None and day < s[0]:
                out.append(g.assign(ret=np.nan, threshold=np.nan, side="late"))
                continue
            if s is None:
                s = (int(day), 0.0, 0, None, 0, 0.0, 0.0, 0.0)
            elif day > s[0]:
                s = self.close_day(s, int(day))
            prev, limit = s[3], self.threshold(s)
            s = (s[0], float(np.add.accumulate([s[1], *g["price"]])[-1]), s[2] + len(g), *s[3:])  # one after the other, as SQL adds; sum() adds in pairs
            if prev is not None and limit is not None:
                with np.errstate(divide="ignore", invalid="ignore"):
                    ret = pd.Series(g["price"].to_numpy() / np.float64(prev) - 1, g.index)
                up = (ret > limit) | ret.isna()  # NaN is above every number, as in SQL
                out.append(g.assign(ret=ret, threshold=limit, side=np.where(up, "surge", "plunge"))[up | (ret < -limit)])
        self.state.update(s)
        if out:
            yield pd.concat(out, ignore_index=True)[["event_id", "code", "date", "price", "ret", "threshold", "side"]]

    def close(self) -> None:
        pass


def move_alerts(ticks: DataFrame, k: float = 2.0, floor: float = 0.025, cap: float = 0.15, min_obs: int = 60, beta: float = 0.94) -> DataFrame:
    """(event_id, code, date, price, ret, threshold, side): ticks that move more than the threshold of the evening before. ticks: stream (event_id, code, date, price).

    The threshold is that of `prices.move_threshold` on the codes' own days, with the mean price of a day as its close: k times the EWMA deviation of the
    returns up to yesterday, within floor and cap. It is carried from day to day as state, so nothing of a day or of the future enters it. Days of one code
    must arrive in order across batches; ticks of a closed day get side 'late' and change nothing. The prices of a day are added in the order of event_id (within
    a batch; batches in theirs), so the rows do not depend on how ticks are dealt to files and tasks. Ticks without a price or code are left out. After a close
    of zero every tick is an alert (ret is infinite or NaN, side 'surge'), and the threshold stays at the cap.
    """
    return ticks.where("price is not null and code is not null").groupBy("code").transformWithStateInPandas(
        MoveAlerts(k, floor, cap, min_obs, beta), "event_id long, code string, date date, price double, ret double, threshold double, side string", "append", "None")
