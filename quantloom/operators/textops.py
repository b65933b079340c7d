"""Text tables: topic shares and source selection, mentions of listed names, anonymous labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions import rules as R
from quantloom.operators import ranks

MIN_DOMESTIC = 0.40
MIN_VIDEOS, MAX_VIDEOS = 50, 3000


def topic_shares(titles: DataFrame, key: str = "channel", min_share: float = MIN_DOMESTIC) -> DataFrame:
    """(key, n, kr, fo, topic_ok): share of titles with a domestic word and no foreign one, and with a foreign word."""
    t = titles.where("title is not null and title <> ''")
    g = t.groupBy(key).agg(F.count("*").alias("n"), F.avg(R.is_domestic_title("title").cast("double")).alias("kr"), F.avg(R.is_foreign_title("title").cast("double")).alias("fo"))
    return g.withColumn("topic_ok", (F.col("kr") >= min_share) & (F.col("fo") < F.col("kr")))


def select_sources(cands: DataFrame, titles: DataFrame, n: int = 10, min_videos: int = MIN_VIDEOS, max_videos: int = MAX_VIDEOS,
                   min_share: float = MIN_DOMESTIC, key: str = "channel") -> DataFrame:
    """Candidates by subscribers: status of each, the first n that pass are picked, the rest is not checked.

    The walk down the list is a cut at the n-th passing candidate, found with a top-k instead of a numbered scan.
    """
    d = cands.join(topic_shares(titles, key, min_share), key, "left").na.fill({"n": 0, "kr": 0.0, "fo": 0.0})
    status = (F.when(F.col("n") < min_videos, "too_few").when(F.col("n") > max_videos, "too_many").when(~F.coalesce("topic_ok", F.lit(False)), "off_topic").otherwise("picked"))
    d = d.withColumn("status", status)
    return _walked(d, n, key)


def _walked(d: DataFrame, n: int, key: str) -> DataFrame:
    """Rows behind the n-th picked one, by subscribers and key, are not checked."""
    passing = d.where("status = 'picked'").orderBy(F.col("subscribers").desc(), F.col(key)).limit(n)
    last = passing.agg(F.count("*").alias("k"), F.min("subscribers").alias("s"), F.max_by(key, F.struct(-F.col("subscribers"), F.col(key))).alias("c"))
    k, s, c = (last.select(x).scalar() for x in ("k", "s", "c"))
    beyond = (k >= n) & ((F.col("subscribers") < s) | ((F.col("subscribers") == s) & (F.col(key) > c)))
    return d.withColumn("status", F.when(beyond, "not_checked").otherwise(F.col("status")))


def select_channels(cands: DataFrame, videos: DataFrame, start, end, manual: DataFrame | None = None, n: int = 10, min_videos: int = MIN_VIDEOS, max_videos: int = MAX_VIDEOS,
                    min_share: float = MIN_DOMESTIC, min_seconds: int = 180, key: str = "channel") -> DataFrame:
    """(key, subscribers, listed, n, kr, fo, status, reason) of the candidates: walked by subscribers until n are picked, the rest `not_checked`.

    cands: (key, name, subscribers); those with an excluded word in the name or NULL subscribers leave. videos: (key, title, published, seconds): more than
    max_videos published in [start, end] is `too_many`; of them those longer than min_seconds count (NULL seconds: not), fewer than min_videos is `too_few`,
    their titles decide `off_topic`. manual: (key, reason), checked and never picked. Repeated candidates count once, the one with most subscribers.
    """
    c = cands.where(R.excluded_word("name").isNull() & F.col("subscribers").isNotNull()).groupBy(key).agg(F.max("subscribers").alias("subscribers"))
    inside = videos.where(F.col("published").between(start, end))
    shares = topic_shares(inside.where(F.coalesce(F.col("seconds"), F.lit(0)) > min_seconds), key, min_share)
    counts = inside.groupBy(key).agg(F.count("*").alias("listed"), F.count_if(F.coalesce(F.col("seconds"), F.lit(0)) > min_seconds).alias("_long"))
    d = c.join(counts, key, "left").join(shares.drop("n"), key, "left").na.fill({"listed": 0, "_long": 0, "kr": 0.0, "fo": 0.0}).withColumnRenamed("_long", "n")
    if manual is not None:
        d = d.join(manual.groupBy(key).agg(F.min("reason").alias("reason"), F.lit(True).alias("_out")), key, "left")
    else:
        d = d.withColumn("reason", F.lit(None).cast("string")).withColumn("_out", F.lit(None).cast("boolean"))
    status = (F.when(F.col("_out"), "manual_exclude").when(F.col("listed") > max_videos, "too_many").when(F.col("n") < min_videos, "too_few")
              .when(~F.coalesce("topic_ok", F.lit(False)), "off_topic").otherwise("picked"))
    return _walked(d.withColumn("status", status), n, key).select(key, "subscribers", "listed", "n", "kr", "fo", "status", "reason")


NAMES_AT_ONCE = 200_000
WORD_BEFORE = re.compile("[가-힣A-Za-z0-9]")


def mention_counts(docs: DataFrame, names: DataFrame, top: int = 6, doc: str = "doc_id") -> DataFrame:
    """(doc, code, n): six-digit known codes plus names of 3+ letters that do not continue a word, top-k per document.

    Names are found by an automaton of whole names, which reads a text once, whatever its length and the number of names. A dictionary of more than
    NAMES_AT_ONCE names is cut by a hash into parts of about that size, one pass over the texts each, so tasks and driver hold one part. Equal names of
    several codes count for each. NULL texts have no mentions.
    """
    dic = names.where("length(name) >= 3").groupBy("name").agg(F.collect_set("code").alias("codes"))
    parts = dic.count() // NAMES_AT_ONCE + 1
    part = F.pmod(F.xxhash64("name"), F.lit(parts))
    kind = docs.select(doc).schema[0]
    hits = [docs.select(doc, "text").mapInArrow(_finder([(r["name"], list(r["codes"])) for r in dic.where(part == i).collect()], doc), T.StructType([kind, T.StructField("code", T.StringType()), T.StructField("n", T.LongType())]))
            for i in range(parts)]
    codes = docs.select(doc, F.explode(F.regexp_extract_all("text", F.lit(r"(?<!\d)(\d{6})(?!\d)"), 1)).alias("code")).join(names.select("code").distinct(), "code", "left_semi")
    n = reduce(DataFrame.unionByName, [*hits, codes.select(doc, "code", F.lit(1).cast("long").alias("n"))]).groupBy(doc, "code").agg(F.sum("n").alias("n"))
    return ranks.top_k(n, [doc], [F.col("n").desc(), F.col("code")], top).drop("rn")


def _finder(entries: list[tuple[str, list[str]]], doc: str):
    """Arrow step: (doc, text) to (doc, code, n)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for name, codes in entries:
            found.add_word(name, (len(name), codes))
        if entries:
            found.make_automaton()
        for batch in batches:
            at, code, n = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist() if entries else ()):
                counts: Counter[str] = Counter()
                for end, (length, codes) in found.iter(text or ""):
                    begin = end + 1 - length
                    if not begin or not WORD_BEFORE.match(text[begin - 1]):
                        counts.update(codes)
                at += [i] * len(counts)
                code += counts.keys()
                n += counts.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(code, pa.string()), pa.array(n, pa.int64())], [doc, "code", "n"])

    return work


def anonymous_labels(ids: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Labels A, B, C … in an order hashed from the seed. `ids` is the short list of picked sources."""
    w = Window.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key))
    return ids.select(key, _letters(F.row_number().over(w)).alias("label"))


def _letters(n) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, 702 -> ZZ, 703 -> AAA …, as columns of a sheet are named."""
    digits = F.aggregate(F.array(*[F.lit(i) for i in range(6)]), F.struct(n.cast("long").alias("rest"), F.lit("").alias("text")), lambda a, _: F.when(
        a["rest"] > 0, F.struct(F.floor((a["rest"] - 1) / 26).cast("long").alias("rest"), F.concat(F.chr((a["rest"] - 1) % 26 + 65), a["text"]).alias("text"))).otherwise(a))
    return digits["text"]
