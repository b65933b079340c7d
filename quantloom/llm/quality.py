"""Quality of documents by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm import store

SYMBOLS = "[#*$%&|<>]"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words inside a three-word window that the same text has twice or more (its first occurrence included).

    Windows are compared by 64-bit hash. A primitive sort tells whether any hash repeats; only then are places sorted along.
    """
    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    )

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def same(s: Column) -> Column:
            twins = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(twins, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(placed, same))

    return F.coalesce(_let(windows, covered), F.lit(0)).cast("bigint")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts per document that the rules read, over whole texts; a null text counts as empty.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words, and n_lines (lines with a word), n_upper, n_letters, n_stops (sentence ends),
    n_marks (exclamation marks). Long values. Other columns are dropped, except those named in `keep`.
    """
    text = F.col("__text")
    words = F.regexp_extract_all(text, F.lit(store.WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(store.WORD)))
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("bigint")
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"), *keep)
        .withColumn("__words", words)
        .withColumn("__lines", lines)
        .select(
            "doc_id",
            F.size("__words").cast("bigint").alias("n_words"),
            F.length(F.regexp_replace(text, store.SPACE + "+", "")).cast("bigint").alias("word_chars"),
            count(SYMBOLS).alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
            repeated_words(F.col("__words")).alias("n_repeat_words"),
            F.size("__lines").cast("bigint").alias("n_lines"),
            count(r"\p{Lu}").alias("n_upper"),
            count(r"\p{L}").alias("n_letters"),
            count(r"[.!?\x{3002}]").alias("n_stops"),
            count("!").alias("n_marks"),
            *keep,
        )
    )


def _vote(good: Column, bad: Column) -> Column:
    """1 for good, -1 for bad, 0 (also where a measure is undefined) to abstain."""
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))




def rules() -> dict[str, Column]:
    symbols, upper, repeats, dups = _share("n_symbols", "n_words"), _share("n_upper", "n_letters"), _share("n_repeat_words", "n_words"), _share("n_dup_lines", "n_lines")
    length, stops, marks, letters = _share("word_chars", "n_words"), _share("n_stops", "n_words"), _share("n_marks", "n_words"), _share("n_letters", "word_chars")
    dense = _share("n_symbols", "word_chars")
    return {
        "size": _vote(F.col("n_words") >= 50, F.col("n_words") < 20),
        "word_length": _vote((length >= 3) & (length <= 10), (length < 2) | (length > 14)),
        "symbols": _vote(symbols < 0.05, symbols > 0.2),
        "upper_case": _vote(upper < 0.2, upper > 0.5),
        "repeated_words": _vote(repeats < 0.2, repeats > 0.4),
        "repeated_lines": _vote((dups < 0.1) & (F.col("n_lines") > 1), dups > 0.3),
        "sentences": _vote((stops > 0.01) & (stops < 0.3), (stops > 0.6) | (stops < 0.002)),
        "exclamations": _vote(marks < 0.05, marks > 0.2),
        "letters": _vote(letters > 0.92, letters < 0.75),
        "symbols_in_words": _vote(dense < 0.01, dense > 0.03),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 60, prior: float = 0.8, smooth: float = 1.0) -> tuple[float, dict[str, dict[int, float]]]:
    """Weights of the votes by expectation-maximisation over (votes, number of documents).

    The hidden class is good or bad. A rule's accuracies are its vote probabilities given either class, with `smooth` added to every count. It starts by blaming
    one good document in twenty and two bad ones in five: a bad document is bad in some way, not in all. A rule that came to vote against its own meaning gets no weight. Returns the log odds of good before any vote and, per rule, what a vote adds;
    abstaining adds nothing. Without documents the starting values are returned.
    """
    right = {1: {1: 0.95, -1: 0.05}, -1: {1: 0.6, -1: 0.4}}
    rates = [{y: dict(right[y]) for y in (1, -1)} for _ in names]
    total = sum(n for _, n in patterns)

    def odds(votes):
        return math.log(prior / (1 - prior)) + sum(math.log(r[1][v] / r[-1][v]) for r, v in zip(rates, votes, strict=True) if v)

    for _ in range(rounds if total else 0):
        good = [1 / (1 + math.exp(-max(-500.0, min(500.0, odds(votes))))) for votes, _ in patterns]
        weight = {1: [g * n for g, (_, n) in zip(good, patterns, strict=True)], -1: [(1 - g) * n for g, (_, n) in zip(good, patterns, strict=True)]}
        prior = (sum(weight[1]) + smooth) / (total + 2 * smooth)
        for k, r in enumerate(rates):
            for y in (1, -1):
                count = {v: smooth * right[y][v] + sum(w for w, (votes, _) in zip(weight[y], patterns, strict=True) if votes[k] == v) for v in (1, -1)}
                r[y] = {v: c / (count[1] + count[-1]) for v, c in count.items()}
    adds = {name: {v: math.log(r[1][v] / r[-1][v]) for v in (1, -1)} for name, r in zip(names, rates, strict=True)}
    adds = {name: {1: max(0.0, x[1]), -1: min(0.0, x[-1])} for name, x in adds.items()}
    return math.log(prior / (1 - prior)), adds


def judged(measured: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds `posterior`, `base_failed` and `kept`. The driver sees only the counts of vote patterns: at most 3 ** rules rows, whatever the input."""
    votes = rules()
    names = list(votes)
    voted = measured.withColumns({f"__v_{k}": c for k, c in votes.items()})
    seen = voted.groupBy(*[f"__v_{k}" for k in names]).agg(F.count(F.lit(1)).alias("n")).collect()
    start, adds = fit(sorted((tuple(r[f"__v_{k}"] for k in names), r["n"]) for r in seen), names)
    odds = F.lit(start)
    for k in names:
        odds = odds + F.when(F.col(f"__v_{k}") == 1, F.lit(adds[k][1])).when(F.col(f"__v_{k}") == -1, F.lit(adds[k][-1])).otherwise(F.lit(0.0))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & (F.col("posterior") >= threshold))
        .drop(*[f"__v_{k}" for k in names])
    )


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: measures, base_failed, posterior (probability of good) and kept.

    Measures are written to the shared folder once and read for the fit and for the result. Null or empty text: zero counts, base_failed, not kept. Repeated
    rows are judged each. An empty table gives an empty table. Extra columns are ignored, except those named in `keep`.
    """
    return judged(store.stored(measures(docs, id_col, text_col, keep), "quality"), threshold)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    out = assess(store.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
