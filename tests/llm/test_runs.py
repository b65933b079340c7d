import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quantloom.llm import runs as R
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """All runs by trying every period: stretches of words equal those q further on, least period first."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def periodic(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(60):
        kind, vocab = rnd.randrange(6), rnd.choice([1, 2, 3, 9, 400])
        words = [rnd.randrange(vocab) for _ in range(rnd.randrange(1, 160))]
        if kind == 1:
            words = words + words[: rnd.randrange(1, 40)] * rnd.randrange(2, 5) + words
        if kind == 2:
            fib = [[0], [1]]
            while len(fib[-1]) < 150:
                fib.append(fib[-1] + fib[-2])
            words = fib[-1][rnd.randrange(9):] + words
        if kind == 3:
            words = [bin(i).count("1") % 2 for i in range(rnd.randrange(20, 400))] + words
        out.append(words)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    docs = texts(seed)
    first = np.r_[0, np.cumsum([len(d) for d in docs])]
    s, e, q = R.find_runs(np.array([w for d in docs for w in d], dtype=np.int64), first, 12 if seed % 2 else 4)
    got = [[] for _ in docs]
    for a, b, c in zip(s.tolist(), e.tolist(), q.tolist()):
        i = int(np.searchsorted(first, a, side="right")) - 1
        got[i].append((a - int(first[i]), b - a, c))
    assert got == [brute(d, 12 if seed % 2 else 4) for d in docs]


def test_one_word_a_hundred_thousand_times():
    s, e, q = R.find_runs(np.zeros(100_000, dtype=np.int64), np.array([0, 100_000]))
    assert (s.tolist(), e.tolist(), q.tolist()) == ([0], [100_000], [1])


def test_thue_morse_where_hashes_may_fail():
    words = np.array([i.bit_count() % 2 for i in range(1 << 13)], dtype=np.int64)
    a = R.find_runs(words, np.array([0, len(words)]), 4)
    for s, e, q in zip(*(c.tolist() for c in a)):
        assert (words[s:e - q] == words[s + q:e]).all() and (s == 0 or words[s - 1] != words[s - 1 + q]) and (e == len(words) or words[e] != words[e - q])
    small = words[:700].tolist()
    s, e, q = R.find_runs(words[:700], np.array([0, 700]), 4)
    assert [(x, y - x, z) for x, y, z in zip(s.tolist(), e.tolist(), q.tolist())] == brute(small, 4)


def test_exact_matches_equal_hashed():
    rnd = np.random.default_rng(4)
    words = rnd.integers(0, 2, 3000)
    a, b = rnd.integers(500, 2500, 400), rnd.integers(500, 2500, 400)
    bound = rnd.integers(0, 500, 400)
    for step in (1, -1):
        assert (R.Matches(words).ahead(a, b, bound, step) == R.Matches(words, exact=True).ahead(a, b, bound, step)).all()


def test_odd_table(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK_BYTES", 300)  # texts above a chunk, several chunks
    line = "a b c\x1cd  é\n"
    data = [(None, "x " * 30, "r"), (1, None, "r"), (2, "", None), (2, " \n\t", "q"), (3, line * 9, "r"), (3, line * 9, "r"), (4, "one two", "r"), (5, " ".join(str(i % 7) for i in range(2000)), "r")]
    docs = spark.createDataFrame(data, "doc_id long, text string, runs string").selectExpr("*", "1 as n_words", "2 as collapsed")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in R.periodic_runs(docs).collect())
    want = []
    for i, t, _ in data:
        words = WORD.findall(t or "")
        found = brute(words)
        want.append(((i is None, i or 0), len(words), found, collapsed(words, found)))
    assert got == sorted(want)
    assert R.periodic_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in R.op13_runs(spark, SF).collect()}
    assert got.keys() == docs.keys()
    some = 0
    for i, text in docs.items():
        words = periodic(i, WORD.findall(text or ""))
        if len(words) > 2500:
            continue
        found, r = brute(words), got[i]
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
        some += bool(found)
    assert some > 5
