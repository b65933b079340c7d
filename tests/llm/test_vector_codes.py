import hashlib
import math
import random

import pytest

from quantloom.llm import vector_codes as V
from tests.conftest import SF


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (vec_id, vector, label). Plain Python after the contract."""
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    first = [v for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    wide = len(first[0]) // parts
    cut = lambda v: [tuple(v[p * wide:(p + 1) * wide]) for p in range(parts)]
    books = [[cut(v)[p] for v in first] for p in range(parts)]
    vectors = [cut(v) for _, v, _ in kept]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in vectors:
                groups.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k])) if k in groups else e for k, e in enumerate(books[p])]
    out, by_label = [], {}
    for (i, _, lab), v in zip(kept, vectors):
        found = [near(v[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, lab))
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [(i, code, error, by_label[lab], digest) for i, code, error, lab in out], digest


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) if x is not None else (True, 0) for x in r))


def run(spark, rows, monkeypatch=None, **opts):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "label as code", "vec_id as salt", "'k' as key", "1 as ids").repartition(3)
    coded, books = V.compress(table, **opts)
    made = V.with_label_error(V.store.stored(coded, "coded")).collect()
    text = ",".join(str(c) for r in books.orderBy("part", "entry").collect() for c in r["components"])
    digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
    return [(r["vec_id"], r["code"].hex(), r["error"], r["label_error"], digest) for r in made]


def test_query_equals_brute_force(spark):
    data = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = [tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in V.op12_vector_codes(spark, SF).collect()]
    assert order(got) == order(brute(data)[0])


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 7)
    rnd = random.Random(2)
    f = lambda: float(rnd.choice([rnd.randrange(-40, 40) / 4096, rnd.randrange(-3, 3)]))
    data = [(i, [f() for _ in range(16)], rnd.choice([None, 1, 2, 2, 2])) for i in range(60)]
    data += [(5, [f() for _ in range(16)], 2), (None, [f() for _ in range(16)], 3), (None, [f() for _ in range(16)], None)]  # repeated and null ids
    data += [(61, None, 1), (62, [], 1), (63, [None] + [0.0] * 15, 1), (64, [float("nan")] + [0.0] * 15, 1), (65, [float("-inf")] + [0.0] * 15, None)]
    data += [(70, [0.5] * 16, 1)] * 30  # copies, and ties between entries
    got = run(spark, data)
    assert len(got) == 93 and order(got) == order(brute(data)[0])
    few = data[:5] + data[-3:]
    assert order(run(spark, few)) == order(brute(few)[0])


def test_nothing_kept(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1), (2, [float("inf")], None)]) == []


def test_faults_are_named(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, [1.0] * 9, 1)])
    with pytest.raises(Exception, match="components"):
        run(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)])
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [1.0] * 8, 1), (2, [1e30] * 8, 1)])
    with pytest.raises(ValueError):
        V.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), entries=300)
