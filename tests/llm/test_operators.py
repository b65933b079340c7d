"""The operators for training text against brute-force restatements, on small tables with nulls, ties, copies and clashing columns."""

import hashlib
import random
import re
import struct

import numpy as np
import pytest

import corpus_pipeline
from quantloom.llm import edits, jaccard, mixing, packing, quality, repeats, seeds, store, suffixes, toxicity, url_rules, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = ["Ab", "ab", "cé", "dd", "e.", "ff", "漢字", "g#", "hh", "ii"] + [f"w{i}" for i in range(300)]
    passage = " ".join(r.choice(words) for _ in range(45))
    texts = []
    for i in range(n):
        body = [r.choice(words) for _ in range(r.choice([1, 2, 5, 40, 90, 400]))]
        if i % 4 == 0:
            at = r.randrange(len(body))
            body[at:at] = passage.split()
        texts.append(r.choice([" ", "\n", "\t "]).join(body))
        if i % 7 == 3:
            texts.append(texts[-1])
        if i % 9 == 5:
            texts.append(texts[-1] + " tail")
    texts += [None, "", " \n", "one", "one", "x " * 500, "two words", "long " * 20 + passage]
    return [(i, t, "en", f"s{i % 4}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def odd(spark):
    """Empty tables, null ids, repeated rows and columns whose names clash with those that operators use."""
    wide = SCHEMA + ", node long, pos int, n int, root string, shard string, payload string, copy boolean"
    extra = (7, 7, 7, "r", "s", "p", True)
    data = [(None, "a b c d", None, None, None, *extra), (1, None, None, None, None, *extra), (2, "a b c d", "en", "s", 7, *extra), (2, "a b c d", "en", "s", 7, *extra), (3, "", "en", "s", 0, *extra)]
    return spark.createDataFrame([], SCHEMA), spark.createDataFrame(data, wide)


def test_jaccard_equals_brute_force(docs, rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for k, percent in ((3, 90), (5, 80)):
        sets = {}
        for d, t, *_ in rows:
            w = WORD.findall((t or "").translate(lower))
            sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        label = {d: d for d in sets}
        changed = True
        while changed:
            changed = False
            for a in sets:
                for b in sets:
                    both = len(sets[a] & sets[b])
                    if a != b and both and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                        label[a] = label[b] = min(label[a], label[b])
                        changed = True
        got = {tuple(r) for r in jaccard.link_documents(docs, k, percent).collect()}
        assert got == {(d, len(sets[d]), label[d]) for d in sets}


def test_jaccard_near_copies_chain(spark):
    """A large group in which neighbours link, the ends do not, and none is an exact copy."""
    words = [f"v{i}" for i in range(400)]
    data = [(i, " ".join(words[i:i + 200]), None, None, None) for i in range(120)]
    got = jaccard.link_documents(spark.createDataFrame(data, SCHEMA)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_jaccard_near_the_threshold_equals_brute_force(spark):
    """Texts of many sizes cut from few bases with edits, so that overlaps lie on both sides of the threshold; some shingles stand in a third of them."""
    r = random.Random(21)
    texts = []
    for base in ([f"b{i}x{j}" for j in range(120)] for i in range(6)):
        for _ in range(25):
            lo = r.randrange(12)
            w = base[lo:lo + r.choice([30, 60, 100, 108])]
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"e{r.randrange(40)}"
            texts.append(" ".join(w + ["common", "tail", "of", "many", "texts"] * r.choice([0, 0, 1])))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for k, percent in ((3, 90), (5, 80), (2, 55)):
        sets = [{tuple(t.split()[i:i + k]) for i in range(len(t.split()) - k + 1)} for t in texts]
        label = list(range(len(sets)))
        for _ in sets:
            old = list(label)
            for a in range(len(sets)):
                for b in range(a):
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        label[a] = label[b] = min(label[a], label[b])
            if label == old:
                break
        got = {r["doc_id"]: r["component_id"] for r in jaccard.link_documents(docs, k, percent).collect()}
        assert got == dict(enumerate(label)) and len(set(label)) < len(label)


def test_jaccard_copies_that_do_not_link_meet_in_no_list(spark, monkeypatch):
    """A group in which all pairs share four fifths of their shingles and none links: its pairs are not made."""
    core = [f"c{i}" for i in range(120)]
    data = [(i, " ".join(core + [f"own{i}x{j}" for j in range(20)])) for i in range(80)]
    seen, stored = {}, store.stored
    monkeypatch.setattr(jaccard.store, "stored", lambda df, name: seen.setdefault(name, []).append(stored(df, name)) or seen[name][-1])
    monkeypatch.setattr(jaccard.store, "drop", lambda *tables: None)
    out = jaccard.link_documents(spark.createDataFrame(data, "doc_id long, text string"), 5, 80).collect()
    assert all(r["component_id"] == r["doc_id"] for r in out)
    assert [t.count() for t in seen["open"]] == [0]


def test_jaccard_tries_the_middle_of_a_family(spark, monkeypatch):
    """Every copy links to the base and no two copies to each other: the base is tried, whatever its name, so no pair is left for the second round."""
    base = [f"c{i}" for i in range(200)]
    data = [(0, " ".join(base))] + [(i, " ".join([*base[:i], f"own{i}", *base[i + 1:]])) for i in range(10, 190, 6)]
    seen, stored = {}, store.stored
    monkeypatch.setattr(jaccard.store, "stored", lambda df, name: seen.setdefault(name, []).append(stored(df, name)) or seen[name][-1])
    monkeypatch.setattr(jaccard.store, "drop", lambda *tables: None)
    out = jaccard.link_documents(spark.createDataFrame(data, "doc_id long, text string"), 5, 95).collect()
    assert {r["component_id"] for r in out} == {0}
    assert [t.count() for t in seen["pairs"]] == [len(data) - 1, 0]


def test_jaccard_rarity_counts_every_document(docs, rows):
    total = np.zeros(1 << jaccard.SKETCH_BITS)
    for _, t, *_ in rows:
        b = (t or "").encode()
        total += np.bincount(jaccard._slots(jaccard.shingle_sets(np.frombuffer(b, dtype=np.uint8), np.array([0, len(b)]), 3)[0]), minlength=len(total))
    assert (jaccard._frequencies(docs, 3) == (np.log1p(total) * 2000).astype(np.uint16)).all()


def test_word_repeats_equal_brute_force(docs, rows):
    seen, want = set(), set()
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i:i + 20])
            if key in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(key)
        want.add((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = repeats.cut_repeats(docs).collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got} == want
    assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in got)


def test_byte_repeats_equal_brute_force(docs, rows):
    seen, want = {}, set()
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if seen.setdefault(b[i:i + 50], d) < d:
                gone[i:i + 50] = b"\1" * 50
        want.add((d, len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g)))
    got = suffixes.cut_suffixes(docs).collect()
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got} == want


def test_repeats_under_null_and_shared_ids(spark):
    """Different long texts under one id or none, of unequal length, that share a passage with each other and with other ids."""
    r = random.Random(8)
    fresh = lambda n: " ".join(f"q{r.randrange(10**9)}" for _ in range(n))
    shared, late = fresh(40), fresh(30)
    data = [(None, fresh(300) + " " + shared), (None, shared + " " + fresh(5)), (None, fresh(25)), (4, fresh(10) + " " + shared + " " + fresh(200) + " " + late), (4, late + " " + fresh(3)),
            (4, late + " " + fresh(3)), (4, fresh(60)), (9, fresh(50) + " " + late), (9, late), (None, fresh(2))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for k, length, cut, units in ((0, 20, repeats.cut_repeats, lambda t: t.split()), (1, 50, suffixes.cut_suffixes, lambda t: list(t.encode()))):
        first, want = {}, []
        place = lambda d, i: (-1 if d is None else d, 0 if k else i)
        for d, t in data:
            u = units(t)
            for i in range(len(u) - length + 1):
                w = tuple(u[i:i + length])
                first[w] = min(first.get(w, place(d, i)), place(d, i))
        for d, t in data:
            u = units(t)
            gone = set()
            for i in range(len(u) - length + 1):
                if place(d, i) > first[tuple(u[i:i + length])]:
                    gone.update(range(i, i + length))
            left = [x for i, x in enumerate(u) if i not in gone]
            want.append((-1 if d is None else d, len(u), len(gone), bytes(left) if k else " ".join(left)))
        got = [(x["doc_id"], x[1], x["n_removed"], bytes(x["kept"]) if k else x["kept"]) for x in cut(docs).collect()]
        assert sorted(got) == sorted(want)
        keyed = cut(docs.withColumn("key", repeats.F.xxhash64("text", "doc_id")), row_col="key")
        assert keyed.columns[:2] == ["key", "doc_id"]


def test_best_fit_against_plain_search():
    r = random.Random(4)
    lengths = np.array([r.randint(1, 64) for _ in range(500)])
    which, offset = packing.best_fit_decreasing(lengths, 64)
    rooms = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [x for x in rooms if x >= lengths[i]]
        room = min(fits) if fits else 64
        if fits:
            rooms.remove(room)
        assert offset[i] == 64 - room
        rooms.append(room - lengths[i])
    assert len(rooms) == which.max() + 1


def test_packing_keeps_every_id(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    model.encode_special_tokens = True
    got = packing.pack(docs, window=128, shard=40).collect()
    back, places = {}, {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(back.get(r["doc_id"], [])) and r["length"] == len(r["ids"]) <= 128
        back[r["doc_id"]] = back.get(r["doc_id"], []) + r["ids"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert back == {d: [*model.encode(t or "", add_special_tokens=False).ids, 2] for d, t, *_ in rows}
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128


def test_packing_of_special_strings_is_the_plain_call(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    text = "one <|startoftext|> two <|endoftext|>three"
    want = [*model.encode(text, add_special_tokens=False).ids, 2]
    model.encode_special_tokens = True
    assert want != [*model.encode(text, add_special_tokens=False).ids, 2]
    assert [r["ids"] for r in packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == [want]


def test_mix_meets_targets_and_is_stable(docs):
    out = mixing.with_copies(docs).collect()
    per = {}
    for r in out:
        assert 0 <= r["__copies"] <= 2
        words, target, taken, longest = per.get(r["source"], (0, 0, 0, 0))
        per[r["source"]] = (r["__words"], r["__target"], taken + r["__copies"] * r["__size"], max(longest, r["__size"]))
    for words, target, taken, longest in per.values():
        assert target <= 2 * words and abs(taken - target) <= 2 * longest
    assert abs(sum(t for _, t, _, _ in per.values()) - 1.5 * sum(w for w, *_ in per.values())) < 1e-6
    assert sorted((r["doc_id"], r["__copies"]) for r in out) == sorted((r["doc_id"], r["__copies"]) for r in mixing.with_copies(docs.repartition(2)).collect())


def test_warc_round_trip(spark):
    data = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "z" * 400_000), (6, "u", "\r\n\r\n"), (None, "u", "only")]
    data += [(i, f"http://h/{i}", f"body {i % 50}" * 40) for i in range(100, 400)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    index = warc.write(pages, store.fresh(spark, "warc"))
    got = {r["page_id"]: r for r in warc.read(index).collect()}
    assert len(got) == len(data)
    best = {}
    for p, _, h in data:
        best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
    for p, _, h in data:
        first = best[h or ""] == (-1 if p is None else p)
        r = got[p]
        assert r["record_type"] == ("response" if first else "revisit") and r["refers_to"] == (None if first else best[h or ""])
        assert r["payload"] == ((h or "") if first else None) and r["payload_bytes"] == len((h or "").encode())
        assert r["payload_digest"] == warc._digest((h or "").encode())
    path = index.first()["bundle"]
    files, local = warc._store(path)
    frames = warc.seek_table(files, local)
    with files.open_input_file(local) as f:
        assert struct.unpack("<I", f.read_at(4, frames[-1][0] + frames[-1][1]))[0] == warc.SKIPPABLE
    kept = warc.read(warc.write(pages, store.fresh(spark, "warc"), min_bytes=100)).collect()
    assert {r["record_type"] for r in kept if r["payload_bytes"] < 100} == {"response"}


def test_quality_measures_and_em(docs, rows):
    got = {r["doc_id"]: r for r in quality.assess(docs).collect()}
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    start, adds = quality.fit([((1, 1, 1), 900), ((-1, -1, 0), 100)], ["a", "b", "c"])
    assert start > 0 and adds["a"][1] > 0 > adds["a"][-1]


def test_fingerprints(docs, rows):
    got = {r["doc_id"]: r for r in edits.fingerprints(docs).collect()}
    text = {d: t or "" for d, t, *_ in rows}
    order = sorted(text)
    for i, d in enumerate(order):
        changed = edits.edited(text[d], text[order[(i + 1) % len(order)]])
        assert got[d]["n_chars"] == len(text[d]) and got[d]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert got[d]["fingerprint"] == edits.embed([text[d]])[0].tobytes().hex()
        assert got[d]["edited_fingerprint"] == edits.embed([changed])[0].tobytes().hex()
    long = [d for d in order if len(text[d]) > 500]
    assert np.mean([got[d]["near_edited"] for d in long]) > 0.6


def test_fingerprints_survive_edits_and_pair_up(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh ijkl") for _ in range(2000)) for _ in range(6)]
    data = [(i, t, None, None, None) for i, t in enumerate(base)] + [(10 + i, t[:700] + "XY" + t[700:], None, None, None) for i, t in enumerate(base)]
    prints = edits.fingerprints(spark.createDataFrame(data, SCHEMA))
    assert {(p["a"], p["b"]) for p in edits.near_pairs(prints).collect()} == {(i, 10 + i) for i in range(6)}


def test_near_documents_behind_leaders_that_are_not_near(spark, monkeypatch):
    """Each bucket that two near documents share is led by a smaller id that is near to neither; groups against all pairs of a bucket."""
    r = np.random.default_rng(5)
    make = lambda: r.integers(1, 256, edits.LANES).astype(np.uint8)
    b = make()
    c = b.copy()
    c[-8:] = make()[-8:]
    codes = []
    for k in range(32):
        x = make()
        x[4 * k:4 * k + 4] = b[4 * k:4 * k + 4]
        codes.append(x)
    codes += [b, c, c]
    base = make()
    for _ in range(60):  # a family on both sides of the threshold
        x = base.copy()
        at = r.choice(edits.LANES, r.integers(10, 50), replace=False)
        x[at] = make()[at]
        codes.append(x)
    codes = np.array(codes)
    prints = spark.createDataFrame([(i, x.tobytes().hex()) for i, x in enumerate(codes)] + [(None, b.tobytes().hex())], "doc_id long, fingerprint string")
    label = list(range(len(codes)))
    for i in range(len(codes)):
        for j in range(i):
            if label[i] != label[j] and (codes[i] == codes[j]).reshape(32, 4).all(axis=1).any() and edits.likeness(codes[i:i + 1], codes[j:j + 1])[0] >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert label[33] == label[34] == 32 and len(set(label[35:])) > 1
    for cell in (edits.CELL, 4):
        monkeypatch.setattr(edits, "CELL", cell)
        assert {(x["doc_id"], x["near_group"]) for x in edits.near_groups(prints).collect()} == {*enumerate(label), (None, 32)}
    pairs = {(x["a"], x["b"]) for x in edits.near_pairs(prints).collect()}
    assert {(32, 33), (33, 34)} <= pairs


def test_sketches_rule_out_far_pairs_and_no_near_one():
    r = np.random.default_rng(8)
    a = r.integers(1, 256, (4000, edits.LANES)).astype(np.uint8)
    a[np.arange(edits.LANES) >= r.integers(1, edits.LANES + 1, len(a))[:, None]] = 0
    b = np.where(r.random(a.shape) < r.random(len(a))[:, None] * 0.6, r.integers(0, 256, a.shape), a).astype(np.uint8)
    for threshold in (0.0, 0.5, 0.8, 1.0):
        near, may = edits.likeness(a, b) >= threshold, edits.may_be_near(*edits.sketch(a), *edits.sketch(b), threshold)
        assert may[near].all() and near.any()
    full = r.integers(1, 256, (4000, edits.LANES)).astype(np.uint8)
    assert edits.may_be_near(*edits.sketch(full), *edits.sketch(full[::-1]), 0.8).mean() < 0.01


def test_far_documents_of_a_bucket_are_dropped_before_fingerprints_travel(spark, monkeypatch):
    """Six hundred far documents share a bucket, two of them are near; few others meet as whole fingerprints."""
    r = np.random.default_rng(9)
    codes = r.integers(1, 256, (600, edits.LANES)).astype(np.uint8)
    codes[:, :4] = 7
    codes[500, 8:] = codes[400, 8:]
    sizes, stored = {}, store.stored
    monkeypatch.setattr(store, "stored", lambda df, name: sizes.setdefault(name, []).append(out := stored(df, name)) or out)
    monkeypatch.setattr(store, "drop", lambda *tables: None)
    prints = spark.createDataFrame([(i, x.tobytes().hex()) for i, x in enumerate(codes)], "doc_id long, fingerprint string")
    got = {x["doc_id"]: x["near_group"] for x in edits.near_groups(prints).collect()}
    assert got == {i: 400 if i == 500 else i for i in range(600)}
    assert sizes["tries"][0].count() < 20 and sizes["sides"][0].count() < 200  # of 600


def test_network_learns_a_phrase():
    texts = [" ".join(["good", "day", "word", "other"][(i + j) % 4] for j in range(40)) for i in range(60)]
    toxic = np.array([i % 2 for i in range(60)])
    texts = [t + " nasty thing" if y else t for t, y in zip(texts, toxic)]
    net, slope, shift = toxicity.fit(texts * 6, np.tile(toxic, 6), 0.5)
    raw = [t.encode() for t in ["good day other", "good nasty thing day"]]
    doc, logits = toxicity.window_logits(net, np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    p = toxicity._sigmoid(slope * toxicity.highest(doc, logits, 2, 0.0) + shift)
    assert p[0] < 0.5 < p[1]


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([(r["score"] >= 0.5) == bool(r["toxic"]) for r in got]) > 0.85


def test_fit_in_chunks(monkeypatch):
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(30 + i)) + (" vile" if i % 2 else "") for i in range(40)] + ["", "x" * 5000]
    toxic = np.array([i % 2 for i in range(42)])
    whole = toxicity.fit(texts, toxic, 0.5)
    monkeypatch.setattr(toxicity, "CHUNK", 300)
    pieces = toxicity.fit(texts, toxic, 0.5)
    assert abs(whole[1] - pieces[1]) < 0.05 and abs(whole[2] - pieces[2]) < 0.05


def test_fit_takes_passages_of_long_texts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, share: seen.update(zip(texts, toxic)))
    long, heavy = " ".join(f"n{i}" for i in range(9000)), "y" * (toxicity.LONGEST + 1)
    docs = spark.createDataFrame([(1, long), (2, "short text"), (3, heavy), (4, None), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (None, 1)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    cut = next(t for t in seen if t.startswith("n0 ")).split(" ")
    assert set(seen) == {"short text", "", " ".join(cut)} and len(cut) == toxicity.PASSAGES * toxicity.WINDOW and cut[-1] == "n8999"


def test_toxicity_on_rows_not_fitted(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").join(labels.select("doc_id"), "doc_id", "left_semi")
    held = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"
    got = toxicity.score(docs, toxicity.train(docs, labels.where(f"not ({held})"))).join(labels, "doc_id").where(held).toPandas()
    bad, rank = got["toxic"].to_numpy() == 1, got["score"].rank().to_numpy()
    area = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    hits = (got["score"].to_numpy() >= 0.5) & bad
    right = np.mean((got["score"].to_numpy() >= 0.5) == bad)
    assert area > 0.93 and hits.sum() / bad.sum() > 0.7 and right > 0.02 + max(np.mean(bad), np.mean(~bad))


def test_url_rules(spark):
    data = [(1, "http://A.Example.net/en/x?q"), (2, "http://b.net/de/"), (3, "http://example.com/de/1"), (4, "https://x.org/fr/#a"), (5, None), (6, "no scheme"), (7, "http://notexample.com")]
    got = {r["page_id"]: r for r in url_rules.filter_urls(spark.createDataFrame(data, "page_id long, url string").withColumn("tokens", url_rules.F.lit(1))).collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in (1, 2, 3, 4)] == [("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    assert got[5]["host"] == got[6]["host"] == got[5]["path"] == "" and got[7]["rule"] is None


def test_odd_tables(spark):
    empty, wide = odd(spark)
    pages = lambda d: d.selectExpr("doc_id AS page_id", "text AS url", "text AS html", "n_chars AS size")
    model = toxicity.fit([], np.zeros(0), 0.0)
    for run in (
        jaccard.link_documents, repeats.cut_repeats, suffixes.cut_suffixes, lambda d: packing.pack(d), mixing.with_copies, quality.assess, edits.fingerprints,
        lambda d: toxicity.score(d, model), lambda d: url_rules.filter_urls(pages(d)), lambda d: warc.read(warc.write(pages(d), store.fresh(spark, "warc"))),
    ):
        assert run(empty).count() == 0
        assert run(wide).count() == wide.count()


def test_pipeline_stages(spark, docs, rows):
    stages, current = dict(corpus_pipeline.STAGES), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = store.stored(stage(spark, current, ""), name)
        assert current.columns == docs.columns
    empty, wide = odd(spark)
    for stage in stages.values():
        assert stage(spark, empty, "").count() == 0
        stage(spark, wide, "").count()
    near = [r["doc_id"] for r in stages["near_duplicates"](spark, docs, "").collect()]
    assert sorted(near) == sorted({r["component_id"] for r in jaccard.link_documents(docs, 5, 80).collect()})
    cut = {r["doc_id"]: r["text"] for r in stages["passages"](spark, docs, "").collect()}
    for r in repeats.cut_repeats(docs).collect():
        source = dict((d, t) for d, t, *_ in rows)[r["doc_id"]]
        assert cut.get(r["doc_id"]) == (source if not r["n_removed"] else r["kept"] or None)


def test_passages_stage_stores_the_texts_once(spark, monkeypatch):
    import corpus_pipeline

    made, stored = [], corpus_pipeline.store.stored
    monkeypatch.setattr(corpus_pipeline.store, "stored", lambda df, name: made.append((name, "text" in df.columns)) or stored(df, name))
    docs = spark.createDataFrame([(1, "a b", "x", 7), (2, None, "y", None), (None, "", "z", 0)], "doc_id int, text string, `odd name` string, n_chars int")
    out = dict(corpus_pipeline.STAGES)["passages"](spark, docs, "")
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a b", "x", 3), (2, None, "y", None), (None, "", "z", 0)], key=str)
    assert [name for name, text in made if text] == ["marked"]


def test_quality_and_near_duplicates_store_no_text(spark, docs, monkeypatch):
    made, stored = [], store.stored
    monkeypatch.setattr(store, "stored", lambda df, name: made.append((name, df.schema.simpleString())) or stored(df, name))
    for name in ("quality", "near_duplicates"):
        dict(corpus_pipeline.STAGES)[name](spark, docs, "").count()
    assert {"quality", "grouped", "picked"} <= {name for name, _ in made} and not [x for x in made if "text:" in x[1]]


def test_near_duplicates_takes_one_of_equal_rows(spark):
    words = " ".join(f"w{i}" for i in range(60))
    data = [(2, words, "a", [1]), (2, words, "b", [2]), (None, words + " x", "c", None), (None, "y " + words.upper(), "d", None), (4, "\t", "e", None), (4, None, "f", None)]
    docs = spark.createDataFrame(data, "doc_id int, text string, text_name string, many array<int>")
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    got = sorted(map(tuple, out.collect()), key=str)
    assert out.schema == docs.schema and len(got) == 3 and got[1:] == sorted(data[4:], key=str) and got[0] in data[:2]


def test_anchors_that_stand_once_are_never_stored(docs, monkeypatch):
    made, stored = {}, store.stored
    monkeypatch.setattr(store, "stored", lambda df, name: made.setdefault(name, df.columns) and stored(df, name))
    for run in (suffixes.cut_suffixes, repeats.cut_repeats):
        made.clear()
        run(docs)
        assert "shared" in made and not [name for name, columns in made.items() if "anchor" in columns and "around" in columns]


def test_anchors_travel_packed(spark, monkeypatch):
    """A document full of one byte, parts that get nothing, anchors known in their chunk: rows as by brute force, and no row for each anchor before they are known to repeat."""
    r = random.Random(9)
    data = [(1, "x" * 400), (2, " ".join(f"q{r.randrange(10**9)}" for _ in range(400))), (3, "y" + "x" * 90 + "z"), (4, "short")] + [(d, f"{d} " + "x" * 60 + f"{r.random()}" * 3) for d in range(5, 9)]
    monkeypatch.setattr(seeds, "PIECE", 100)
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(2)
    rows = docs.select("doc_id", "text", repeats.F.col("doc_id").alias("row"))
    dealt = seeds.anchors(rows, seeds.byte_units, 16, 50, 5).collect()
    assert sum(len(x["anchor"]) // 8 for x in dealt if not x["known"]) > 200 > 4 * len(dealt) and all(len(x["row"]) <= 800 for x in dealt if x["known"])
    assert len({(x["part"], y) for x in dealt for y in (x["anchor"][i:i + 8] for i in range(0, len(x["anchor"]), 8))}) == len({y for x in dealt for y in (x["anchor"][i:i + 8] for i in range(0, len(x["anchor"]), 8))})
    first, want = {}, set()
    for d, t in data:
        gone = set()
        for i in range(len(t) - 49):
            if first.setdefault(t[i:i + 50], d) < d:
                gone.update(range(i, i + 50))
        want.add((d, len(gone), "".join(x for i, x in enumerate(t) if i not in gone)))
    assert {(x["doc_id"], x["n_removed"], bytes(x["kept"]).decode()) for x in suffixes.cut_suffixes(docs).collect()} == want and any(n for _, n, _ in want)


def test_pipeline_rows_with_null_and_repeated_ids(spark):
    r = random.Random(6)
    fresh = lambda n, k=10**6: " ".join(f"word{r.randrange(k)}" for _ in range(n))
    a, b, c, shared = fresh(80), fresh(80), fresh(80), fresh(30)
    stages = dict(corpus_pipeline.STAGES)
    frame = lambda data: spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in data], SCHEMA).repartition(3)
    got = lambda stage, data: sorted(((x["doc_id"], x["text"]) for x in stages[stage](spark, frame(data), "").collect()), key=str)
    good = ". ".join(" ".join(f"plain{r.randrange(10**6)}" for _ in range(9)) for _ in range(20)) + ".\nNext line, as plain as that."
    data = [(None, good), (1, good + " More."), (1, "x"), (1, good + " More."), (None, None)]
    judged = {x["text"]: x["kept"] for x in quality.assess(frame(data), keep=("text",)).collect()}
    assert judged[good] and not judged["x"]
    assert got("quality", data) == sorted([x for x in data if judged[x[1]]], key=str)
    data = [(None, a), (None, a + " tail"), (None, b), (5, b + " tail"), (5, c), (7, c), (7, c + " tail"), (8, ""), (8, ""), (None, None)]
    assert got("near_duplicates", data) == sorted([(None, a), (5, b + " tail"), (5, c), (8, ""), (8, ""), (None, None)], key=str)
    near = [(6, a + " tail"), (6, a), (6, b)]
    assert got("near_duplicates", near) == sorted([(6, a), (6, b)], key=str)
    head, end = fresh(4), fresh(3)
    data = [(None, shared + " " + head), (None, end + " " + shared), (3, b + " " + shared), (3, b + " " + shared), (3, c), (4, shared)]
    assert got("passages", data) == sorted([(None, shared + " " + head), (None, end), (3, b), (3, b), (3, c)], key=str)
