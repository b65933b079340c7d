import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantloom.llm import bpe
from tests.conftest import SF

PATH = public_tokenizers.path(bpe.TOKENIZER)
ODD = [
    "", "   ", "Straße İstanbul é 안녕하세요 12³ <|endoftext|>foo  ...!?", "x<|startoftext|>  <|endoftext|>y<|endof", "ΑΣ ΑΣ<|endoftext|>Σ",
    "a\x1cb\x1d c\x1e", "it's they'll 'S", "é ́a", "aaaab aaa aa aaaaa", "\x00 x y\u0085z ﻿", "a" * 3000, "ab" * 2000 + "!" * 700,
]


def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library_on_odd_texts():
    encoder, model, rnd = bpe.Encoder(PATH), library(), random.Random(5)
    letters = [chr(rnd.choice([rnd.randrange(0x20, 0x7F), rnd.randrange(0x20, 0x2FFF), rnd.randrange(0xAC00, 0xD7A3), rnd.randrange(9, 33), 32])) for _ in range(5000)]
    texts = ODD + ["".join(rnd.choices(letters, k=rnd.randrange(300))) for _ in range(300)] + ["".join(rnd.choices("abcdefgh", k=20_000))]
    ids, ends = encoder.encode(texts)
    for i, text in enumerate(texts):
        assert ids[ends[i]:ends[i + 1]].tolist() == model.encode(text, add_special_tokens=False).ids, text[:60]


def test_every_fifth_character():
    encoder, model = bpe.Encoder(PATH), library()
    chars = [chr(c) for c in range(0, 0x110000, 5) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}!{c}1 {c} " for c in chars[lo:lo + 500]) for lo in range(0, len(chars), 500)]
    ids, ends = encoder.encode(texts)
    for i, made in enumerate(model.encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[i]:ends[i + 1]].tolist() == made.ids


def test_long_words_and_short_words_merge_alike():
    with open(PATH, encoding="utf-8") as f:
        merges = bpe.Merges(json.load(f))
    rnd = random.Random(3)
    words = ["".join(rnd.choices("aabcdeéin", k=rnd.randrange(1, 250))) for _ in range(300)]
    symbols, lengths = merges.symbols(words)
    word = np.repeat(np.arange(len(words)), lengths)
    (long, of_long), = merges._merge_long(symbols.copy(), word)
    short, counts = merges.merge(symbols.copy(), lengths)
    assert long.tolist() == short.tolist() and np.bincount(of_long, minlength=len(words)).tolist() == counts.tolist()


def test_forgotten_chunks_come_back(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_CHUNKS", 3)
    encoder, model = bpe.Encoder(PATH), library()
    for text in ["one two three four five", "six two <|endoftext|>", "one seven", ""]:
        assert encoder.encode([text])[0].tolist() == model.encode(text, add_special_tokens=False).ids


def test_unfit_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_encode_decode_odd_table(spark, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP_CHARS", 1000)  # texts above a group
    rows = [(None, t, "x") for t in ODD[:3]] + [(7, t, None) for t in ODD] + [(8, None, "y"), (9, "same text", "a"), (9, "same text", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    model = library()
    for packed in (True, False):
        made = bpe.decode(bpe.encode(docs, packed=packed)).collect()
        got = sorted((r["doc_id"] or -1, np.frombuffer(r["ids"], "<u4").tolist() if packed else r["ids"], r["n_tokens"], r["decoded"]) for r in made)
        want = []
        for i, t, _ in rows:
            ids = model.encode(t or "", add_special_tokens=False).ids
            want.append((i or -1, ids, len(ids), model.decode(ids, skip_special_tokens=False)))
        assert got == sorted(want)
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0


def test_decode_keeps_columns_and_skips(spark):
    t = spark.createDataFrame([(1, [320, 49407, 10**6, -1, 321], "x"), (2, None, "y"), (3, [], None), (4, [49406], "z")], "decoded long, `i d` array<int>, n string")
    got = {r["n"]: r["decoded"] for r in bpe.decode(t, ids_col="i d").collect()}
    assert got == {"x": "a</w> <|endoftext|> b</w>", "y": "", None: "", "z": "<|startoftext|>"}
    got = {r["n"]: r["decoded"] for r in bpe.decode(t, ids_col="i d", skip_special=True).collect()}
    assert got["x"] == "a</w> b</w>" and got["z"] == ""


def test_query_equals_the_library(spark):
    model = library()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()}
    got = bpe.op11_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = model.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids, skip_special_tokens=False).encode()).hexdigest()
