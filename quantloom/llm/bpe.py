"""Byte-pair encoding and decoding: merge rounds over the symbols of many words at once."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm import store
from quantloom.llm.arrays import ragged

TOKENIZER = "word_bpe_49k.json"
GROUP_CHARS = 2 << 20  # texts that are encoded together
KNOWN_CHUNKS = 1 << 19  # a task forgets the chunks it has encoded beyond so many
LONG = 256  # symbols from which a word goes through `merge_long`
NEVER = np.int64(1) << 40
#: What Python's \s takes for white space and the tokenizers' regular expressions do not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


class Merges:
    """Vocabulary and merges of a tokenizer file, as sorted pair keys.

    A pair (a, b) has key a * size + b; `keys` is sorted, `order` and `product` hold rank and product of each key.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"only plain byte-pair models are encoded here; this one has {model['type']} {odd}")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        left, right, made = (np.array(c, dtype=np.int64) for c in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        ranks = np.arange(len(pairs))
        first = np.full(self.size, -1, dtype=np.int64)
        first[made[::-1]] = ranks[::-1]
        if (np.maximum(first[left], first[right]) >= ranks).any() or len(np.unique(made)) < len(made):
            raise ValueError("a merge stands before those that make its parts, or two merges make one token: rounds would not follow the ranks")
        keys = left * self.size + right
        by = np.argsort(keys)
        self.keys, self.order, self.product = keys[by], ranks[by], made[by]
        # symbols of single bytes, inside a word and at its end
        self.inner = np.array([vocab.get(c, -1) for c in byte_letters()], dtype=np.int64)
        self.last = np.array([vocab.get(c + suffix, -1) for c in byte_letters()], dtype=np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, place among the keys) of pairs; a pair that no merge takes, or with a symbol below 0, has rank NEVER."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.order[at], NEVER), at

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words' bytes in one array, and the words' lengths. Bytes that the vocabulary lacks are left out, as the library does."""
        coded = [w.encode() for w in words]
        lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        data = np.frombuffer(b"".join(coded), dtype=np.uint8)
        out = self.inner[data]
        ends = np.cumsum(lengths)[lengths > 0] - 1
        out[ends] = self.last[data[ends]]
        if (out < 0).any():
            lengths = np.bincount(np.repeat(np.arange(len(words)), lengths)[out >= 0], minlength=len(words))
            out = out[out >= 0]
        return out, lengths

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        word = np.repeat(np.arange(len(lengths)), lengths)
        long = lengths > LONG
        for at, work in ((~long[word], self._rounds), (long[word], self._merge_long)):
            if at.any():
                out += work(symbols[at], word[at])
        if not out:
            return symbols[:0], lengths * 0
        made, word = (np.concatenate(c) for c in zip(*out, strict=True))
        by = np.argsort(word, kind="stable")
        return made[by], np.bincount(word, minlength=len(lengths))

    def _rounds(self, sym: np.ndarray, word: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Every round merges, in each word, all places of the word's lowest-ranked pair, from left to right. Words without a pair to merge leave."""
        done = []
        rank, at = self.find(sym, np.r_[sym[1:], -1])
        rank[:-1][word[1:] != word[:-1]] = NEVER
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            stay = least < NEVER
            if not stay.all():
                done.append((sym[~stay], word[~stay]))
            place = np.flatnonzero((rank == least) & stay)
            if not len(place):
                break
            place = place[every_other(place[1:] == place[:-1] + 1)]
            sym[place] = self.product[at[place]]
            stay[place + 1] = False
            new = np.cumsum(stay)[place] - 1  # places after the others have left
            sym, word, rank, at = sym[stay], word[stay], rank[stay], at[stay]
            touched = np.r_[new, new[new > 0] - 1]
            right = np.minimum(touched + 1, len(sym) - 1)
            inside = (right > touched) & (word[right] == word[touched])
            rank[touched], at[touched] = self.find(sym[touched], np.where(inside, sym[right], -1))
        return done

    def _merge_long(self, sym: np.ndarray, word: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for long words: a round takes the lowest rank of all of them and touches only its own places, which wait in a list for each rank.

        No rank comes twice, so rounds are bounded by the merges and work by the symbols, whatever the words' length.
        """
        n = len(sym)
        sym = np.r_[sym, -1]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.flatnonzero(np.r_[word[1:] != word[:-1], True])
        after[ends], before[ends[:-1] + 1], before[0] = n, n, n
        alive, rank = np.ones(n + 1, dtype=bool), np.full(n + 1, NEVER)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(place: np.ndarray) -> None:
            found, at = self.find(sym[place], sym[after[place]])
            rank[place] = found
            place, found = place[found < NEVER], found[found < NEVER]
            by = np.argsort(found, kind="stable")
            place, found = place[by], found[by]
            for part in np.split(place, np.flatnonzero(found[1:] != found[:-1]) + 1) if len(place) else ():
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(part)

        product = np.empty(len(self.order), dtype=np.int64)
        product[self.order] = self.product
        wait(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            place = np.unique(np.concatenate(waiting.pop(r)))
            place = place[alive[place] & (rank[place] == r)]
            if not len(place):
                continue
            place = place[every_other(after[place[:-1]] == place[1:])]
            gone = after[place]
            sym[place], alive[gone] = product[r], False
            after[place] = after[gone]
            before[after[place]] = place
            prior = before[place]
            wait(np.r_[place, prior[prior < n]])
        keep = alive[:n]
        return [(sym[:n][keep], word[keep])]


def every_other(follows: np.ndarray) -> np.ndarray:
    """Of places that follow each other (`follows`: a place overlaps the one before it) the first, third, fifth, ... of each row."""
    index = np.arange(len(follows) + 1)
    first = np.maximum.accumulate(np.where(np.r_[True, ~follows], index, 0))
    return (index - first) % 2 == 0


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Numbers(dict):
    """Numbers keys in the order of their first look-up."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Lists:
    """Growing table of integer lists: list i is pool[start[i]:start[i] + count[i]]."""

    def __init__(self):
        self.start, self.count, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def add(self, flat: np.ndarray, counts: np.ndarray) -> None:
        self.start = np.r_[self.start, len(self.pool) + np.cumsum(counts) - counts]
        self.count, self.pool = np.r_[self.count, counts], np.r_[self.pool, flat.astype(np.int32)]

    def joined(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count[which]
        return self.pool[ragged(self.start[which], counts)], counts


class Encoder:
    """Encodes texts: chunks between white space are numbered, new ones are normalised and split into words, and new words go through the merges."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tokenizer = Tokenizer.from_file(path)
        self.merges, self.clean, self.split = Merges(spec), tokenizer.normalizer, tokenizer.pre_tokenizer
        match spec["pre_tokenizer"]:
            case {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]}:
                self.words = regex.compile(f"{pattern}| ")
            case other:
                raise ValueError(f"only words matched by a pattern, then bytes, are encoded here, not {other}")
        if regex.search(pattern, " \xa0\n") or self.clean is None or self.clean.normalize_str("A\nb") != "a b":
            raise ValueError("the tokenizer keeps white space: its texts cannot be cut there")
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("normalized", "single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens must be matched as they stand")
        self.added = {t["content"]: t["id"] for t in added}
        self.special = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.spaces = re.compile(rf"[^\S{NOT_SPACE}]+")
        self.odd = re.compile(f"[{NOT_SPACE}]")
        self.forget()

    def forget(self) -> None:
        """Starts the tables of chunks (an added token is a chunk in a tuple) and of words anew."""
        self.chunk_numbers, self.word_numbers = Numbers(), Numbers()
        self.chunk_ids, self.word_ids = Lists(), Lists()

    def chunks(self, text: str) -> list:
        """The text between white space, and its added tokens, in order."""
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return [c for i, part in enumerate(parts) for c in ([(part,)] if i % 2 else self.chunks(part))]
        return [c for c in self.spaces.split(text) if c] if self.odd.search(text) else text.split()

    def split_words(self, text: str) -> list[str]:
        """The words of normalised chunks, and the spaces between them. Characters that are unassigned here, where two Unicode versions may differ, are left to the library."""
        if text.isprintable():
            return self.words.findall(text)
        out: list[str] = []
        for i, chunk in enumerate(text.split(" ")):
            out += [" "] if i else []
            out += self.words.findall(chunk) if chunk.isprintable() else [chunk[a:b] for _, (a, b) in self.split.pre_tokenize_str(chunk)]
        return out

    def learn(self) -> None:
        """Ids of the chunks that have come since the last call."""
        fresh = list(self.chunk_numbers)[len(self.chunk_ids.start):]
        if not fresh:
            return
        is_added = np.fromiter((isinstance(c, tuple) for c in fresh), dtype=bool, count=len(fresh))
        plain = [c for c in fresh if not isinstance(c, tuple)]
        known = self.word_numbers
        gap = known[" "]
        which = np.fromiter(map(known.__getitem__, self.split_words(self.clean.normalize_str("\n".join(["", *plain])))), dtype=np.int64)
        new = list(known)[len(self.word_ids.start):]
        self.word_ids.add(*self.merges.merge(*self.merges.symbols(["" if w == " " else w for w in new])))
        ids, counts = self.word_ids.joined(which)
        per = np.zeros(len(fresh), dtype=np.int64)
        per[~is_added] = np.bincount(np.cumsum(which == gap) - 1, weights=counts, minlength=len(plain))
        if len(plain) < len(fresh):
            ids = np.insert(ids, (np.cumsum(per) - per)[is_added], [self.added[c[0]] for c in fresh if isinstance(c, tuple)])
            per[is_added] = 1
        self.chunk_ids.add(ids, per)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the texts' bounds in it."""
        if max(len(self.chunk_numbers), len(self.chunk_ids.pool) // 8, len(self.word_ids.pool) // 8) > KNOWN_CHUNKS:
            self.forget()
        parts = [self.chunks(t) for t in texts]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        which = np.fromiter(map(self.chunk_numbers.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=int(sizes.sum()))
        self.learn()
        ids, counts = self.chunk_ids.joined(which)
        return ids, np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum(sizes)]]


def groups(texts: pa.Array, size: int = GROUP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows with about `size` bytes; a null counts as empty."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - lengths[lo] + size, side="right")))
        yield lo, [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
        lo = hi


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids (array of ints; `packed`: bytes, unsigned 32-bit little-endian).

    The ids are those of the tokenizers library for whole texts, without added special tokens, truncation or padding; strings of the tokenizer's special
    tokens in a text are these tokens. Each task numbers the chunks that stand between white space, so a chunk is normalised, split and merged once a task
    (a bounded table, forgotten when full). Texts are taken in groups of about GROUP_CHARS, so memory follows the group or the longest text.

    Null or empty text: no ids. Null or repeated doc_id: rows are encoded each on its own. Very long texts and words: whole; long words are merged by
    lists of places, see `Merges._merge_long`. An empty table gives an empty table. Extra columns are ignored, whatever their names. Nothing here has ties.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = Encoder(public_tokenizers.path(tokenizer))
        for batch in batches:
            for lo, texts in groups(batch.column(1)):
                ids, ends = encoder.encode(texts)
                if packed:
                    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends * 4), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                else:
                    flat = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(np.diff(ends)), flat], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, f"doc_id long, n_tokens long, ids {'binary' if packed else 'array<int>'}")


def decode(tokens: DataFrame, tokenizer: str = TOKENIZER, ids_col: str = "ids", out: str = "decoded", skip_special: bool = False) -> DataFrame:
    """`tokens` with the text of its ids (array of ints, or packed bytes) in a column `out`, which replaces one of that name.

    As the library's decode for a tokenizer without a decoder: tokens joined by one space; ids that the vocabulary lacks are left out, special tokens
    only with `skip_special`. Null or no ids: empty text. All other columns are kept as they are.
    """
    fields = [f for f in tokens.schema.fields if f.name != out]
    at = [f.name for f in fields].index(ids_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("decoder"):
            raise ValueError("the tokenizer has a decoder of its own")
        names = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max(names.values()) + 1
        strings: list[str | None] = [None] * size
        for name, i in names.items():
            strings[i] = name
        for t in spec.get("added_tokens") or []:
            if skip_special and t["special"]:
                strings[t["id"]] = None
        real = np.array([s is not None for s in strings])
        table = pa.array([f"{s or ''} " for s in strings] + [s or "" for s in strings], pa.large_string())  # with a space behind, and as the last of its text

        for batch in batches:
            column = batch.column(at)
            for lo in range(0, max(batch.num_rows, 1), 512):
                part = column.slice(lo, 512)
                if pa.types.is_binary(part.type):
                    sizes = np.asarray(pc.fill_null(pc.binary_length(part), 0), dtype=np.int64) // 4
                    ids = np.frombuffer(b"".join(x or b"" for x in part.to_pylist()), dtype="<u4").astype(np.int64)
                else:
                    sizes = np.asarray(pc.fill_null(pc.list_value_length(part), 0), dtype=np.int64)
                    ids = np.asarray(pc.fill_null(part.flatten(), -1), dtype=np.int64)
                ok = (ids >= 0) & (ids < size)
                ok[ok] = real[ids[ok]]
                if not ok.all():
                    sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[ok], minlength=len(sizes))
                    ids = ids[ok]
                ends = np.cumsum(sizes)
                ids = ids.copy()
                ids[ends[sizes > 0] - 1] += size
                joined = table.take(pa.array(ids))
                bounds = np.frombuffer(joined.buffers()[1], dtype=np.int64, count=len(ids) + 1)[np.r_[0, ends]] if len(ids) else np.zeros(len(sizes) + 1, np.int64)
                texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.ascontiguousarray(bounds)), joined.buffers()[2] or pa.py_buffer(b""))
                yield pa.RecordBatch.from_arrays([c.slice(lo, 512) for c in batch.columns] + [texts.cast(pa.string())], [*batch.schema.names, out])

    return tokens.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(work, T.StructType([*fields, T.StructField(out, T.StringType())]))


def op11_bpe(spark, sf_dir: str) -> DataFrame:
    both = decode(encode(store.read(spark, sf_dir, "documents"), packed=True))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
