"""WARC records in seekable Zstandard bundles, with a map from record to frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import store

FRAME, BUNDLE = 256 << 10, 32 << 20
#: Seekable format of Zstandard: fixed values.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame_at long, frame_bytes long, offset long, length long"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", f"Content-Length: {len(payload)}"]
    if url:
        head.insert(3, "WARC-Target-URI: " + "".join(x for x in url if x not in "\r\n"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Bundle:
    """One file: independent frames, then a skippable frame with the seek table."""

    def __init__(self, folder: str):
        import zstandard

        self.press = zstandard.ZstdCompressor(level=3)
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.files, self.path = _store(self.uri)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(self.path, compression=None)
        self.table, self.at, self.rows, self.open, self.size = [], 0, [], [], 0

    def add(self, page_id, raw: bytes) -> None:
        self.open.append((page_id, self.size, len(raw), raw))
        self.size += len(raw)
        if self.size >= FRAME:
            self.flush()

    def flush(self) -> None:
        if self.open:
            packed = self.press.compress(b"".join(x[3] for x in self.open))
            self.out.write(packed)
            self.rows += [(p, self.uri, self.at, len(packed), a, n) for p, a, n, _ in self.open]
            self.table.append((len(packed), self.size))
            self.at += len(packed)
            self.open, self.size = [], 0

    def close(self) -> pd.DataFrame:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()
        return pd.DataFrame(self.rows, columns=["page_id", "bundle", "frame_at", "frame_bytes", "offset", "length"]).astype({"page_id": "Int64"})


def seek_table(files, path: str) -> list[tuple[int, int, int]]:
    """(place, bytes, plain bytes) of each frame, from the footer of a bundle."""
    with files.open_input_file(path) as f:
        end = f.size()
        n, _, magic = struct.unpack("<IBI", f.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        sizes = struct.iter_unpack("<II", f.read_at(8 * n, end - 9 - 8 * n))
    out, at = [], 0
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes all pages into bundles below `folder` and returns the stored index: page_id, bundle, frame_at, frame_bytes, offset, length.

    Of pages with equal payloads of at least `min_bytes`, the one with the largest id is the response, the others are revisits without a payload. A task writes
    bundles of about 32 MB under fresh names; only the index of tasks that succeeded is kept, so a lost or repeated task leaves files that nothing refers to.
    Null html: empty payload. Null url: no target field. Null page_id: counts as the least. Rows that repeat id and payload are all responses (or all revisits).
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    named = pages.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    first = named.filter(F.col("size") >= min_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("many"), F.max("page_id").alias("best")).filter("many > 1").select("sha", "best")
    best = (F.col("size") >= min_bytes) & F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    ready = named.join(first, "sha", "left").select("page_id", "url", F.when(~F.coalesce(best, F.lit(False)), F.col("html")).alias("html"), "sha", "size", F.when(best, F.col("best")).alias("refers_to"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle = None
        for f in frames:
            for page_id, url, html, sha, size, refers in f.astype({"page_id": "object", "refers_to": "object"}).itertuples(index=False):
                bundle = bundle or _Bundle(folder)
                page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                bundle.add(page_id, record(page_id, url, (html or "").encode(), base64.b32encode(bytes.fromhex(sha)).decode(), int(size), refers))
                if bundle.at >= BUNDLE:
                    yield bundle.close()
                    bundle = None
        if bundle:
            yield bundle.close()

    return store.stored(ready.mapInPandas(work, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """One row per record of the index, read by frame: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        undo = zstandard.ZstdDecompressor()

        @lru_cache(maxsize=1)
        def bundle(uri):
            files, path = _store(uri)
            return files, path, {at: (n, plain) for at, n, plain in seek_table(files, path)}

        @lru_cache(maxsize=2)
        def frame(uri, at):
            files, path, table = bundle(uri)
            n, plain = table[at]
            with files.open_input_file(path) as f:
                return undo.decompress(f.read_at(n, at), max_output_size=plain)

        for f in frames:
            rows = []
            for uri, at, offset, length in f[["bundle", "frame_at", "offset", "length"]].itertuples(index=False):
                head, payload = parse(frame(uri, at)[offset:offset + length])
                name = lambda k: None if head.get(k, "<urn:page:None>") == "<urn:page:None>" else int(head[k][10:-1])
                digest = head["WARC-Payload-Digest"][5:]
                if head["WARC-Type"] == "response" and (_digest(payload) != digest or len(payload) != int(head["X-Payload-Length"])):
                    raise ValueError(f"payload of {head['WARC-Record-ID']} in {uri} is damaged")
                rows.append((name("WARC-Record-ID"), head.get("WARC-Target-URI"), payload.decode() if head["WARC-Type"] == "response" else None, int(head["X-Payload-Length"]), digest, head["WARC-Type"], name("WARC-Refers-To")))
            out = pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    ordered = index.repartition("bundle").sortWithinPartitions("bundle", "frame_at", "offset")
    return ordered.mapInPandas(work, "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = store.read(spark, sf_dir, "pages")
    return read(write(pages, store.fresh(spark, "warc"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT hex, max(page_id) AS best FROM q GROUP BY hex),
d AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::INT + 1, 1), '' ORDER BY i) AS payload_digest
      FROM b, range(32) t(i) GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM q JOIN b USING (hex) JOIN d USING (hex)
"""
