"""WARC in seekable Zstandard bundles.

Each bundle is a file of independent Zstandard frames that group whole WARC records, and ends with a seek table: a skippable
frame that lists the compressed and the plain size of every frame (the public seekable format). The index maps a record to
its file, its frame and the offset inside that frame, so one record costs one ranged read and one small decompression.

Bundles are named by a digest of their content: a retried task writes the same file again, and what a lost attempt has
left is in no index. They are written to the shared folder and read by ranges with pyarrow.fs.

Defined results. A null html is an empty payload, a null url an empty target. Rows with a null page_id are recorded under
the id "none" and rank below all others. Rows that share payload and the largest page_id are all responses. An empty table
gives no bundle and an empty index. Extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import cut, discard, fresh_path

#: Fixed values of the public seekable format: skippable-frame magic, seek-table magic.
SKIPPABLE, SEEK_TABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 32 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What a row of plan_records() is known by, and the words of 64 bits in a bitmap over it: 8 MB.
KEY, WORDS = ["page_id", "digest", "size"], 1 << 20
INDEX = "page_id bigint, file string, frame int, record_offset bigint, record_bytes bigint"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary, file string"


def _place() -> list[Column]:
    """word and pos: the bit of a bitmap that stands for a row's KEY."""
    h = F.xxhash64(*KEY)
    return [F.pmod(h, F.lit(WORDS)).alias("word"), F.shiftrightunsigned(h, 58).cast("int").alias("pos")]


def bitmap(rows: DataFrame) -> DataFrame:
    """word, bits: the words with a bit set of the bitmap of rows. WORDS bound it at any number of rows, so it may be broadcast."""
    return rows.select(*_place()).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, pos)")).alias("bits"))


def hits(rows: DataFrame, bits: DataFrame, hit: bool = True) -> DataFrame:
    """The rows whose bit is set, which all rows of the bitmap are and few others; or all those whose bit isn't."""
    placed = rows.select("*", *_place()).join(F.broadcast(bits), "word", "inner" if hit else "left")
    return placed.where((F.coalesce(F.expr("bit_get(bits, pos)"), F.lit(0)) == 1) == F.lit(hit)).select(*rows.columns)


def plan_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload (null for a revisit), size, digest, and refers_to (null for a response).

    Payloads are compared by SHA-1 and length; only ids, urls, digests and sizes are shuffled. Digests seen twice or more are
    found with partial counts and written, so that the join with them is one of two plain shuffles, which AQE splits at a hot
    digest. A response's payload stays where it is read, as no bit of the revisits' bitmap is set for it. Those few for which
    one is set by chance are known from their ids: a second bitmap finds them, and only their payloads go through a join.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    narrow = cut(rows.drop("payload"), "pages")
    groups = narrow.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = cut(groups, "digests")
    of = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    told = narrow.join(groups, ["digest", "size"], "left").select("page_id", "url", "digest", "size", of.alias("refers_to"))
    revisits = told.where("refers_to IS NOT NULL")
    maybe = cut(bitmap(revisits), "maybe")
    chance = cut(hits(told.where("refers_to IS NULL"), maybe).select(*KEY).distinct(), "chance")
    second = cut(bitmap(chance), "second")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in KEY]
    found = hits(hits(rows, maybe), second).alias("r").join(chance.alias("c"), same, "left_semi")
    responses = hits(rows, maybe, False).union(found.select(*rows.columns)).withColumn("refers_to", F.lit(None).cast("long"))
    out = responses.unionByName(revisits.withColumn("payload", F.lit(None).cast("binary"))).select("page_id", "url", "payload", "size", "digest", "refers_to")
    out._tables = [narrow, groups, maybe, chance, second]
    return out


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def format_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse_records(plain: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of the records in a frame."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at) + 4
        lines = plain[at : end - 4].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in (f"{line} " if line.endswith(":") else line for line in lines[1:]))
        size = int(head["Content-Length"])
        yield at, end + size + 4 - at, head, plain[end : end + size]
        at = end + size + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEK_TABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of every frame, from the footer (or a whole bundle) alone."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEK_TABLE:
        raise ValueError("no seek table")
    width, at, out = 12 if flags & 0x80 else 8, 0, []
    table = bundle[-9 - n * width : -9]
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def _write(tables: Iterator[pd.DataFrame], uri: str, frame_bytes: int, bundle_bytes: int) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(uri)
    packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
    done, sizes, index, frame, filled = bytearray(), [], [], bytearray(), []

    def close_frame():
        nonlocal frame, filled
        if frame:
            packed = packer.compress(bytes(frame))
            index.extend((page_id, len(sizes), at, n) for page_id, at, n in filled)
            sizes.append((len(packed), len(frame)))
            done.extend(packed)
            frame, filled = bytearray(), []

    def close_bundle():
        nonlocal done, sizes, index
        close_frame()
        done += seek_table(sizes)
        name = f"{hashlib.sha256(done).hexdigest()[:32]}.warc.zst"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}.part") as out:
            out.write(bytes(done))
        store.move(f"{folder}/{name}.part", f"{folder}/{name}")
        rows = pd.DataFrame([(p, name, f, at, n) for p, f, at, n in index], columns=["page_id", "file", "frame", "record_offset", "record_bytes"], dtype=object)
        done, sizes, index = bytearray(), [], []
        return rows.astype({"page_id": "Int64", "frame": "int32", "record_offset": "int64", "record_bytes": "int64"})

    for t in tables:
        for page_id, known, url, payload, size, digest, refers_to, again in t.itertuples(index=False, name=None):
            page_id = int(page_id) if known else None
            record = format_record(page_id, url, None if again else bytes(payload), size, digest, int(refers_to) if again else None)
            filled.append((page_id, len(frame), len(record)))
            frame += record
            if len(frame) >= frame_bytes:
                close_frame()
                if len(done) >= bundle_bytes:
                    yield close_bundle()
    if frame or done:
        yield close_bundle()


def write_bundles(records: DataFrame, uri: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write plan_records() rows as bundles under uri; returns the index, already written. A task holds one bundle at most."""
    null = F.lit(0).cast("long")
    rows = records.select(
        F.coalesce("page_id", null), F.col("page_id").isNotNull(), "url", "payload", "size", "digest", F.coalesce("refers_to", null), F.col("refers_to").isNotNull()
    ).toDF("page_id", "known", "url", "payload", "size", "digest", "refers_to", "again")
    return cut(rows.mapInPandas(lambda tables: _write(tables, uri, frame_bytes, bundle_bytes), INDEX), "warc-index")


def _page(urn: str) -> int | None:
    name = urn[len("<urn:page:") : -1]
    return None if name == "none" else int(name)


class Bundle:
    """A bundle file, read by ranges: its footer once, then single frames."""

    def __init__(self, store, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, flags, _ = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        length = 9 + n * (12 if flags & 0x80 else 8)
        self.frames = frames(self.file.read_at(length, size - length))

    def close(self) -> None:
        self.file.close()

    def frame(self, number: int) -> bytes:
        start, packed, plain = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, start), max_output_size=plain)


def _fields(record: bytes, payloads: bool) -> tuple:
    _, _, head, block = next(parse_records(record))
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = head["WARC-Type"] == "revisit"
    told = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex() if revisit else hashlib.sha1(payload).hexdigest()
    size = int(told["Content-Length"]) if revisit else len(payload)
    return _page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], _page(head["WARC-Refers-To"]) if revisit else None, payload if payloads and not revisit else None


def _read(tables: Iterator[pd.DataFrame], uri: str, payloads: bool) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(uri)
    name, bundle, number, plain = None, None, None, b""
    for t in tables:
        rows = []
        for file, frame, at, n in t.itertuples(index=False, name=None):
            if file != name:
                if bundle:
                    bundle.close()
                name, bundle, number = file, Bundle(store, f"{folder}/{file}"), None
            if frame != number:
                number, plain = frame, bundle.frame(frame)
            rows.append((*_fields(plain[at : at + n], payloads), file))
        out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "file"], dtype=object)
        yield out.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})
    if bundle:
        bundle.close()


def read_records(index: DataFrame, uri: str, payloads: bool = False) -> DataFrame:
    """The records that index rows name, each found through its file's seek table: one ranged read a frame.

    The rows of a frame stand together in an index as it is written, so a whole archive is read once, without a shuffle.
    """
    return index.select("file", "frame", "record_offset", "record_bytes").mapInPandas(lambda tables: _read(tables, uri, payloads), RECORD)


def archive(pages: DataFrame, least_bytes: int = 1000, uri: str | None = None) -> tuple[DataFrame, str]:
    """Write the pages as bundles; (index, uri)."""
    uri = uri or fresh_path(pages.sparkSession, "warc")
    records = plan_records(pages, least_bytes)
    index = write_bundles(records, uri)
    for table in records._tables:
        discard(table)
    return index, uri
