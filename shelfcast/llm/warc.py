"""WARC archives: written as whole-file gzip, normalised to a member per record with an index.

A record is a response, or a revisit of the response with the same payload. Monolithic
archives hold all their records in one gzip stream, which no reader can enter half-way. The
normaliser inflates such a stream once, writes every record as a gzip member of its own and
notes where it starts, so that single records can be read later.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

GZIP = 31  # window bits of zlib for the gzip wrapper
LEVEL = 6
INFLATED = 1 << 20
FED = 1 << 18
RECORD_PREFIX = "urn:shelfcast:page:"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One record. A revisit has no block; digest and length tell of the payload it stands for."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    target = "".join((url or "").split())  # a header field holds no line breaks
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD_PREFIX}{'' if key is None else key}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_PREFIX}{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


class RecordSplitter:
    """Cuts a stream of inflated bytes into records, holding one record at a time."""

    def __init__(self) -> None:
        self.held, self.need = bytearray(), 0

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        while True:
            if not self.need:
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                self.need = end + 4 + int(header(bytes(self.held[:end]))["content-length"]) + 4
            if len(self.held) < self.need:
                return
            yield bytes(self.held[: self.need])
            del self.held[: self.need]
            self.need = 0

    def close(self) -> None:
        if self.held:
            raise ValueError("an archive ends inside a record")


def header(head: bytes) -> dict[str, str]:
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not the start of a record")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file in bounded pieces: any number of members, zero padding after.

    Input is fed in bounded pieces as well, so what is left of it is not copied again and
    again.
    """
    at, stream = 0, None
    while at < len(data):
        if stream is None:
            if data[at] == 0:
                at += 1
                continue
            stream = zlib.decompressobj(GZIP)
        fed = data[at: at + FED]
        at += len(fed)
        while fed and not stream.eof:
            yield stream.decompress(fed, INFLATED)
            fed = stream.unconsumed_tail
        while not stream.eof and (piece := stream.decompress(b"", INFLATED)):
            yield piece
        if stream.eof:
            at -= len(stream.unused_data)
            stream = None
    if stream is not None:
        raise ValueError("a gzip stream is cut short")


def monolithic(records: Iterable[bytes]) -> Iterator[bytes]:
    """All records in one gzip stream."""
    stream, any_record = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), False
    for r in records:
        any_record = True
        yield stream.compress(r)
    if any_record:
        yield stream.flush()


# A gzip header with one extra field "sl": sizes of the member and of what it holds.
MEMBER = struct.Struct("<4sIBBH2sHII")
FLAGS = b"\x1f\x8b\x08\x04"


def member(data: bytes) -> bytes:
    """A record as a gzip member whose header tells its size, so that readers can skip it.

    The last byte is zero, and so the text sink's separator can stand for it. A member ends
    in the length of the record; from 16 MiB on a zero byte of padding is counted to it.
    """
    stream = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = stream.compress(data) + stream.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    body = body if body.endswith(b"\0") else body + b"\0"
    return MEMBER.pack(FLAGS, 0, 0, 255, 12, b"sl", 8, MEMBER.size + len(body), len(data) & 0xFFFFFFFF) + body


def member_sizes(data: bytes) -> Iterator[tuple[int, int]]:
    """Offset and size of each member, without inflating any."""
    at = 0
    while at < len(data):
        flags, _, _, _, _, name, _, size, _ = MEMBER.unpack_from(data, at)
        if flags != FLAGS or name != b"sl":
            raise ValueError("not a member of a normalised archive")
        yield at, size
        at += size


def record_at(data: bytes, offset: int, size: int, most: int = 0) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one member; ``most`` bounds what is inflated."""
    found = zlib.decompressobj(GZIP).decompress(data[offset: offset + size], most)
    head, _, rest = found.partition(b"\r\n\r\n")
    return header(head), rest[:-4]


def normalised(data: bytes) -> Iterator[bytes]:
    """A member for each record of an archive, which is inflated once."""
    split = RecordSplitter()
    for piece in inflated(data):
        for found in split.feed(piece):
            yield member(found)
    split.close()


def named(fields: dict[str, str]) -> tuple[int | None, str, int | None]:
    """Page, record type and the page referred to."""
    def page(field: str) -> int | None:
        value = fields.get(field, "").strip("<>").removeprefix(RECORD_PREFIX)
        return int(value) if value else None
    return page("warc-record-id"), fields["warc-type"], page("warc-refers-to")


def indexed(fields: dict[str, str]) -> tuple:
    """What the index keeps of a record's header."""
    return (*named(fields), fields["warc-target-uri"], fields["warc-date"], int(fields["x-payload-length"]),
            fields["warc-payload-digest"].removeprefix("sha1:"))


# --- on Spark -----------------------------------------------------------------------


def with_revisits(pages: DataFrame, least: int) -> DataFrame:
    """Add ``refers_to``: the smallest page with the same payload, null for that page itself.

    Payloads are told apart by digest and length; only those travel, never the html.
    Payloads under ``least`` bytes are never revisits; nor is a page without an id.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html", F.sha1(payload).alias("_sha"))
    keys = pages.filter(F.col("page_id").isNotNull() & (F.octet_length(payload) >= least)).select(
        "page_id", "_sha", F.octet_length(payload).alias("_bytes"))
    keys = shared.written(keys, "payloads")
    first = shared.with_smallest(keys, ["_sha", "_bytes"], "page_id", "refers_to", keys.count())
    again = first.filter(F.col("page_id") > F.col("refers_to")).select("page_id", "_sha", "refers_to").distinct()
    return pages.join(again, ["page_id", "_sha"], "left").drop("_sha")


def write_monolithic(pages: DataFrame, path: str) -> None:
    """One whole-file gzip archive for each task that has rows."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for key, url, html, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                    payload = (html or "").encode()
                    yield record(key, url, payload, refers_to, payload_digest(payload))
        yield from shared.chunk_batches(shared.cut_at_zero(monolithic(records())))

    rows = pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, shared.BYTES)
    shared.write_bytes(rows, path)


INDEX = ("place long, offset long, size long, page_id long, record_type string, refers_to long, url string, date string, "
         "payload_bytes long, payload_digest string")
RECORDS = ("place long, offset long, page_id long, payload_bytes long, payload_digest string, "
           "record_type string, refers_to long, block binary")
HEADER_BYTES = 1 << 16
# Rows of an index that every task may hold; with more of them archives meet their ranges by a join.
RANGES_SENT = 250_000
# Archives that a look-up may name one by one.
FILES_NAMED = 10_000


def normalise(spark: SparkSession, source: str, path: str) -> None:
    """Write ``path/archives`` with a member per record and the sidecar ``path/index``.

    The index has the place and size of each member and what its record's header says: page,
    kind, url, date, payload's length and digest, and the page it refers to. It is made from
    the written archives by their member sizes; of each record only the header is inflated.
    An archive holds what a task of the writing job held, and is one value when it is read:
    tasks of 2 GB compressed or more stop the run.
    """
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = (m for b in batches for c in b.column("content") for m in normalised(c.as_py()))
        yield from shared.chunk_batches(shared.cut_at_zero(members))

    found = shared.read_bytes(spark, source).select("content").mapInArrow(rewrite, shared.BYTES)
    shared.write_bytes(found, f"{path}/archives")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(batch.column("part").to_pylist(), batch.column("content")):
                data = content.as_py()
                yield _rows([(place, at, size, *indexed(record_at(data, at, size, HEADER_BYTES)[0]))
                             for at, size in member_sizes(data)], INDEX)

    shared.read_bytes(spark, f"{path}/archives").select("part", "content").mapInArrow(
        index, INDEX).write.parquet(f"{path}/index")


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar index of normalised archives; an empty one where none was written."""
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_archives(spark: SparkSession, path: str, index: DataFrame | None = None) -> DataFrame:
    """The records that the index, or chosen rows of it, names.

    Rows of the index are gathered for each archive, and of it only the ranges they give are
    read and inflated. The digest of a response is taken from its block; a block that does not
    match the index or its header raises. Digest and length of a revisit are those its header
    states. A few chosen rows read only their own archives.
    """
    chosen = read_index(spark, path) if index is None else index
    ranges = chosen.groupBy("place").agg(F.sort_array(F.collect_list(F.struct(
        "offset", "size", "page_id", "payload_digest"))).alias("ranges"))
    files = f"{path}/archives"
    few = chosen.limit(RANGES_SENT + 1).count() <= RANGES_SENT
    if index is not None:
        ranges = shared.written(ranges, "ranges")
        places = [r[0] for r in ranges.select("place").limit(FILES_NAMED + 1).collect()]
        if len(places) <= FILES_NAMED:
            wanted = ",".join(f"part-{p:05d}*" for p in places) or "none"
            files = f"{files}/{{{wanted}}}"
            if not places:
                return spark.createDataFrame([], RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content, members in zip(batch.column("place").to_pylist(), batch.column("content"), batch.column("ranges").to_pylist()):
                data, rows = content.as_py(), []
                for m in members:
                    fields, block = record_at(data, m["offset"], m["size"])
                    key, kind, refers_to = named(fields)
                    digest, n = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                    if (key, digest) != (m["page_id"], m["payload_digest"]):
                        raise ValueError("a record is not the one that the index names")
                    if kind == "response" and (n, digest) != (len(block), payload_digest(block)):
                        raise ValueError("a payload does not match its digest")
                    rows.append((place, m["offset"], key, n, digest, kind, refers_to, block))
                    if len(rows) == 256:
                        yield _rows(rows, RECORDS)
                        rows = []
                yield _rows(rows, RECORDS)

    found = shared.read_bytes(spark, files).select(F.col("part").cast("long").alias("place"), "content")
    return found.join(F.broadcast(ranges) if few else ranges, "place").select("place", "content", "ranges").mapInArrow(read, RECORDS)


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record in monolithic archives, normalised, and read back.

    A null html is an empty payload. An empty table gives no archives and no rows.
    """
    pages = with_revisits(shared.table(spark, sf_dir, "pages"), least=0)
    raw, path = shared.scratch(spark, "warc-raw"), shared.scratch(spark, "warc")
    write_monolithic(pages, raw)
    normalise(spark, raw, path)
    return read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
