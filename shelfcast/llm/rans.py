"""Token ids in files coded by a static range asymmetric numeral system.

File format, all numbers little-endian, one file per range of documents:

    "TANS" | u16 version | u16 scale bits | u32 table checksum
    blocks: u32 ids | u32 lanes | u32 words | u32 crc32 of the ids | u64 state per lane | u32 words
    checkpoints: per block u64 place in the file, u64 first id, u32 ids, u32 crc32 of the ids
    documents (zlib): i64 key and i64 ids of each
    u64 place of checkpoints | u64 blocks | u64 place of documents | u64 documents | u32 crc32 | "SNAT"

Zero bytes may follow. Every block can be decoded alone: its lanes start from their own
states and all files share one frequency table, which lies beside them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .tokens import WORD_BPE, word_tokens

END_ID = 1
SCALE_BITS = 20
LANES = 4096
BLOCK_IDS = LANES * 256
SHARD_IDS = 16 * BLOCK_IDS
LOW = np.uint64(1 << 31)
HEAD, BLOCK, CHECKPOINT, FOOT = struct.Struct("<4sHHI"), struct.Struct("<IIII"), struct.Struct("<QQII"), struct.Struct("<QQQQI4s")


class FrequencyTable:
    """Counts scaled to a power of two, with at least one slot for every id that occurs."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, bits: int = SCALE_BITS) -> None:
        order = np.argsort(ids)
        ids, counts = ids[order].astype(np.int64), counts[order].astype(np.float64)
        if len(ids) > 1 << bits:
            raise ValueError("more ids than slots; raise the scale bits")
        total = 1 << bits
        share = np.maximum(1, np.floor(counts / max(counts.sum(), 1) * total)).astype(np.int64)
        # Rounding is settled on the largest shares, each of which keeps a slot.
        by_size, off = np.argsort(-share, kind="stable"), total - int(share.sum())
        for i in by_size if len(ids) else []:
            step = max(off, 1 - int(share[i]))
            share[i] += step
            off -= step
            if not off:
                break
        self.bits, size = bits, int(ids.max()) + 1 if len(ids) else 0
        self.freq, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[ids] = share
        self.start[ids] = np.cumsum(share) - share
        self.slot = np.repeat(ids, share).astype(np.uint32)
        self.checksum = zlib.crc32(self.freq.tobytes())


def encode_block(ids: np.ndarray, table: FrequencyTable) -> bytes:
    """Id k is on lane k mod lanes; lanes advance together and are coded back to front."""
    lanes, bits = min(LANES, len(ids)), np.uint64(table.bits)
    top, low32 = np.uint64(63 - table.bits), np.uint64(0xFFFFFFFF)
    state, words = np.full(lanes, LOW), []
    freq, start = table.freq[ids], table.start[ids]
    for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        f, c = freq[at: at + lanes], start[at: at + lanes]
        x = state[: len(f)]
        over = x >= f << top
        words.append((x[over] & low32).astype("<u4"))
        x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        state[: len(f)] = (q << bits) + (x - q * f) + c
    stream = np.concatenate(words[::-1])
    raw = ids.astype("<u4").tobytes()
    return BLOCK.pack(len(ids), lanes, len(stream), zlib.crc32(raw)) + state.astype("<u8").tobytes() + stream.tobytes()


def decode_block(data: bytes, at: int, table: FrequencyTable) -> np.ndarray:
    """The ids of the block at a place in a file; a wrong checksum raises."""
    n, lanes, words, crc = BLOCK.unpack_from(data, at)
    at += BLOCK.size
    state = np.frombuffer(data, "<u8", lanes, at).copy()
    stream = np.frombuffer(data, "<u4", words, at + 8 * lanes).astype(np.uint64)
    out = np.empty(n, "<u4")
    bits, mask, read = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), 0
    for k in range(0, n, lanes):
        x = state[: min(lanes, n - k)]
        slot = x & mask
        ids = table.slot[slot]
        x = table.freq[ids] * (x >> bits) + slot - table.start[ids]
        under = np.flatnonzero(x < LOW)
        x[under] = (x[under] << np.uint64(32)) | stream[read: read + len(under)]
        read += len(under)
        state[: len(x)] = x
        out[k: k + len(x)] = ids
    if zlib.crc32(out.tobytes()) != crc:
        raise ValueError("a block does not match its checksum")
    return out


def encode_file(documents: Iterable[tuple[int, np.ndarray]], table: FrequencyTable) -> Iterator[bytes]:
    """A file of (key, ids) in the given order; nothing without documents."""
    place, first, held, held_ids = 0, 0, [], 0
    checkpoints, keys, sizes = [], [], []

    def blocks(least: int) -> Iterator[bytes]:
        nonlocal place, first, held, held_ids
        ids = np.concatenate(held)
        whole = len(ids) // BLOCK_IDS * BLOCK_IDS if least else len(ids)
        for at in range(0, whole, BLOCK_IDS):
            part = ids[at: min(at + BLOCK_IDS, whole)]
            block = encode_block(part, table)
            checkpoints.append(CHECKPOINT.pack(place, first, len(part), zlib.crc32(part.tobytes())))
            place, first = place + len(block), first + len(part)
            yield block
        held, held_ids = [ids[whole:]], len(ids) - whole

    for key, ids in documents:
        if not keys:
            head = HEAD.pack(b"TANS", 1, table.bits, table.checksum)
            place = len(head)
            yield head
        keys.append(key)
        sizes.append(len(ids))
        held.append(ids)
        held_ids += len(ids)
        if held_ids >= BLOCK_IDS:
            yield from blocks(BLOCK_IDS)
    if keys:
        yield from blocks(0)
        points = b"".join(checkpoints)
        listed = zlib.compress(np.array([keys, sizes], "<i8").tobytes(), 1)
        foot = (place, len(checkpoints), place + len(points), len(keys), zlib.crc32(points + listed), b"SNAT")
        yield points + listed + FOOT.pack(*foot)


class CodedFile:
    """Random access to one file: its documents, its checkpoints and any block."""

    def __init__(self, data: bytes, table: FrequencyTable) -> None:
        end = data.rfind(b"SNAT") + 4  # zero bytes may follow
        at, n, listed, documents, crc, _ = FOOT.unpack_from(data, end - FOOT.size)
        magic, _, bits, checksum = HEAD.unpack_from(data)
        if magic != b"TANS" or (bits, checksum) != (table.bits, table.checksum):
            raise ValueError("not a file of this table")
        if zlib.crc32(data[at: end - FOOT.size]) != crc:
            raise ValueError("the checkpoints do not match their checksum")
        self.data, self.table = data, table
        self.checkpoints = list(CHECKPOINT.iter_unpack(data[at: at + n * CHECKPOINT.size]))
        self.keys, self.sizes = np.frombuffer(
            zlib.decompress(data[listed: end - FOOT.size]), "<i8").reshape(2, documents)

    def block(self, k: int) -> np.ndarray:
        return decode_block(self.data, self.checkpoints[k][0], self.table)

    def ids(self, first: int, count: int) -> np.ndarray:
        """Ids from any place, decoding only the blocks that hold them."""
        parts = [self.block(k)[max(0, first - at): first + count - at]
                 for k, (_, at, n, _) in enumerate(self.checkpoints) if at < first + count and first < at + n]
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def documents(self) -> Iterator[tuple[int, int, int, list[np.ndarray]]]:
        """Key, first id, ids and their parts, holding one block at a time."""
        block, k, used = np.empty(0, "<u4"), 0, 0
        first = 0
        for key, size in zip(self.keys.tolist(), self.sizes.tolist()):
            parts, left = [], size
            while left:
                if used == len(block):
                    block, k, used = self.block(k), k + 1, 0
                parts.append(block[used: used + left])
                used += len(parts[-1])
                left -= len(parts[-1])
            yield key, first, size, parts
            first += size


# --- on Spark -----------------------------------------------------------------------


def id_type(tokenizer: str) -> str:
    return "<u2" if word_tokens(tokenizer).size <= 1 << 16 else "<u4"


def token_rows(docs: DataFrame, tokenizer: str, end_id: int, doc: str, text: str) -> DataFrame:
    """``doc_id`` and ``ids`` (with the end id) of every document; null text is empty.

    Ids are 16-bit where the vocabulary allows, as ``id_type`` says. Each task adds a row
    with null ids whose ``counts`` (compressed) say how often it has met each id, so that
    nothing needs to read all ids to learn the frequencies.
    """
    tail = np.array([end_id], "<u4").tobytes()
    kind, size, names = id_type(tokenizer), word_tokens(tokenizer).size, ["doc_id", "ids", "counts"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen = word_tokens(tokenizer).ids, np.zeros(size, np.int64)
        for batch in batches:
            found = [np.frombuffer(ids(t) + tail, "<u4").astype(kind) for t in batch.column(1).to_pylist()]
            if found:
                seen += np.bincount(np.concatenate(found), minlength=size)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f.tobytes() for f in found], pa.binary()), pa.nulls(len(found), pa.binary())], names)
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array(
                [zlib.compress(seen.tobytes(), 1)], pa.binary())], names)

    return docs.select(F.col(doc).cast("long").alias("doc_id"), text).mapInArrow(
        encode, "doc_id long, ids binary, counts binary")


def shared_table(tokens: DataFrame) -> tuple[FrequencyTable, int]:
    """Frequencies and number of all ids. The driver gets one row per id of the vocabulary at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            for value in batch.column("counts").to_pylist():
                here = np.frombuffer(zlib.decompress(value), np.int64)
                seen = here + (0 if seen is None else seen)
        if seen is not None:
            ids = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(seen[ids])], ["id", "n"])

    rows = tokens.filter("counts IS NOT NULL").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(
        F.sum("n").alias("n")).collect()
    ids, n = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    return FrequencyTable(ids, n), int(n.sum())


def write_coded(tokens: DataFrame, path: str, kind: str, shard_ids: int = SHARD_IDS) -> FrequencyTable:
    """Write ids in ascending order of ``doc_id`` (null first) as files of about ``shard_ids`` ids."""
    spark = tokens.sparkSession
    table, total = shared_table(tokens)
    held = spark.sparkContext.broadcast(table)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, v) for b in batches for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        keyed = ((MISSING if k is None else k, np.frombuffer(v, kind).astype("<u4")) for k, v in rows)
        yield from shared.chunk_batches(shared.cut_at_zero(encode_file(keyed, held.value)))

    shards = max(1, -(-total // shard_ids))
    ordered = tokens.filter("counts IS NULL").select("doc_id", "ids").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")
    shared.write_bytes(ordered.mapInArrow(encode, shared.BYTES), path)
    return table


# Stands for a null key in a file.
MISSING = -(1 << 63)


def read_coded(spark: SparkSession, path: str, table: FrequencyTable) -> DataFrame:
    """``part``, ``doc_id``, ``first`` (its place in the file), ``n_tokens`` and ``ids_crc32`` from the files."""
    held = spark.sparkContext.broadcast(table)
    names = ["part", "doc_id", "first", "n_tokens", "ids_crc32"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column("part").to_pylist(), batch.column("content")):
                rows = []
                for key, first, size, pieces in CodedFile(content.as_py(), held.value).documents():
                    crc = 0
                    for piece in pieces:
                        crc = zlib.crc32(piece.tobytes(), crc)
                    rows.append((part, None if key == MISSING else key, first, size, crc))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return shared.read_bytes(spark, path).select("part", "content").mapInArrow(
        decode, ", ".join(f"{n} long" for n in names))


def op7_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, write, read back; ``start`` counts the ids of all documents before.

    Files are numbered in order of their documents, so only one row per file enters the
    running total. An empty table gives no files and no rows.
    """
    docs = shared.table(spark, sf_dir, "documents")
    tokens = shared.written(token_rows(docs, WORD_BPE, END_ID, "doc_id", "text"), "ids", compression="zstd")
    path = shared.scratch(spark, "coded")
    table = write_coded(tokens, path, id_type(WORD_BPE))
    shared.removed(spark, tokens)
    read = shared.written(read_coded(spark, path, table), "decoded")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = read.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return read.join(files, "part").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
