"""SHA-256 that one task can stop and another take up again."""

from __future__ import annotations

import ctypes
import functools
import itertools
import operator
from collections.abc import Iterator

import pyarrow as pa

# OpenSSL's SHA256_CTX: eight words of state, two of length, sixteen of data and two counters.
CONTEXT_BYTES = 4 * 28
# Bytes of a file in order of block and row; a digest so far stands before them, at block -1.
BYTES = "file int, block long, row long, value binary"
DIGESTS = f"{BYTES}, sha256 string"


@functools.cache
def _openssl() -> ctypes.CDLL | None:
    """The OpenSSL of hashlib, whose digests, unlike those of hashlib, can be stored."""
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        library.SHA256_Init.argtypes = [ctypes.c_void_p]
        library.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        library.SHA256_Final.argtypes = [ctypes.c_void_p, ctypes.c_void_p]
    except (ImportError, AttributeError, OSError):
        return None
    return library


def can_be_stored() -> bool:
    return _openssl() is not None


class Digest:
    """A SHA-256 from its start, or from what ``stored`` gave."""

    def __init__(self, stored: bytes = b""):
        self._context = ctypes.create_string_buffer(stored, CONTEXT_BYTES)
        if not stored:
            _openssl().SHA256_Init(self._context)

    def update(self, data: bytes) -> None:
        _openssl().SHA256_Update(self._context, data, len(data))

    def stored(self) -> bytes:
        return self._context.raw

    def hexdigest(self) -> str:
        copy = ctypes.create_string_buffer(self.stored(), CONTEXT_BYTES)
        found = ctypes.create_string_buffer(32)
        _openssl().SHA256_Final(found, copy)
        return found.raw.hex()


def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file's digest after its bytes; the rows of a file stand together and in order."""
    rows = (row for batch in batches for row in zip(
        *[batch.column(c).to_pylist() for c in ("file", "block", "value")], strict=True))
    for file, own in itertools.groupby(rows, key=operator.itemgetter(0)):
        digest = Digest()
        for _, block, value in own:
            if block < 0:
                digest = Digest(value)
            else:
                digest.update(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array([file], pa.int32()), pa.array([-1], pa.int64()), pa.array([0], pa.int64()),
             pa.array([digest.stored()], pa.binary()), pa.array([digest.hexdigest()])],
            ["file", "block", "row", "value", "sha256"])
