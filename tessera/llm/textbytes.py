"""UTF-8 bytes of an Arrow string column as numpy arrays, with words and rolling hashes.

All hashes are 64-bit: a polynomial over a random table of the 256 byte values, modulo 2**64,
finished with a multiply-xorshift mix. Equal bytes give equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one numpy block holds; a longer single text makes a block of its own.
BLOCK_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space of the word pattern: space and the bytes 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        made = []
        for base in (_R, _R_INV):
            x = np.full(size, base & (2**64 - 1), dtype=U64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(32)
    return x


class Block:
    """Some whole texts: their bytes one after another, and where each text starts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1
        self._prefix: dict[bool, np.ndarray] = {}

    def words(self, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and number of the text of each word: maximal runs of bytes for which ``inside`` holds."""
        mask = (~SPACE if inside is None else inside)[self.data]
        size = len(mask)
        if not size:
            return (np.empty(0, np.int64),) * 3
        begin = mask.copy()
        begin[1:] &= ~mask[:-1]
        stop = mask.copy()
        stop[:-1] &= ~mask[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < size)]
        begin[edges] = mask[edges]
        stop[edges - 1] = mask[edges - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def prefix(self, lower: bool) -> np.ndarray:
        if lower not in self._prefix:
            pw, _ = powers(len(self.data) + 1)
            code = BYTE_CODE[LOWER] if lower else BYTE_CODE
            out = np.empty(len(self.data) + 1, U64)
            out[0] = 0
            np.cumsum(code[self.data] * pw[: len(self.data)], out=out[1:])
            self._prefix[lower] = out
        return self._prefix[lower]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hash of the bytes from each start to each end."""
        p = self.prefix(lower)
        _, inv = powers(len(self.data) + 1)
        return mix((p[ends] - p[starts]) * inv[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def string_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column in runs of whole texts of about ``size`` bytes."""
    data, offs = string_parts(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield Block(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i)
        i = j


def spark_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
