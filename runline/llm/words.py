"""Words of whole texts as numpy arrays, straight from Arrow string buffers.

A text is read as UTF-8 bytes. A word is a maximal run of bytes of one class; both classes used in this
package keep every byte of 0x80 and above, so a multi-byte character never ends a word. Nulls are empty texts.
No Python object is made per word: a word is named by a 64-bit hash (a polynomial over its bytes, then mixed).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text worked on at once; a longer text is worked on alone, whole.
SLICE_BYTES = 2 << 20


def _table(breaks) -> np.ndarray:
    kept = np.ones(256, dtype=bool)
    kept[list(breaks)] = False
    return kept


#: `[^\x20\x09-\x0D]+`
BLANK_SEPARATED = _table([0x20, *range(0x09, 0x0E)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALPHANUMERIC = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base, dtype=U64)
            factors[0] = 1
            _powers[name] = np.cumprod(factors, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without copies; offsets start at 0."""
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes together; a longer text has a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
        high = min(max(high, low + 1), n, low + 60_000)
        yield low, high
        low = high


def text_slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with the bytes and offsets of their texts."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    for low, high in slices(offsets):
        yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def word_spans(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; a word never crosses a text's border."""
    inside = kept[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    at = offsets[:-1][full]
    first[at] = inside[at]
    at = offsets[1:][full] - 1
    last[at] = inside[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def window_hashes(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of `size` words within a text, and the number of its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= U64(_BASE)
        out += words[k : n + k]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(out[at]), at


def short_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text with some words, but fewer than `size`: a hash of its whole sequence, and the text's number."""
    count = np.bincount(doc, minlength=n_docs)
    begin = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < size))
    out = np.zeros(len(short), dtype=U64)
    for k in range(size - 1):
        more = count[short] > k
        out[more] = out[more] * U64(_BASE) + words[begin[short[more]] + k]
    return mix(out + count[short].astype(U64) * U64(0xD6E8FEB86659FD93)), short


def planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of unsigned 64-bit values, byte by byte: alike bytes stand together and compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()
