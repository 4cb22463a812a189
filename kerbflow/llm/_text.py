"""Column-at-a-time text kernels used inside ``mapInArrow`` tasks.

Texts stay in Arrow buffers; only the distinct words of a slice become Python
objects.  A slice holds about ``SLICE_BYTES`` of text (one text at least), so a
task's memory does not follow the length of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
_MIX1 = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * _MIX2
    return (x ^ (x >> np.uint64(29))) * _MIX1


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of ``batch`` with about ``limit`` bytes of text."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)


def long_column(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(column).cast(pa.int64())


def mapped_bytes(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """The texts with each byte replaced by ``table``'s entry for it; null texts are empty.

    Bytes from 128 on must stay themselves, or the texts are no UTF-8 any more.
    """
    texts = pc.fill_null(texts, "").cast(pa.string())
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int32, len(texts) + 1, 4 * texts.offset) if off is not None else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(off - off[0]), pa.py_buffer(table[data]))


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word codes of all texts in a row, the texts' offsets into them, the distinct words.

    A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``; a null
    text has none.  ``lower`` maps A-Z only.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        off, flat = kept[off], flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), off, coded.dictionary


def hash_words(vocabulary: pa.Array) -> np.ndarray:
    """A 64-bit hash for each string; equal strings hash alike in every task."""
    items = vocabulary.cast(pa.binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh64_intdigest, items), np.uint64, len(items))


def shingles(hashes: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width``-word shingles in text order and the texts' offsets.

    A text with fewer words gives its whole sequence as one; one without words none.
    """
    count = np.diff(off)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out_off = np.concatenate([[0], np.cumsum(made)])
    if not len(hashes):
        return np.zeros(0, np.uint64), out_off
    value = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width):
        value = mix(value + hashes[k : len(hashes) - width + 1 + k]) if len(value) else value
    starts = np.repeat(off[:-1] - out_off[:-1], made) + np.arange(out_off[-1])
    short = np.repeat(count < width, made)
    out = np.empty(out_off[-1], np.uint64)
    out[~short] = value[starts[~short]]
    for doc in np.flatnonzero((count > 0) & (count < width)):
        h = np.uint64(count[doc])
        for x in hashes[off[doc] : off[doc + 1]]:
            h = mix(np.atleast_1d(h + x))[0]
        out[out_off[doc]] = h
    return out, out_off


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    codes, off, vocabulary = words(texts)
    with np.errstate(over="ignore"):
        flat, cut = shingles(hash_words(vocabulary)[codes], off, width)
    return [np.unique(flat[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def set_id(values: np.ndarray) -> int:
    """A signed 64-bit id of a sorted set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).astype(np.int64))


def large_binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    """An array of list<int64> from integer arrays."""
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))
