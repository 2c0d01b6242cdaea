"""Vectorised word handling on Arrow string columns, shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte map that lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Byte map for words of ASCII letters, digits and any non-ASCII character: everything else becomes a space.
ALNUM = LOWER.copy()
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    ALNUM[_low : _high + 1] = 0x20


def remap(texts: pa.Array, table: np.ndarray) -> pa.StringArray:
    """Apply a byte map to every text; null becomes the empty text. The map must keep UTF-8 valid."""
    texts = pc.fill_null(pc.cast(texts, pa.string()), "")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(table[data]))


def split_words(texts: pa.Array, table: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """All words of all texts in order, and offsets: the words of text i are offsets[i]:offsets[i + 1]."""
    lists = pc.ascii_split_whitespace(remap(texts, table))
    words, ends = lists.values, lists.offsets.to_numpy()
    words = words[ends[0] : ends[-1]] if len(ends) else words
    full = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.zeros(len(full) + 1, np.int64)
    np.cumsum(full, out=before[1:])
    return words.filter(pa.array(full)), before[ends - ends[0]] if len(ends) else np.zeros(1, np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the named text column holds about ``most`` bytes in each; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(pc.cast(batch.column(column), pa.string())), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def gathered(batches: Iterator[pa.RecordBatch], column: str, least: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Join small record batches into ones with about ``least`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, column, least):
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of each run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose value i is the bytes of data[offsets[i]:offsets[i + 1]]."""
    width = data.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64) * width), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
