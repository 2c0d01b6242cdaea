"""Packing along a space-filling curve.

A document's words are hashed to a vector, which a fixed random projection takes to a few dimensions; a Hilbert curve turns
these into one key. Documents are range-sorted by the key, and neighbours along the curve are put one after another into
sequences of ``length`` tokens. Each range fills whole sequences; what is left at its end is cut into sequences whose lengths
are powers of two, so that nothing is padded.

Defined cases: a null or empty text is its end id alone and lies at the middle of the curve's box; repeated rows are packed
as often as they occur; a null doc_id is kept; an empty table gives no pieces; extra columns are ignored. Documents with
equal keys lie by doc_id, so a group of copies can be cut between ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _tokens
from ._text import LOWER, gathered, split_words

FEATURES, DIMS, BITS = 1024, 4, 12
_STEP = 12 << 20


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n x dims) in a box with sides of 2**bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for k in range(dims):
            on = (x[k] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(on, low, swap)
            x[k] ^= swap
        bit >>= 1
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    turn, bit = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for k in range(dims):
            key = (key << 1) | ((x[k] >> b) & 1)
    return key


def text_keys(texts: pa.Array, features: int = FEATURES, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Curve keys of texts."""
    words, ends = split_words(texts, LOWER)
    coded = words.dictionary_encode()
    buckets = (pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False) % np.uint64(features)).astype(np.int64) if len(coded) else np.zeros(0, np.int64)
    projection = np.random.default_rng(7).standard_normal((features, dims))
    lengths = np.diff(ends)
    rows, own = np.repeat(np.arange(len(lengths)), lengths), buckets[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    sums = np.stack([np.bincount(rows, weights=projection[own, k], minlength=len(lengths)) for k in range(dims)], axis=1)
    centre = sums / np.maximum(lengths, 1)[:, None]
    return hilbert_key(np.minimum((0.5 + 0.5 * np.tanh(6 * centre)) * (1 << bits), (1 << bits) - 1).astype(np.int64), bits)


class _Packer:
    """Takes documents in order and gives out the pieces of finished sequences."""

    def __init__(self, length: int, first: int, with_ids: bool):
        self.length, self.sequence, self.with_ids = length, first, with_ids
        self.docs: list[tuple] = []  # doc_id, start, doc_tokens, ids: what isn't in a finished sequence yet
        self.held = 0

    def add(self, doc_id, total: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, total, ids))
        self.held += len(ids)

    def pieces(self, last: bool) -> pa.RecordBatch:
        sizes = [self.length] * (self.held // self.length)
        rest = self.held % self.length
        if last:
            sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        out: list[list] = [[] for _ in range(8)]
        queue, at = self.docs, 0
        for size in sizes:
            offset = 0
            while offset < size:
                doc_id, start, total, ids = queue[at]
                take = min(size - offset, len(ids))
                raw = ids[:take].astype("<u4").tobytes()
                for column, value in zip(out, (doc_id, start, take, zlib.crc32(raw), total, self.sequence, offset, raw if self.with_ids else None)):
                    column.append(value)
                offset += take
                if take == len(ids):
                    at += 1
                else:
                    queue[at] = (doc_id, start + take, total, ids[take:])
            self.sequence += 1
            self.held -= size
        self.docs = queue[at:]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:7]] + ([pa.array(out[7], pa.binary())] if self.with_ids else []), names + ["ids"] * self.with_ids)


def pack(docs: DataFrame, tokenizer: str, end: int, length: int = 4096, spaces: bool = False, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset.

    with_ids adds the piece's ids as little-endian 32-bit numbers. A doc_id that is no number becomes null. Pieces of a sequence lie in it without gaps.
    """
    rows = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", _STEP):
            ids, lengths = _tokens.encode(batch.column("text"), tokenizer, spaces, end)
            ends = np.cumsum(lengths)
            small = ids.astype("<u4" if len(ids) and ids.max() >= 1 << 16 else "<u2")
            raw = [small[e - n : e].tobytes() for e, n in zip(ends, lengths)]
            yield pa.RecordBatch.from_arrays([pa.array(text_keys(batch.column("text"))), batch.column("doc_id"), pa.array(lengths), pa.array(raw, pa.binary())], ["key", "doc_id", "n", "ids"])

    coded = _store.stored(rows.mapInArrow(tokens, "key bigint, doc_id bigint, n bigint, ids binary"), "packing")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(length, TaskContext.get().partitionId() << 32, with_ids)
        for batch in batches:
            for doc_id, n, raw in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids").to_pylist()):
                packer.add(doc_id, n, np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4"))
            yield packer.pieces(False)
        yield packer.pieces(True)

    along = coded.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return along.select("doc_id", "n", "ids").mapInArrow(fill, schema + ", ids binary" * with_ids)
