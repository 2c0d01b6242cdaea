"""Near-duplicates by SimHash fingerprints, with pigeonring candidate filtering.

A 64-bit fingerprint is cut into 4 segments of 16 bits on a ring. If two fingerprints differ in at most 3 bits, some
segment starts a chain along the ring whose first k segments differ in at most floor(3k / 4) bits in all, for every k: 0, 1
and 2 bits after one, two and three segments. So the first segment is equal, and of the second at least one half is equal:
these 24 bits are the key under which two fingerprints meet, 8 keys each. Pairs that meet are cut down by the longer chains
before the full Hamming check. Equal fingerprints are one node, so copies are never expanded.

Within a key, fingerprints are grouped by breadth-first search over the links, which gives one link for each fingerprint
beyond the first, not all pairs. Keys with very many fingerprints are dealt out in pairs of blocks, so that no task gets
an unbounded group and no link is lost.

Defined cases: null or empty text has fingerprint zero and is linked like any other; fewer than three words: the whole
sequence is the only shingle; repeated rows give repeated rows; null doc_id rows get a fingerprint but never name a
component (a group of nothing else has a null component_id); ids that are no numbers count as null; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._text import LOWER, ragged, slices, split_words
from .components import components

#: Fingerprints of one key that are compared as a whole; keys with more are dealt out in pairs of blocks.
BLOCK = 16384
LIMIT, SEGMENTS, WIDTH = 3, 4, 16


def _shingles(words: pa.StringArray, ends: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray]:
    """Space-joined shingles of all texts in order, and how many each text has."""
    lengths = np.diff(ends)
    counts = np.where(lengths >= size, lengths - size + 1, 0)
    at = ragged(ends[:-1], counts)
    full = pc.binary_join_element_wise(*(words.take(pa.array(at + k)) for k in range(size)), " ") if len(at) else pa.array([], pa.string())
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if not len(short):
        return full, counts
    joined = pa.array([" ".join(words[int(ends[k]) : int(ends[k + 1])].to_pylist()) for k in short], pa.string())
    counts[short] = 1
    base = np.cumsum(counts) - counts
    order = np.empty(int(counts.sum()), np.int64)
    is_short = np.zeros(len(order), bool)
    is_short[base[short]] = True
    order[~is_short] = np.arange(len(full))
    order[is_short] = len(full) + np.arange(len(joined))
    return pa.concat_arrays([full, joined]).take(pa.array(order)), counts


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits set in over half of each text's hashes. Two bits are summed at a time, in the halves of a 64-bit number."""
    out = np.zeros(len(counts), np.uint64)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return out
    starts, half = (np.cumsum(counts) - counts)[rows], counts[rows].astype(np.uint64)
    lanes, low, two = np.uint64(0x0000000100000001), np.uint64(0xFFFFFFFF), np.uint64(2)
    for bit in range(32):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, starts)
        out[rows] |= ((sums & low) * two > half).astype(np.uint64) << np.uint64(bit)
        out[rows] |= ((sums >> np.uint64(32)) * two > half).astype(np.uint64) << np.uint64(bit + 32)
    return out


def text_fingerprints(texts: pa.Array, size: int = 3, seed: int = 42) -> np.ndarray:
    words, ends = split_words(texts, LOWER)
    shingles, counts = _shingles(words, ends, size)
    coded = shingles.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return _majority(hashes[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64), counts)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, h, fp): h is a hash of the text, fp the 64-bit fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = pa.array(text_fingerprints(batch.column("text"), size).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), fps], ["doc_id", "h", "fp"])

    text = F.col("text").cast("string")
    rows = docs.select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, h bigint, fp bigint")


def _rotated(fps: np.ndarray, start: int) -> np.ndarray:
    """Turn the ring so that segment ``start`` is the lowest."""
    if not start:
        return fps
    by = np.uint64(WIDTH * start)
    return (fps >> by) | (fps << (np.uint64(64) - by))


def _near(one: np.uint64, others: np.ndarray, limit: int) -> np.ndarray:
    """Which of the others pass the chains that start at the lowest segment, and then the full check."""
    x = others ^ one
    keep = np.flatnonzero(np.bitwise_count(x & np.uint64(0xFFFFFFFF)) <= limit * 2 // SEGMENTS)
    keep = keep[np.bitwise_count(x[keep] & np.uint64(0xFFFFFFFFFFFF)) <= limit * 3 // SEGMENTS]
    return keep[np.bitwise_count(x[keep]) <= limit]


def _group_links(fps: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links that join the fingerprints of one key into their groups: breadth-first search, each node expanded once."""
    out, left = [], np.arange(len(fps))
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = _near(fps[front.pop()], fps[left], limit)
            if len(near):
                got = left[near]
                out += [(int(root), int(k)) for k in got]
                front += got.tolist()
                left = np.delete(left, near)
    return out


def _links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Input sorted by key; the rows of a key may lie in several batches."""
    held: list[np.ndarray] = []
    names = ["a", "b"]

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        """rows: key, pa, pb, fp as columns; whole keys only."""
        cut = np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1)) + 1
        starts = np.concatenate([[0], cut])
        sizes = np.diff(np.concatenate([starts, [len(rows)]]))
        fp = rows[:, 3].astype(np.int64).view(np.uint64)
        a, b = [], []
        two = starts[sizes == 2]
        if len(two):
            x = fp[two] ^ fp[two + 1]
            for s in range(SEGMENTS):
                mine = (rows[two, 0] >> 24) // 2 == s
                y = _rotated(x[mine], s)
                ok = (np.bitwise_count(y & np.uint64(0xFFFFFFFF)) <= limit * 2 // SEGMENTS) & (np.bitwise_count(y & np.uint64(0xFFFFFFFFFFFF)) <= limit * 3 // SEGMENTS) & (np.bitwise_count(y) <= limit)
                a.append(fp[two[mine][ok]])
                b.append(fp[two[mine][ok] + 1])
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own = np.unique(fp[start : start + size])
            links = np.array(_group_links(_rotated(own, int(rows[start, 0] >> 24) // 2), limit), np.int64).reshape(-1, 2)
            a.append(own[links[:, 0]])
            b.append(own[links[:, 1]])
        join = lambda x: pa.array((np.concatenate(x) if x else np.zeros(0, np.uint64)).view(np.int64))
        return pa.RecordBatch.from_arrays([join(a), join(b)], names)

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        last = len(rows) - int(np.argmax(np.any(rows[::-1, :3] != rows[-1, :3], axis=1)))  # first row of the last key
        if np.all(rows[0, :3] == rows[-1, :3]):
            last = 0
        if held and (last > 0 or np.any(held[-1][-1, :3] != rows[0, :3])):
            whole = np.concatenate([*held, rows[:last]]) if last else np.concatenate(held)
            yield solve(whole)
            held = []
        elif last:
            yield solve(rows[:last])
        held.append(rows[last:])
    if held:
        yield solve(np.concatenate(held))


def hamming_links(fps: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among the distinct fingerprints of a column fp, enough to join all that are within ``limit`` bits.

    A link stands for a path of pairs within the limit, not always for such a pair itself.
    """
    if not 0 <= limit <= 3:
        raise ValueError("the key of 24 bits finds all pairs up to 3 differing bits")
    fp = F.col("fp")
    part = lambda k: F.shiftrightunsigned(fp, WIDTH * (k % SEGMENTS)).bitwiseAND(0xFFFF)
    keys = []
    for s in range(SEGMENTS):
        for h in range(2):
            second = F.shiftrightunsigned(part(s + 1), 8 * h).bitwiseAND(0xFF)
            keys.append(F.lit((2 * s + h) << 24).cast("bigint") + F.shiftleft(part(s), 8) + second)
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = rows.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = rows.join(hot, "key", "left").withColumn("own", F.when(F.col("blocks").isNull(), 0).otherwise(mine))
    dealt = dealt.select("key", "own", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").cast("bigint").alias("pa"), F.greatest("own", "other").cast("bigint").alias("pb"), "fp")
    together = dealt.repartition("key", "pa", "pb").sortWithinPartitions("key", "pa", "pb")
    return together.mapInArrow(lambda it: _links(it, limit), "a bigint, b bigint").distinct()


def _grouped(docs: DataFrame, size: int, limit: int) -> DataFrame:
    """(doc_id, h, fp, component_id) for every row."""
    fps = _store.stored(fingerprints(docs, size), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    groups = components(hamming_links(nodes.select("fp"), limit))
    named = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = named.join(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame, size: int = 3, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach, for every row."""
    return _grouped(docs, size, limit).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, size: int = 3, limit: int = LIMIT) -> DataFrame:
    """The documents without near-duplicates: of each component one row with the smallest doc_id, with its columns.

    Rows are told apart by doc_id and text, so each is decided by its own text. Rows with a null doc_id stay.
    """
    kept = _grouped(docs, size, limit).filter("doc_id is not null").groupBy("component_id").agg(F.min(F.struct("doc_id", "h")).alias("d"))
    kept = _store.stored(kept.select(F.col("d.doc_id").alias("__id"), F.col("d.h").alias("__h")), "kept")
    own = docs.withColumns({"__id": F.expr("try_cast(doc_id AS bigint)"), "__h": F.xxhash64(F.col("text").cast("string"))})
    chosen = own.join(kept, ["__id", "__h"], "left_semi")
    if not chosen.groupBy("__id", "__h").count().filter("count > 1").isEmpty():
        chosen = chosen.dropDuplicates(["__id", "__h"])
    return chosen.unionByName(own.filter("__id is null")).select(*docs.columns)
