"""Near-duplicates for filtering: SimHash groups, and every pair whose word shingles have the wanted Jaccard similarity.

Fingerprints that pigeonring filtering links (simhash_ring) group most copies. Fingerprints of 64 bits can't find every pair
of 0.8, so an exact search follows, and both kinds of links join groups.

A text is the set of the hashes of its shingles; equal sets are one node, so copies are never expanded. The shingles of all
sets stand in one order, those that a sample of the documents holds often come last. Two sets of n and m shingles that reach
the share have a common one among the first n - ceil(share n) + 1 of the one and the first m - ceil(share m) + 1 of the other
(prefix filter); any order gives all pairs, this one gives few candidates. Sizes and places of the common shingle rule out
most of them. Sketches, about one bit for each shingle, rule out nearly all other pairs that are not similar; what is left is
compared as whole sets.

A similar pair is a link, as are documents of one SimHash group; of the documents that links join, one stays. Shingles that
the sample shows to be in very many sets are dealt out in pairs of blocks at once. The task that has the rows of any other
shingle hands them on, without holding them, as soon as they are too many, and these are counted and dealt out next; so no
shingle of any number of sets is held whole, whatever the sample has missed.

Defined cases: null and empty texts are one node, without shingles; fewer words than a shingle: the whole sequence is the
only one; a document is its doc_id and text, so rows with null or repeated doc_id are decided by their own text, and of rows
with both equal one stays; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._text import LOWER, binaries, ragged, slices, split_words
from .components import components
from .simhash_ring import LIMIT, hamming_links, text_fingerprints

#: Sets of one shingle that are compared as a whole; shingles with more are dealt out in pairs of blocks.
BLOCK = 4096
#: Documents in the sample that tells common shingles, and how many of these are told. They set the order, not the result.
SAMPLE, COMMON = 20_000, 200_000
#: Bytes of text that a task hashes at a time.
SLICE = 2 << 20
#: Different leaders that the keys of one group can have; a power of two. Rounds of further leaders.
LEADERS, ROUNDS = 4, 1
#: Bits of the short sketch of a set, which goes with its rows; the long one has at least as many bits as the set shingles.
SKETCH = 256
#: Sets that are sketched at a time.
STEP = 4096
#: A shingle's rows are handed on to be dealt out where there are more than so many blocks of them.
FULL = 4
#: Pairs that are held before they are sent on.
PAIRS = 1 << 20
_TWO = "a bigint, b bigint"
_WORDS = [f"s{k}" for k in range(SKETCH // 64)]


def text_shingles(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, ascending, and offsets: those of text i are offsets[i]:offsets[i + 1]."""
    words, ends = split_words(texts, LOWER)
    coded = words.dictionary_encode()
    each = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    hashed = each[coded.indices.to_numpy()] if len(coded) else each
    lengths = np.diff(ends)
    rows, hashes = [], []
    for own in range(1, size + 1):
        mine = np.flatnonzero(lengths >= size if own == size else lengths == own)
        counts = lengths[mine] - own + 1
        at = ragged(ends[mine], counts)
        h = np.full(len(at), 42, np.uint64)
        for k in range(own):
            h = (h ^ hashed[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        rows.append(np.repeat(mine, counts))
        hashes.append(h)
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return h[first], np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(lengths)))])


def _nodes(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(hashes[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())), np.uint64, len(ends) - 1).view(np.int64)


def _sketches(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Of each set a short sketch of SKETCH bits, as 64-bit words, and a long one: of the hashes that fall on a bit, whether their number is odd.

    A long sketch has a power of two of bits, not fewer than the set has hashes. Two sets differ in at least as many shingles
    as their sketches in bits; a longer one is folded onto a shorter one first (_folded).
    """
    counts = np.diff(ends)
    if len(counts) > STEP:
        short, long = zip(*(_sketches(hashes, ends[k : k + STEP + 1]) for k in range(0, len(counts), STEP)))
        return np.concatenate(short), [x for part in long for x in part]
    hashes = hashes[ends[0] : ends[-1]]
    bits = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(base[:-1], counts) + ((hashes >> np.uint64(9)).astype(np.int64) & np.repeat(bits - 1, counts))
    packed = np.packbits(np.bincount(at, minlength=base[-1]).astype(np.uint8) & 1, bitorder="little")
    own = [packed[a:b] for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist())]
    short = np.array([_folded(x, SKETCH // 8) for x in own], np.uint8).reshape(len(own), SKETCH // 8)
    return short.view(np.int64), [x.tobytes() for x in own]


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of ``size`` bytes of the same set."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def _maybe(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, n, m, x, y) that sizes n, m and long sketches x, y do not rule out."""
    for batch in batches:
        keep = []
        for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y"))):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            size = min(len(x), len(y))
            apart = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
            both = -(-least * (n + m) // (100 + least))
            keep.append(min(n, m) >= both and apart <= n + m - 2 * both)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _in_order(hashes: np.ndarray, ends: np.ndarray, common: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's hashes in the order of all shingles, and how often the sample held them."""
    seen = np.zeros(len(hashes), np.int64)
    if len(common) and len(hashes):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        seen = np.where(common[at] == hashes, often[at], 0)
    order = np.lexsort((hashes, seen, np.repeat(np.arange(len(ends) - 1), np.diff(ends))))
    return hashes[order], seen[order]


def _possible(n, i, m, j, least: int):
    """Whether sets of n and m shingles whose first common one is at places i and j can be similar enough."""
    return np.minimum(n - i, m - j) >= -(-least * (n + m) // (100 + least))


def _with_partner(rows: np.ndarray, group: np.ndarray, least: int) -> np.ndarray:
    """Rows (key, part, node, n, place) without those for which no other row of their key is possible in the sense of _possible.

    A row's partner may have up to ``most`` shingles, and the row must itself be within the partner's ``most``.
    """
    order = np.lexsort((rows[:, 3], group))
    rows, base = rows[order], group[order] << 32
    n = rows[:, 3]
    most = np.maximum((n - rows[:, 4]) * (100 + least) // least - n, 0)
    up_to = np.searchsorted(base + n, base + most, side="right")
    largest = np.maximum.accumulate(base + most)
    before = np.minimum(np.arange(len(rows)), up_to) - 1  # the last row that may be a smaller partner
    smaller = (before >= 0) & (largest[before] >= base + n)
    larger = up_to > np.arange(len(rows)) + 1
    return rows[smaller | larger]


def _whole_keys(batches: Iterator[pa.RecordBatch], most: int = 0) -> Iterator[tuple[np.ndarray, bool]]:
    """Rows (columns key, part, ...) of whole keys, and False. Input sorted by key and part; the rows of a key may lie in several batches.

    Where ``most`` is given, no more rows than these and a batch are held: those of a larger key come in pieces, with True.
    """
    held: list[np.ndarray] = []
    waiting, full, now = 0, False, None
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        new = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
        stop = 0 if now is None or np.any(now != rows[0, :2]) else int(new[0]) if len(new) else len(rows)
        if stop and full:
            yield rows[:stop], True
        elif stop:
            held.append(rows[:stop])
            waiting += stop
        if stop < len(rows):
            if held:
                yield np.concatenate(held), False
            last = int(new[-1]) if len(new) else 0  # first row of the last key
            if stop < last:
                yield rows[stop:last], False
            held, waiting, full, now = [rows[last:]], len(rows) - last, False, rows[-1, :2].copy()
        if most and waiting > most:
            yield np.concatenate(held), True
            held, waiting, full = [], 0, True
    if held:
        yield np.concatenate(held), False


def _groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each key's rows."""
    starts = np.concatenate([[0], np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1])
    return starts, np.diff(np.concatenate([starts, [len(rows)]]))


def _told(pairs: list[np.ndarray]) -> np.ndarray:
    """Distinct pairs, the smaller node first, as two rows."""
    both = np.concatenate([np.zeros((0, 2), np.int64), *pairs]).T
    return np.unique(np.stack([both.min(axis=0), both.max(axis=0)])[:, both[0] != both[1]], axis=1)


def _first_pairs(batches: Iterator[pa.RecordBatch], least: int, most: int = 0) -> Iterator[pa.RecordBatch]:
    """Of the nodes that share a key: each with one of a few leaders (part is null), so no more pairs than rows.

    Of keys with three nodes and more, the rows that have a possible partner come out as well (b is 0), for what these pairs
    leave open. Rows of keys with more than ``most`` rows come out as they are (b is 1).
    """
    names = ["key", "part", "a", "b", "n", "place"]

    def told(rows: np.ndarray, mark: int) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(rows), 1 << 16):
            key, part, node, n, place = rows[s : s + (1 << 16)].T
            columns = [key, part, node, np.full(len(key), mark, np.int64), n.astype(np.int32), place.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    for rows, full in _whole_keys(batches, most):
        if full:
            yield from told(rows, 1)
            continue
        starts, sizes = _groups(rows)
        group = np.repeat(np.arange(len(starts)), sizes)
        # a key's leader: the node with the smallest of a few hashes, which of them the key tells
        mixed = (rows[:, 2] ^ ((rows[:, 0] & (LEADERS - 1)) * -0x61C8864680B583EB)) * -0x40A7B892E31B1A47
        order = np.lexsort((mixed, group))
        lead = rows[order[starts]][group]
        ok = _possible(rows[:, 3], rows[:, 4], lead[:, 3], lead[:, 4], least)
        a, b = _told([np.stack([rows[ok, 2], lead[ok, 2]], axis=1)])
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int32())], names)
        open_ = (sizes > 2)[group]
        yield from told(_with_partner(rows[open_], group[open_], least), 0)


def _close(one: np.ndarray, others: np.ndarray, least: int) -> np.ndarray:
    """Whether rows (key, part, node, n, place, root, sketch) can be similar enough and aren't joined yet."""
    n, m = one[..., 3], others[:, 3]
    apart = np.bitwise_count((one[..., 6:] ^ others[:, 6:]).view(np.uint64)).sum(axis=1)
    near = apart <= n + m - 2 * -(-least * (n + m) // (100 + least))
    return near & (one[..., 5] != others[:, 5]) & _possible(n, one[..., 4], m, others[:, 4], least)


def _more_pairs(batches: Iterator[pa.RecordBatch], least: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Of the nodes that share a key and aren't joined yet: each with the key's leader of this turn. Columns as for _open_pairs."""
    for rows, _ in _whole_keys(batches):
        starts, sizes = _groups(rows)
        group = np.repeat(np.arange(len(starts)), sizes)
        mixed = (rows[:, 2] ^ (((rows[:, 0] & (LEADERS - 1)) + LEADERS * turn) * -0x61C8864680B583EB)) * -0x40A7B892E31B1A47
        lead = rows[np.lexsort((mixed, group))[starts]][group]
        a, b = _told([np.stack([rows[:, 2], lead[:, 2]], axis=1)[_close(lead, rows, least)]])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _open_pairs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes that share a key and aren't joined yet. Columns key, part, node, n, place, root, sketch."""

    def told(pairs: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _told(pairs)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    pairs: list[np.ndarray] = []
    waiting = 0
    for rows, _ in _whole_keys(batches):
        starts, sizes = _groups(rows)
        group = np.repeat(np.arange(len(starts)), sizes)
        mixed = np.maximum.reduceat(rows[:, 5], starts) != np.minimum.reduceat(rows[:, 5], starts)
        rows = rows[mixed[group]]  # keys whose nodes are all joined have nothing left
        for start, size in zip(*(x.tolist() for x in _groups(rows)) if len(rows) else ([], [])):
            own = rows[start : start + size]
            own = own[np.unique(own[:, 2], return_index=True)[1]]
            own = own[np.argsort(own[:, 3], kind="stable")]
            stops = np.searchsorted(own[:, 3], own[:, 3] * 100 // least, side="right")
            for k, stop in enumerate(stops.tolist()):
                others = own[k + 1 : stop]
                near = others[_close(own[k], others, least), 2]
                if len(near):
                    pairs.append(np.stack([np.full(len(near), own[k, 2]), near], axis=1))
                    waiting += len(near)
                if waiting > PAIRS:
                    yield told(pairs)
                    pairs, waiting = [], 0
    yield told(pairs)


def _similar(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, x, y) whose sets x and y reach the share."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            u, v = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            common = len(np.intersect1d(u, v, assume_unique=True))
            keep.append(100 * common >= least * (len(u) + len(v) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with __id and __h, which tell a document."""
    return docs.withColumns({"__id": F.expr("try_cast(doc_id AS bigint)"), "__h": F.xxhash64(F.col("text").cast("string"))})


def _semi(docs: DataFrame, ids: DataFrame) -> DataFrame:
    other = ids.select(F.col("__id").alias("__id2"), F.col("__h").alias("__h2"))
    return docs.join(other, F.col("__h").eqNullSafe(F.col("__h2")) & F.col("__id").eqNullSafe(F.col("__id2")), "left_semi")


def _all_nodes(docs: DataFrame, size: int) -> DataFrame:
    """(__id, __h, node, fp, n, sketch, s0, s1, ...) of every document: the set of its shingles, its SimHash fingerprint, the set's size and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            texts = batch.column("text")
            sets = text_shingles(texts, size)
            short, long = _sketches(*sets)
            columns = [pa.array(_nodes(*sets)), pa.array(text_fingerprints(texts).view(np.int64)), pa.array(np.diff(sets[1]), pa.int32()), pa.array(long, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__h"), *columns, *map(pa.array, short.T)], ["__id", "__h", "node", "fp", "n", "sketch", *_WORDS])

    schema = "__id bigint, __h bigint, node bigint, fp bigint, n int, sketch binary, " + ", ".join(f"{s} bigint" for s in _WORDS)
    return _keyed(docs).select("__id", "__h", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _simhash_links(nodes: DataFrame, limit: int) -> DataFrame:
    """Links (a, b) that join the nodes of each SimHash group."""
    pairs = nodes.select("fp", "node").distinct()
    groups = components(hamming_links(pairs.select("fp").distinct(), limit)).withColumnRenamed("node", "fp")
    named = pairs.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "a")
    return named.join(least, "root").select("a", F.col("node").alias("b")).filter("a <> b").distinct()


def _common(docs: DataFrame, size: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that a sample of the documents holds most often, ascending, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(text_shingles(batch.column("text"), size)[0].view(np.int64))], ["key"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    if rows > SAMPLE:
        texts = texts.filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) < F.lit(1_000_000 * SAMPLE // rows))
    counts = texts.mapInArrow(run, "key bigint").groupBy("key").count().filter("count > 1").orderBy(F.desc("count"), "key").limit(COMMON).toArrow()
    keys, often = (counts.column(k).to_numpy().astype(np.int64) for k in ("key", "count"))
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    return keys[order], often[order]


def _prefixes(docs: DataFrame, size: int, least: int, rows: int, block: int) -> DataFrame:
    """(key, part, node, n, place) for the first shingles of each set; a task tells a set once."""
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs, size, rows))
    scale = max(1.0, rows / SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = sent.value
        told: set[int] = set()
        for batch in slices(batches, "text", SLICE):
            hashes, ends = text_shingles(batch.column("text"), size)
            nodes, n = _nodes(hashes, ends), np.diff(ends)
            hashes, seen = _in_order(hashes, ends, common, often)
            fresh = np.zeros(len(nodes), bool)
            for k, node in enumerate(nodes.tolist()):
                if node not in told:
                    fresh[k] = True
                    if len(told) < 1 << 20:
                        told.add(node)
            counts = np.where(fresh & (n > 0), n + least * n // -100 + 1, 0)
            at = ragged(ends[:-1], counts)
            row, place = np.repeat(np.arange(len(nodes)), counts), ragged(np.zeros(len(counts), np.int64), counts)
            blocks = np.maximum(1, np.ceil(seen[at] * scale / block)).astype(np.int64)
            other = ragged(np.zeros(len(at), np.int64), blocks)
            at, row, place, blocks = (np.repeat(v, blocks) for v in (at, row, place, blocks))
            own = nodes[row].view(np.uint64) % blocks.astype(np.uint64)
            own = own.astype(np.int64)
            part = np.minimum(own, other) << 32 | np.maximum(own, other)
            for s in range(0, len(at), 1 << 16):
                t = slice(s, s + (1 << 16))
                columns = [hashes[at[t]].view(np.int64), part[t], nodes[row[t]], n[row[t]].astype(np.int32), place[t].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "part", "node", "n", "place"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key bigint, part bigint, node bigint, n int, place int")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            hashes, ends = text_shingles(batch.column("text"), size)
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(hashes, ends)), binaries(hashes, ends)], ["node", "shingles"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "node bigint, shingles binary")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes aren't joined yet."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _reach(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, least: int) -> DataFrame:
    """The pairs that reach the share: long sketches rule pairs out, the others are compared as whole sets; of texts with equal sets one is read."""
    pairs = _store.stored(pairs.distinct(), "candidates")
    about = nodes.select("node", "n", "sketch").join(_ends(pairs), "node", "left_semi").dropDuplicates(["node"])
    both = pairs.join(about.select(F.col("node").alias("a"), "n", F.col("sketch").alias("x")), "a").join(about.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y")), "b")
    maybe = _store.stored(both.select("a", "b", "n", "m", "x", "y").mapInArrow(lambda it: _maybe(it, least), _TWO), "maybe")
    rows = nodes.join(_ends(maybe), "node", "left_semi").groupBy("node", "__h", "__id").agg(F.count(F.lit(1)).alias("rows"))
    need = rows.groupBy("node").agg(F.min(F.struct("__h", "__id", "rows")).alias("d")).select("d.__id", "d.__h", "d.rows")
    need = _store.stored(need, "need")  # so that its size is known and the texts aren't shuffled where it is small
    sets = _sets(_semi(_keyed(docs), need), size)
    if not need.filter("rows > 1").isEmpty():
        sets = sets.dropDuplicates(["node"])
    sets = _store.stored(sets, "sets")
    both = maybe.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    links = _store.stored(both.select("a", "b", "x", "y").mapInArrow(lambda it: _similar(it, least), _TWO), "similar")
    _store.remove(pairs, maybe, need, sets)
    return links


def _dealt(full: DataFrame, block: int) -> DataFrame:
    """Rows (key, part, node, n, place) of the keys with too many rows, which are counted here, in pairs of blocks of these."""
    counts = full.groupBy("key", "part").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    own = F.pmod(F.xxhash64("a"), F.col("blocks"))
    rows = full.join(counts, ["key", "part"]).withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))})
    part = F.xxhash64("part", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select("key", part.alias("part"), F.col("a").alias("node"), "n", "place")


def similar_links(docs: DataFrame, nodes: DataFrame, size: int = 5, least: int = 80, block: int = BLOCK, joined: DataFrame | None = None) -> DataFrame:
    """Links (a, b) among the nodes, a stored table: ``joined``, and enough pairs with at least ``least`` percent similarity to join all such pairs.

    Nodes that share a shingle are compared with a few leaders first. What these links and ``joined`` join isn't compared
    any more, so a group of near copies takes about as many comparisons as it has members, not as many as pairs.
    """
    schema = "key bigint, part bigint, a bigint, b bigint, n int, place int"

    def by_key(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "part").sortWithinPartitions("key", "part")

    keys = by_key(_prefixes(docs, size, least, nodes.count(), block))
    told = _store.stored(keys.mapInArrow(lambda it: _first_pairs(it, least, FULL * block), schema), "keys")
    used = [told]
    full = told.filter("b = 1 and part is not null")
    if not full.isEmpty():
        used.append(_store.stored(by_key(_dealt(full, block)).mapInArrow(lambda it: _first_pairs(it, least), schema), "keys"))
        told = told.filter("b <> 1 or part is null").unionByName(used[-1])
    links = joined if joined is not None else nodes.sparkSession.createDataFrame([], _TWO)
    sketches = nodes.groupBy("node").agg(*[F.first(s).alias(s) for s in _WORDS])

    def reached(pairs: DataFrame) -> DataFrame:
        used.append(_reach(docs, nodes, pairs, size, least))
        return links.unionByName(used[-1])

    def rest(roots: DataFrame) -> DataFrame:
        rows = told.filter("part is not null").withColumnRenamed("a", "node").join(roots, "node", "left").join(sketches, "node")
        return by_key(rows.select("key", "part", "node", "n", "place", F.coalesce("root", "node").alias("root"), *_WORDS))

    roots = components(links)
    links = reached(_apart(told.filter("part is null").select("a", "b"), roots))
    _store.remove(roots)
    for turn in range(1, ROUNDS + 1):
        roots = components(links)
        links = reached(rest(roots).mapInArrow(lambda it, turn=turn: _more_pairs(it, least, turn), _TWO))
        _store.remove(roots)
    roots = components(links)
    links = _store.stored(reached(rest(roots).mapInArrow(lambda it: _open_pairs(it, least), _TWO)), "near")
    _store.remove(roots, *used)
    return links


def one_of_each(docs: DataFrame, size: int = 5, least: int = 80, limit: int = LIMIT) -> DataFrame:
    """The documents without near-duplicates: of each group the one with the smallest doc_id (nulls last), with its columns."""
    nodes = _store.stored(_all_nodes(docs, size), "nodes")
    joined = _store.stored(_simhash_links(nodes, limit), "joined")
    links = similar_links(docs, nodes, size, least, joined=joined)
    _store.remove(joined)
    roots = components(links)
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = named.groupBy("root").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__h")).alias("d")).select("d.__id", "d.__h")
    kept = _store.stored(kept, "kept")
    own = _semi(_keyed(docs), kept)
    if not _semi(nodes, kept).groupBy("__id", "__h").count().filter("count > 1").isEmpty():
        own = own.dropDuplicates(["__id", "__h"])
    _store.remove(links, roots, nodes)
    return own.select(*docs.columns)
