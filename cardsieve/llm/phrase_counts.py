"""Phrases that stick together: exact counts of word sequences in a HAT-trie, scored by the weakest cut.

Two passes over the texts, both in blocks of a task's own rows:

1. Every sequence of 1 to ``LONGEST`` words is hashed into one of 2**``BITS`` buckets for its length. A task sorts its buckets,
   ``HELD`` at a time, and sends them in ranges with their counts; a range is added up in one table. A sequence can reach
   ``least`` only if its bucket does. Counts stop at ``least``, which changes no answer, so a cell is one byte. What is left
   is one bit a bucket: a broadcast of fixed size (32 MB).
2. A sequence whose bucket and whose shorter parts' buckets reach ``least`` is counted exactly. Equal ones of a block are
   added up first, then go to the task's HAT-trie. Its nodes fan out ``FAN`` ways by a word's id (a node's first level by the
   first word, the next by the second, ...); below hang hash containers that hold whole keys and counts as columns, so adding
   and merging is done for many entries at a time. A container beyond ``BURST`` distinct entries bursts into a node. Beyond
   ``ENTRIES`` the largest subtrees are written out whole: their entries are dealt by prefix (a hash of language and all words
   but the last) and packed, sorted by phrase, into one run for each prefix partition. Spark brings a partition's runs
   together and they are merged one after another, in a table of the partition's phrases. There are ``PARTS`` partitions, or
   one for each of the session's shuffle partitions if those are more, so a partition stays small as the input grows.

Hashes only rule out; counts are of the words themselves. The tables shrink the second pass at moderate sizes; where nearly
all buckets reach ``least`` they rule out little and the counts are the same.

Defined cases: a null language is ``und`` and counted with texts that say so; a null or empty text has no words; rows are
counted as often as they occur, ids are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _store
from ._text import LOWER, gathered, remap

LONGEST = 4
#: Each length has 2**BITS buckets, of one bit in the broadcast.
BITS = 26
#: Buckets that are added up in one table; buckets that a task holds and sorts.
RANGE, HELD = 1 << 22, 1 << 23
#: Entries of a container, ways of a node.
BURST, FAN = 1 << 16, 16
#: Entries of a task's trie beyond which subtrees are written out; bytes of text in a block.
ENTRIES, BLOCK = 1 << 21, 4 << 20
#: Prefix partitions at least; phrases of a run; unmerged entries of a partition beyond which they are added up.
PARTS, RUN, LOOSE = 64, 1 << 17, 1 << 19
#: Parts that the best phrases of a language are picked from first.
SALT = 64

_SPACE, _BREAK = 32, 10
#: Byte map: A-Z lower-cased, tab to space, signs between pieces to a line feed.
PIECES = LOWER.copy()
PIECES[9] = _SPACE
PIECES[[*b".,;:!?", 10, 11, 12, 13]] = _BREAK


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """All words of all texts in order, the piece of each (pieces have distinct numbers), and the text of each."""
    clean = remap(texts, PIECES)
    offsets = np.frombuffer(clean.buffers()[1], np.int32, len(clean) + 1).astype(np.int64)
    data = np.frombuffer(clean.buffers()[2], np.uint8, offsets[-1]) if offsets[-1] else np.zeros(0, np.uint8)
    inside = (data != _SPACE) & (data != _BREAK)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a word never runs over the end of a text
    first = first[:-1]
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    last = np.concatenate([first[1:], [True]]) if len(inside) else inside
    starts, ends = np.flatnonzero(inside & (~before | first)), np.flatnonzero(inside & (~after | last)) + 1
    bounds = np.zeros(2 * len(starts) + 2, np.int32)
    bounds[1:-1:2], bounds[2:-1:2], bounds[-1] = starts, ends, len(data)
    # gaps and words take turns: words have odd places
    turns = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data) if len(data) else pa.py_buffer(b""))
    words = turns.take(pa.array(np.arange(1, len(turns), 2)[: len(starts)])).dictionary_encode()
    piece = np.cumsum((data == _BREAK) | first)[starts] if len(starts) else np.zeros(0, np.int64)
    return words, piece, np.searchsorted(offsets, starts, side="right") - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Block:
    """Words of a block of texts, and the places where a sequence of each length may start."""

    def __init__(self, batch: pa.RecordBatch):
        self.words, piece, text = words_of(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        self.langs, self.lang = langs.dictionary.to_pylist(), langs.indices.to_numpy()[text]
        self.ids = self.words.indices.to_numpy().astype(np.int64)
        names = self.words.dictionary.to_pylist()
        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
        base = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in self.langs), np.uint64, len(self.langs))
        self.hash, self.base, self.piece = own[self.ids], base[self.lang], piece

    def buckets(self, size: int) -> np.ndarray:
        """Bucket of the sequence of ``size`` words at each place, -1 where the piece ends before."""
        n = len(self.ids) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        total = self.base[:n].copy()
        for k in range(size):
            total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + self.hash[k : k + n])
        found = (total >> np.uint64(64 - BITS)).astype(np.int64)
        return np.where(self.piece[:n] == self.piece[size - 1 : size - 1 + n], found, -1)


def _coded(values: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """(range, n, cells) of the buckets: steps between the n distinct ones of a range as three planes of bytes, then their counts."""
    values, codec = np.sort(values), pa.Codec("zstd", 1)
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    values, counts = values[at], np.minimum(np.diff(np.append(at, len(values))), least).astype(np.uint8)
    part = values // RANGE
    ends = np.flatnonzero(np.concatenate([part[1:] != part[:-1], [True]])) + 1
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        low = values[a:b] % RANGE
        steps = np.diff(low, prepend=np.uint32(0))
        planes = [(steps >> np.uint32(shift)).astype(np.uint8).tobytes() for shift in (0, 8, 16)]
        cells = codec.compress(b"".join([*planes, counts[a:b].tobytes()]), asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int32()), pa.array([b - a], pa.int32()), pa.array([cells], pa.binary())], ["range", "n", "cells"])


def _tables(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Coded buckets of all sequences; those of length k lie from (k - 1) * 2**BITS."""
    held, n = [], 0
    for batch in gathered(batches, "text", BLOCK):
        block = Block(batch)
        for size in range(1, LONGEST + 1):
            found = block.buckets(size)
            held.append((found[found >= 0] + ((size - 1) << BITS)).astype(np.uint32))
            n += len(held[-1])
        if n >= HELD:
            yield from _coded(np.concatenate(held), least)
            held, n = [], 0
    if n:
        yield from _coded(np.concatenate(held), least)


def _bits(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(range, bits): rows come sorted by range, and a range's cells are added one row after another."""
    codec, now, total = pa.Codec("zstd"), None, np.zeros(RANGE, np.uint8)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["range", "bits"])

    for batch in batches:
        for k, n, cells in zip(batch.column("range").to_pylist(), batch.column("n").to_pylist(), batch.column("cells")):
            if k != now:
                if now is not None:
                    yield out()
                now, total = k, np.zeros(RANGE, np.uint8)
            *planes, counts = np.frombuffer(codec.decompress(cells.as_buffer(), 4 * n), np.uint8).reshape(4, n)
            at = np.cumsum(sum(plane.astype(np.int64) << shift for plane, shift in zip(planes, (0, 8, 16))))
            total[at] = np.minimum(total[at] + counts, least)  # both are at most ``least`` <= 127, so a byte holds the sum
    if now is not None:
        yield out()


#: Columns of a trie's keys, and of its entries.
_KEY = [f"w{k}" for k in range(LONGEST)]
_NONE = -1


class HatTrie:
    """Counts of sequences of ids (int32, ``_NONE`` behind the end): nodes by id near the root, hash containers below."""

    def __init__(self, burst: int = BURST, depth: int = 0):
        self.burst, self.depth = burst, depth
        self.children: list[HatTrie] | None = None
        self.held: list[pa.Table] = []
        self.entries, self.loose = 0, 0

    def add(self, entries: pa.Table) -> None:
        """``entries``: _KEY and count; keys may repeat. A container adds its entries up when the new ones have doubled it."""
        if not entries.num_rows:
            return
        if self.children is not None:
            for child, part in zip(self.children, self._dealt(entries)):
                child.add(part)
            self.entries = sum(c.entries for c in self.children)
            return
        self.held.append(entries)
        self.loose += entries.num_rows
        self.entries += entries.num_rows
        if self.loose * 2 > self.entries and self.entries > self.burst:
            self._merge()
            if self.entries > self.burst and self.depth < LONGEST:
                whole, self.held = self.held, []
                self.children = [HatTrie(self.burst, self.depth + 1) for _ in range(FAN)]
                self.entries = 0
                for table in whole:
                    self.add(table)

    def _merge(self) -> None:
        """The container as a hash table: one entry for each key."""
        table = pa.concat_tables(self.held).group_by(_KEY, use_threads=False).aggregate([("count", "sum")]).rename_columns([*_KEY, "count"])
        self.held, self.entries, self.loose = [table], table.num_rows, 0

    def _dealt(self, entries: pa.Table) -> list[pa.Table]:
        """Entries by the id at this depth, FAN ways; those that end before it go with id -1."""
        way = (entries.column(_KEY[self.depth]).to_numpy() // FAN**self.depth) % FAN
        order = np.argsort(way, kind="stable")
        cuts = np.searchsorted(way[order], np.arange(FAN + 1))
        sorted_ = entries.take(pa.array(order))
        return [sorted_.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]

    def taken(self, keep: int) -> Iterator[pa.Table]:
        """Take whole subtrees out, the largest first, until at most ``keep`` entries stay; one entry for each key."""
        if self.children is None:
            if self.entries > keep:
                self._merge()
                yield self.held[0]
                self.held, self.entries, self.loose = [], 0, 0
            return
        for child in sorted(self.children, key=lambda c: -c.entries):
            if self.entries <= keep:
                break
            before = child.entries
            yield from child.taken(0)
            self.entries -= before


def _distinct(block: Block, hot: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: places of one sequence of each kind that may be frequent, and how often it occurs in the block."""
    alive = pairs = None
    n_words, n_langs = max(len(block.words.dictionary), 1), max(len(block.langs), 1)
    for size in range(1, LONGEST + 1):
        bucket = block.buckets(size)
        fine = bucket >= 0
        fine[fine] = (hot[size - 1][bucket[fine] >> 3] >> (7 - (bucket[fine] & 7)).astype(np.uint8)) & 1
        if alive is not None:
            fine &= alive[: len(fine)] & alive[1 : len(fine) + 1]
        at = np.flatnonzero(fine)
        # exact keys below 2**63: a word or a pair of words has a dense number in this block
        if size == 1:
            key = block.lang[at].astype(np.int64) * n_words + block.ids[at]
        elif size == 2:
            _, key = np.unique((block.lang[at].astype(np.int64) * n_words + block.ids[at]) * n_words + block.ids[at + 1], return_inverse=True)
            pairs = np.zeros(len(fine), np.int64)
            pairs[at] = key
        else:
            key = pairs[at] * max(n_words, len(block.ids)) + (block.ids[at + 2] if size == 3 else pairs[at + 2])
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        alive = fine
        yield at[first], count


_FIELDS = ["lang", "words", "phrase", "count"]
_RUN = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("count", pa.int64())])
_PACKED = "part int, run binary"


def _packed(part: int, run: pa.Table) -> pa.RecordBatch:
    """A run as one row: an Arrow stream, compressed."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _RUN, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(run.cast(_RUN))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["part", "run"])


def _runs(batches: Iterator[pa.RecordBatch], hot: Sequence[np.ndarray], burst: int, entries: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Packed runs (lang, words, phrase, count) of subtrees; words 0: all words of the language in these texts."""
    trie, ids, names, totals = HatTrie(burst), {}, [], {}

    def run(keep: int) -> Iterator[pa.RecordBatch]:
        """The first word's id stands for language and word, the others' for the word alone."""
        known = pa.array([w for _, w in names], pa.string())
        langs = pa.array([v for v, _ in names], pa.string())
        own = np.fromiter((xxhash.xxh64_intdigest(w if v is None else f"{v} {w}") for v, w in names), np.uint64, len(names))
        held: list[pa.Table] = []
        for table in trie.taken(keep):
            held.append(table)
            if sum(t.num_rows for t in held) >= RUN * 4:
                yield from dealt(pa.concat_tables(held), known, langs, own)
                held = []
        if held:
            yield from dealt(pa.concat_tables(held), known, langs, own)

    def dealt(table: pa.Table, known: pa.Array, langs: pa.Array, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = [table.column(k).combine_chunks().to_numpy() for k in _KEY]
        size = sum((k != _NONE).astype(np.int32) for k in keys)
        prefix = _mixed(own[keys[0]])
        for k in range(1, LONGEST - 1):
            prefix = np.where(size > k + 1, _mixed(prefix + own[keys[k]]), prefix)
        part = (prefix % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        counts = table.column("count").combine_chunks()
        for p in np.flatnonzero(np.diff(cuts)):
            for at in range(cuts[p], cuts[p + 1], RUN):
                rows = order[at : min(at + RUN, cuts[p + 1])]
                words = [known.take(pa.array(k[rows], mask=k[rows] == _NONE)) for k in keys]
                phrase = pc.binary_join_element_wise(*words, " ", null_handling="skip")
                run = pa.table([langs.take(pa.array(keys[0][rows])), pa.array(size[rows], pa.int32()), phrase, counts.take(pa.array(rows))], _FIELDS)
                yield _packed(int(p), run.sort_by([("lang", "ascending"), ("phrase", "ascending")]))

    def numbered(lang: str | None, words: list[str]) -> list[int]:
        out = []
        for w in words:
            k = ids.setdefault((lang, w), len(ids))
            if k == len(names):
                names.append((lang, w))
            out.append(k)
        return out

    for batch in gathered(batches, "text", BLOCK):
        block = Block(batch)
        for lang, n in zip(block.langs, np.bincount(block.lang, minlength=len(block.langs)).tolist()):
            totals[lang] = totals.get(lang, 0) + n
        plain = np.full(len(block.words.dictionary), _NONE, np.int32)
        opening = {}
        for size, (at, count) in enumerate(_distinct(block, hot), 1):
            if size == 1:  # every word of a longer sequence is one that may be frequent itself
                own, lang = block.ids[at], block.lang[at]
                used = np.unique(own)
                plain[used] = numbered(None, block.words.dictionary.take(pa.array(used)).to_pylist())
                for k, name in enumerate(block.langs):
                    mine = np.unique(own[lang == k])
                    opening[k] = np.full(len(plain), _NONE, np.int32)
                    opening[k][mine] = numbered(name, block.words.dictionary.take(pa.array(mine)).to_pylist())
            columns = [np.full(len(at), _NONE, np.int32) for _ in range(LONGEST)]
            for k, table in opening.items():
                mine = block.lang[at] == k
                columns[0][mine] = table[block.ids[at[mine]]]
            for k in range(1, size):
                columns[k] = plain[block.ids[at + k]]
            trie.add(pa.table([*map(pa.array, columns), pa.array(count.astype(np.int64))], [*_KEY, "count"]))
        if trie.entries > entries:
            yield from run(entries // 2)
    yield from run(0)
    if totals:
        n = len(totals)
        yield _packed(0, pa.table([pa.array(list(totals), pa.string()), pa.array([0] * n, pa.int32()), pa.array([""] * n), pa.array(list(totals.values()), pa.int64())], _FIELDS))


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Merge the runs of each partition (rows come sorted by it); what stays below ``least`` goes."""
    now, held, loose = None, [], 0

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(_FIELDS[:3], use_threads=False).aggregate([("count", "sum")]).rename_columns(_FIELDS)

    def out() -> list[pa.RecordBatch]:
        rows = added(held)
        return rows.filter(pc.or_(pc.greater_equal(rows["count"], least), pc.equal(rows["words"], 0))).combine_chunks().to_batches(max_chunksize=1 << 16)

    for batch in batches:
        for part, packed in zip(batch.column("part").to_pylist(), batch.column("run")):
            if part != now and held:
                yield from out()
                held, loose = [], 0
            now = part
            with pa.ipc.open_stream(packed.as_buffer()) as reader:
                held.append(reader.read_all())
            loose += held[-1].num_rows
            if loose > max(LOOSE, held[0].num_rows):  # as many new entries as merged ones
                held, loose = [added(held)], 0
    if held:
        yield from out()


_COUNTS = "lang string, words int, phrase string, count bigint"


def frequent(documents: DataFrame, least: int = 30, burst: int = BURST, entries: int = ENTRIES) -> DataFrame:
    """lang, words, phrase, count of every sequence of 1 to LONGEST words with ``least`` occurrences; words 0: all words of the language."""
    if not 1 <= least <= 127:
        raise ValueError("least is 1 to 127")
    spark = documents.sparkSession
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tables = texts.mapInArrow(lambda it: _tables(it, least), "range int, n int, cells binary")
    ranges = LONGEST * (1 << BITS) // RANGE
    with _store.shuffle_cleanup(spark):
        found = tables.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(lambda it: _bits(it, least), "range int, bits binary").toArrow()
    packed = np.zeros((ranges, RANGE // 8), np.uint8)
    for k, bits in zip(found["range"].to_pylist(), found["bits"].to_pylist()):
        packed[k] = np.frombuffer(bits, np.uint8)
    sent = spark.sparkContext.broadcast(packed.reshape(LONGEST, -1))  # LONGEST * 2**BITS / 8 bytes, whatever the input
    parts = max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    runs = texts.mapInArrow(lambda it: _runs(it, sent.value, burst, entries, parts), _PACKED)
    dealt = runs.repartition(parts, "part").sortWithinPartitions("part")
    return _store.stored(dealt.mapInArrow(lambda it: _merged(it, least), _COUNTS), "phrases")


def _part(start: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice("split", start, size), " ")


def collocations(documents: DataFrame, least: int = 30, top: int = 2000, covered: int = 80, **settings) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language whose weakest cut scores highest.

    score is floor(2000000 * a / (l + r)) at the lowest-scoring cut. A phrase goes if a longer candidate around it occurs at
    least ``covered`` percent as often. Products are decimals: exact beyond 64 bits."""
    counts = frequent(documents, least, **settings)
    phrases = counts.filter("words >= 1").select("lang", "phrase", F.col("count").alias("f"))
    candidates = counts.filter("words >= 2").select("lang", "phrase", "words", F.col("count").alias("a"), F.split("phrase", " ").alias("split"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # sequences inside longer candidates, each with the largest count around it
    inner = candidates.filter("words >= 3").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1))).groupBy("lang", _part(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("around"))
    left = scored.join(inner, ["lang", "phrase"], "left").filter(F.expr(f"around is null or cast(100 as decimal(3,0)) * around < cast({int(covered)} as decimal(3,0)) * a"))
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*best)).cast("bigint")
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALT))
    left = left.withColumn("part", part).withColumn("place", place("lang", "part")).filter(F.col("place") <= top)
    left = left.withColumn("rank", place("lang")).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", F.col("count").alias("n"))
    return left.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
