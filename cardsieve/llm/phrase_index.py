"""Benchmark decontamination by a distributed positional inverted index.

Documents are cut into segments of bounded size. A segment holds, for every word in it, the ascending list of positions
(a position space of its own, documents apart by a gap, so that no phrase crosses two of them). Segments are rows of a
table in the shared folder. A search looks up the words of the phrases, starts from the rarest one in the segment and
intersects the offset-adjusted lists of the others in order of length, so common words are touched last and mostly never.

Defined cases: a null or empty text has no words and gets a row with zeros; null or repeated doc_id values are kept, one
row out for each row in; items without words match nothing; rows of one item_id count as one item; items with a null
item_id hit words like any others but aren't counted or named as items; ids that are no numbers count as null; extra columns
are ignored. An item with fewer words than the window is one window as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store
from ._text import ALNUM, gathered, ragged, split_words

#: Positions between the last word of a document and the first of the next one; longer than any window.
GAP = 64
SEGMENT_BYTES = 16 << 20
#: Phrases are sent to the tasks in blocks of at most about this many bytes of text.
BLOCK_BYTES = 16 << 20
SEGMENT_SCHEMA = "segment bigint, doc_ids array<bigint>, n_words binary, starts binary, terms binary, term_ends binary, list_ends binary, positions binary"
HIT_SCHEMA = "segment bigint, row int, doc_id bigint, n_words bigint, hit_starts array<bigint>, hit_ends array<bigint>, items array<bigint>"


def _segment(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
    words, ends = split_words(batch.column("text"), ALNUM)
    lengths = np.diff(ends)
    starts = ends[:-1] + np.arange(len(lengths)) * GAP
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    order = np.argsort(codes, kind="stable")
    positions = ragged(starts, lengths)[order].astype(np.uint32)
    vocabulary = coded.dictionary
    raw = b"".join(vocabulary.cast(pa.binary()).to_pylist())
    term_ends = np.cumsum(pc.binary_length(vocabulary).to_numpy(zero_copy_only=False)).astype(np.uint32)
    list_ends = np.cumsum(np.bincount(codes, minlength=len(vocabulary))).astype(np.uint32)
    blob = lambda x, t: pa.array([x.astype(t).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), blob(lengths, np.int64), blob(starts, np.int64), pa.array([raw], pa.binary()), blob(term_ends, np.uint32), blob(list_ends, np.uint32), blob(positions, np.uint32)],
        ["segment", "doc_ids", "n_words", "starts", "terms", "term_ends", "list_ends", "positions"],
    )


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write the segments of all documents (doc_id, text) to the shared folder; returns the table of segments."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(gathered(batches, "text", segment_bytes)):
            yield _segment(batch, first + number)

    rows = docs.select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _store.stored(rows.mapInArrow(build, SEGMENT_SCHEMA), "postings", per_file=4)


class Segment:
    """One row of the table of segments, opened for search."""

    def __init__(self, row: dict):
        self.number, self.doc_ids = row["segment"], row["doc_ids"]
        self.n_words = np.frombuffer(row["n_words"], np.int64)
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.positions = np.frombuffer(row["positions"], np.uint32)
        self.lists = np.concatenate([[0], np.frombuffer(row["list_ends"], np.uint32)]).astype(np.int64)
        ends = np.concatenate([[0], np.frombuffer(row["term_ends"], np.uint32)]).astype(np.int32)
        self.terms = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(row["terms"]))

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Term number (-1: not here) and list length of each word."""
        number = pc.fill_null(pc.index_in(words, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        length = np.where(number >= 0, self.lists[number + 1] - self.lists[number], 0)
        return number, length

    def postings(self, number: int) -> np.ndarray:
        return self.positions[self.lists[number] : self.lists[number + 1]].astype(np.int64)

    def phrase(self, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Start positions of an exact phrase: the rarest word first, the others by rising length."""
        order = np.argsort(lengths, kind="stable")
        starts = self.postings(numbers[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            held = self.postings(numbers[k])
            at = np.searchsorted(held, starts + k)
            starts = starts[(at < len(held)) & (held[np.minimum(at, len(held) - 1)] == starts + k)]
        return starts

    def near(self, numbers: np.ndarray, lengths: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest word that have every other word at most ``slop`` positions away."""
        order = np.argsort(lengths, kind="stable")
        centre = self.postings(numbers[order[0]])
        for k in order[1:]:
            held = self.postings(numbers[k])
            at = np.searchsorted(held, centre - slop)
            centre = centre[(at < len(held)) & (held[np.minimum(at, len(held) - 1)] <= centre + slop)]
        return centre

    def documents(self, positions: np.ndarray) -> np.ndarray:
        """Row of the document that holds each position."""
        return np.searchsorted(self.starts, positions, side="right") - 1


class Phrases:
    """Items cut into windows, ready to be sent to the tasks."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        words, ends = split_words(pa.array([t for _, t in items], pa.string()), ALNUM)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        self.vocabulary = coded.dictionary
        seen: dict[tuple[int, bytes], None] = {}
        for (item, _), a, b in zip(items, ends[:-1], ends[1:]):
            for s in range(a, max(a + 1, b - window + 1) if b > a else a):
                seen[item, codes[s : min(s + window, b)].tobytes()] = None
        #: for each number of words the windows' items, and their words as rows of a matrix
        self.windows: list[tuple[list, np.ndarray]] = []
        for size in sorted({len(raw) for _, raw in seen}):
            own = [(item, raw) for item, raw in seen if len(raw) == size]
            self.windows.append(([item for item, _ in own], np.frombuffer(b"".join(raw for _, raw in own), codes.dtype).reshape(len(own), -1)))


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _hits(segment: Segment, phrases: Phrases) -> pa.RecordBatch:
    number, length = segment.look_up(phrases.vocabulary)
    found: dict[int, list] = {}
    for items, matrix in phrases.windows:
        for k in np.flatnonzero((length[matrix] > 0).all(axis=1)).tolist():  # every word is somewhere in the segment
            starts = segment.phrase(number[matrix[k]], length[matrix[k]])
            for row, start in zip(segment.documents(starts).tolist(), starts.tolist()):
                found.setdefault(row, []).append((items[k], start - int(segment.starts[row]), matrix.shape[1]))
    columns: list[list] = [[], [], []]
    for row in range(len(segment.doc_ids)):
        hits = found.get(row, [])
        spans = _merged(np.array([h[1] for h in hits], np.int64), np.array([h[1] + h[2] for h in hits], np.int64))
        columns[0].append([a for a, _ in spans])
        columns[1].append([b for _, b in spans])
        columns[2].append(sorted({h[0] for h in hits}, key=lambda x: (x is None, x or 0)))
    lists = [pa.array(c, pa.list_(pa.int64())) for c in columns]
    n = len(segment.doc_ids)
    own = [pa.array(np.full(n, segment.number)), pa.array(np.arange(n, dtype=np.int32)), pa.array(segment.doc_ids, pa.int64()), pa.array(segment.n_words, pa.int64())]
    return pa.RecordBatch.from_arrays([*own, *lists], ["segment", "row", "doc_id", "n_words", "hit_starts", "hit_ends", "items"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Segment(batch.slice(k, 1).to_pylist()[0])


def find_phrases(index: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """Every document with the word ranges [hit_starts, hit_ends) that lie in an occurrence of a window, and the items.

    ``items`` has item_id and text. It is read in blocks of bounded size; one block goes to the tasks at a time.
    """
    if not 1 <= window < GAP:
        raise ValueError(f"window must be from 1 to {GAP - 1}")
    spark = index.sparkSession
    items = items.select(F.expr("try_cast(item_id AS bigint)").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    parts = []
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        sent = spark.sparkContext.broadcast(Phrases([(r.item_id, r.text) for r in block.distinct().collect()], window))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for segment in _opened(batches):
                yield _hits(segment, sent.value)

        parts.append(index.mapInArrow(search, HIT_SCHEMA))
    columns = ["doc_id", "n_words", "hit_starts", "hit_ends", "items"]
    if blocks == 1:
        return parts[0].select(columns)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    spans = every.groupBy("segment", "row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        _joined(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("hit_starts", "hit_ends"))))).alias("pairs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return spans.withColumns({"hit_starts": F.col("pairs.hit_starts"), "hit_ends": F.col("pairs.hit_ends")}).select(columns)


def _joined(pairs: Column) -> Column:
    """Sorted ranges with those that touch or overlap made one."""

    def step(done: Column, pair: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["hit_starts"].alias("hit_starts"), F.greatest(last["hit_ends"], pair["hit_ends"]).alias("hit_ends"))
        touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["hit_ends"] >= pair["hit_starts"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(pair)))

    return F.aggregate(pairs, F.filter(pairs, lambda _: F.lit(False)), step)


def find_near(index: DataFrame, queries: list[tuple[int, str]], slop: int = 8) -> DataFrame:
    """Proximity matches: (doc_id, query_id, word) where all words of the query lie within ``slop`` words of its rarest one."""
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be from 0 to {GAP - 1}")
    vocabulary = [(q, split_words(pa.array([t]), ALNUM)[0].unique()) for q, t in queries]
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment in _opened(batches):
            rows = []
            for query, words in sent.value:
                number, length = segment.look_up(words)
                if len(words) and length.all():
                    at = segment.near(number, length, slop)
                    rows += [(segment.doc_ids[r], query, p - int(segment.starts[r])) for r, p in zip(segment.documents(at).tolist(), at.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["doc_id", "query_id", "word"])

    return index.mapInArrow(search, "doc_id bigint, query_id bigint, word bigint")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document.

    contaminated: some words are hit and they are at least one in ``share`` of the document's words.
    """
    return _judged(build_index(docs), items, window, share)


def _judged(index: DataFrame, items: DataFrame, window: int, share: int) -> DataFrame:
    hits = find_phrases(index, items, window)
    n_hit = F.aggregate(F.zip_with("hit_ends", "hit_starts", lambda b, a: b - a), F.lit(0).cast("bigint"), lambda x, y: x + y)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(F.array_compact("items")).cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """The documents that are not contaminated, with their columns. A row is decided by its own text, whatever its doc_id.

    What is contaminated is written to the shared folder, then the index is removed.
    """
    own = docs.withColumn("__text", F.xxhash64(F.col("text").cast("string")))
    index = build_index(own.select(F.col("__text").alias("doc_id"), "text"))
    bad = _judged(index, items, window, 20).filter("contaminated").select(F.col("doc_id").alias("__text")).distinct()
    bad = _store.stored(bad, "contaminated")
    _store.remove(index)
    return own.join(bad, "__text", "left_anti").select(*docs.columns)
