"""Token-id files compressed by a static range asymmetric numeral system (rANS).

One frequency table, counted over all documents, is shared by all files. A file holds a run of documents in ascending
doc_id order: a header with the documents' ids and token counts, then independent blocks. A block's tokens are dealt in
turn to interleaved lanes, each with a state of its own, so that numpy codes all lanes of a step at once. Blocks carry a
CRC-32 and, at fixed steps, checkpoints (stream position and lane states), so that decoding can begin at any block or
checkpoint on any machine.

Defined cases: a null or empty text has the end id alone; rows with equal doc_id all stay, in any order among themselves;
a null doc_id sorts first; an empty table gives no files; extra columns are ignored. A damaged block raises ValueError.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _tokens
from ._text import gathered

MAGIC = b"RANSTOK1"
SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 4096
#: Tokens of a block and steps between checkpoints; tokens of a file.
BLOCK_TOKENS, CHECK_STEPS = 1 << 20, 128
FILE_TOKENS = 1 << 22


@dataclass
class Table:
    """Frequencies that sum to 2**SCALE, at least 1 for every id below the vocabulary's size."""

    freq: np.ndarray

    def __post_init__(self):
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq.astype(np.int64))

    @classmethod
    def fit(cls, counts: np.ndarray) -> Table:
        room = (1 << SCALE) - len(counts)
        if room < 0 or len(counts) > 1 << 16:
            raise ValueError("the vocabulary must have at most 65,536 ids")
        total = max(int(counts.sum()), 1)
        freq = 1 + np.array([int(c) * room // total for c in counts], np.uint64)
        freq[int(np.argmax(counts))] += np.uint64((1 << SCALE) - int(freq.sum()))
        return cls(freq)


def _encode_block(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    out: list[np.ndarray] = []
    checks: list[tuple[int, np.ndarray]] = []
    words = 0
    for step in range(steps - 1, -1, -1):
        s = ids[step * lanes : (step + 1) * lanes]
        x = state[: len(s)]
        f, c = table.freq[s], table.start[s]
        over = x >= (f << np.uint64(63 - SCALE))
        out.append((x[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        words += len(out[-1])
        x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        state[: len(s)] = (q << np.uint64(SCALE)) + (x - q * f) + c
        if step and step % CHECK_STEPS == 0:
            checks.append((words, state.copy()))
    body = b"".join([struct.pack("<IIII", n, lanes, len(checks), words), state.tobytes(), *(struct.pack("<I", words - w) + s.tobytes() for w, s in reversed(checks)), *(w.tobytes() for w in reversed(out))])
    return struct.pack("<II", len(body), zlib.crc32(body)) + body


def _decode_block(body: bytes, table: Table, first_step: int = 0) -> np.ndarray:
    """Tokens of a block, from a checkpointed step on."""
    n, lanes, n_checks, words = struct.unpack_from("<IIII", body)
    at = 16
    state = np.frombuffer(body, np.uint64, lanes, at).copy()
    at += 8 * lanes
    position = 0
    if first_step:
        k = first_step // CHECK_STEPS - 1
        if first_step % CHECK_STEPS or k >= n_checks:
            raise ValueError("not a checkpoint")
        position = struct.unpack_from("<I", body, at + k * (4 + 8 * lanes))[0]
        state = np.frombuffer(body, np.uint64, lanes, at + k * (4 + 8 * lanes) + 4).copy()
    stream = np.frombuffer(body, np.uint32, words, at + n_checks * (4 + 8 * lanes))
    mask, out = np.uint64((1 << SCALE) - 1), np.empty(n, np.uint16)
    for step in range(first_step, -(-n // lanes)):
        x = state[: min(lanes, n - step * lanes)]
        slot = x & mask
        s = table.symbol[slot]
        out[step * lanes : step * lanes + len(x)] = s
        x = table.freq[s] * (x >> np.uint64(SCALE)) + slot - table.start[s]
        under = np.flatnonzero(x < LOW)
        x[under] = (x[under] << np.uint64(32)) | stream[position : position + len(under)]
        position += len(under)
        state[: len(x)] = x
    return out[first_step * lanes :]


def encode_file(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    known = np.array([x is not None for x in doc_ids], np.uint8)
    head = np.array([x or 0 for x in doc_ids], np.int64).tobytes() + known.tobytes() + np.asarray(lengths, np.int64).tobytes()
    blocks = [_encode_block(ids[k : k + BLOCK_TOKENS], table) for k in range(0, len(ids), BLOCK_TOKENS)]
    head = zlib.compress(head, 6)
    return b"".join([MAGIC, struct.pack("<IIII", len(doc_ids), len(head), len(blocks), zlib.crc32(head)), head, *blocks])


def decode_file(raw: bytes, table: Table) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, token counts, tokens) of a file; every checksum is verified."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    n, size, blocks, crc = struct.unpack_from("<IIII", raw, 8)
    head, at = raw[24 : 24 + size], 24 + size
    if zlib.crc32(head) != crc:
        raise ValueError("damaged header")
    head = zlib.decompress(head)
    ids, known, lengths = np.frombuffer(head, np.int64, n), np.frombuffer(head, np.uint8, n, 8 * n), np.frombuffer(head[9 * n :], np.int64, n)
    parts = []
    for k in range(blocks):
        size, crc = struct.unpack_from("<II", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if len(body) != size or zlib.crc32(body) != crc:
            raise ValueError(f"damaged block {k}")
        parts.append(_decode_block(body, table))
        at += 8 + size
    return [int(x) if ok else None for x, ok in zip(ids, known)], lengths, np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _tokenized(docs: DataFrame, tokenizer: str, spaces: bool, end: int) -> DataFrame:
    """Runs of documents in ascending doc_id order, as rows: part, number, doc_ids, lengths, counts (of each id), planes (low bytes, high bytes).

    A doc_id that is no number becomes null; such documents come first."""
    ordered = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, "text", 12 << 20):
            ids, lengths = _tokens.encode(batch.column("text"), tokenizer, spaces, end)
            if len(ids) and ids.max() >= 1 << 16:
                raise ValueError("the vocabulary must have at most 65,536 ids")
            small, ends, names = ids.astype("<u2"), np.cumsum(lengths), batch.column("doc_id").to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(ends // FILE_TOKENS)) + 1).tolist(), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    own = small[ends[a] - lengths[a] : ends[b - 1]]
                    planes = np.ascontiguousarray(own.view(np.uint8).reshape(-1, 2).T).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([names[a:b]], pa.list_(pa.int64())), pa.array([lengths[a:b].tobytes()], pa.binary()), pa.array([np.bincount(own).astype("<u4").tobytes()], pa.binary()), pa.array([planes], pa.binary())], ["part", "number", "doc_ids", "lengths", "counts", "planes"])
                    number += 1

    return ordered.mapInArrow(run, "part bigint, number bigint, doc_ids array<bigint>, lengths binary, counts binary, planes binary")


def _joined(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(2, -1).T).view("<u2").ravel()


def write_files(docs: DataFrame, tokenizer: str, vocabulary: int, end: int = 0, spaces: bool = True) -> tuple[DataFrame, Table, str]:
    """Encode every document into files in the shared folder; returns the manifest, the frequency table and the folder.

    The manifest has a row for each file: part and number (their order), name, n_docs, n_tokens, n_bytes.
    """
    spark = docs.sparkSession
    rows = _store.stored(_tokenized(docs, tokenizer, spaces, end), "token-runs", per_file=2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for raw in batch.column("counts"):
                own = np.frombuffer(raw.as_py(), "<u4")
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for r in rows.select("counts").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row for each id of the vocabulary
        counts[r.id] = r.n
    table = Table.fit(counts)
    sent, folder = spark.sparkContext.broadcast(table.freq), _store.new_path(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(sent.value)
        for batch in batches:
            for r in batch.to_pylist():
                name, lengths = f"tokens-{r['part']:06d}-{r['number']:06d}-{uuid.uuid4().hex}.rans", np.frombuffer(r["lengths"], np.int64)
                ids = _joined(r["planes"])
                size = _store.put_file(folder, name, [encode_file(r["doc_ids"], lengths, ids, table)])
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (r["part"], r["number"], name, len(lengths), len(ids), size)], ["part", "number", "name", "n_docs", "n_tokens", "n_bytes"])

    manifest = rows.mapInArrow(write, "part bigint, number bigint, name string, n_docs bigint, n_tokens bigint, n_bytes bigint")
    return _store.stored(manifest, "token-manifest"), table, folder


def read_files(manifest: DataFrame, table: Table, folder: str, with_ids: bool = False) -> DataFrame:
    """Decode the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    from pyspark.sql import Window

    spark = manifest.sparkSession
    sent = spark.sparkContext.broadcast(table.freq)
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("n_tokens")
    totals = sorted(manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("files")).collect())  # a row for each range of doc_id
    before, at = [], 0
    for part, n, _ in totals:
        before.append((part, at))
        at += n
    bases = spark.createDataFrame(before, "part bigint, base bigint")
    files = manifest.withColumn("within", within).join(bases, "part").select("name", (F.col("base") + F.col("within")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(sent.value)
        system, base = _store.file_system(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(f"{base}/{r['name']}") as f:
                    doc_ids, lengths, ids = decode_file(f.read(), table)
                wide, ends = ids.astype("<u4"), np.cumsum(lengths)
                raw = [wide[e - n : e].tobytes() for e, n in zip(ends, lengths)]
                arrays = [pa.array(doc_ids, pa.int64()), pa.array(r["start"] + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(raw, pa.binary())] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    spread = files.repartition(max(1, sum(t.files for t in totals)), "name")  # the rows are small, the files aren't: a number keeps tasks from being joined
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)
