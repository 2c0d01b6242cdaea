"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of several codebooks, all in the full dimension. Codebooks are fitted to a
bounded sample: k-means on residuals, then rounds of beam-search encoding and a joint least-squares refit. Every vector is
encoded by beam search and kept as a few code bytes and the norm of its reconstruction. A query is scored against codes by
adding up a lookup table's entries; the best candidates are then measured on the original vectors in double precision.

Equal vectors are encoded and scored once; each stands for its smallest ids, as many as a result can hold. Queries and codes
meet in blocks, so no task holds all of either.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another length than most, take no
part as query or candidate; a query with fewer candidates than asked for gets all found; ties go to the smaller id; rows
with a null id take no part; of several rows with one id and one vector one counts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _store

#: Vectors of the sample that codebooks are fitted to: those with the smallest hash of their id.
SAMPLE = 8192
#: Sweeps over the codebooks in a refit.
SWEEPS = 4
QUERY_BLOCK, CODE_BLOCK = 2048, 65536


@dataclass
class Codebooks:
    #: codebooks x codewords x dimension
    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n x codebooks) and squared norms of the reconstructions, by beam search."""
        codes, norms = [], []
        for k in range(0, len(x), 2048):
            c = self._beam(np.ascontiguousarray(x[k : k + 2048], np.float32), beam)
            codes.append(c)
            norms.append((self.decode(c) ** 2).sum(axis=1))
        return (np.concatenate(codes), np.concatenate(norms)) if codes else (np.zeros((0, len(self.words)), np.uint8), np.zeros(0, np.float32))

    def _beam(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, size = len(x), self.words.shape[1]
        rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
        lost = (rest**2).sum(axis=2)
        for book in self.words:
            width = rest.shape[1]
            error = lost[:, :, None] - 2 * (rest.reshape(-1, x.shape[1]) @ book.T).reshape(n, width, size) + (book**2).sum(axis=1)
            flat = error.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            row, parent, word = np.arange(n)[:, None], best // size, best % size
            codes = np.concatenate([codes[row, parent], word[:, :, None].astype(np.uint8)], axis=2)
            rest, lost = rest[row, parent] - book[word], flat[row, best]
        return codes[np.arange(n), np.argmin(lost, axis=1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, k]] for k, book in enumerate(self.words))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries with all codewords: queries x (codebooks * codewords)."""
        return queries.astype(np.float32) @ self.words.reshape(-1, self.words.shape[2]).T


def _k_means(x: np.ndarray, size: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centre = x[rng.choice(len(x), size, replace=len(x) < size)].copy()
    for _ in range(rounds):
        near = np.argmin((centre**2).sum(axis=1) - 2 * x @ centre.T, axis=1)
        count = np.bincount(near, minlength=size)
        sums = np.stack([np.bincount(near, weights=x[:, d], minlength=size) for d in range(x.shape[1])], axis=1)
        centre = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(len(x), size=size)])
    return centre.astype(np.float32)


def fit(sample: np.ndarray, books: int = 24, size: int = 256, rounds: int = 1, seed: int = 0) -> Codebooks:
    """Fit codebooks to a sample (n x dimension, n >= 1)."""
    rng, x = np.random.default_rng(seed), sample.astype(np.float32)
    rest, words = x.copy(), []
    for _ in range(books):
        words.append(_k_means(rest, size, rng))
        rest = rest - words[-1][np.argmin((words[-1] ** 2).sum(axis=1) - 2 * rest @ words[-1].T, axis=1)]
    model = Codebooks(np.stack(words))
    for _ in range(rounds):
        codes, _ = model.encode(x, 4)
        words = model.words.copy()
        rest = x - model.decode(codes)
        for _ in range(SWEEPS):  # least squares over all codebooks, one after another: a word moves by the mean of what its vectors lack
            for b in range(books):
                count = np.bincount(codes[:, b], minlength=size)
                sums = np.stack([np.bincount(codes[:, b], weights=rest[:, d], minlength=size) for d in range(x.shape[1])], axis=1)
                step = (sums / np.maximum(count, 1)[:, None]).astype(np.float32)
                words[b] += step
                rest -= step[codes[:, b]]
        model = Codebooks(words)
    return model


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _distinct(vectors: DataFrame, dim: int, ids: int) -> DataFrame:
    """uid (smallest id), ids (the smallest ones), is_query, vector for each distinct vector."""
    first = vectors.withColumn("rank", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("rank") <= ids)
    first = first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return first.join(vectors.groupBy("vector").agg(F.min("vec_id").alias("uid"), F.max("is_query").alias("is_query")), "vector").select("uid", "ids", "is_query", "vector")


def search(vectors: DataFrame, every: int = 20, k: int = 20, rerank: int = 384, books: int = 24, size: int = 256, beam: int = 4, metric: str = "ip", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each query: its k nearest rows, itself left out.

    ``vectors`` has vec_id and embedding; queries are the rows whose id is divisible by ``every``. metric: "ip" (largest inner
    product) or "l2" (smallest distance; score is its square with a minus sign). ``rerank`` candidates of each query are
    measured exactly. Rows whose id is no number take no part. Index parameters: ``books`` codebooks of ``size`` codewords fitted to ``sample`` vectors, ``beam`` width.
    """
    if metric not in ("ip", "l2") or not 1 <= size <= 256:
        raise ValueError("metric is ip or l2; a codebook has at most 256 words")
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").try_cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).distinct()
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    dim = sizes.dim
    rows = rows.filter(F.size("vector") == dim).withColumn("is_query", F.col("vec_id") % every == 0)
    distinct = _store.stored(_distinct(rows, dim, k + 1), "vectors")
    taken = distinct.orderBy(F.xxhash64("uid"), "uid").limit(sample).select("vector").toArrow()
    sent = spark.sparkContext.broadcast(fit(_matrix(taken.column(0).combine_chunks(), dim), books, size).words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Codebooks(sent.value)
        for batch in batches:
            codes, norms = model.encode(_matrix(batch.column("vector"), dim), beam)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32())], ["uid", "codes", "norm"])

    codes = _store.stored(distinct.select("uid", "vector").mapInArrow(encode, "uid bigint, codes binary, norm float"), "codes")
    n_codes, n_queries = codes.count(), distinct.filter("is_query").count()
    code_blocks, query_blocks = -(-n_codes // CODE_BLOCK), max(1, -(-n_queries // QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")

    def code_block(table: pa.Table) -> pa.Table:
        raw = table.combine_chunks()
        return pa.table({"uids": pa.array([raw["uid"].to_numpy().tobytes()], pa.binary()), "codes": pa.array([b"".join(raw["codes"].to_pylist())], pa.binary()), "norms": pa.array([raw["norm"].to_numpy().tobytes()], pa.binary())})

    def query_block(table: pa.Table) -> pa.Table:
        raw = table.combine_chunks()
        return pa.table({"query_block": raw["query_block"][:1], "queries": pa.array([raw["uid"].to_numpy().tobytes()], pa.binary()), "points": pa.array([_matrix(raw["vector"].combine_chunks(), dim).astype(np.float32).tobytes()], pa.binary())})

    held = codes.withColumn("block", block(code_blocks)).groupBy("block").applyInArrow(code_block, "uids binary, codes binary, norms binary")
    asked = distinct.filter("is_query").withColumn("query_block", block(query_blocks)).select("query_block", "uid", "vector").groupBy("query_block").applyInArrow(query_block, "query_block int, queries binary, points binary")
    pairs = held.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).join(asked, "query_block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Codebooks(sent.value)
        for batch in batches:
            for r in batch.to_pylist():
                uids, norms, queries = np.frombuffer(r["uids"], np.int64), np.frombuffer(r["norms"], np.float32), np.frombuffer(r["queries"], np.int64)
                own = np.frombuffer(r["codes"], np.uint8).reshape(len(uids), -1).astype(np.int64) + np.arange(books) * size
                points = np.frombuffer(r["points"], np.float32).reshape(len(queries), dim)
                for at in range(0, len(queries), 128):
                    table = model.tables(points[at : at + 128])
                    score = np.take(table, own[:, 0], axis=1)
                    for b in range(1, books):
                        score += np.take(table, own[:, b], axis=1)
                    if metric == "l2":
                        score = 2 * score - norms
                    keep = min(rerank, len(uids))
                    best = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries[at : at + 128], keep)), pa.array(uids[best].ravel()), pa.array(np.take_along_axis(score, best, 1).ravel(), pa.float32())], ["query", "uid", "near"])

    near = pairs.mapInArrow(scan, "query bigint, uid bigint, near float")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "uid"))).filter(F.col("place") <= rerank).select("query", "uid")
    near = near.join(distinct.select("uid", "ids", "vector"), "uid").join(distinct.filter("is_query").select(F.col("uid").alias("query"), F.col("vector").alias("point")), "query")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _matrix(batch.column("vector"), dim).astype(float), _matrix(batch.column("point"), dim).astype(float)
            score = (a * b).sum(axis=1) if metric == "ip" else -((a - b) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("ids"), pa.array(score)], ["query", "ids", "score"])

    exact = near.select("query", "ids", "vector", "point").mapInArrow(measure, "query bigint, ids array<bigint>, score double")
    exact = exact.select("query", "score", F.explode("ids").alias("vec_id"))
    exact = exact.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= k + 1)
    best = exact.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    # each query row takes the list of its vector
    owners = rows.filter("is_query").join(distinct.filter("is_query").select("vector", F.col("uid").alias("query")), "vector").select(F.col("vec_id").alias("query_id"), "query")
    found = owners.join(best, "query").select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("rank", "hit"))
    return found.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
