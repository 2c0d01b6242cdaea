"""Hard negatives by an inverted multi-index: exact best rows of the same label, and rows of other labels in score windows.

Two codebooks, one for each half of the dimensions, are fitted to a bounded sample. A row belongs to the cell of its two
nearest words; each word keeps the largest distance of its rows' halves (radius). For a query q a half with word c and radius
r scores at most q.c + |q| r, so a cell scores at most the sum of its two half bounds. Multi-sequence search pops cells from
a heap in order of these sums and stops when the next sum is below what is still needed: then the result is certified, no row
unseen can belong to it.

On Spark: cells are laid out in order and cut into shards of about ``SHARD`` rows (large cells into several). Each query
first visits its home shard, the one with the highest bound; what it finds there is a floor, and only shards with a cell whose
bound reaches the floor are visited next. Queries travel in blocks to packed shards; both sides of each meeting have a fixed
size, and a query takes at most a few rows from each. The directory of cells and radii has words x words entries, whatever the
input.

Scores are integers: components become floor(256 x). Products are summed in double precision while that is exact (below
2**53), else in 64-bit integers; beyond 2**63 an error is raised.

Defined cases: rows with an id or label that is null or no whole number, a null vector, null or non-finite components, or another number of components than most
take no part; of several rows with one id the one with the smallest label, then vector, counts; an anchor without other rows
of its label has no rows, neither has a positive without a row in its window (a negative score has none); ties go to the
smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _store
from .additive_quant import _k_means

#: Rows (smallest hash of id) that codebooks are fitted to, and words of each.
SAMPLE, WORDS = 8192, 16
SHARD, QUERIES = 16384, 512
LOWEST = -(2**62)


@dataclass
class Directory:
    """Codebooks of both halves, radii of their words, rows of each cell, and where each cell's rows lie."""

    words: list[np.ndarray]
    radii: list[np.ndarray]
    counts: np.ndarray
    #: first shard and number of shards of each cell
    first: np.ndarray
    parts: np.ndarray

    def bounds(self, q: np.ndarray) -> list[np.ndarray]:
        """Upper bounds of the half scores of queries (n x dim): n x words for each half, a little raised against rounding."""
        out, at = [], 0
        for words, radius in zip(self.words, self.radii):
            own = q[:, at : at + words.shape[1]]
            at += words.shape[1]
            size = np.sqrt((own**2).sum(axis=1))[:, None]
            exact = own @ words.T + size * radius
            out.append(exact + 1e-9 * (np.abs(own) @ np.abs(words).T + size * radius) + 1e-6)
        return out

    def shards(self, q: np.ndarray) -> np.ndarray:
        """Best bound of each shard for each query: n x shards."""
        left, right = self.bounds(q)
        cells = (left[:, :, None] + right[:, None, :]).reshape(len(q), -1)
        out = np.full((len(q), int((self.first + self.parts).max())), -np.inf)
        for cell in np.flatnonzero(self.counts.ravel()):
            at = slice(self.first[cell], self.first[cell] + self.parts[cell])
            out[:, at] = np.maximum(out[:, at], cells[:, [cell]])
        return out


def _cells(x: np.ndarray, words: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Cell of each row, and the distances of its halves to their words."""
    cell, far, at = np.zeros(len(x), np.int64), [], 0
    for book in words:
        own = x[:, at : at + book.shape[1]]
        at += book.shape[1]
        near = np.argmin((book**2).sum(axis=1) - 2 * own @ book.T, axis=1) if len(own) else np.zeros(0, np.int64)
        cell, far = cell * len(book) + near, [*far, np.sqrt(((own - book[near]) ** 2).sum(axis=1))]
    return cell, far


def _layout(counts: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells in order fill shards of at most ``shard`` rows; a larger cell is dealt over shards of its own."""
    first, parts, now, filled = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for cell, n in enumerate(counts.tolist()):
        if filled and filled + n > shard:
            now, filled = now + 1, 0
        first[cell], parts[cell] = now, max(1, -(-n // shard))
        if parts[cell] > 1:
            now, filled = now + int(parts[cell]), 0
        else:
            filled += n
    return first, parts


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dim)


class Search:
    """One query's multi-sequence visits of the cells of one shard."""

    def __init__(self, cells: np.ndarray, width: int):
        #: rows of each cell of the shard: cell -> slice; rows are in order of cells
        self.where = {int(c): slice(a, b) for c, a, b in zip(*_spans(cells))}
        self.left, self.right = sorted({c // width for c in self.where}), sorted({c % width for c in self.where})
        self.width = width

    def visits(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[float, slice]]:
        """Rows of cells and their bounds, in descending order of bounds."""
        a, b = sorted(self.left, key=lambda i: -left[i]), sorted(self.right, key=lambda j: -right[j])
        heap, pushed = [(-(left[a[0]] + right[b[0]]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            rows = self.where.get(a[i] * self.width + b[j])
            yield -bound, rows
            for k, m in ((i + 1, j), (i, j + 1)):
                if k < len(a) and m < len(b) and (k, m) not in pushed:
                    pushed.add((k, m))
                    heapq.heappush(heap, (-(left[a[k]] + right[b[m]]), k, m))


def _spans(cells: np.ndarray) -> tuple[list, list, list]:
    at = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[at].tolist(), at.tolist(), [*at[1:].tolist(), len(cells)]


def _better(best: list, scores: np.ndarray, ids: np.ndarray, k: int) -> list:
    """The k first of the rows held and these, by score descending, then id; entries are (-score, id)."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= edge
        scores, ids = scores[keep], ids[keep]
    return sorted(best + [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())])[:k]


def _find_same(search: Search, halves, score, ids, labels, own: int, label: int, k: int, floor: int) -> tuple[list, int]:
    """The k best rows of the same label that score at least ``floor``, and how many rows were scored."""
    best, looked = [], 0
    for bound, rows in search.visits(*halves):
        if bound < (max(floor, -best[-1][0]) if len(best) == k else floor):
            break
        if rows is None:
            continue
        mine = np.flatnonzero((labels[rows] == label) & (ids[rows] != own)) + rows.start
        if len(mine):
            s = score(mine)
            looked += len(mine)
            fine = s >= floor
            best = _better(best, s[fine], ids[mine][fine], k)
    return best, looked


def _find_windows(search: Search, halves, score, ids, labels, own: int, label: int, windows: Sequence[tuple[int, int, int]], k: int) -> tuple[list[list], int]:
    """For each window (low, high, floor): the k best rows of other labels with low <= score <= high; below ``floor`` none is needed."""
    best, looked = [[] for _ in windows], 0

    def needed() -> int:
        return min((max(floor, -own[-1][0]) if len(own) == k else floor for own, (_, _, floor) in zip(best, windows)), default=2**62)

    for bound, rows in search.visits(*halves):
        if bound < needed():
            break
        if rows is None:
            continue
        others = np.flatnonzero(labels[rows] != label) + rows.start
        if len(others):
            s = score(others)
            looked += len(others)
            for w, (low, high, floor) in enumerate(windows):
                fine = (s >= max(low, floor)) & (s <= high)
                if fine.any():
                    best[w] = _better(best[w], s[fine], ids[others][fine], k)
    return best, looked


def _windows(positives: Sequence[int], low: int, high: int) -> list[tuple[int, int]]:
    """(smallest, largest) integer score s with low * p <= 100 * s <= high * p, for each positive score p."""
    return [(-(-low * p // 100), high * p // 100) for p in positives]


class MultiIndex:
    """The index of a table: ``rows`` (id, label, vector as int64 bytes, cell, shard), written, and its directory."""

    def __init__(self, vectors: DataFrame, words: int = WORDS, sample: int = SAMPLE, shard: int = SHARD, relabel: tuple[int, int] | None = None):
        """``relabel`` (m, n): where the id is divisible by m, the label first becomes (label + 1) mod n."""
        self.spark = spark = vectors.sparkSession
        id, label = F.col("vec_id").try_cast("bigint"), F.col("label").try_cast("bigint")
        if relabel:
            label = F.when(id % relabel[0] == 0, (label + 1) % relabel[1]).otherwise(label)
        rows = vectors.select(id.alias("id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
        fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
        rows = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(256 * x)))
        sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(F.greatest(F.array_max("vector"), -F.array_min("vector"))).alias("most")).orderBy(F.desc("n"), "dim").first()
        self.dim = sizes.dim if sizes else 0
        if not self.dim:
            self.rows = None
            return
        if self.dim * (most := int(sizes.most or 0)) ** 2 >= 2**63:
            raise ValueError("inner products would not fit 64 bits")
        #: doubles add up integers below 2**53 exactly, in any order
        self.kind = np.float64 if self.dim * most**2 < 2**53 else np.int64
        rows = rows.filter(F.size("vector") == self.dim).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("kept")).select("id", "kept.label", "kept.vector")
        rows = _store.stored(rows, "vectors")
        taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
        x = taken.column(0).combine_chunks().flatten().to_numpy().reshape(-1, self.dim).astype(np.float64)
        rng, half = np.random.default_rng(0), self.dim // 2
        # a half without dimensions has words without any
        books = [_k_means(part, words, rng).astype(np.float64) if part.shape[1] else np.zeros((words, 0)) for part in (x[:, :half], x[:, half:])]
        dim, kind = self.dim, "id bigint, label bigint, vector binary, cell int, far1 double, far2 double"

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column("vector").flatten().to_numpy().reshape(-1, dim)
                cell, far = _cells(own.astype(np.float64), books)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([v.tobytes() for v in own], pa.binary()), pa.array(cell.astype(np.int32)), *map(pa.array, far)], ["id", "label", "vector", "cell", "far1", "far2"])

        placed = _store.stored(rows.mapInArrow(assign, kind), "cells")
        counts, radii = np.zeros(words * words, np.int64), [np.zeros(words), np.zeros(words)]
        for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2")).collect():  # words x words rows at most
            counts[r.cell] = r.n
            for k, (word, far) in enumerate(((r.cell // words, r.far1), (r.cell % words, r.far2))):
                radii[k][word] = max(radii[k][word], far)
        self.directory = Directory(books, radii, counts, *_layout(counts, shard))
        table = spark.createDataFrame([(c, int(f), int(p)) for c, (n, f, p) in enumerate(zip(counts, self.directory.first, self.directory.parts)) if n], "cell int, first bigint, parts bigint")
        self.rows = placed.join(F.broadcast(table), "cell").select("id", "label", "vector", "cell", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("shard"))
        self.words = words

    def _packed(self) -> DataFrame:
        """One row for each shard: ids, labels, cells and vectors in order of cells."""

        def pack(table: pa.Table) -> pa.Table:
            table = table.sort_by([("cell", "ascending"), ("id", "ascending")]).combine_chunks()
            flat = [pa.array([table[c].to_numpy().tobytes()], pa.binary()) for c in ("id", "label", "cell")]
            return pa.table([table["shard"][:1], *flat, pa.array([b"".join(table["vector"].to_pylist())], pa.binary())], ["shard", "ids", "labels", "cells", "vectors"])

        return self.rows.groupBy("shard").applyInArrow(pack, "shard int, ids binary, labels binary, cells binary, vectors binary")

    def _visit(self, queries: DataFrame, home: bool, search, result: str) -> DataFrame:
        """``search`` of each query in its home shard, or in all others whose best bound reaches the query's floor.

        ``queries``: id, label, vector, floor (the lowest score that is still needed) and state (bytes that search takes)."""
        sent, dim = self.spark.sparkContext.broadcast(self.directory), self.dim
        width, kind = self.words, self.kind

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    best = sent.value.shards(_matrix(part.column("vector"), dim).astype(np.float64))
                    top = best.argmax(axis=1)
                    wanted = np.zeros(best.shape, bool)
                    if home:
                        wanted[np.arange(len(top)), top] = True
                    else:
                        wanted = (best >= part.column("floor").to_numpy()[:, None]) & np.isfinite(best)
                        wanted[np.arange(len(top)), top] = False
                    row, shard = np.nonzero(wanted)
                    if len(row):
                        moved = part.take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *moved.columns], ["shard", *moved.schema.names])

        def block(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            flat = [pa.array([table[c].to_numpy().tobytes()], pa.binary()) for c in ("id", "label", "floor")]
            return pa.table([table["shard"][:1], *flat, pa.array([b"".join(table["vector"].to_pylist())], pa.binary()), pa.array([table["state"].to_pylist()], pa.list_(pa.binary()))], ["shard", "query_ids", "query_labels", "floors", "points", "states"])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                    vectors = np.frombuffer(r["vectors"], np.int64).reshape(-1, dim).astype(kind)
                    own = Search(np.frombuffer(r["cells"], np.int32), width)
                    points = np.frombuffer(r["points"], np.int64).reshape(-1, dim)
                    left, right = sent.value.bounds(points.astype(np.float64))
                    rows = []
                    for k, (i, label, floor) in enumerate(zip(*(np.frombuffer(r[c], np.int64).tolist() for c in ("query_ids", "query_labels", "floors")))):
                        q = points[k].astype(kind)
                        score = lambda at: (vectors[at] @ q).astype(np.int64)  # noqa: B023, E731
                        rows += search(own, (left[k], right[k]), score, ids, labels, i, label, floor, r["states"][k])
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [f.split()[0] for f in result.split(", ")])

        routed = queries.select("id", "label", "vector", "floor", "state").mapInArrow(route, "shard int, id bigint, label bigint, vector binary, floor bigint, state binary")
        # blocks of about QUERIES queries of one shard: their number follows from the queries there are
        blocks = max(1, -(-queries.count() // QUERIES))
        asked = routed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("shard", "part").applyInArrow(block, "shard int, query_ids binary, query_labels binary, floors binary, points binary, states array<binary>")
        return self._packed().join(asked, "shard").mapInArrow(scan, result)

    def _first(self, df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "found"))).filter(F.col("rank") <= k)

    def positives(self, anchors: DataFrame, k: int = 5) -> DataFrame:
        """anchor, found, score, rank: the k best other rows of each anchor's label. ``anchors``: rows of the index."""
        result = "anchor bigint, found bigint, score bigint, looked bigint"

        def search(own, halves, score, ids, labels, i, label, floor, state):
            best, looked = _find_same(own, halves, score, ids, labels, i, label, k, floor)
            return [(i, f, -s, looked) for s, f in best]

        asked = anchors.withColumns({"floor": F.lit(LOWEST), "state": F.lit(b"")})
        home = _store.stored(self._visit(asked, True, search, result), "home")
        floors = home.groupBy(F.col("anchor").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("found"))
        asked = asked.drop("floor").join(floors, "id", "left").withColumn("floor", F.coalesce("found", F.lit(LOWEST)))
        rest = self._visit(asked, False, search, result)
        return self._first(home.unionByName(rest), ["anchor"], k)

    def windows(self, anchors: DataFrame, positives: DataFrame, k: int = 3, low: int = 50, high: int = 95) -> DataFrame:
        """anchor, positive_score, found, score, rank: for each distinct positive score its k best rows of other labels in the window."""
        result = "anchor bigint, positive_score bigint, found bigint, score bigint, looked bigint"

        def search(own, halves, score, ids, labels, i, label, floor, state):
            wanted = np.frombuffer(state, np.int64).reshape(-1, 2).tolist()  # positive score, floor of its window
            spans = [(a, b, max(a, f)) for (a, b), (_, f) in zip(_windows([p for p, _ in wanted], low, high), wanted)]
            best, looked = _find_windows(own, halves, score, ids, labels, i, label, spans, k)
            return [(i, p, f, -s, looked) for (p, _), found in zip(wanted, best) for s, f in found]

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = [sorted((w["p"], w["f"]) for w in own) for own in batch.column("wanted").to_pylist()]
                state = [np.array(own, np.int64).tobytes() for own in pairs]
                floor = [min(max(f, -(-low * p // 100)) for p, f in own) for own in pairs]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("vector"), pa.array(floor, pa.int64()), pa.array(state, pa.binary())], ["id", "label", "vector", "floor", "state"])

        def queries(floors: DataFrame) -> DataFrame:
            """``floors``: anchor, positive_score, floor."""
            wanted = floors.groupBy(F.col("anchor").alias("id")).agg(F.collect_list(F.struct(F.col("positive_score").alias("p"), F.col("floor").alias("f"))).alias("wanted"))  # at most as many as positives of an anchor
            return anchors.join(wanted, "id").select("id", "label", "vector", "wanted").mapInArrow(encode, "id bigint, label bigint, vector binary, floor bigint, state binary")

        # a window with no integer in it, as below zero, needs no search
        scores = positives.select("anchor", F.col("score").alias("positive_score")).distinct().filter(F.expr(f"-((-{low} * cast(positive_score as decimal(20,0))) div 100) <= ({high} * cast(positive_score as decimal(20,0))) div 100 and positive_score >= 0"))
        home = _store.stored(self._visit(queries(scores.withColumn("floor", F.lit(LOWEST))), True, search, result), "home")
        floors = home.groupBy("anchor", "positive_score").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        floors = scores.join(floors, ["anchor", "positive_score"], "left").select("anchor", "positive_score", F.coalesce("least", F.lit(LOWEST)).alias("floor"))
        rest = self._visit(queries(floors), False, search, result)
        return self._first(home.unionByName(rest), ["anchor", "positive_score"], k)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, relabel: tuple[int, int] | None = (7, 10), **settings) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, and positive_rank.

    Anchors are rows whose id is divisible by ``every``; a negative's score is from ``low`` to ``high`` percent of the positive's."""
    index = MultiIndex(vectors, relabel=relabel, **settings)
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint, positive_rank int"
    if index.rows is None:
        return vectors.sparkSession.createDataFrame([], result)
    anchors = index.rows.filter(F.col("id") % every == 0).select("id", "label", "vector")
    best = _store.stored(index.positives(anchors, positives), "positives")
    found = index.windows(anchors, best, negatives, low, high)
    own = best.select("anchor", F.col("found").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("positive_rank"))
    return own.join(found, ["anchor", "positive_score"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), F.col("positive_rank").cast("int").alias("positive_rank"))
