"""Nearest rows, exact, with blocks of rows ruled out by distances to pivots.

A pivot is a row of the table; the distance of two rows is at least the difference of their distances to any pivot. Rows are
ordered by their nearest pivot and the distance to it and cut into blocks of bounded size, so the rows of a block lie close
together where the data let them. Of each block the smallest and largest distance to every pivot are known, and of each row the
distance of its k-th nearest row in its own block, which its true k-th nearest can't exceed. A row meets another block only if
the bound between the two blocks doesn't exceed that distance.

On clustered tables most pairs of blocks are ruled out. Where all rows are about equally far from one another (many dimensions
without clusters) nearly none are, and the work grows with the square of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranges import with_range

#: Summaries of blocks in one group when pairs of blocks are chosen.
SUMMARIES = 1024
#: Blocks of either side in one group when rows meet.
FIRST, SECOND = 4, 16


def _to(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=-1))


def _nearest(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, k: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Some rows of x at a time: their places, the k nearest rows of y (sorted by id) other than themselves, the distances."""
    for s in range(0, len(x), 16):
        d = _to(x[s : s + 16], y)
        d[a[s : s + 16, None] == b[None]] = np.inf
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        yield slice(s, s + 16), at, np.take_along_axis(d, at, 1)


def pivot_blocks(df: DataFrame, vector: str, row_id: str, k: int, block: int = 2048, pivots: int = 32) -> DataFrame:
    """Rows in blocks of about ``block``: id, v, block, kd (distance of the k-th nearest row in the block; infinite if the block has
    too few rows). One row of each block also holds ``low`` and ``high``, the block's distances to the pivots, and ``reach``, its
    largest kd; elsewhere they are null. Pivots are the ``pivots`` rows with the smallest hash of their id.

    Rows with a null id and vectors that are null or hold null or non-finite components are left out; ids are unique.
    """
    v = F.col(vector).cast("array<double>")
    own = df.select(F.col(row_id).alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    blocks = max(1, -(-own.count() // block))
    kept = [r.v for r in own.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()]  # pivots rows at most
    points = np.array(kept, dtype=float) if kept else np.zeros((0, 0))

    @F.pandas_udf("cell int, r double")
    def placed(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cell": np.zeros(0, "i4"), "r": np.zeros(0)})
        d = np.concatenate([_to(np.stack(vectors.iloc[s : s + 256]), points) for s in range(0, len(vectors), 256)])
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("i4"), "r": d[np.arange(len(d)), cell]})

    rows = written(own.withColumn("p", placed("v")).select("id", "v", "p.cell", "p.r"), "pivot-cells")
    dealt = with_range(rows, ["cell", "r", "id"], blocks, "block").select(F.col("block").cast("bigint").alias("block"), "id", "v")
    kind = own.schema["id"].dataType.simpleString()

    def bounds(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("id", kind="stable").reset_index(drop=True)
        x, ids = np.stack(held["v"]), held["id"].to_numpy()
        kd = np.full(len(x), np.inf)
        if len(x) > k:
            for rows, _, d in _nearest(x, ids, x, ids, k):
                kd[rows] = d[:, -1]
        d = np.concatenate([_to(x[s : s + 256], points) for s in range(0, len(x), 256)])
        first = [True] + [False] * (len(x) - 1)
        one = lambda value: [value if f else None for f in first]
        return held.assign(kd=kd, low=one(d.min(axis=0).tolist()), high=one(d.max(axis=0).tolist()), reach=one(float(kd.max())))

    return written(dealt.groupBy("block").applyInPandas(bounds, f"block bigint, id {kind}, v array<double>, kd double, low array<double>, high array<double>, reach double"), "pivot-blocks")


def block_pairs(rows: DataFrame) -> DataFrame:
    """Blocks whose rows must meet, from ``pivot_blocks``: first, second, bound (no row of the first is nearer to one of the second).

    Summaries (a row for each block) meet in groups of ``SUMMARIES`` by ``SUMMARIES``."""
    own = rows.filter(F.col("low").isNotNull()).select("block", "low", "high", "reach")
    groups = max(1, -(-own.count() // SUMMARIES))
    own = own.withColumn("own", F.pmod(F.xxhash64("block"), F.lit(groups)))
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>"))
    left = own.withColumn("right", each).withColumnRenamed("own", "left")
    right = own.withColumn("left", each).select(F.col("left").alias("left"), F.col("own").alias("right"), *[F.col(c).alias(c) for c in ("block", "low", "high")])

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"first": np.zeros(0, "i8"), "second": np.zeros(0, "i8"), "bound": np.zeros(0)})
        if not len(a) or not len(b):
            return none
        low, high = np.stack(b["low"]), np.stack(b["high"])
        out = [none]
        for block, lo, hi, reach in zip(a["block"], a["low"], a["high"], a["reach"]):
            gap = np.maximum(low - hi[None], lo[None] - high)
            # distances are rounded: a little less than the gap is certain
            bound = np.maximum(gap - 1e-9 * (1 + np.maximum(high, hi[None])), 0).max(axis=1)
            near = np.flatnonzero(bound <= reach)
            out.append(pd.DataFrame({"first": np.full(len(near), block), "second": b["block"].to_numpy()[near], "bound": bound[near]}))
        return pd.concat(out)

    return left.groupBy("left", "right").cogroup(right.groupBy("left", "right")).applyInPandas(meet, "first bigint, second bigint, bound double")


def _near_of_block(x: np.ndarray, a: np.ndarray, kd: np.ndarray, others: list[tuple[float, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows x with ids a, whose k-th nearest row is at kd at most: places of the rows, ids and distances of their k nearest rows
    in the other blocks (bound, vectors, ids).

    A matrix product rules out pairs that are farther than the k-th so far, with room for its rounding; distances of the rest are
    computed as differences. Nearer blocks come first, so the k-th shrinks early."""
    far = kd.copy()
    rows, ids, found = np.zeros(0, int), a[:0], np.zeros(0)
    with np.errstate(over="ignore", invalid="ignore"):
        xx = (x * x).sum(axis=1)
        for bound, y, b in others:
            some = np.flatnonzero(bound <= far)
            if not len(some):
                continue
            yy = (y * y).sum(axis=1)
            room = 16 * (x.shape[1] + 4) * np.finfo(float).eps * (xx[some].max() + yy.max())
            about = xx[some, None] + yy[None] - 2 * (x[some] @ y.T)
            # what is no number by overflow is not ruled out
            at, to = np.nonzero(~(about > (far[some] ** 2 * (1 + 1e-9) + room)[:, None]))
            at = some[at]
            other = a[at] != b[to]
            at, to = at[other], to[other]
            d = np.concatenate([np.zeros(0), *[np.sqrt(((x[at[s : s + 65536]] - y[to[s : s + 65536]]) ** 2).sum(axis=-1)) for s in range(0, len(at), 65536)]])
            near = np.isfinite(d) & (d <= far[at])
            rows, ids, found = np.concatenate([rows, at[near]]), np.concatenate([ids, b[to[near]]]), np.concatenate([found, d[near]])
            order = np.lexsort((ids, found, rows))
            rows, ids, found = rows[order], ids[order], found[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            last = place == k - 1
            far[rows[last]] = np.minimum(far[rows[last]], found[last])
            rows, ids, found = (v[place < k] for v in (rows, ids, found))
    return rows, ids, found


def nearest_rows(df: DataFrame, vector: str, row_id: str, k: int, block: int = 2048, pivots: int = 32) -> DataFrame:
    """(a, b, d): of each row a its k nearest other rows b by Euclidean distance, ties to the smaller id. Exact.

    Pairs of blocks that ``block_pairs`` keeps meet in groups of ``FIRST`` by ``SECOND`` blocks, which give k rows at most for each
    row of the first, so memory is bounded, copies add no pairs and a row is sent once for each group, not for each pair. A row
    meets only blocks whose bound its kd reaches.
    Vectors that are null or hold null or non-finite components have no neighbours and are none.
    """
    rows = pivot_blocks(df, vector, row_id, k, block, pivots)
    pairs = written(block_pairs(rows), "block-pairs").withColumns({"left": F.floor(F.col("first") / FIRST), "right": F.floor(F.col("second") / SECOND)})
    asked = pairs.groupBy("first", "left", "right").agg(F.collect_list(F.struct("bound", "second")).alias("meets"))  # SECOND at most
    # of a block's rows one holds the list of blocks that it meets
    queries = rows.select(F.col("block").alias("first"), "id", "v", "kd", F.col("low").isNotNull().alias("one")).join(asked, "first")
    queries = queries.select("left", "right", "first", "id", "v", "kd", F.when(F.col("one"), F.col("meets")).alias("meets"))
    given = pairs.select("second", "left", "right").distinct()
    # aliases keep the two readings of the rows apart
    others = rows.select(F.col("block").alias("second"), "id", "v").join(given, "second").select(*[F.col(c).alias(c) for c in ("left", "right", "second", "id", "v")])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": left["id"][:0], "b": right["id"][:0], "d": np.zeros(0)})]
        held = {second: (np.stack(g["v"]), g["id"].to_numpy()) for second, g in right.groupby("second")}
        for _, g in left.groupby("first"):
            x, a = np.stack(g["v"]), g["id"].to_numpy()
            meets = sorted((m["bound"], m["second"]) for m in next(m for m in g["meets"] if m is not None))
            at, b, d = _near_of_block(x, a, g["kd"].to_numpy(float), [(bound, *held[second]) for bound, second in meets if second in held], k)
            out.append(pd.DataFrame({"a": a[at], "b": b, "d": d}))
        return pd.concat(out)

    kind = rows.schema["id"].dataType.simpleString()
    near = queries.groupBy("left", "right").cogroup(others.groupBy("left", "right")).applyInPandas(run, f"a {kind}, b {kind}, d double")
    return near.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).filter(F.col("place") <= k).select("a", "b", "d")
