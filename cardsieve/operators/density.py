"""Density clusters (DBSCAN) on a grid, exact, and connected components.

Cells have the side eps / sqrt(d), so all points of a cell are neighbours of one another. That keeps every step linear in the
points, however many share a cell:

- a cell with ``least`` points or more has only core points: nothing is compared inside;
- the points of other cells are fewer than ``least`` to a cell, so around any cell, full as it may be, only a fixed number of
  them is compared with its points (to count neighbours, and to give border points to clusters);
- two cells are linked if they hold core points within eps of one another. First the points of each that are nearest to the
  other's bounding box are tried: they nearly always decide. For pairs still open, points within eps of the other's box meet in
  blocks.

Links of cells become clusters by components; their table has a row for each pair of neighbouring cells, not of points.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Points of a cell in one block of a comparison of two cells.
BLOCK = 512


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node it is linked to, by whatever path) for each node of the links (a, b).

    Rounds of two steps: each node's neighbours are linked to the smallest of them, larger ones first, then the others. Paths
    shrink to stars in about as many rounds as the logarithm of the longest. Each round is written."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (now := tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())) != before:
        before = now
        around = both(edges)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.inline(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        edges = written(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _squared(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0))


def dbscan(df: DataFrame, row_id: str, columns: Sequence[str], eps: float, least: int) -> DataFrame:
    """row_id, cluster, is_core: cluster is the smallest id of its core points, null for noise.

    A core point has ``least`` points (itself one of them) within ``eps``. A border point goes to the cluster of its nearest
    core point, of several at one distance to the one with the smallest id. Rows with a null or non-finite value are noise;
    ids are unique. Few columns (2 or 3): neighbouring cells grow with their number as a power."""
    d, limit = len(columns), eps * eps
    reach = math.isqrt(d - 1) + 1 if d > 1 else 1  # cells that eps spans, rounded up
    side, xs, cs = eps / math.sqrt(d), [f"x{k}" for k in range(d)], [f"c{k}" for k in range(d)]
    fine = F.lit(True)
    for c in columns:
        fine = fine & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    points = df.filter(fine).select(F.col(row_id).alias("id"), *[F.col(c).cast("double").alias(x) for c, x in zip(columns, xs)])
    points = points.select("id", *xs, *[F.floor(F.col(x) / side).alias(c) for x, c in zip(xs, cs)])
    sizes = points.groupBy(*cs).agg(F.count(F.lit(1)).alias("size"))
    points = written(points.join(sizes, cs), "points")
    offsets = [o for o in itertools.product(range(-reach, reach + 1), repeat=d) if sum(max(abs(k) - 1, 0) ** 2 for k in o) < d]
    moves = F.array(*[F.struct(*[F.lit(k).cast("bigint").alias(f"o{n}") for n, k in enumerate(o)]) for o in offsets])

    def around(table: DataFrame) -> DataFrame:
        """Each row once for every cell near its own: columns n0, n1, ..."""
        moved = table.withColumn("__o", F.explode(moves))
        return moved.withColumns({f"n{k}": F.col(c) + F.col(f"__o.o{k}") for k, c in enumerate(cs)}).drop("__o")

    def near(table: DataFrame, others: DataFrame) -> DataFrame:
        """Rows of a table of few points to a cell with the others within eps: q (id), y0, y1, ... of those."""
        own = others.select(F.col("id").alias("q"), *[F.col(x).alias(f"y{k}") for k, x in enumerate(xs)], *[F.col(c).alias(f"n{k}") for k, c in enumerate(cs)])
        met = around(table).join(own, [f"n{k}" for k in range(d)])
        return met.withColumn("far", _squared([F.col(x) for x in xs], [F.col(f"y{k}") for k in range(d)])).filter(F.col("far") <= limit)

    few = points.filter(F.col("size") < least)
    reached = near(few, points).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("id")
    core = written(points.filter(F.col("size") >= least).unionByName(few.join(reached, "id", "left_semi").select(*points.columns)), "core")

    # cells that hold core points: bounding box and smallest id, which names the cell
    boxes = written(core.groupBy(*cs).agg(F.min("id").alias("cell"), *[F.min(x).alias(f"lo_{x}") for x in xs], *[F.max(x).alias(f"hi_{x}") for x in xs]), "boxes")
    other = boxes.select(*[F.col(c).alias(f"n{k}") for k, c in enumerate(cs)], F.col("cell").alias("other"), *[F.col(f"{e}_{x}").alias(f"{e}2_{x}") for e in ("lo", "hi") for x in xs])
    gap = lambda lo1, hi1, lo2, hi2: F.greatest(F.lit(0.0), lo1 - hi2, lo2 - hi1)
    apart = sum((gap(F.col(f"lo_{x}"), F.col(f"hi_{x}"), F.col(f"lo2_{x}"), F.col(f"hi2_{x}")) ** 2 for x in xs), F.lit(0.0))
    pairs = written(around(boxes).join(other, [f"n{k}" for k in range(d)]).filter((F.col("cell") < F.col("other")) & (apart <= limit)), "pairs")
    # for both cells of a pair, the core point nearest to the other's box
    ends = pairs.select("cell", "other", *[F.col(f"{e}2_{x}").alias(f"b{e}_{x}") for e in ("lo", "hi") for x in xs], F.col("cell").alias("side"))
    ends = ends.unionByName(pairs.select("cell", "other", *[F.col(f"{e}_{x}").alias(f"b{e}_{x}") for e in ("lo", "hi") for x in xs], F.col("other").alias("side")))
    named = written(core.join(boxes.select(*cs, F.col("cell").alias("side")), cs).select("id", *xs, "side"), "named")
    inside = ends.join(named, "side").withColumn("gap", sum((F.greatest(F.lit(0.0), F.col(f"blo_{x}") - F.col(x), F.col(x) - F.col(f"bhi_{x}")) ** 2 for x in xs), F.lit(0.0))).filter(F.col("gap") <= limit)
    first = inside.groupBy("cell", "other", "side").agg(F.min_by(F.struct(*xs), F.struct("gap", "id")).alias("p"))
    tried = first.groupBy("cell", "other").agg(F.min_by("p", F.col("side")).alias("p"), F.max_by("p", F.col("side")).alias("q"), F.count(F.lit(1)).alias("n")).filter("n = 2")
    tried = written(tried.withColumn("linked", _squared([F.col(f"p.{x}") for x in xs], [F.col(f"q.{x}") for x in xs]) <= limit), "tried")
    links = tried.filter("linked").select(F.col("cell").alias("a"), F.col("other").alias("b"))
    # pairs still open: the points near the other's box, in blocks
    open_ = inside.join(tried.filter("not linked").select("cell", "other"), ["cell", "other"])
    open_ = open_.withColumn("block", F.floor(F.row_number().over(Window.partitionBy("cell", "other", "side").orderBy("gap", "id")) / BLOCK))
    grouped = open_.groupBy("cell", "other", "side", "block").agg(F.collect_list(F.struct(*xs)).alias("held"))  # BLOCK points
    left = grouped.filter("side = cell").select("cell", "other", F.col("held").alias("one"))
    right = grouped.filter("side = other").select("cell", "other", F.col("held").alias("two"))
    touch = F.exists("one", lambda p: F.exists("two", lambda q: _squared([p[x] for x in xs], [q[x] for x in xs]) <= limit))
    links = links.unionByName(left.join(right, ["cell", "other"]).filter(touch).select(F.col("cell").alias("a"), F.col("other").alias("b")).distinct())

    roots = components(links)
    clustered = named.join(roots.withColumnsRenamed({"node": "side"}), "side", "left").select("id", F.coalesce("root", "side").alias("cluster"))
    border = few.join(core.select("id"), "id", "left_anti")
    nearest = near(border, core).groupBy("id").agg(F.min_by("q", F.struct("far", "q")).alias("q"))
    bordered = nearest.join(clustered.withColumnRenamed("id", "q"), "q").select("id", "cluster")
    labelled = clustered.withColumn("is_core", F.lit(1)).unionByName(bordered.withColumn("is_core", F.lit(0)))
    return df.select(F.col(row_id)).join(labelled.withColumnRenamed("id", "__id"), F.col(row_id) == F.col("__id"), "left").select(row_id, "cluster", F.coalesce("is_core", F.lit(0)).alias("is_core"))
