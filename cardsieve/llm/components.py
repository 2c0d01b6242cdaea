"""Connected components of a set of links: contraction within tasks, then joins and aggregates until nothing changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store

#: Links that a task contracts at a time.
TASK = 1 << 20


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest that the given links reach; these nodes themselves have none."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, np.concatenate([root[a], root[b]]), np.concatenate([low, low]))
        while np.any(root[root] != root):
            root = root[root]
        left = root[a] != root[b]
        a, b = a[left], b[left]
    hung = np.flatnonzero(root != np.arange(len(names)))
    return names[hung], names[root[hung]]


def _contracted(batches: Iterator[pa.RecordBatch], task: int) -> Iterator[pa.RecordBatch]:
    """Fewer links with the same components: those of every ``task`` rows as stars."""

    def out() -> pa.RecordBatch:
        u, v = (np.concatenate([x[k] for x in held]) for k in range(2))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(u, v)], ["u", "v"])

    held, rows = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, task):
            part = batch.slice(start, task)
            if held and rows + part.num_rows > task:
                yield out()
                held, rows = [], 0
            held.append([c.to_numpy(zero_copy_only=False) for c in part.columns])
            rows += part.num_rows
    if held:
        yield out()


def components(links: DataFrame, task: int = TASK) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the smallest node that can be reached.

    Each task first replaces the links it holds by stars, ``task`` links at a time, so copies and short paths need no
    shuffle. Where one task holds all links that are left, that is the result. Else large-star and small-star steps join the
    tasks' stars: a node's neighbours are hung under its smallest neighbour, first those larger than it, then the others, and
    so on in turn until nothing changes, after about as many rounds as the logarithm of the longest path. Self-links and
    repeated links do no harm; links with null are ignored. Each round is written to the shared folder; the last one can be
    removed (_store.remove) when the result has been used.
    """

    def contracted(edges: DataFrame) -> DataFrame:
        return edges.mapInArrow(lambda it: _contracted(it, task), "u bigint, v bigint")

    edges = links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = _store.stored(contracted(edges), "links")
    state = None
    while True:  # until a round changes nothing
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, before = now, edges
        tasks = -(-now[0] // task)
        edges = contracted(edges.coalesce(max(1, tasks)))
        if tasks <= 1:
            edges = _store.stored(edges, "links")
            _store.remove(before)
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = _store.stored(small.filter("u <> v").distinct(), "links")
        _store.remove(before)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    named = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    named.stored_at = edges.stored_at
    return named
