"""Velocity on streams, and incremental jobs. The same functions take batch and streaming tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def window_counts(df: DataFrame, keys: Sequence[str], ts: str, length: str, slide: str | None = None, amount: str | None = None) -> DataFrame:
    """Counts (and sums) of the keys in tumbling or sliding windows of event time: keys, start, end, n, total."""
    window = F.window(F.col(ts).cast("timestamp"), length, slide) if slide else F.window(F.col(ts).cast("timestamp"), length)
    measures = [F.count(F.lit(1)).alias("n")] + ([F.sum(amount).alias("total")] if amount else [])
    out = df.groupBy(*keys, window.alias("w")).agg(*measures)
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *["n", "total"][: 1 + bool(amount)])


def velocity_stream(events: DataFrame, keys: Sequence[str], ts: str, length: str = "10 minutes", slide: str = "1 minute", late: str = "24 hours", amount: str | None = None) -> DataFrame:
    """Sliding-window velocity of a stream. Rows later than ``late`` are dropped; state lives as long as the watermark lets it.

    Windows move by ``slide``, so this approximates the row-exact batch operator; ``exact_velocity_stream`` gives its numbers.
    """
    stream = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return window_counts(stream, keys, ts, length, slide, amount)


def process_new_files(spark: SparkSession, source: str, schema: StructType, checkpoint: str, each: Callable[[DataFrame, int], None], file_format: str = "parquet") -> None:
    """Hand the files that have come since the last call to ``each`` (batch, number) and end: each file once.

    ``each`` may see a batch again after a failure; it should write by the batch's number or by keys.
    """
    stream = spark.readStream.schema(schema).format(file_format).load(source)
    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()


def since_last(new: DataFrame, log: DataFrame, day: str) -> DataFrame:
    """Rows of days that the log doesn't have."""
    return new.join(log.select(day).distinct(), day, "left_anti")


#: What a key keeps on a stream: rows that may still get earlier ones (time in ms, id, amount), and totals of each second.
_STATE = "row_ms binary, row_id binary, row_x binary, second binary, n binary, x binary"


def exact_velocity_stream(events: DataFrame, key: str, ts: str, row_id: str, amount: str, windows: Mapping[str, int], late: str = "10 minutes") -> DataFrame:
    """Count and sum of the key's earlier rows in each window, row by row as in the batch operator: key, row id, n_*, sum_*.

    A row comes out once the watermark (the latest time seen less ``late``) is past its second: then no earlier row can come any
    more, whatever the order of arrival. A key's state is its rows that still wait and one total for each second with rows
    within the longest window; a timer wakes the key when its next row is due, or its last total out of every window. Rows
    later than the watermark are dropped, rows with a null key or time have no part; ids are whole numbers."""
    longest = max(windows.values())
    names = [f"{m}_{w}" for w in windows for m in ("n", "sum")]
    kind = events.schema[key].dataType.simpleString()
    own = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(row_id).cast("bigint").alias("id"), F.coalesce(F.col(amount).cast("double"), F.lit(0.0)).alias("amount"))
    own = own.filter("key is not null and ts is not null").withWatermark("ts", late).select("key", "ts", F.unix_millis("ts").alias("ms"), "id", "amount")

    def step(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kinds = (np.int64, np.int64, np.float64, np.int64, np.int64, np.float64)
        held = [np.frombuffer(b, k) for b, k in zip(state.get, kinds)] if state.exists else [np.zeros(0, k) for k in kinds]
        rows, totals = held[:3], held[3:]
        for frame in frames:
            rows = [np.concatenate([a, frame[c].to_numpy(a.dtype)]) for a, c in zip(rows, ("ms", "id", "amount"))]
        closed = state.getCurrentWatermarkMs() // 1000  # seconds before this one are complete
        due = rows[0] // 1000 < closed
        ready, rows = [a[due] for a in rows], [a[~due] for a in rows]
        if len(ready[0]):
            order = np.lexsort((ready[1], ready[0] // 1000))
            ms, ids, x = (a[order] for a in ready)
            second = ms // 1000
            # totals of the past and rows of now as one list in order; sums up to each place
            when = np.concatenate([totals[0], second])
            count, value = (np.concatenate([[0], np.cumsum(np.concatenate(p))]) for p in ((totals[1], np.ones(len(x), np.int64)), (totals[2], x)))
            here = len(totals[0]) + np.arange(len(x))
            out = {"key": group[0], "id": ids}
            for name, seconds in windows.items():
                first = np.searchsorted(when, second - seconds, side="left")
                out |= {f"n_{name}": count[here] - count[first], f"sum_{name}": value[here] - value[first]}
            yield pd.DataFrame(out)[["key", "id", *names]]
            at, place = np.unique(second, return_inverse=True)
            totals = [np.concatenate(p) for p in ((totals[0], at), (totals[1], np.bincount(place)), (totals[2], np.bincount(place, weights=x)))]
        kept = totals[0] >= closed - longest
        totals = [a[kept] for a in totals]
        if not len(rows[0]) and not len(totals[0]):
            if state.exists:
                state.remove()
            return
        state.update(tuple(np.ascontiguousarray(a, k).tobytes() for a, k in zip([*rows, *totals], kinds)))
        wake = (int(rows[0].min()) // 1000 + 1) * 1000 if len(rows[0]) else (int(totals[0][-1]) + longest + 1) * 1000
        state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))

    result = ", ".join([f"key {kind}", "id bigint", *[f"{n} {'bigint' if n.startswith('n_') else 'double'}" for n in names]])
    found = own.groupBy("key").applyInPandasWithState(step, result, _STATE, "append", "EventTimeTimeout")
    return found.withColumnsRenamed({"key": key, "id": row_id})
