"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and cut at white space; the n-grams of a word are taken with a space on either side and hashed to a
fixed number of buckets. Training counts are summed over all labelled documents by Spark. The log-probability matrix
(languages x buckets) goes to the tasks by broadcast, behind a check of its size; scoring is sparse: a batch's distinct
words are scored once, each document adds up the scores of its words.

Defined cases: ``und`` with score 0 for null texts, for texts without a letter, and where nothing has been learned. Documents
with null text or label teach nothing; null doc_id counts as training text. Ties go to the label that sorts first.
Repeated rows count each time; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from ._text import ragged, slices

UNKNOWN = "und"
#: Characters of words whose n-grams are hashed at a time.
PART = 1 << 18
#: Most bytes of a model that are sent to the tasks.
MODEL_BYTES = 256 << 20


@dataclass
class Model:
    labels: list[str]
    #: log probabilities, buckets x labels
    weights: np.ndarray
    prior: np.ndarray
    sizes: tuple[int, ...]


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Coded words, and the row of each."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(pc.cast(texts, pa.string()), "")))
    rows = pc.list_parent_indices(lists).to_numpy()
    words = lists.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)
    return words.filter(full).dictionary_encode(), rows[full.to_numpy(zero_copy_only=False)]


def _features(words: pa.Array, buckets: int, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashed n-grams of the words, some words at a time: the words' numbers, how many n-grams each has, their buckets.

    A very long word comes in several parts, each with the n-grams that start in it.
    """
    padded = pc.binary_join_element_wise(pa.scalar(" "), words, pa.scalar(" "), "")
    lengths = pc.utf8_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
    long = np.flatnonzero(lengths > PART)  # these stand alone
    cuts = np.unique(np.concatenate([[0, len(lengths)], long, long + 1, np.flatnonzero(np.diff(np.cumsum(lengths) // PART)) + 1])).tolist()
    for a, b in zip(cuts, cuts[1:]):
        own, text = lengths[a:b], "".join(padded[a:b].to_pylist())
        if own[0] <= PART:
            yield (np.arange(a, b), *_hashed(text, own, buckets, sizes, PART))
            continue
        for k in range(0, len(text), PART):
            part = text[k : k + PART + max(sizes) - 1]
            yield (np.array([a]), *_hashed(part, np.array([len(part)]), buckets, sizes, PART))


def _hashed(text: str, lengths: np.ndarray, buckets: int, sizes: tuple[int, ...], most: int) -> tuple[np.ndarray, np.ndarray]:
    """How many n-grams each of the joined words has, and their buckets in order; of each size the first ``most``."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    found, owner = [], []
    for n in sizes:
        counts = np.minimum(np.maximum(lengths - n + 1, 0), most)
        at = ragged(starts, counts)
        h = np.full(len(at), 0x9E3779B97F4A7C15 + n, np.uint64)
        for k in range(n):
            h = (h ^ points[at + k]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        found.append((h % np.uint64(buckets)).astype(np.int64))
        owner.append(np.repeat(np.arange(len(lengths)), counts))
    where = np.argsort(np.concatenate(owner), kind="stable")
    return np.bincount(np.concatenate(owner), minlength=len(lengths)), np.concatenate(found)[where]


def _count(batches: Iterator[pa.RecordBatch], buckets: int, sizes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    sums: list[np.ndarray] = []
    docs: list[int] = []
    for batch in slices(batches, "text"):
        coded, rows = _words(batch.column("text"))
        labels = batch.column("lang").to_pylist()
        for x in labels:
            if x not in names:
                names[x] = len(sums)
                sums.append(np.zeros(buckets, np.int64))
                docs.append(0)
        own = np.array([names[x] for x in labels])
        for k, n in zip(*np.unique(own, return_counts=True)):
            docs[k] += int(n)
        if not len(coded):
            continue
        size = len(coded.dictionary)
        each = np.bincount(own[rows] * size + coded.indices.to_numpy(), minlength=len(sums) * size).reshape(len(sums), size)
        for words, counts, found in _features(coded.dictionary, buckets, sizes):
            for k in range(len(sums)):
                sums[k] += np.bincount(found, weights=np.repeat(each[k, words], counts), minlength=buckets).astype(np.int64)
    for label, k in names.items():
        at = np.flatnonzero(sums[k])
        yield pa.RecordBatch.from_arrays([pa.array([label] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1)), pa.array(np.append(sums[k][at], docs[k]))], ["lang", "bucket", "n"])


def train(docs: DataFrame, buckets: int = 1 << 16, sizes: tuple[int, ...] = (1, 2, 3, 4), smoothing: float = 0.5) -> Model:
    """Learn from the columns text and lang of all rows that have both."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = rows.mapInArrow(lambda it: _count(it, buckets, sizes), "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("found"))  # at most buckets + 1 for a language
    labels = counts.select("lang").count()
    if labels * buckets * 4 > MODEL_BYTES:
        raise ValueError(f"{labels} languages x {buckets} buckets are more than the model may take; use fewer buckets")
    found = sorted(counts.select("lang", F.col("found.bucket").alias("bucket"), F.col("found.n").alias("n")).toLocalIterator(), key=lambda r: r.lang)
    table, prior = np.full((len(found), buckets), smoothing), np.zeros(len(found))
    for k, r in enumerate(found):
        at, n = np.array(r.bucket), np.array(r.n, float)
        table[k, at[at >= 0]] += n[at >= 0]
        prior[k] = n[at < 0].sum()
    weights = np.log(table / table.sum(axis=1, keepdims=True)) if len(found) else table
    return Model([r.lang for r in found], np.ascontiguousarray(weights.T, np.float32), np.log(prior / max(prior.sum(), 1)) if len(found) else prior, sizes)


def _predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    coded, rows = _words(texts)
    total = np.tile(model.prior, (len(texts), 1))
    if len(coded) and model.labels:
        each = np.zeros((len(coded.dictionary), len(model.labels)))
        for words, counts, found in _features(coded.dictionary, len(model.weights), model.sizes):
            each[words] += np.add.reduceat(model.weights[found], np.cumsum(counts) - counts, axis=0)
        codes = coded.indices.to_numpy()
        for k in range(len(model.labels)):
            total[:, k] += np.bincount(rows, weights=each[codes, k], minlength=len(texts))
    letters = pc.fill_null(pc.match_substring_regex(pc.cast(texts, pa.string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not model.labels:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = np.argmax(total, axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.labels[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.where(letters, score, 0.0)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of the documents (None: all), then lang_pred and score (the posterior probability of lang_pred).

    Existing columns of these two names are replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*dict.fromkeys([*names, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            label, score = _predict(batch.column(text), sent.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(label, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return rows.mapInArrow(run, StructType(docs.select(*names).schema.fields).add("lang_pred", StringType()).add("score", DoubleType()))


def held_out(doc_id: str = "doc_id", mod: int = 3, rest: int = 1) -> Column:
    """True where crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learned from those that aren't held out."""
    model = train(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text")), model, keep=["doc_id", "held_out"])


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is known with a score of at least ``least``, with their columns."""
    model = train(docs.filter(~held_out()))
    mark = docs.withColumn("__text", F.col("text").cast("string"))
    found = predict(mark.withColumnsRenamed({c: f"__in_{c}" for c in docs.columns}), model, "__text", [f"__in_{c}" for c in docs.columns])
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(f"__in_{c}").alias(c) for c in docs.columns])
