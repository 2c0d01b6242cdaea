"""Language-model scoring with sharded Elias-Fano n-gram tries.

The model is interpolated absolute discounting: p(w | context) = max(c - D, 0) / C + D * T / C * p(w | shorter context), where
C is the context's count and T the number of distinct words after it; at the bottom (c + 1) / (N + V + 1). Texts run from
end token to end token.

Neither counts nor model ever lie in one place. Documents are cut into words once and kept as blocks: the distinct words'
hashes, and the texts as their numbers. A block lists its distinct n-grams, once each with its training count, as a forest:
first words, the words after each, the words after those. Shards are ranges of first words' hashes, so a shard gets whole
branches. It adds up what all blocks sent, builds its trie, and answers every block in the order of its list. So a word or
phrase that is everywhere costs one entry a block. Branches below very frequent words are split over several shards by the
hash of the next word; their totals are added up again in the block.

A trie's levels: first words as an Elias-Fano sequence of hashes; for each further level monotone pointers from a node to
the run of its children, the runs, stored as ranks in the list of words and made monotone by the parent's number, and
probabilities quantised to 8 bits; contexts' counts and numbers of distinct next words as Elias-Fano sequences of their
running sums. A shard writes its trie as one file of the shared folder, maps it into memory, and looks a word up by
successor search within its parent's run. The file goes when the shard has answered.

Words are told apart by 64-bit hashes; in a trie first words by 56 bits and the words after a context by 32.

Defined cases: a null or empty text is the end token alone. Repeated rows train and score as often as they occur; a null mark
means no training row; with no training rows every probability is the bottom one; an empty table gives no rows; a doc_id
that is no number counts as null; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store
from ._text import LOWER, gathered, split_words
from .elias_fano import EliasFano, laid_out, opened

DISCOUNT = 0.75
#: Bytes of text in a block, and tokens for each shard; shards of single words, which have far fewer entries, are fewer.
BLOCK_BYTES, SHARD_TOKENS, WORD_SHARDS = 5 << 20, 1 << 19, 32
#: Most words that count as frequent, so the bytes that a task is sent: their hashes and counts.
FREQUENT = 1 << 22
#: Key of the end token; no word of a text has it but by chance.
END_KEY = np.uint64(0x5851F42D4C957F2D)
#: Bits of a first word's hash, and of the hash of a word after others.
KEY_BITS, WORD_BITS = 56, 32
_DECADES, _ABSENT = 8.0, 255
_BLOCK = "block bigint, doc_ids array<bigint>, marks binary, lengths binary, keys binary, codes binary, tokens bigint"
_REQUEST = "block bigint, shard bigint, keys binary, runs array<binary>, words array<binary>, counts array<binary>"
_ANSWER = "block bigint, level int, shard bigint, codes array<binary>, totals array<binary>, types array<binary>, n bigint, v bigint"
_SCORE = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double"
_I, _B = pa.int64(), pa.binary()
_REQUEST_TYPES = {"block": _I, "shard": _I, "keys": _B, "runs": pa.list_(_B), "words": pa.list_(_B), "counts": pa.list_(_B)}
_ANSWER_TYPES = {"block": _I, "level": pa.int32(), "shard": _I} | {c: pa.list_(_B) for c in ("codes", "totals", "types")} | {"n": _I, "v": _I}
_SCORE_TYPES = {"doc_id": _I, "train": pa.bool_(), "n_tokens": _I, "n_known": _I, "base_score": pa.float64(), "score": pa.float64()}


def _arrow(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(types.items())})


def _narrow(values: np.ndarray) -> bytes:
    """Numbers in as many bytes as the largest needs, byte planes one after another: upper planes compress well."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def _widened(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()


def _rising(values: np.ndarray) -> bytes:
    """A sorted list of keys as the first one and the packed differences."""
    return values[:1].tobytes() + _narrow(np.diff(values))


def _risen(raw: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(raw, np.uint64, 1), _widened(raw[8:]).view(np.uint64)]), dtype=np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _quantised(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities; of zero the code of a word that isn't there."""
    return np.where(p > 0, np.clip(np.round(-np.log10(np.maximum(p, 1e-30)) / _DECADES * 254), 0, 254), _ABSENT).astype(np.uint8)


#: Probability of each code; 0 for a word that the trie doesn't have.
_VALUE = np.append(10.0 ** (-_DECADES * np.arange(255) / 254), 0.0)


def _coded(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
    """A block: the texts of a batch as numbers of its distinct words in order of their hashes."""
    words, ends = split_words(batch.column("text"), LOWER)
    coded = words.dictionary_encode()
    named = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
    keys, place = np.unique(np.append(pd.util.hash_array(named, categorize=False) if len(named) else np.zeros(0, np.uint64), END_KEY), return_inverse=True)
    lengths = np.diff(ends) + 1
    codes = np.full(int(lengths.sum()), place[-1], np.int64)
    inner = np.ones(len(codes), bool)
    inner[np.cumsum(lengths) - 1] = False
    if len(coded):
        codes[inner] = place[:-1][coded.indices.to_numpy()]
    marks = batch.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)
    columns = [number, batch.column("doc_id").to_pylist(), marks.tobytes(), _narrow(lengths), keys.tobytes(), _narrow(codes), len(codes)]
    kinds = [_I, pa.list_(_I), _B, _B, _B, _B, _I]
    names = ["block", "doc_ids", "marks", "lengths", "keys", "codes", "tokens"]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(columns, kinds)], names)


@dataclass
class Frequent:
    """Words with more training tokens than ``hot``: their hashes, ascending, and counts."""

    hot: int
    keys: np.ndarray
    counts: np.ndarray

    def parts(self, keys: np.ndarray) -> np.ndarray:
        """Parts that the branches below each word are dealt out over."""
        parts = np.ones(len(keys), np.int64)
        at = np.searchsorted(keys, self.keys)
        here = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == self.keys)
        parts[at[here]] = -(-self.counts[here] // self.hot)
        return parts


@dataclass
class Level:
    """The nodes that a block asks for on one level, in order: of n-gram ``gram`` the part ``part``, below ``parent``."""

    gram: np.ndarray
    part: np.ndarray
    parent: np.ndarray
    word: np.ndarray


class Block:
    def __init__(self, row: dict):
        self.number, self.doc_ids = row["block"], row["doc_ids"]
        self.marks, self.lengths = np.frombuffer(row["marks"], np.uint8).astype(bool), _widened(row["lengths"])
        self.keys, self.codes = np.frombuffer(row["keys"], np.uint64), _widened(row["codes"])
        self.end = int(np.searchsorted(self.keys, END_KEY))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(self.marks, self.lengths)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.codes[self.train], minlength=len(self.keys))

    def word_cuts(self, shards: int) -> np.ndarray:
        return np.searchsorted(self.keys, np.array([(k << 64) // shards for k in range(1, shards)], np.uint64))

    def forest(self, order: int, frequent: Frequent) -> Forest:
        return Forest(self, order, frequent)


class Forest:
    """A block's n-grams of all orders, and the nodes that stand for them in the tries.

    The same block gives the same lists in every pass.
    """

    def __init__(self, block: Block, order: int, frequent: Frequent):
        self.block, self.order, self.keys = block, order, block.keys
        self._grams()
        # an n-gram is at most as frequent as its rarest word; nodes below frequent ones are dealt out over parts
        words = frequent.parts(block.keys)
        self.parts = [words]
        for m in range(2, order):
            self.parts.append(np.minimum(self.parts[-1][self.context[m]], words[self.word[m]]))
        self._nodes()

    def _grams(self) -> None:
        """token[m]: the number of each token's m-gram; context[m], word[m]: of each m-gram; counts[m]: training counts."""
        block, pads, size = self.block, self.order - 1, len(self.keys)
        at = np.arange(len(block.codes)) + pads * np.repeat(np.arange(1, len(block.lengths) + 1), block.lengths)
        stream = np.full(len(block.codes) + pads * len(block.lengths), block.end, np.int64)
        stream[at] = block.codes
        ids, self.token, self.context, self.word, self.counts = stream, {1: block.codes}, {}, {}, {}
        for m in range(2, self.order + 1):
            # ids holds the (m - 1)-gram that ends at each place from m - 2 on
            key = ids[:-1] * size + stream[m - 1 :]
            if m == self.order:
                key = key[at - m + 1]
            found, ids = np.unique(key, return_inverse=True)
            self.token[m] = ids if m == self.order else ids[at - m + 1]
            self.context[m], self.word[m] = np.divmod(found, size)
            self.counts[m] = np.bincount(self.token[m][block.train], minlength=len(found))

    def _nodes(self) -> None:
        """levels[m]: the nodes of level m, parents before children; own[m]: the node with each m-gram's own count."""
        order, keys = self.order, self.keys
        gram = np.arange(len(self.word[order]))
        found, part = {}, np.zeros(len(gram), np.int64)
        for m in range(order, 1, -1):
            context, word = self.context[m][gram], self.word[m][gram]
            parts, base = self.parts[m - 2], np.cumsum(self.parts[m - 2]) - self.parts[m - 2]
            below = base[context]
            split = np.flatnonzero(parts[context] > 1)
            if len(split):
                below[split] += (_mix(keys[word[split]], part[split] + 77) % parts[context[split]].astype(np.uint64)).astype(np.int64)
            low = keys[word] >> np.uint64(64 - WORD_BITS)
            again = np.flatnonzero(part)
            low[again] = _mix(keys[word[again]], part[again]) >> np.uint64(64 - WORD_BITS)
            used = np.unique(below if m == 2 else np.concatenate([below, base]))
            found[m] = (gram, part, np.searchsorted(used, below), low)
            gram = np.searchsorted(base, used, side="right") - 1
            part = used - base[gram]
        self.levels: dict[int, Level] = {}
        entry = _mix(keys[gram], part + 1) >> np.uint64(64 - KEY_BITS)
        by = np.argsort(entry, kind="stable")
        self.entry, rank = entry[by], np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.levels[1] = Level(gram[by], part[by], np.zeros(len(by), np.int64), self.entry)
        self.own: dict[int, np.ndarray] = {}
        for m in range(2, order + 1):
            gram, part, parent, low = found[m]
            parent = rank[parent]
            by = np.argsort((parent.astype(np.uint64) << np.uint64(WORD_BITS)) | low, kind="stable")
            self.levels[m] = Level(gram[by], part[by], parent[by], low[by])
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            self.own[m] = np.empty(len(self.word[m]), np.int64)
            first = np.flatnonzero(self.levels[m].part == 0)
            self.own[m][self.levels[m].gram[first]] = first

    def cuts(self, shards: int) -> list[tuple[int, dict[int, slice]]]:
        """Shard, and its nodes on each level. A shard is a range of first words' hashes."""
        edges = [np.concatenate([[0], np.searchsorted(self.entry, np.array([-(-(k << KEY_BITS) // shards) for k in range(1, shards)], np.uint64)), [len(self.entry)]])]
        for m in range(2, self.order + 1):
            edges.append(np.searchsorted(self.levels[m].parent, edges[-1]))
        at = np.stack(edges, axis=1).tolist()
        return [(k, {m: slice(a[m - 1], b[m - 1]) for m in self.levels}) for k, (a, b) in enumerate(zip(at, at[1:])) if b[0] > a[0]]

    def requests(self, shards: int) -> list[tuple]:
        levels = range(2, self.order + 1)
        runs = {m: np.bincount(self.levels[m].parent, minlength=len(self.levels[m - 1].gram)) for m in levels}
        counts = {m: np.where(self.levels[m].part == 0, self.counts[m][self.levels[m].gram], 0) for m in levels}
        rows = []
        for k, own in self.cuts(shards):
            words = [self.levels[m].word[own[m]].astype("<u4").tobytes() for m in levels]
            rows.append((self.block.number, k, _rising(self.entry[own[1]]), [_narrow(runs[m][own[m - 1]]) for m in levels], words, [_narrow(counts[m][own[m]]) for m in levels]))
        return rows


class Trie:
    """One shard's trie: first words -> next words and so on, with quantised probabilities; contexts' counts and word types."""

    def __init__(self, levels: dict[str, np.ndarray], order: int):
        self.order, sequence = order, lambda name: EliasFano.named(levels, name)
        self.first, self.words = sequence("first"), sequence("words")
        self.pointers, self.runs, self.codes = ({m: f(m) for m in range(2, order + 1)} for f in (lambda m: sequence(f"pointers{m}"), lambda m: sequence(f"runs{m}"), lambda m: levels[f"codes{m}"]))
        self.totals, self.types = ({m: sequence(f"{name}{m}") for m in range(1, order)} for name in ("totals", "types"))

    @classmethod
    def levels(cls, first: np.ndarray, nodes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], discount: float = DISCOUNT) -> dict[str, np.ndarray]:
        """From distinct first words, ascending, and for each further level (parent, word, count) of its nodes, in order.

        Nodes that have neither a count nor such nodes below them are left out.
        """
        order = max(nodes)
        keep, below = {}, None
        for m in range(order, 1, -1):
            keep[m] = nodes[m][2] > 0
            if below is not None:
                keep[m][below] = True
            below = nodes[m][0][keep[m]]
        alive = np.zeros(len(first), bool)
        alive[below] = True
        vocabulary = np.unique(np.concatenate([nodes[m][1][keep[m]] for m in nodes]))
        size, number, n = max(len(vocabulary), 1), np.cumsum(alive) - 1, int(alive.sum())
        sequences, out = {"first": (first[alive], 1 << KEY_BITS), "words": (vocabulary, 1 << WORD_BITS)}, {}
        for m in range(2, order + 1):
            parent, word, count = (x[keep[m]] for x in nodes[m])
            parent, rank = number[parent], np.searchsorted(vocabulary, word)
            total = np.bincount(parent, weights=count, minlength=n).astype(np.int64)
            types = np.bincount(parent[count > 0], minlength=n)
            for name, each in (("totals", total), ("types", types)):
                sequences[f"{name}{m - 1}"] = (np.concatenate([[0], np.cumsum(each)]), int(each.sum()) + 1)
            sequences[f"pointers{m}"] = (np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=n))]), len(parent) + 1)
            sequences[f"runs{m}"] = (parent * size + rank, max(n, 1) * size)
            out[f"codes{m}"] = _quantised(np.where(count > 0, (count - discount) / np.maximum(total[parent], 1), 0.0))
            number, n = np.cumsum(keep[m]) - 1, len(parent)
        for name, (values, universe) in sequences.items():
            out |= {f"{name}.{part}": x for part, x in EliasFano.build(values, universe).items()}
        return out

    def look_up(self, first: np.ndarray, nodes: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[dict, dict, dict]:
        """Codes of the nodes (parent, word) by level; totals and types of those on all levels but the last."""
        codes, totals, types = {}, {}, {}
        at, known = self.first.find(first)
        for m in range(2, self.order + 1):
            mine = np.flatnonzero(known)
            for out, sums in ((totals, self.totals[m - 1]), (types, self.types[m - 1])):
                a, b = sums.steps(at[mine])
                out[m - 1] = np.zeros(len(known), np.int64)
                out[m - 1][mine] = b - a
            start, stop = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
            start[mine], stop[mine] = self.pointers[m].steps(at[mine])
            parent, word = nodes[m]
            rank, there = self.words.find(word)
            ask = np.flatnonzero(there & known[parent])
            own = parent[ask]
            place, found = self.runs[m].find((at[own] * max(self.words.n, 1) + rank[ask]).astype(np.uint64), start[own], stop[own])
            at, known = np.zeros(len(word), np.int64), np.zeros(len(word), bool)
            at[ask], known[ask] = place, found
            codes[m] = np.full(len(word), _ABSENT, np.uint8)
            codes[m][known] = self.codes[m][at[known]]
        return codes, totals, types


def _stored_trie(levels: dict[str, np.ndarray], order: int, folder: str) -> tuple[Trie, tuple]:
    """Write a trie as one file of the folder and open it where it lies; also what removes the file."""
    chunks, directory = laid_out(levels)
    name = f"{uuid.uuid4().hex}.trie"
    _store.put_file(folder, name, chunks)
    system, base = _store.file_system(folder)
    return Trie(opened(_store.mapped_file(folder, name), directory), order), (system.delete_file, f"{base}/{name}")


def _ask_words(block: Block, shards: int) -> list[tuple]:
    counts, cuts = block.word_counts(), [0, *block.word_cuts(shards).tolist(), len(block.keys)]
    return [(block.number, k, _rising(block.keys[a:b]), [], [], [_narrow(counts[a:b])]) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def _answer_words(table: pa.Table, hot: int) -> pa.Table:
    """Training counts of every block's words; in a row of its own, under block -1, the frequent words and the sums."""
    asked = table.to_pylist()
    keys = [_risen(r["keys"]) for r in asked]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([_widened(r["counts"][0]) for r in asked]), minlength=len(distinct)).astype(np.int64)
    shard, rows, at = asked[0]["shard"], [], 0
    for r, own in zip(asked, keys):
        rows.append((r["block"], 1, shard, [], [_narrow(total[place[at : at + len(own)]])], [], 0, 0))
        at += len(own)
    often = total > hot
    rows.append((-1, 1, shard, [distinct[often].tobytes()], [total[often].tobytes()], [], int(total.sum()), int((total > 0).sum())))
    return _arrow(rows, _ANSWER_TYPES)


def _answer(table: pa.Table, order: int, discount: float, folder: str) -> pa.Table:
    """Add up what the blocks ask for, build the shard's trie, and look up every distinct node once."""
    asked, levels = table.to_pylist(), range(2, order + 1)
    entries = [_risen(r["keys"]) for r in asked]
    sizes, place, nodes, counts = {1: [len(e) for e in entries]}, {}, {}, {}
    first, place[1] = np.unique(np.concatenate(entries), return_inverse=True)
    for m in levels:
        runs = [_widened(r["runs"][m - 2]) for r in asked]
        words = [np.frombuffer(r["words"][m - 2], "<u4") for r in asked]
        sizes[m] = [len(w) for w in words]
        key = np.repeat(place[m - 1].astype(np.uint64) << np.uint64(WORD_BITS), np.concatenate(runs)) | np.concatenate(words)
        key, place[m] = np.unique(key, return_inverse=True)
        counts[m] = np.bincount(place[m], weights=np.concatenate([_widened(r["counts"][m - 2]) for r in asked]), minlength=len(key)).astype(np.int64)
        nodes[m] = ((key >> np.uint64(WORD_BITS)).astype(np.int64), key & np.uint64((1 << WORD_BITS) - 1))
    trie, (remove, name) = _stored_trie(Trie.levels(first, {m: (*nodes[m], counts[m]) for m in levels}, discount), order, folder)
    codes, totals, types = trie.look_up(first, nodes)
    remove(name)
    edges = {m: np.cumsum([0, *sizes[m]]) for m in sizes}
    rows = []
    for k, r in enumerate(asked):
        own = {m: place[m][edges[m][k] : edges[m][k + 1]] for m in place}
        told = [[_narrow(x[m][own[m]]) for m in range(1, order)] for x in (totals, types)]
        rows.append((r["block"], order, r["shard"], [codes[m][own[m]].tobytes() for m in levels], *told, 0, 0))
    return _arrow(rows, _ANSWER_TYPES)


def _counts(block: Block, answers: list[dict]) -> np.ndarray:
    """Training counts of the block's words in all documents."""
    told = {r["shard"]: r["totals"][0] for r in answers if r["level"] == 1}
    return np.concatenate([_widened(told[k]) for k in sorted(told)]) if told else np.zeros(len(block.keys), np.int64)


def _scored(block: Block, answers: list[dict], order: int, shards: int, frequent: Frequent, bottom: int, discount: float) -> pa.Table:
    count = _counts(block, answers)
    forest = block.forest(order, frequent)
    told = {r["shard"]: r for r in answers if r["level"] > 1}
    inner, last = range(1, order), range(2, order + 1)
    code = {m: np.full(len(forest.levels[m].gram), _ABSENT, np.uint8) for m in last}
    totals, types = ({m: np.zeros(len(forest.levels[m].gram)) for m in inner} for _ in range(2))
    for k, own in forest.cuts(shards):
        r = told[k]
        for m in last:
            code[m][own[m]] = np.frombuffer(r["codes"][m - 2], np.uint8)
        for m in inner:
            totals[m][own[m]], types[m][own[m]] = _widened(r["totals"][m - 1]), _widened(r["types"][m - 1])
    unigram = (count + 1) / bottom
    p = unigram[block.codes]
    for m in last:
        contexts = len(forest.word[m - 1]) if m > 2 else len(block.keys)
        above = forest.levels[m - 1]
        total, kinds = (np.bincount(above.gram, weights=x[m - 1], minlength=contexts) for x in (totals, types))
        whole, own, context = np.maximum(total, 1), forest.own[m], forest.context[m]
        seen = _VALUE[code[m][own]] * totals[m - 1][forest.levels[m].parent[own]] / whole[context]
        rest = np.where(total > 0, discount * kinds / whole, 1.0)[context]
        p = seen[forest.token[m]] + rest[forest.token[m]] * p
    sums = lambda x: np.add.reduceat(x, block.starts)
    known, base = (count > 0).astype(np.int64)[block.codes], np.log10(unigram)[block.codes]
    columns = [block.doc_ids, block.marks, block.lengths, sums(known), sums(base), sums(np.log10(p))]
    return pa.table({name: pa.array(x, kind) for x, (name, kind) in zip(columns, _SCORE_TYPES.items())})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block(batch.slice(k, 1).to_pylist()[0])


def score(docs: DataFrame, train: Column, order: int = 3, discount: float = DISCOUNT, block_bytes: int = BLOCK_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score, score, train_tokens for every document (doc_id, text).

    ``train`` marks the rows to learn from. base_score is the add-one unigram score, score that of the trie model.
    """
    if order < 2:
        raise ValueError("the model needs an order of 2 at least")
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(gathered(batches, "text", block_bytes)):
            yield _coded(batch, first + number)

    rows = docs.select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = _store.stored(rows.mapInArrow(cut, _BLOCK), "blocks", per_file=2)
    tokens = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shards = max(1, -(-tokens // shard_tokens))
    word_shards, hot = max(1, shards // WORD_SHARDS), max(1000, shard_tokens // 4, tokens // FREQUENT)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield from _arrow(_ask_words(block, word_shards), _REQUEST_TYPES).to_batches()

    asked = blocks.mapInArrow(ask_words, _REQUEST)
    words = _store.stored(asked.groupBy("shard").applyInArrow(lambda t: _answer_words(t, hot), _ANSWER), "unigrams")
    sums = words.filter("block < 0").select("codes", "totals", "n", "v").collect()  # a row for each shard; at most FREQUENT words in all
    train_tokens, kinds = sum(r.n for r in sums), sum(r.v for r in sums)
    often = [np.frombuffer(b"".join(bytes(r[c][0]) for r in sums), kind) for c, kind in ((0, np.uint64), (1, np.int64))]
    by = np.argsort(often[0])
    frequent = spark.sparkContext.broadcast(Frequent(hot, often[0][by], often[1][by]))
    words, bottom, folder = words.filter("block >= 0"), train_tokens + kinds + 1, _store.new_path(spark, "tries")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield from _arrow(block.forest(order, frequent.value).requests(shards), _REQUEST_TYPES).to_batches()

    def finish(own: pa.Table, answers: pa.Table) -> pa.Table:
        told = answers.to_pylist()
        found = [_scored(b, told, order, shards, frequent.value, bottom, discount) for b in _blocks(own.to_batches())]
        return pa.concat_tables(found) if found else _arrow([], _SCORE_TYPES)

    asked = blocks.mapInArrow(ask, _REQUEST)
    answered = _store.stored(asked.groupBy("shard").applyInArrow(lambda t: _answer(t, order, discount, folder), _ANSWER), "ngrams")
    every = words.unionByName(answered)
    scored = blocks.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(finish, _SCORE)
    return scored.withColumn("train_tokens", F.lit(train_tokens).cast("bigint"))
