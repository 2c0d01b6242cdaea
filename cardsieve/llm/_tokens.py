"""Token ids of many texts at once. A batch's distinct words are encoded once by the tokenizers library, and remembered."""

from __future__ import annotations

import functools
import os
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from ._text import ragged

#: Every character that some Unicode table counts as white space, for regular expressions.
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: Words that a worker remembers with their ids (at most about 30 bytes each), and the longest of them in bytes.
REMEMBERED, LONGEST = 3_000_000, 60
#: Marks that can end a piece without changing how its word is read.
_MARKS = ".,;:!?)|*%#"
#: Latin letters whose lower case is one character, without signs that stand among them: the pieces made of these and of marks.
_LATIN = [range(0x41, 0x5B), range(0x61, 0x7B), range(0xC0, 0xD7), range(0xD8, 0xF7), range(0xF8, 0x130), range(0x131, 0x250)]
_LETTERS = "".join(chr(c) for run in _LATIN for c in run)
_PLAIN = "^ ?[" + "".join(rf"\x{{{run[0]:x}}}-\x{{{run[-1]:x}}}" for run in _LATIN) + rf"]+[{_MARKS}]*$"


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet, by its rule: printable bytes stand for themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: b for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = extra, extra + 1
    return out


def _flat(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in order, and how many each has."""
    raw = [array("I", x).tobytes() for x in ids]
    return np.frombuffer(b"".join(raw), np.uint32), np.fromiter(map(len, raw), np.int64, len(raw)) // 4


class _Memory:
    """Words by their hashes (64 bits to find, 32 others to make sure), with their ids in one array."""

    def __init__(self):
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, (self.keys[at] == keys) & (self.checks[at] == checks)

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember words that aren't there yet, if there is room. ``ids``: all that are remembered, then those of the words.

        A word has at most as many ids as bytes, so a length fits into a byte.
        """
        if len(keys) > REMEMBERED - len(self.keys):
            return
        by = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[by])
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.keys, self.checks = np.insert(self.keys, at, keys[by]), np.insert(self.checks, at, checks[by])
        self.starts, self.lengths = np.insert(self.starts, at, starts[by]), np.insert(self.lengths, at, lengths[by].astype(np.uint8))
        self.ids = ids


class _Encoder:
    """Ids of pieces. Latin words are one pre-token of either vocabulary and go straight to the library's model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.known = self.tokenizer.model, _byte_letters(), _Memory()
        self.lower = "Lowercase" in (repr(self.tokenizer.normalizer) if self.tokenizer.normalizer else "")

    def _model_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, letters = self.model.tokenize, self.letters
        return _flat([[t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))] for p in pieces])

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct Latin words, each with one space before it at most."""
        named = words.to_numpy(zero_copy_only=False).astype(object)
        keys = pd.util.hash_array(named, categorize=False)
        checks = pd.util.hash_array(named, hash_key="another hash key", categorize=False).astype(np.uint32)
        place, there = self.known.find(keys, checks)
        new, found = np.flatnonzero(~there), np.flatnonzero(there)
        ids, own = self._model_ids(words.take(pa.array(new)).to_pylist())
        starts, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[found], lengths[found] = self.known.starts[place[found]], self.known.lengths[place[found]]
        starts[new], lengths[new] = len(self.known.ids) + np.cumsum(own) - own, own
        every = np.concatenate([self.known.ids, ids])
        self.known.add(keys[new], checks[new], every, own)
        return every[ragged(starts, lengths)], lengths

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for at in range(0, len(pieces), 50_000):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(pieces[at : at + 50_000], add_special_tokens=False)]
        return _flat(out)

    def __call__(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and how many each has."""
        plain = pc.and_(pc.match_substring_regex(pieces, _PLAIN), pc.less_equal(pc.binary_length(pieces), LONGEST)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(plain)
        own = pieces.take(pa.array(at))
        if self.lower:
            own = pc.utf8_ltrim(own, " ")
        words = pc.utf8_rtrim(own, _MARKS).dictionary_encode()
        marks = pc.utf8_ltrim(own, _LETTERS + " ").dictionary_encode()
        lower = pc.utf8_lower(words.dictionary) if self.lower else words.dictionary
        parts = [self._words(lower) if len(lower) else _flat([]), self._model_ids(marks.dictionary.to_pylist()), self._pieces(pieces.filter(pa.array(~plain)).to_pylist())]
        flat, lengths = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        starts = np.cumsum(lengths) - lengths
        # a plain piece is its word and its marks, any other piece stands for itself
        first, second = np.zeros(len(pieces), np.int64), np.full(len(pieces), -1, np.int64)
        first[at], second[at] = words.indices.to_numpy(), len(words.dictionary) + marks.indices.to_numpy()
        first[~plain] = len(lengths) - len(pieces) + len(at) + np.arange(len(pieces) - len(at))
        two = np.stack([first, second], axis=1).ravel()
        each = np.where(two >= 0, lengths[two], 0)
        return flat[ragged(starts[two], each)], each.reshape(-1, 2).sum(axis=1)


_load = functools.lru_cache(2)(_Encoder)


def encode(texts: pa.Array, path: str, spaces: bool, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, each text's followed by ``end``, and how many each has. A null text is empty.

    spaces=True: for byte-level vocabularies whose pieces begin with the space before them. A text is cut before each space
    between two characters that aren't white space; any text with other spacing next to a space is encoded as a whole.
    spaces=False: for vocabularies that drop white space. A text is cut at white space. Both give the ids of the whole text.
    """
    texts = pc.fill_null(pc.cast(texts, pa.string()), "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    whole = np.zeros(0, np.int64)
    if spaces:
        whole = np.flatnonzero(pc.match_substring_regex(texts, rf"^ | $|{_SPACE} | {_SPACE}").to_numpy(zero_copy_only=False))
    cut = texts
    if len(whole):
        keep = np.ones(n, bool)
        keep[whole] = False
        cut = pc.if_else(pa.array(keep), texts, "")
    lists = pc.split_pattern(cut, " ") if spaces else pc.ascii_split_whitespace(cut)  # each text has a piece at least, if an empty one
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values[int(offsets[0]) : int(offsets[-1])].dictionary_encode()
    offsets -= offsets[0]
    codes, strings = coded.indices.to_numpy().astype(np.int64), [coded.dictionary]
    if spaces:
        first = offsets[:-1]
        opening, own = np.unique(codes[first], return_inverse=True)
        codes[first] = len(coded.dictionary) + own
        strings = [pc.binary_join_element_wise(pa.scalar(" "), coded.dictionary, ""), coded.dictionary.take(pa.array(opening))]
    codes[offsets[whole]] = sum(map(len, strings)) + np.arange(len(whole))
    flat, lengths = _load(path)(pa.concat_arrays([*strings, texts.take(pa.array(whole))]))
    flat, lengths = np.append(flat, np.uint32(end)), np.append(lengths, 1)
    # the pieces of a text, then the end id
    row = np.arange(n)
    code = np.full(len(codes) + n, len(lengths) - 1, np.int64)
    code[np.arange(len(codes)) + np.repeat(row, np.diff(offsets))] = codes
    each = lengths[code]
    ids = flat[ragged((np.cumsum(lengths) - lengths)[code], each)]
    return ids, np.add.reduceat(each, offsets[:-1] + row)
