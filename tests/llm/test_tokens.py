import functools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cardsieve.llm import _tokens, hilbert_pack, token_files

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


load = functools.lru_cache(Tokenizer.from_file)


def ids(path, text, end):
    return np.array(load(path).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("path,spaces,end", [(BYTES, True, 0), (WORDS, False, 2)])
def test_encode_equals_the_library(docs, odd, path, spaces, end):
    import pyarrow as pa

    texts = [r.text for r in docs.limit(80).collect()] + [r.text for r in odd.collect() if len(r.text or "") < 9999]
    texts += [" a b", "a  b", "x \n y", "don't <|endoftext|> stop, it's!", "Ünï  ", "a\tb c", "  ", "　x y", "İx ΑΣ q", "a.b,c! d?? e|", "A' b'", "é x", "  z", "q\x1c w", "don't's 'll", "ab1 c2.d"]
    got, lengths = _tokens.encode(pa.array(texts), path, spaces, end)
    tokenizer, at = Tokenizer.from_file(path), 0
    for text, n in zip(texts, lengths):
        assert got[at : at + n].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids + [end], text
        at += n


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000, 300_000])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    tokens = np.minimum(rng.zipf(1.3, n), 999).astype(np.uint16)
    table = token_files.Table.fit(np.bincount(tokens, minlength=1000))
    raw = token_files.encode_file([1], np.array([n]), tokens, table)
    names, lengths, back = token_files.decode_file(raw, table)
    assert names == [1] and list(lengths) == [n] and (back == tokens).all()
    if n:
        with pytest.raises(ValueError):
            token_files.decode_file(raw[:-1] + bytes([raw[-1] ^ 1]), table)
    if n == 300_000:
        p = np.bincount(tokens) / n
        assert len(raw) * 8 / n < 1.05 * -(p[p > 0] * np.log2(p[p > 0])).sum() + 0.9


def test_checkpoints():
    tokens = np.random.default_rng(0).integers(0, 50, token_files.LANES * 300).astype(np.uint16)
    table = token_files.Table.fit(np.bincount(tokens, minlength=50))
    body = token_files._encode_block(tokens, table)[8:]
    for step in (128, 256):
        assert (token_files._decode_block(body, table, step) == tokens[step * token_files.LANES :]).all()
    with pytest.raises(ValueError):
        token_files._decode_block(body, table, 100)


def test_token_files(docs):
    manifest, table, folder = token_files.write_files(docs, BYTES, 50257)
    got, at = {r.doc_id: r for r in token_files.read_files(manifest, table, folder, with_ids=True).collect()}, 0
    for r in docs.orderBy("doc_id").collect():
        want = ids(BYTES, r.text, 0)
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32, bytes(g.ids)) == (at, len(want), zlib.crc32(want.tobytes()), want.tobytes())
        at += len(want)


def test_token_files_odd_rows(odd):
    out = token_files.read_files(*token_files.write_files(odd, BYTES, 50257)).collect()
    assert len(out) == odd.count() and all(r.n_tokens == 1 for r in out if r.doc_id in (2, 3))
    spans = sorted((r.start, r.n_tokens) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert token_files.read_files(*token_files.write_files(odd.filter("false"), BYTES, 50257)).count() == 0


def check_pieces(rows, texts):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        own = texts[r.doc_id]
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for spans, total in [(s, None) for s in sequences.values()] + [(p, len(texts[k])) for k, p in pieces.items()]:
        at = 0
        for start, n in sorted(spans):
            assert start == at and n > 0
            at += n
        assert at == total if total is not None else at == 4096 or (at & (at - 1) == 0 and at < 4096)
    assert set(pieces) == set(texts)


def test_packing(docs):
    check_pieces(hilbert_pack.pack(docs, WORDS, 2).collect(), {r.doc_id: ids(WORDS, r.text, 2) for r in docs.collect()})


def test_packing_odd_rows(odd):
    out = hilbert_pack.pack(odd, WORDS, 2, with_ids=True).collect()
    assert sum(r.length for r in out) == sum(len(ids(WORDS, r.text, 2)) for r in odd.collect())
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in out)
    assert hilbert_pack.pack(odd.filter("false"), WORDS, 2).count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_neighbours(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
    keys = hilbert_pack.hilbert_key(points, bits)
    assert sorted(keys) == list(range(len(points)))
    steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()  # the curve moves to a neighbour each time
