import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cardsieve.llm import simhash_ring
from cardsieve.llm.components import components


def fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute(rows):
    fps = [(i, fingerprint(t)) for i, t in rows]
    pairs = [(a, b) for k, (a, x) in enumerate(fps) for b, y in fps[:k] if (x ^ y).bit_count() <= 3]
    root = groups(pairs, [i for i, _ in fps])
    return {i: (f"{x:016x}", root[i]) for i, x in fps}


def test_fingerprints_and_components(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_ring.near_duplicates(docs).collect()}
    assert got == brute(rows)


def chains(r, n):
    """Fingerprints in chains of small steps, so that components are long."""
    out = []
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            out.append(x)
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
    return [v - (1 << 64) if v >> 63 else v for v in out[:n]]


@pytest.mark.parametrize("seed,block", [(1, 16384), (2, 16384), (3, 2)])
def test_no_link_is_lost(spark, seed, block):
    fps = sorted(set(chains(random.Random(seed), 600)))
    if block == 2:
        fps = sorted({(f & 0xFFFF) | (0x1234 << 16) for f in fps})  # dense keys, dealt out in pairs of blocks
    links = simhash_ring.hamming_links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block)
    got = {r.node: r.root for r in components(links).collect()}
    u = np.array(fps, np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    want = groups([(fps[a], fps[b]) for a, b in zip(*np.nonzero(near)) if a > b], fps)
    assert {f: got.get(f, f) for f in fps} == want


@pytest.mark.parametrize("task", [1 << 20, 50, 1])
def test_long_chain_components(spark, task):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1000), (None, 4), (500, 400), (400, 500)], "a long, b long")
    got = {r.node: r.root for r in components(links, task).collect()}
    assert all(got[k] == 0 for k in range(301)) and got[500] == 400 and len(got) == 303
    assert components(links.filter("false"), task).count() == 0


@pytest.mark.parametrize("task", [1 << 20, 64])
def test_components_of_random_links(spark, task):
    rng = random.Random(task)
    links = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(500)]
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(7), task).collect()}
    assert got == groups(links, nodes)


def test_odd_rows(odd):
    out = simhash_ring.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[2] == by[3] == by[4] == {("0" * 16, 2)} and by[1] == {(next(iter(by[1]))[0], 1)} and by[7] == by[1]
    kept = simhash_ring.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 2, 5, 6, 8, 9, 10]
    assert kept.filter("doc_id is null").count() == 2
    assert simhash_ring.near_duplicates(odd.filter("false")).count() == 0 and simhash_ring.one_of_each(odd.filter("false")).count() == 0


def test_majority_of_few_and_many():
    texts = ["a b c", "a b c d", "", "a", " ".join(f"w{k}" for k in range(999))]
    assert [int(x) for x in simhash_ring.text_fingerprints(pa.array(texts))] == [fingerprint(t) for t in texts]


def test_rows_of_one_id_are_decided_by_their_own_text(spark):
    rows = [(3, "some words that are here"), (5, "some words that are here"), (5, "others that nobody else has"), (5, "others that nobody else has")]
    out = simhash_ring.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out)) == [rows[0], rows[2]]
