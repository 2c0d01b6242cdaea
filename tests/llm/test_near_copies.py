import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cardsieve.llm import _store, near_copies


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or {tuple(words)}


def brute(rows, size=5, least=80):
    """The ids that stay when pairs at or above the share are joined into groups."""
    sets = {i: shingles(t, size) for i, t in rows}
    return firsts(sets, [(a, b) for a, b in combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])])


def firsts(nodes, pairs):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i for i in nodes if find(i) == i}


def kept(docs, **settings):
    return {r.doc_id for r in near_copies.one_of_each(docs, **settings).collect()}


def test_rows_without_a_possible_partner_go():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = rng.integers(1, 60, 40)
        rows = np.stack([np.zeros(40, int), np.zeros(40, int), np.arange(40), n, rng.integers(0, n // 5 + 1)], axis=1)
        group = np.sort(rng.integers(0, 9, 40))
        got = set(near_copies._with_partner(rows, group, 80)[:, 2].tolist())
        for a, b in combinations(range(40), 2):
            if group[a] == group[b] and min(n[a] - rows[a, 4], n[b] - rows[b, 4]) * 180 >= 80 * (n[a] + n[b]):
                assert {a, b} <= got
        assert len(got) < 40


def test_the_stage_finds_all_pairs_of_the_tables(spark, docs, sf):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(8)
    sets, pairs = [], []
    for _ in range(300):
        one = rng.integers(0, 2**63, int(rng.integers(0, 1500)), dtype=np.uint64)
        other = one.copy()
        changed = np.flatnonzero(rng.random(len(one)) < rng.choice([0.05, 0.12, 0.4, 1.0]))
        other[changed] = rng.integers(0, 2**63, len(changed), dtype=np.uint64)
        pairs.append((np.unique(one), np.unique(other[: int(len(other) * rng.uniform(0.8, 1))])))
        sets += pairs[-1]
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    short, long = near_copies._sketches(np.concatenate(sets), ends)
    assert short.shape == (600, 4) and all(8 * len(x) >= max(256, len(s)) for x, s in zip(long, sets))
    table = pa.record_batch({"a": list(range(300)), "b": list(range(300)), "n": [len(x) for x, _ in pairs], "m": [len(y) for _, y in pairs], "x": long[::2], "y": long[1::2]})
    (out,) = near_copies._maybe([table], 80)
    like = [k for k, (x, y) in enumerate(pairs) if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))]
    got = set(out.column("a").to_pylist())
    assert set(like) <= got and 20 < len(like) and len(got) < len(like) + 40


def test_rows_of_keys_that_are_too_large_are_handed_on():
    rng = np.random.default_rng(3)
    keys = np.sort(np.concatenate([rng.integers(0, 40, 100), np.full(300, 7), np.full(90, 21)]))
    rows = np.stack([keys, np.zeros(490, int), np.arange(490), np.ones(490, int), np.zeros(490, int)], axis=1)
    for step, most in [(1, 20), (10, 20), (64, 100), (490, 500)]:
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in rows[s : s + step].T], list("kpabc")) for s in range(0, 490, step)]
        got = list(near_copies._whole_keys(batches, most))
        assert np.array_equal(np.concatenate([part for part, _ in got]), rows)
        assert all(len(part) <= most + step for part, _ in got)
        whole = [set(part[:, 0].tolist()) for part, full in got if not full]
        full = {key for part, mark in got if mark for key in part[:, 0].tolist()}
        assert sum(map(len, whole)) == len(set().union(*whole)) and not full & set().union(*whole)
        assert all(np.sum(keys == key) > most for key in full)


def variants(r, groups):
    """Texts that share lines, and copies of them with a few words changed, at similarities around the limit."""
    lines = [" ".join(r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(12)) for _ in range(20)]
    out = []
    for _ in range(groups):
        base = " ".join([*(f"w{r.randrange(10**6)}" for _ in range(r.randint(1, 60))), *r.sample(lines, r.randint(0, 6))]).split()
        for _ in range(r.randint(1, 5)):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = f"v{r.randrange(10**6)}"
            out.append(" ".join(own))
    return list(enumerate(out))


@pytest.mark.parametrize("seed,sample,block,common", [(1, 20_000, 4096, 200_000), (2, 20, 4096, 200_000), (3, 20_000, 2, 200_000), (4, 20_000, 1, 0)])
def test_no_pair_is_lost(spark, monkeypatch, seed, sample, block, common):
    """Whatever the sample, so whatever the order of shingles; with common shingles dealt out in pairs of blocks, and with a sample that tells none of them."""
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    monkeypatch.setattr(near_copies, "COMMON", common)
    rows = variants(random.Random(seed), 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = _store.stored(near_copies._all_nodes(docs, 5), "nodes")
    links = [tuple(r) for r in near_copies.similar_links(docs, nodes, block=block).collect()]
    texts, ids, sets, first = dict(rows), {}, {}, {}
    for r in nodes.orderBy("__id").collect():
        sets[r.node] = shingles(texts[r["__id"]])
        ids[r["__id"]] = first.setdefault(r.node, r["__id"])
    assert all(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in links)
    assert firsts(ids, [*ids.items(), *((first[a], first[b]) for a, b in links)]) == brute(rows)


def test_a_few_changed_words_of_many(spark):
    """In a text of 100 words one change costs 5 shingles of 96 on either side: two changes 0.81, three 0.73."""
    words = [f"w{k}" for k in range(100)]
    change = lambda *at: " ".join("x" + w if k in at else w for k, w in enumerate(words))
    docs = spark.createDataFrame([(1, change()), (2, change(30, 60)), (3, change(20, 50, 80))], "doc_id long, text string")
    assert kept(docs) == {1, 3}


def test_rows_are_decided_by_their_own_text(spark, odd):
    out = near_copies.one_of_each(odd)
    assert out.columns == odd.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, k) for k in (1, 2, 5, 6, 8, 9, 10)] + [(True, 0)]
    assert near_copies.one_of_each(odd.filter("false")).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words that stay here"), (None, "a b c d e f"), (None, "only here and nowhere else"), (None, None)]
    out = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(({*rows} - {(None, "a b c d e f")}), key=str)
