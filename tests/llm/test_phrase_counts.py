import re
from collections import Counter

import numpy as np
import pyarrow as pa

from cardsieve.llm import phrase_counts


def brute(rows, least, top=2000, covered=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    total, counts = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts.update((lang, tuple(words[s : s + n])) for n in range(1, 5) for s in range(len(words) - n + 1))
    around = Counter()
    for (lang, w), a in counts.items():
        if a >= least and len(w) > 2:
            for n in range(2, len(w)):
                for s in range(len(w) - n + 1):
                    around[lang, w[s : s + n]] = max(around[lang, w[s : s + n]], a)
    best = {}
    for (lang, w), a in counts.items():
        if a >= least and len(w) > 1 and 100 * around[lang, w] < covered * a:
            score, k = min((2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w)))
            best.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, total[lang], -s) for lang, own in best.items() for rank, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def found(df, **settings):
    return sorted(tuple(r) for r in phrase_counts.collocations(df, **settings).collect())


def test_the_same_as_all_counts(spark, docs):
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    want = brute(rows, 5)
    assert want and found(docs, least=5) == want
    # containers that burst at once, and a trie that is written out after every block
    assert found(docs, least=5, burst=2, entries=50) == want
    assert found(docs, least=5, top=3) == brute(rows, 5, top=3)


def test_one_phrase_in_a_third_of_all_texts(spark):
    rows = [("en", "again and again we say, the very same words; the very same") for _ in range(300)] + [("en" if k % 2 else None, f"a {k} b {k % 7} c d e. F G") for k in range(600)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(9)
    assert found(df) == brute(rows, 30)


def test_odd_rows(spark, odd):
    rows = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    assert found(odd, least=2) == brute(rows, 2)
    signs = [("x", "a\tb\x0bc\u00a0d  e. . ,f"), ("x", "A\u2028b a b\r\nA B"), ("und", "q r"), (None, "Q R"), ("x", "É É é É"), ("x", "..."), ("x", "a")]
    df = spark.createDataFrame([(*r, 1, "k") for r in signs], "lang string, text string, words int, phrase string")
    assert found(df, least=2) == brute(signs, 2)
    assert found(df.filter("false")) == [] and found(df, least=100) == []


def test_words_and_pieces():
    words, piece, text = phrase_counts.words_of(pa.array(["a b,c", None, "d", " E\tf. ", ""]))
    assert words.to_pylist() == ["a", "b", "c", "d", "e", "f"] and text.tolist() == [0, 0, 0, 2, 3, 3]
    assert (np.diff(piece) != 0).tolist() == [False, True, True, True, False]


def test_trie_against_a_dictionary():
    rng = np.random.default_rng(0)
    trie, want, taken = phrase_counts.HatTrie(burst=20), Counter(), Counter()

    def take(keep):
        for table in trie.taken(keep):
            for *key, n in zip(*(table.column(c).to_pylist() for c in table.column_names)):
                taken[tuple(key)] += n

    for k in range(300):
        keys = [tuple(rng.integers(40, size=s).tolist() + [-1] * (4 - s)) for s in rng.integers(1, 5, size=30)]
        trie.add(pa.table([pa.array([key[c] for key in keys], pa.int32()) for c in range(4)] + [pa.array([2] * len(keys))], ["w0", "w1", "w2", "w3", "count"]))
        want.update({key: 2 * n for key, n in Counter(keys).items()})
        if k % 50 == 49:
            take(500)
            assert trie.entries <= 500
    take(0)
    assert taken == want and trie.entries == 0
