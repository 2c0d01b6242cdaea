import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cardsieve.llm import license_scan, queries


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=30), st.lists(st.sampled_from("abcdefgh"), max_size=20))
def test_alignment_is_a_common_subsequence(text, template):
    found = license_scan.align(text, template)
    assert all(text[a] == template[b] for a, b in found)
    assert all(x < u and y < v for (x, y), (u, v) in zip(found, found[1:]))


@settings(max_examples=100, deadline=None)
@given(st.permutations(list(range(12))))
def test_rising_is_longest(order):
    best = max((len(s) for s in _all_rising(list(order))), default=0)
    assert len(license_scan._rising(list(enumerate(order)))) == best


def _all_rising(v):
    ends: list[list[int]] = []
    for x in v:
        ends.append(max((e for e in ends if e[-1] < x), key=len, default=[]) + [x])
    return ends


def test_unique_words_are_all_aligned():
    words = [f"w{k}" for k in range(200)]
    r = random.Random(3)
    text = [w for k, w in enumerate(words) for w in ([w] if k % 9 else ["z", w, "y"])]
    assert len(license_scan.align(text, words)) == 200
    dropped = [w for w in text if r.random() > 0.1]
    assert len(license_scan.align(dropped, words)) == len([w for w in dropped if w in set(words)])


def test_scan(spark):
    mit = license_scan.TEMPLATES["MIT-text"]
    rows = [(1, "foo bar. Released under the MIT License. more"), (2, "head " * 300 + mit.lower().replace("software", "program", 2) + " tail" * 300), (3, "released into the wild under a tree, license none"), (4, None), (5, " ".join(mit.split()[:60]))]
    out = {r.doc_id: {m.license: m for m in r.matches} for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(out[1]) == {"MIT"} and (out[1]["MIT"].start, out[1]["MIT"].end) == (2, 7)
    assert set(out[2]) == {"MIT-text"} and out[2]["MIT-text"].coverage > 0.95
    assert out[3] == out[4] == out[5] == {}


def test_copies_side_by_side_are_found(spark):
    """Each copy stands after a copyright line; within twice its length every word of it occurs more than once."""
    rows, want = [], {}
    for k, name in enumerate(("MIT-text", "ISC-text", "Apache-2.0-header")):
        text = license_scan.TEMPLATES[name]
        changed = text.split()
        changed[5::20] = ["changed"] * len(changed[5::20])
        for n, (copy, times) in enumerate(((text, 1), (text, 2), (text, 5), (" ".join(changed), 1), (" ".join(changed), 3))):
            rows.append((10 * k + n, "Notices. " + "".join(f"Copyright (c) 20{j:02} Holder {j} {copy} IN NO EVENT shall anyone be liable. " for j in range(times))))
            want[10 * k + n] = name
    out = {r.doc_id: {m.license: m for m in r.matches} for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in want.items():
        assert name in out[i], (i, name)
        assert (out[i][name].coverage == 1.0) if i % 10 < 3 else (out[i][name].coverage == out[i // 10 * 10 + 3][name].coverage > 0.85)
        assert i % 10 >= 3 or out[i][name].start == out[i // 10 * 10][name].start


def test_odd_rows(odd):
    out = license_scan.scan(odd).collect()
    assert len(out) == odd.count() and all(r.matches == [] for r in out)
    assert license_scan.scan(odd.filter("false")).count() == 0
    assert license_scan.scan(odd, {"none": ""}).filter("size(matches) > 0").count() == 0


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_align(text, template):
    """How many template words a patience alignment by the book matches: equal ends, then unique anchors, then the gaps.

    Of several longest chains of anchors the one is taken whose words, from the last to the first, stand latest in the text, as in
    patience sorting."""
    n = 0
    while text and template and text[0] == template[0]:
        n, text, template = n + 1, text[1:], template[1:]
    while text and template and text[-1] == template[-1]:
        n, text, template = n + 1, text[:-1], template[:-1]
    own, other = Counter(text), Counter(template)
    pairs = [(k, template.index(w)) for k, w in enumerate(text) if own[w] == 1 and other[w] == 1]
    chains: list[list] = []
    for a, b in pairs:
        chains.append(max((c for c in chains if c[-1][1] < b), key=lambda c: (len(c), c[-1][0]), default=[]) + [(a, b)])
    anchors = max(chains, key=lambda c: (len(c), c[-1][0]), default=[])
    if not anchors:
        return n
    edges = [(-1, -1), *anchors, (len(text), len(template))]
    return n + len(anchors) + sum(plain_align(text[a + 1 : c], template[b + 1 : d]) for (a, b), (c, d) in zip(edges, edges[1:]))


def every_window(text, template, least):
    """The best coverage of all windows from the least share to twice the template's length; 0 where none reaches ``least``. Windows that don't hold
    enough of the template's words, in whatever order, can't."""
    size, best, need = len(template), 0, Counter(template)
    held, end, common = Counter(), 0, 0
    for start in range(len(text)):
        while end < min(len(text), start + 2 * size):
            common += held[text[end]] < need[text[end]]
            held[text[end]] += 1
            end += 1
        if common >= least * size and best < size:
            found = {plain_align(text[start : start + n], template) for n in range(math.ceil(least * size - 1e-9), 2 * size + 1)}
            best = max(best, *found)
        held[text[start]] -= 1
        common -= held[text[start]] < need[text[start]]
    return best / size if best >= least * size else 0.0


@pytest.mark.parametrize("seed", range(4))
def test_every_window(spark, seed):
    """Short templates in noise, whole and with words changed, left out, put in or moved."""
    r = random.Random(seed)
    noise = [f"n{k}" for k in range(30)] + ["the", "of", "and"]
    templates = {f"t{k}": [r.choice([f"w{k}x{j}" for j in range(9)] + ["the", "of", "and"]) for _ in range(r.randint(6, 16))] for k in range(4)}
    rows = []
    for i in range(40):
        text = [r.choice(noise) for _ in range(r.randint(0, 25))]
        for name in r.sample(sorted(templates), r.randint(0, 3)):
            copy = list(templates[name])
            for _ in range(r.randint(0, 3)):
                at, kind = r.randrange(len(copy)), r.randrange(3)
                copy[at : at + (kind > 0)] = [r.choice(noise)] if kind < 2 else []
            text += copy + [r.choice(noise) for _ in range(r.randint(0, 12))]
        rows.append((i, " ".join(text)))
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), {n: " ".join(t) for n, t in templates.items()}).collect()
    got = {(m.doc_id, x.license): x.coverage for m in found for x in m.matches}
    want = {(i, n): c for i, text in rows for n, t in templates.items() if (c := every_window(text.split(), t, 0.8))}
    assert len(want) > 20 and got == pytest.approx(want)


def test_query_against_every_window(spark, sf, docs):
    templates = {n: plain_words(t) for n, t in license_scan.TEMPLATES.items()}
    got = {r.doc_id: (r.n_licenses, r.licenses, r.best_coverage) for r in queries.op6_license_alignment(spark, sf).collect()}
    rows, hits = docs.collect(), 0
    assert len(got) == len(rows)
    for row in rows:
        words = plain_words(row.text)
        want = {n: c for n, t in templates.items() if (c := every_window(words, t, 0.8))}
        hits += bool(want)
        n, names, best = got[row.doc_id]
        assert (n, names) == (len(want), ",".join(sorted(want))), row.doc_id
        assert best == pytest.approx(max(want.values())) if want else best is None
    assert hits > 0


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_each_template_is_found_in_comments(name):
    """With comment marks, line breaks and a word changed here and there."""
    words = license_scan.TEMPLATES[name].split()
    words[9::25] = ["other"] * len(words[9::25])
    text = "# Copyright 2020 a holder\n" + "\n".join("# " + " ".join(words[k : k + 9]) for k in range(0, len(words), 9)) + "\nimport os"
    known = license_scan._Templates(license_scan.TEMPLATES)
    number = {w: k for k, w in enumerate(known.vocabulary)}
    codes = license_scan.np.array([number.get(w, -1) for w in plain_words(text)])
    assert name in [m[0] for m in license_scan._scan(codes, known, 0.8)]
