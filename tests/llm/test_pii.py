import random
import re

import pytest

from cardsieve.llm import pii


def plain(text):
    out = {k: [] for k in pii.KINDS}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return out


def test_base_patterns_equal_regular_expressions():
    r = random.Random(1)
    for _ in range(20_000):
        text = "".join(r.choice(["1", "25", ".", "@", "a", "b-", "+", " ", "-", "4539578763621486", "(", ")", "x.y", "300", "007", "é", "\n"]) for _ in range(r.randint(0, 25)))
        assert pii.detect(text) == plain(text), text


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("mail john dot doe at example dot com now", "email", "john dot doe at example dot com"),
        ("j.doe (at) mail.example.com x", "email", "j.doe (at) mail.example.com"),
        ("or b[at]c[dot]org.", "email", "b[at]c[dot]org"),
        ("to аnna@exаmple.com.", "email", "аnna@exаmple.com"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("+1 five five five 1 2 3 4 five six seven", "phone", "+1 five five five 1 2 3 4 five six seven"),
        ("ip one nine two dot one six eight dot one dot one end", "ip", "one nine two dot one six eight dot one dot one"),
        ("１９２.１６８.０.１", "ip", "１９２.１６８.０.１"),
        ("4539 5787 6362 one four eight six", "card", "4539 5787 6362 one four eight six"),
    ],
)
def test_disguises(text, kind, found):
    base, every = pii.text_spans(text)
    assert [text[a:b] for a, b in every[kind]] == [found] and base[kind] == []


@pytest.mark.parametrize("text", ["the cat sat at the door. then it ran", "look at this. two of them, one at a time", "meet me at noon", "one two three", "version 1.2.3 of 2024", ""])
def test_clean_texts_stay_clean(text):
    assert not any(pii.text_spans(text)[1].values()) and pii.redact_text(text, pii.text_spans(text)[1]) == text


def test_base_spans_stay(docs):
    for r in pii.find(docs).collect():
        assert set(filter(None, r.base.split(","))) <= set(filter(None, r.spans.split(",")))


def test_columns_and_table(docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.find(docs).collect():
        want = plain(texts[r.doc_id])
        assert r.base == ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in want[k])


def test_odd_rows(odd):
    out = pii.find(odd).collect()
    assert len(out) == odd.count() and all(r.spans == "" for r in out if r.doc_id in (2, 3, 4, 8, 9))
    red = pii.redact(odd)
    assert red.columns == odd.columns and sorted(red.collect(), key=str) == sorted(odd.collect(), key=str)
    assert pii.find(odd.filter("false")).count() == 0 and pii.redact(odd.filter("false")).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a b@c.de, +1 555 123 4567.", 26)], "doc_id long, text string, n_chars long")
    r = pii.redact(df).first()
    assert r.text == "a [EMAIL], [PHONE]." and r.n_chars == len(r.text)


def test_long_texts_take_time_in_proportion():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "one " * 50_000, "a at " * 40_000, "a.b@" * 60_000, "+1" * 80_000, "dot " * 50_000):
        pii.text_spans(text)


@pytest.mark.parametrize("text,kind,count", [
    ("look at this dot thing now", "email", 0), ("we met at noon. then", "email", 0), ("look at example.com", "email", 0),
    ("mail bob@example[.]com now", "email", 1), ("mail bob[@]example.com now", "email", 1), ("mail alice.b at example.com now", "email", 1),
    ("mail alice\u00a0dot\u00a0x\u00a0at\u00a0example\u00a0dot\u00a0com", "email", 1), ("host 192 dot 168 dot 1 dot 1 is up", "ip", 1),
    ("host 192[.]168[.]1[.]1 is up", "ip", 1), ("take 1 dot 2 dot 3", "ip", 0), ("host 192 dot 168 dot 1 dot 999", "ip", 0),
])
def test_disguises_and_plain_words(text, kind, count):
    """By the whole column's path, cheap searches first, as well as text by text."""
    import pyarrow as pa

    (found,) = pii._batch(pa.array([text]))
    assert len(found[1][kind] if found else []) == count and len(pii.text_spans(text)[1][kind]) == count
    assert pii.text_spans(text)[0] == pii.detect(text)

