"""Personal data in texts: base patterns, and disguised identifiers found by offset-preserving normalisation.

Three transducers rewrite a text and keep, for each character of the result, the source characters it stands for:
look-alike characters become ASCII and invisible ones go; spelled digits ("four two"), "plus" and "dot" between digits become
digits, "+" and "."; disguised "at" and "dot" become "@" and ".". Identifiers are detected in the result and mapped back to
spans of the source. Spans that touch a base span of their kind, or that hold nothing rewritten, are dropped: base spans stay.

Spans are in code points, end exclusive. Defined cases: null counts as empty and has no spans; a very long text is handled as
a whole, in time proportional to its length; repeated rows give repeated rows; extra columns are ignored by ``find``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices

KINDS = ("email", "ip", "card", "phone")

#: Letters of other scripts that look like ASCII letters. Digits, full-width and styled forms follow from Unicode data.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "﹒": ".", "﹫": "@",
}
#: English digit words.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_ODD = re.compile("[­ıɑɡͰ-ԯ٠-٩۰-۹०-९​-‏‐-―․⁠⁰-₉−①-⑩Ⓐ-ⓩ。﹒﹫﻿！-～\U0001d400-\U0001d7ff]")
_ODD_RE2 = r"[\x{ad}\x{131}\x{251}\x{261}\x{370}-\x{52f}\x{660}-\x{669}\x{6f0}-\x{6f9}\x{966}-\x{96f}\x{200b}-\x{200f}\x{2010}-\x{2015}\x{2024}\x{2060}\x{2070}-\x{2089}\x{2212}\x{2460}-\x{2469}\x{24b6}-\x{24e9}\x{3002}\x{fe52}\x{fe6b}\x{feff}\x{ff01}-\x{ff5e}\x{1d400}-\x{1d7ff}]"
_WORDS = "|".join(DIGITS)
#: White space as the transducers' patterns know it, for the cheap searches.
_S = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPELLED_RE2 = rf"(?i)(?:^|[^a-z])(?:{_WORDS})[{_S},.-]{{1,3}}(?:(?:dot|point)[{_S},.-]{{1,3}})?(?:{_WORDS}|[0-9])(?:[^a-z]|$)"
_DISGUISE_RE2 = rf"(?i)[\[({{<][{_S}]{{0,3}}(?:at|dot|\.|@)[{_S}]{{0,3}}[\])}}>]|[{_S}_-](?:dot|point)[{_S}_-]|[a-z0-9%+-][0-9._%+-][a-z0-9._%+-]*[{_S}]at[{_S}][a-z0-9-]+\.[a-z]"
#: Endings that a spoken address must have; "look at this dot thing" is none.
ENDINGS = frozenset("ai app at au be biz br ca ch cn co com cz de dev dk edu es eu fi fr gov ie in info int io it jp kr me mil mx net nl no nz org pl pt ru se uk us za example invalid local test".split())

_AT = re.compile("@")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the longest run of local characters before it, then the domain."""
    done = 0
    for m in _AT.finditer(text):
        at = m.start()
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (d := _DOMAIN.match(text, at + 1)):
            yield start, d.end()
            done = d.end()


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind by the base patterns."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out["phone"].append(m.span())
    return out


class Mapped:
    """A rewritten text; source characters start[i]:end[i] stand behind its character i, new[i] where it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text), dtype=np.int64)
        self.end = self.start + 1
        self.new = np.zeros(len(text), bool)

    def replace(self, found: list[tuple[int, int, str]]) -> None:
        """Rewrite the ranges [a, b), in order and apart, as the given strings."""
        if not found:
            return
        text, start, end, new, at = [], [], [], [], 0
        for a, b, to in found:
            text += [self.text[at:a], to]
            start += [self.start[at:a], np.full(len(to), self.start[a])]
            end += [self.end[at:a], np.full(len(to), self.end[b - 1])]
            new += [self.new[at:a], np.ones(len(to), bool)]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end, self.new = (np.concatenate([*x, y[at:]]) for x, y in ((start, self.start), (end, self.end), (new, self.new)))


def _plain(c: str) -> str | None:
    """ASCII for a look-alike character, empty for an invisible one, None to leave it."""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if unicodedata.category(c) == "Cf":
        return ""
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    to = unicodedata.normalize("NFKC", c)
    return to if to != c and len(to) == 1 and to.isascii() and to.isprintable() and to != " " else None


_RUN = re.compile(rf"(?<![A-Za-z0-9])(?:plus[\s-]{{1,3}})?(?:{_WORDS}|[0-9]+)(?:[\s,.-]{{1,3}}(?:(?:dot|point)[\s,.-]{{1,3}})?(?:{_WORDS}|[0-9]+))+(?![A-Za-z])", re.I)
_UNIT = re.compile(rf"plus|dot|point|{_WORDS}|[0-9]+", re.I)
_BRACKET_AT = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:at|@)\s{0,3}[\])}>]\s{0,3}", re.I)
_BRACKET_DOT = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:dot|\.)\s{0,3}[\])}>]\s{0,3}", re.I)
_DOTTED = re.compile(r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:[\s,-]{1,3}(?:dot|point)[\s,-]{1,3}[0-9]{1,3}){3}(?![A-Za-z0-9])", re.I)
_DOTS = re.compile(r"[\s,-]{1,3}(?:dot|point)[\s,-]{1,3}", re.I)
_SPOKEN = re.compile(r"[\s_-](at|dot)[\s_-]|@", re.I)
_NAME_SIGN = re.compile(r"[A-Za-z0-9][0-9._%+-]|[0-9][A-Za-z]")
_LABEL, _HOST = re.compile(r"[A-Za-z0-9%+_.-]{1,64}"), re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}")


def _look_alikes(m: Mapped) -> None:
    m.replace([(x.start(), x.end(), to) for x in _ODD.finditer(m.text) if (to := _plain(x.group())) is not None])


def _spelled(m: Mapped) -> None:
    found = []
    for run in _RUN.finditer(m.text):
        units = list(_UNIT.finditer(m.text, run.start(), run.end()))
        if sum(u.group().lower() in DIGITS for u in units) < 2:
            continue
        for k, u in enumerate(units):
            word = u.group().lower()
            to = "+" if word == "plus" else "." if word in ("dot", "point") else DIGITS.get(word, word)
            stop = units[k + 1].start() if k + 1 < len(units) else u.end()
            if word not in DIGITS and word.isdigit() and (k + 1 == len(units) or "." in m.text[u.end() : stop]):
                continue  # plain digits stay as they are, and so does a point after them
            found.append((u.start(), stop, to))
    m.replace(found)


def _at_and_dot(m: Mapped) -> None:
    for pattern, to in ((_BRACKET_AT, "@"), (_BRACKET_DOT, ".")):
        found = [(x.start(), x.end(), to) for x in pattern.finditer(m.text) if 0 < x.start() and x.end() < len(m.text) and m.text[x.start() - 1] in _LOCAL and m.text[x.end()].isalnum()]
        m.replace(found)
    m.replace([(x.start(), x.end(), ".") for run in _DOTTED.finditer(m.text) for x in _DOTS.finditer(m.text, run.start(), run.end())])
    m.replace(_spoken(m.text))


def _spoken(text: str) -> list[tuple[int, int, str]]:
    """Rewrites of addresses with a spoken dot: at most four labels before the at and eight after it, the last a known ending.

    A spoken "at" without a spoken dot is a word, unless what stands before it holds a digit, dot or sign, as names in
    addresses do and words don't.
    """
    marks: list[tuple[int, int, str]] = [(x.start(), x.end(), (x.group(1) or "@").lower()) for x in _SPOKEN.finditer(text)]
    found: list[tuple[int, int, str]] = []
    done = 0
    for k, (start, end, kind) in enumerate(marks):
        if kind == "dot":
            continue
        left = k
        while left > 0 and k - left < 4 and marks[left - 1][2] == "dot" and _LABEL.fullmatch(text, marks[left - 1][1], marks[left][0]):
            left -= 1
        first = marks[left][0]
        while first > max(done, marks[left][0] - 64) and text[first - 1] in _LOCAL:
            first -= 1
        right = k
        while right + 1 < len(marks) and right - k < 8 and marks[right + 1][2] == "dot" and _HOST.fullmatch(text, marks[right][1], marks[right + 1][0]):
            right += 1
        last = _HOST.match(text, marks[right][1])
        if first == marks[left][0] or not last or (right == k and "." not in last.group()):
            continue
        if left == right and (kind == "@" or not _NAME_SIGN.search(text[first : marks[left][0]])):
            continue
        ending = last.group().rpartition(".")[2].lower()
        if ending not in ENDINGS and any(a[2] != "@" for a in marks[left : right + 1]):
            continue
        found += [(a, b, "@" if n == k else ".") for n, (a, b, _) in enumerate(marks[left : right + 1], left)]
        done = last.end()
    return found


def normalised(text: str) -> Mapped:
    m = Mapped(text)
    _look_alikes(m)
    _at_and_dot(m)
    _spelled(m)
    return m


def text_spans(text: str, disguised: bool = True) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and all spans, by kind. disguised=False skips the transducers."""
    base = detect(text)
    if not disguised:
        return base, base
    every, m = {}, normalised(text)
    more = detect(m.text)
    for kind in KINDS:
        own = list(base[kind])
        for a, b in more[kind]:
            start, end = int(m.start[a]), int(m.end[b - 1])
            if m.new[a:b].any() and all(end <= x or y <= start for x, y in own):
                own.append((start, end))
        every[kind] = sorted(own)
    return base, every


def _told(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def _batch(texts: pa.Array) -> Iterator[tuple[dict, dict] | None]:
    """Spans of each text; None where there are none. Cheap searches over the whole column come first."""
    texts = pc.fill_null(pc.cast(texts, pa.string()), "")
    has = lambda p: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False)
    odd = has(_ODD_RE2) | has(_SPELLED_RE2) | has(_DISGUISE_RE2)
    worth = odd | has(r"@|\+[0-9]|[0-9][\x20-]?[0-9]|[0-9]\.[0-9]")
    for k, (look, more) in enumerate(zip(worth, odd)):
        yield text_spans(texts[k].as_py(), bool(more)) if look else None


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base (text of the base spans), spans (text of all spans), n_email, n_ip, n_card, n_phone for every document; an id that is no number becomes null."""
    empty: dict[str, list] = {k: [] for k in KINDS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [x or (empty, empty) for x in _batch(batch.column("text"))]
            columns = [pa.array([_told(b) for b, _ in found], pa.string()), pa.array([_told(e) for _, e in found], pa.string()), *(pa.array([len(e[k]) for _, e in found], pa.int64()) for k in KINDS)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "base", "spans", *(f"n_{k}" for k in KINDS)])

    rows = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, base string, spans string, " + ", ".join(f"n_{k} bigint" for k in KINDS))


def redact_text(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """Replace every span by its kind in brackets; spans that overlap become one, named by the first."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their columns, personal data replaced; n_chars, if there, follows the new text. Null stays null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            own = batch.column(text)
            changed = {k: redact_text(own[k].as_py(), x[1]) for k, x in enumerate(_batch(own)) if x and any(x[1].values())}
            new = pa.array([changed.get(k, t) for k, t in enumerate(own.to_pylist())], pa.string()) if changed else own
            yield pa.RecordBatch.from_arrays([new if n == text else c for n, c in zip(names, batch.columns)], names)

    out = docs.withColumn(text, F.col(text).cast("string"))
    out = out.mapInArrow(run, out.schema)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
