"""Personal data in texts, disguised forms included, with spans in the source.

Base patterns run on the text as it is. Then transducers rewrite disguises, each
keeping for every character it emits the source characters it came from:

1. fold: compatibility forms and look-alike letters to ASCII, invisible characters dropped;
2. spell: runs of spelled digits (with spelled dot, plus, dash) to digits, first the
   runs of three digits or more, then all, also those with one spelled sign only;
3. join: ``[at]``, ``(dot)``, `` at ... dot ...`` to ``@`` and ``.``.

The base patterns run again on what comes out, and the spans found are mapped back.
Spans that overlap a base span are not added, so base ones stay as they are.

Every pattern is linear in the text's length. Offsets are code points, ends exclusive.

Defined cases: null and empty texts have no spans; a disguise inside a longer word
is no disguise; repeated rows are searched each; other columns pass through unless
they have an output column's name, in which case they are dropped.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT, NOT_DIGIT = re.compile("[0-9]"), re.compile("[^0-9]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches: each ``@``'s local part starts where its run does, or the last match ended."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and not NOT_LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[Span]:
    """By kind as listed in KINDS, then start."""
    out = emails(text) if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# Letters of other scripts that look like ASCII ones, and invisible characters.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ε": "e",
    "ı": "i", "ɡ": "g", "ⅼ": "l", "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-",
}
INVISIBLE = "­​‌‍⁠﻿"
# Spelled digits in the four languages of the documents.
DIGIT_WORDS = {
    w: str(d)
    for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
    for d, w in enumerate(words.split())
}
SIGN_WORDS = {"dot": ".", "point": ".", "punkt": ".", "punto": ".", "plus": "+", "dash": "-", "hyphen": "-"}
FOLDED = re.compile("[^\x00-±´-¸»-ɏ]|[­·ı]")
_word = "|".join(sorted(map(re.escape, {**DIGIT_WORDS, **SIGN_WORDS}), key=len, reverse=True))
_digit = "|".join(sorted(map(re.escape, DIGIT_WORDS), key=len, reverse=True))
SPELLED = re.compile(rf"(?<!\w)(?:{_word}|\+?[0-9]+)(?:[ \t\n,-]{{1,2}}(?:{_word}|\+?[0-9]+))+(?!\w)", re.I)
ITEM = re.compile(rf"{_word}|\+?[0-9]+|[ \t\n,-]+", re.I)
BRACKETED = re.compile(r"\s{0,3}(?:\[\s{0,3}(at|dot|@|\.)\s{0,3}\]|\(\s{0,3}(at|dot|@|\.)\s{0,3}\)|\{\s{0,3}(at|dot|@|\.)\s{0,3}\}|<\s{0,3}(at|dot|@|\.)\s{0,3}>)\s{0,3}", re.I)
BARE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:(?: dot |\.)[A-Za-z0-9_%+-]++){0,8}?(?P<at> at |@)[A-Za-z0-9-]++(?:(?: dot |\.)[A-Za-z0-9-]++){0,8} dot [A-Za-z]{2,24}(?![A-Za-z0-9])", re.I)
BARE_SIGN = re.compile(r" (at|dot) ", re.I)


class Mapped:
    """Text under rewriting, with the source start and end of every character."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces the (start, end) stretches, in order and apart; what an edit emits maps to its whole stretch."""
        text, starts, ends, last = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[last:a], new]
            starts += self.starts[last:a] + [self.starts[a]] * len(new)
            ends += self.ends[last:a] + [self.ends[b - 1]] * len(new)
            last = b
        self.text = "".join([*text, self.text[last:]])
        self.starts, self.ends = starts + self.starts[last:], ends + self.ends[last:]


def fold(m: Mapped) -> None:
    edits = []
    for x in FOLDED.finditer(m.text):
        c = x[0]
        new = "" if c in INVISIBLE else LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c)
        if new != c and new.isascii():
            edits.append((x.start(), x.end(), new))
    m.rewrite(edits)


def spell(m: Mapped, least: int) -> None:
    """Rewrites the runs of at least so many spelled items."""
    edits = []
    for run in SPELLED.finditer(m.text):
        items = [(x.start(), x.end(), x[0]) for x in ITEM.finditer(m.text, run.start(), run.end())]
        words = [x for x in items if x[2].lower() in DIGIT_WORDS or least < 3 and x[2].lower() in SIGN_WORDS]
        if len(words) < least:
            continue
        for k, (a, b, t) in enumerate(items):
            new = DIGIT_WORDS.get(t.lower()) or SIGN_WORDS.get(t.lower()) or ("" if not t.strip(" \t\n,-") else t)
            if not new and 0 < k < len(items) - 1 and items[k - 1][2][-1].isdigit() and items[k + 1][2][-1].isdigit():
                continue  # between figures the separator is the text's own
            if new != t:
                edits.append((a, b, new))
    m.rewrite(edits)


def join(m: Mapped) -> None:
    sign = {"at": "@", "dot": ".", "@": "@", ".": "."}
    m.rewrite([(x.start(), x.end(), sign[next(filter(None, x.groups())).lower()]) for x in BRACKETED.finditer(m.text)])
    edits = [(x.start(), x.end(), sign[x[1].lower()]) for run in BARE.finditer(m.text) for x in BARE_SIGN.finditer(m.text, run.start(), run.end())]
    m.rewrite(edits)


def disguised(text: str) -> bool:
    """Whether any transducer could change the text; cheap, and never wrongly false."""
    if not text.isascii() and FOLDED.search(text):
        return True
    if any(c in text for c in "[({<") and BRACKETED.search(text):
        return True
    low = text.lower()
    words = low.replace("-", " ").replace(",", " ").split()
    return " dot " in low or not (DIGIT_WORDS.keys().isdisjoint(words) and SIGN_WORDS.keys().isdisjoint(words)) and bool(SPELLED.search(text))


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the transducers add."""
    base = base_spans(text)
    if not disguised(text):
        return base, []
    added: list[Span] = []
    before = text
    # Long runs first: a lone word beside an identifier ("10[dot]0[dot]0[dot]99 five days") mustn't hide it.
    for least in (3, 1):
        m = Mapped(text)
        fold(m)
        spell(m, least)
        join(m)
        if m.text == before:
            continue
        before = m.text
        taken = sorted((a, b) for _, a, b in base + added)
        for kind, a, b in base_spans(m.text):
            a, b = m.starts[a], m.ends[b - 1]
            k = bisect_left(taken, (b, 0))
            if not (k and taken[k - 1][1] > a):
                added.append((kind, a, b))
    return base, added


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``base_spans`` and ``spans``: ``kind:start:end``, comma-joined."""
    small_batches(docs.sparkSession)

    @pandas_udf("struct<base:string,spans:string>")
    def find(texts: pd.Series) -> pd.DataFrame:
        found = [all_spans(t or "") for t in texts]
        return pd.DataFrame({"base": [joined(b) for b, _ in found], "spans": [joined(b + a) for b, a in found]})

    found = docs.select(*[c for c in docs.columns if c not in ("base_spans", "spans")], find(F.col(text_col)).alias("__found"))
    return found.withColumns({"base_spans": F.col("__found.base"), "spans": F.col("__found.spans")}).drop("__found")


def redact_text(text: str, spans: str) -> str:
    """Each span replaced by its kind, in brackets; of overlapping spans the first counts."""
    out, last = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with their spans replaced; null texts stay null."""
    small_batches(docs.sparkSession)

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else redact_text(t, joined([s for x in all_spans(t) for s in x])) for t in texts], dtype=object)

    return docs.withColumn(text_col, run(F.col(text_col)))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(F.split(spans, ","), lambda s: s.startswith(f"{kind}:"))).cast("long")
