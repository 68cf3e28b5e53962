"""Operator 6: personal data, with disguises undone and every span mapped back to the source characters.

Four plain detectors run over the whole text. Where a text holds disguised characters (look-alike letters,
other scripts' digits, styled or invisible characters), spelled digits or at/dot words, transducers rewrite it to a plain text and
record which source characters each piece of output stands for; the detectors run again over that, and what they find
is mapped back. A span found that way is added if it holds something rewritten and lies inside no plain span.
Detectors take time in proportion to the text, whatever runs of characters it has.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclink.llm.common import slices, tidied

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) << (k & 1)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield Span("email", start, m.end())
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            yield Span("ip", m.start(), m.end())


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield Span("card", m.start(), m.end())


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                yield Span("phone", m.start(), m.end())


def detect(text: str) -> list[Span]:
    """Plain spans, leftmost and non-overlapping by kind, by start and kind."""
    found = list(emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += [*ips(text), *cards(text), *phones(text)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


# Look-alikes of Latin letters and signs in other scripts.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
INVISIBLE = "­​‌‍⁠﻿"
# Digits spelled out.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
PLUS = ("plus", "más")

_NUMBER = "|".join(sorted({*SPELLED}, key=len, reverse=True))
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?:{'|'.join(PLUS)})[ -]+)?(?:(?:{_NUMBER}|[0-9]+)(?:, |[ .-])){{5,}}(?:{_NUMBER}|[0-9]+)(?!\w)", re.IGNORECASE)
_SPELLED_TOKEN = re.compile(rf"({'|'.join(PLUS)})[ -]+|({_NUMBER})(?:(?:, |[ .-])(?=\w))?|([0-9]+)(?:, |[ .-])(?={_NUMBER})", re.IGNORECASE)
# Words and signs for the at sign and the dot.
# A run of blanks is entered at its first one only, so it is read once, however long it is.
_BLANKS = r"(?<![ \t])[ \t]"
_AT = rf"{_BLANKS}*+[(\[{{<][ \t]*+(?:at|arroba|@)[ \t]*+[)\]}}>][ \t]*+"
_DOT = rf"{_BLANKS}*+[(\[{{<][ \t]*+(?:dot|punkt|point|punto|\.)[ \t]*+[)\]}}>][ \t]*+"
_AT_WORD, _DOT_WORD = rf"{_BLANKS}++(?:at|arroba)[ \t]++", rf"{_BLANKS}++(?:dot|punkt|point|punto)[ \t]++"
_LABEL = r"[A-Za-z0-9-]+"
#: An address in disguise: an at sign or its stand-in, and dots or theirs, with a disguise in at least one place.
_AT_CLUE = re.compile(rf"({_AT})|({_AT_WORD})|@", re.IGNORECASE)
_HOST = re.compile(rf"{_LABEL}(?:(?:{_DOT}|{_DOT_WORD}|\.){_LABEL})+", re.IGNORECASE)
_ANY_DOT = re.compile(rf"{_DOT}|{_DOT_WORD}", re.IGNORECASE)
#: The end of a name whose dots are disguised, and how far back it is looked for.
_NAME = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:(?:{_DOT}|{_DOT_WORD})[A-Za-z0-9._%+-]+)+\Z", re.IGNORECASE)
_NAME_BRACKETS = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:{_DOT}[A-Za-z0-9._%+-]+)+\Z", re.IGNORECASE)
_NAME_CHARS = 160
#: Groups of up to three digits, spelled or not, with dots or their stand-ins between; an address has four.
_OCTET = rf"(?:[0-9]{{1,3}}|(?:{_NUMBER}|[0-9])(?:[ -]?(?:{_NUMBER}|[0-9])){{0,2}})"
_IP_DOT = rf"(?:{_DOT}|{_DOT_WORD}|\.)"
_DISGUISED_IP = re.compile(rf"(?<![\w.]){_OCTET}(?:{_IP_DOT}{_OCTET}){{3,}}(?!\w)", re.IGNORECASE)
_IP_PART = re.compile(rf"({_IP_DOT})|{_OCTET}", re.IGNORECASE)
_OCTET_DIGIT = re.compile(rf"({_NUMBER})|[0-9]", re.IGNORECASE)
# Starts with the dot, so that the search is fast; the words around it are looked at only there.
_TIGHT_DOT = re.compile(r"\.(?<=\w\.)(?=\w)")
_SPELLED_END, _SPELLED_START = re.compile(rf"(?:{_NUMBER})\Z", re.IGNORECASE), re.compile(_NUMBER, re.IGNORECASE)
_DOT_CLUE = re.compile(r"[(\[{<][ \t]*(?:at|arroba|@|dot|punkt|point|punto|\.)[ \t]*[)\]}>]|[ \t](?:dot|punkt|point|punto)[ \t]", re.IGNORECASE)


def _odd_digits() -> str:
    """Decimal digits of other scripts, as ranges of a character class."""
    starts = [c for c in range(0x80, 0x20000) if unicodedata.digit(chr(c), -1) == 0 and unicodedata.category(chr(c)) == "Nd"]
    return "".join(f"{chr(c)}-{chr(c + 9)}" for c in starts)


_WIDE = "".join(f"{chr(c + 0xFEE0)}" for c in range(0x21, 0x7F))
#: Styled forms of single ASCII characters (mathematical, circled, small), by their compatibility form.
_STYLED = {
    c: plain for c in map(chr, range(0x80, 0x20000))
    if unicodedata.decomposition(c).startswith(("<font>", "<circle>", "<small>", "<wide>")) and len(plain := unicodedata.normalize("NFKC", c)) == 1 and "!" <= plain <= "~" and c not in LOOKALIKES
}
_COMMON = f"{''.join(map(re.escape, LOOKALIKES))}{INVISIBLE}{re.escape(_WIDE)}{_odd_digits()}"
_ODD, _ODD_OR_STYLED = re.compile(f"[{_COMMON}]"), re.compile(f"[{_COMMON}{re.escape(''.join(_STYLED))}]")
# The long class is slow, so it is used only where a text has characters of the same blocks of 256.
_STYLED_BLOCKS = re.compile(f"[{''.join(f'{chr(k << 8)}-{chr((k << 8) + 255)}' for k in sorted({ord(c) >> 8 for c in _STYLED}))}]")


def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in _STYLED:
        return _STYLED[c]
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    return chr(ord(c) - 0xFEE0)


class Rewritten:
    """A text with places replaced, and the source place of every character of the result."""

    def __init__(self, text: str):
        self.text, self.out, self.source, self.changed = text, [0], [0], []

    @classmethod
    def of(cls, text: str, edits: list[tuple[int, int, str]]) -> Rewritten:
        """``edits``: (start, end, replacement), by start and without overlap."""
        new, parts, at, n = cls(text), [], 0, 0
        new.out, new.source, new.changed = [], [], []
        for start, end, put in edits:
            for a, b, s, edited in ((at, start, text[at:start], False), (start, end, put, True)):
                if b > a:
                    new.out.append(n)
                    new.source.append((a, b))
                    new.changed.append(edited)
                    parts.append(s)
                    n += len(s)
            at = end
        new.out.append(n)
        new.source.append((at, len(text)))
        new.changed.append(False)
        new.text = "".join([*parts, text[at:]])
        return new

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of [start, end), and whether it holds an edit."""
        i, j = bisect_right(self.out, start) - 1, bisect_right(self.out, end - 1) - 1
        a = self.source[i][0] + (0 if self.changed[i] else start - self.out[i])
        b = self.source[j][1] if self.changed[j] else self.source[j][0] + end - self.out[j]
        return a, b, any(self.changed[i : j + 1])


def rewrite_characters(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), _plain(m[0])) for m in (_ODD_OR_STYLED if _STYLED_BLOCKS.search(text) else _ODD).finditer(text)]


def rewrite_digits(text: str) -> list[tuple[int, int, str]]:
    """Runs of six or more spelled digits become digits, without what stands between them."""
    out = []
    for run in _SPELLED_RUN.finditer(text):
        for m in _SPELLED_TOKEN.finditer(text, run.start(), run.end()):
            if m[1]:
                out.append((m.start(), m.end(), "+"))
            elif m[2]:
                out.append((m.start(), m.end(), SPELLED[m[2].lower()]))
            else:
                out.append((m.start(), m.end(), m[3]))
    return out


def rewrite_ips(text: str) -> list[tuple[int, int, str]]:
    """Addresses of four numbers up to 255 whose dots are disguised or whose digits are spelled out."""
    spelled = lambda at: _SPELLED_START.match(text, at + 1) or _SPELLED_END.search(text[max(0, at - 6) : at])
    if not _DOT_CLUE.search(text) and not any(spelled(m.start()) for m in _TIGHT_DOT.finditer(text)):
        return []
    out = []
    for m in _DISGUISED_IP.finditer(text):
        parts = list(_IP_PART.finditer(text, m.start(), m.end()))
        plain = ["." if p[1] else "".join(SPELLED[d[1].lower()] if d[1] else d[0] for d in _OCTET_DIGIT.finditer(p[0])) for p in parts]
        if len(parts) == 7 and all(int(g) <= 255 for g in plain[::2]):
            out += [(p.start(), p.end(), put) for p, put in zip(parts, plain) if p[0] != put]
    return out


def rewrite_signs(text: str) -> list[tuple[int, int, str]]:
    """At and dot disguises that stand between a name and a host name.

    A bare word ``at`` counts only before a host name whose dots are disguised as well, so prose stays as it is.
    """
    if not _DOT_CLUE.search(text):
        return []
    out: list[tuple[int, int, str]] = []
    for m in _AT_CLUE.finditer(text):
        if not m.start() or text[m.start() - 1] not in _LOCAL or out and m.start() < out[-1][1]:
            continue
        if host := _HOST.match(text, m.end()):
            dots = [(d.start(), d.end(), ".") for d in _ANY_DOT.finditer(text, host.start(), host.end())]
            # Bare dot words in the name count only beside another disguise.
            low = max(out[-1][1] if out else 0, m.start() - _NAME_CHARS)
            name = (_NAME if m[1] or dots else _NAME_BRACKETS).search(text[low : m.start()])
            named = [(low + d.start(), low + d.end(), ".") for d in _ANY_DOT.finditer(text[low : m.start()], name.start())] if name else []
            if m[1] or dots or named:
                out += named + [(m.start(), m.end(), "@")] * (m[0] != "@") + dots
    return out


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, added spans)."""
    base = detect(text)
    added: list[Span] = []
    layers: list[Rewritten] = []
    plain = text
    for rewrite in (rewrite_characters, rewrite_ips, rewrite_digits, rewrite_signs):
        if edits := rewrite(plain):
            layers.append(Rewritten.of(plain, edits))
            plain = layers[-1].text
    if layers:
        taken = [sorted((s.start, s.end) for s in base if s.kind == kind) for kind in KINDS]
        for kind, start, end in detect(plain):
            edited = False
            for layer in reversed(layers):
                start, end, here = layer.back(start, end)
                edited |= here
            if edited and not any((i := bisect_right(t, (start, len(text)))) and t[i - 1][1] >= end for t in taken):
                added.append(Span(kind, start, end))
    return base, added


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end)))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span as a tag; overlapping spans become one tag of the first one's kind."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind))):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False, others: list[str] | None = None) -> DataFrame:
    """``id_column, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` and, with ``keep_text``, ``redacted``.

    Columns named in ``others`` come along. The counts are of plain spans, ``n_added`` of the others; ``spans`` lists all of them. A null text is empty and has no spans; a null
    id stays null; repeated rows give repeated rows; other columns of any name are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text in b.column(1).to_pylist():
                base, added = find(text or "")
                row = [sum(s.kind == k for s in base) for k in KINDS]
                row += [hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added), len(added)]
                rows.append(row + [redact(text or "", base + added)] * keep_text)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()] + [pa.string()] * keep_text
            columns = [b.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"] + ["redacted"] * keep_text + list(others or []))

    kinds = dict(docs.dtypes)
    extra = ", redacted string" * keep_text + "".join(f", `{c}` {kinds[c]}" for c in others or [])
    plain = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), *(others or []))
    return plain.mapInArrow(tidied(run), f"doc_id {kinds[id_column]}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long{extra}").withColumnRenamed("doc_id", id_column)
