r"""PII by offset-preserving deobfuscation.

Base detectors look at the text itself: e-mail, IPv4 address, payment card (12 to 19
digits that pass Luhn), phone number.  Then transducers rewrite the text step by step, each
keeping for every character it emits the source interval that it stands for:

* homoglyphs: full-width forms, Cyrillic and Greek look-alikes, zero-width characters,
* at and dot disguises: ``[at]``, ``(dot)``, and bare ``at`` and ``dot`` before a common ending,
* spelled digits: runs of ``five five five`` (also "oh" for 0, "double"/"triple").

The detectors run on the rewritten text; what they find is mapped back to source offsets
and added unless it overlaps a base span of the same kind.  Base spans always stay.

Offsets are code points, end exclusive.  Detection scans whole texts, one document at a
time, and shuffles nothing.

Defined results: a null text is empty and has no spans; rows are independent, so repeated
rows agree; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A start inside a run of digits fails where the run's first digit does, so only that is tried.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain: found from each @, as only it can carry one."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", m.end() if m else at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base detectors."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum("0" <= ch <= "9" for ch in m[0]) <= 15]
    return out


# ---------------------------------------------------------------- transducers

#: Cyrillic and Greek letters and the ASCII letters that they look like.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "α": "a",
}
#: Full-width forms; digits of other scripts; hyphens, dots and spaces; invisible characters.
LOOKALIKES |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
LOOKALIKES |= {chr(base + k): str(k) for base in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for k in range(10)}
LOOKALIKES |= {"\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2024": ".", "\u3002": ".", "\u00a0": " ", "\u2009": " ", "\u3000": " "}
LOOKALIKES |= dict.fromkeys("\u00ad\u200b\u200c\u200d\u2060\ufeff", "")
HOMOGLYPH = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + "]")
#: Last labels that make "x at y dot z" an address without brackets; prose has such words too.
ENDINGS = "com|org|net|edu|gov|mil|info|biz|io|co|eu|uk|de|fr|es"
_BRACKETED = r"(?<![ \t])[ \t]*[\[({{<][ \t]*(?:{}|{})[ \t]*[\])}}>][ \t]*"
_DOT = rf"(?:{_BRACKETED.format('dot', chr(92) + '.')}|(?<=[A-Za-z0-9])[ \t]+dot[ \t]+(?=[A-Za-z0-9]))"
AT = re.compile(rf"{_BRACKETED.format('at', '@')}|(?<=[A-Za-z0-9_%+-])[ \t]+at[ \t]+(?=[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}(?:{ENDINGS})(?![A-Za-z0-9-]))", re.I)
DOT = re.compile(_DOT, re.I)
#: Digit words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_ONE = r"(?:(?:double|triple)[ \t-]+)?(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
SPELLED = re.compile(rf"(?<![A-Za-z])(?:plus[ \t-]+)?{_ONE}(?:[ \t,.-]+{_ONE}){{3,}}(?![A-Za-z])", re.I)
SPELLED_WORD = re.compile(r"plus|double|triple|" + "|".join(DIGIT_WORDS), re.I)


class Mapped:
    """A text and, for each of its characters, the interval of the source that it stands for."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text, self.start, self.end = text, start, end

    def replace(self, pieces: list[tuple[int, int, str]]) -> Mapped:
        """With each [start, end) replaced; a replacement's characters stand for the whole interval."""
        start = list(range(len(self.text))) if self.start is None else self.start
        end = list(range(1, len(self.text) + 1)) if self.end is None else self.end
        out, s, e, last = [], [], [], 0
        for i, j, new in pieces:
            out += [self.text[last:i], new]
            s += start[last:i] + [start[i]] * len(new)
            e += end[last:i] + [end[j - 1]] * len(new)
            last = j
        return Mapped("".join([*out, self.text[last:]]), s + start[last:], e + end[last:])

    def back(self, i: int, j: int) -> tuple[int, int]:
        return (i, j) if self.start is None else (min(self.start[i:j]), max(self.end[i:j]))


def homoglyphs(m: Mapped) -> Mapped:
    found = [] if m.text.isascii() else [(x.start(), x.end(), LOOKALIKES[x[0]]) for x in HOMOGLYPH.finditer(m.text)]
    return m.replace(found) if found else m


def at_and_dot(m: Mapped) -> Mapped:
    low = m.text.lower()
    if "dot" not in low and "[" not in low and "(" not in low and "{" not in low and "<" not in low:
        return m
    for pattern, new, sign in ((AT, "@", "at"), (DOT, ".", "dot")):
        if sign in low or new in low:
            found = [(x.start(), x.end(), new) for x in pattern.finditer(m.text)]
            m = m.replace(found) if found else m
    return m


def spelled_digits(m: Mapped) -> Mapped:
    found = []
    for x in SPELLED.finditer(m.text):
        times = 1
        words = list(SPELLED_WORD.finditer(m.text, x.start(), x.end()))
        last = x.start()
        for w in words:
            word = w[0].lower()
            if word in ("double", "triple"):
                times = 2 if word == "double" else 3
                continue
            found.append((last, w.end(), "+" if word == "plus" else DIGIT_WORDS[word] * times))
            last, times = w.end(), 1
    return m.replace(found) if found else m


def find(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans: the base ones, and those that only the rewritten text shows."""
    base = detect(text)
    out = [(k, s, e, True) for k, s, e in base]
    m = spelled_digits(at_and_dot(homoglyphs(Mapped(text))))
    if m.start is not None:
        taken: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
        for k, s, e in sorted(base, key=lambda x: x[1]):
            taken[k].append((s, e))
        for k, i, j in detect(m.text):
            s, e = m.back(i, j)
            # spans of one kind don't overlap, so only the last that starts before the end can
            at = bisect.bisect_left(taken[k], (e,))
            if not (at and taken[k][at - 1][1] > s):
                taken[k].insert(at, (s, e))
                out.append((k, s, e, False))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of every document, by start and then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in find(t or "")] for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, pa.list_(SPAN))], names=["doc_id", "spans"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redact(text: str, mask: str = "[{}]") -> str:
    """``text`` with every span replaced by its kind; overlapping spans become one, named by the first."""
    out, last = [], 0
    for kind, s, e, _ in find(text):
        if s >= last:
            out += [text[last:s], mask.format(kind)]
        last = max(last, e)
    return "".join([*out, text[last:]])


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
