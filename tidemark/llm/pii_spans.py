"""Operator 8: personal data, also where it is disguised, with spans in the original text.

Plain identifiers are found on the text as it is. Then a transducer rewrites homoglyphs, invisible characters, spelled
digits and at/dot disguises and keeps, for every character of its output, the source characters it came from. The same
detectors run on the rewritten text; a hit that used a rewritten place is mapped back to source characters. Plain spans
always stay; an added span that lies within a plain span of its kind adds nothing and is left out.

All spans are in code points, end exclusive. Texts are read whole; the work is one pass without a shuffle, and every
pattern is anchored so that long runs of one character class cost linear time.

Defined results. Null text: as empty, no spans. Null ids, repeated rows: one result row per row. Empty tables: an empty
result. Further columns of the documents are ignored by ``find`` and kept as they are by ``redact``.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import texts as T

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C",
    "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B",
    "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".",
}
# The digits in words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
               "seven": "7", "eight": "8", "nine": "9"}
# Endings of host names that let a bare " at " count as a disguise before a plain dot.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "ai", "dev", "app", "de", "fr", "es", "uk", "eu", "us")

_STRANGE = re.compile("[" + "".join(sorted(c for c in LOOKALIKES)) + " ­٠-٩۰-۹०-९"
                      " -‏⁠⁰-⁹₀-₉①-⑨﻿﹒﹫！-～\U0001d400-\U0001d7ff]")
_INVISIBLE = frozenset("­​‌‍‎‏⁠﻿")
_DIGIT = "(?:" + "|".join(DIGIT_WORDS) + ")"
_SPELLED = re.compile(rf"(?i)\b(?:plus[ -]+)?{_DIGIT}(?:[ ,-]+{_DIGIT}){{2,}}\b")
_WORD = re.compile(r"[A-Za-z]+")
_OPEN, _CLOSE = r"[ ]?[\[({<][ ]?", r"[ ]?[\])}>][ ]?"
_AT_SIGN = re.compile(rf"(?i){_OPEN}(?:at|@|arroba|chez){_CLOSE}|(?<=\w)[ ]@[ ]?(?=\w)|(?<=\w)@[ ](?=\w)|(?<=\w)_at_(?=\w)")
_DOT_SIGN = re.compile(rf"(?i){_OPEN}(?:dot|\.|punto|point|punkt){_CLOSE}|(?<=\w)[ ]dot[ ](?=\w)|(?<=\w)_dot_(?=\w)")
_AT_WORD = re.compile(r"(?i)(?<=[a-z0-9])[ ]at[ ](?=[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:" + "|".join(ENDINGS) + r")\b)")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            found.append((start, done, "email"))
        # Everything before the sign has failed for every start; a later address starts behind it.
        done = max(done, at + 1)
        at = text.find("@", done)
    return found


def plain_spans(text: str) -> list[Span]:
    """Identifiers written plainly, by start and kind."""
    found = emails(text)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _plain_char(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c.isdigit():
        return str(unicodedata.digit(c))
    flat = unicodedata.normalize("NFKC", c)
    return flat if len(flat) == 1 and flat.isascii() else c


class Rewritten:
    """A text with some ranges replaced, and the way back from its positions to the source's."""

    def __init__(self, text: str) -> None:
        self.text = text
        # Start and end here, start and end in the source: disjoint and in order, so that starts and ends both ascend.
        self.parts: list[tuple[int, int, int, int]] = []
        self.starts: list[int] = []

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint ranges of the present text, in order."""
        out, parts, here, last = [], [], 0, 0
        for start, end, new in edits:
            if start < last or self.text[start:end] == new:
                continue
            out += [self.text[last:start], new]
            here += start - last
            source = self.source(start, end)
            parts.append((here, here + len(new), *source, start, end))
            here += len(new)
            last = end
        if not parts:
            return
        out.append(self.text[last:])
        moved, ends = [], [p[5] for p in parts]
        for old in self.parts:  # earlier edits that a new one did not swallow move along
            at = bisect.bisect_right(ends, old[0])
            if at == len(parts) or parts[at][4] >= old[1]:
                shift = parts[at - 1][1] - ends[at - 1] if at else 0
                moved.append((old[0] + shift, old[1] + shift, old[2], old[3]))
        self.parts = sorted([*moved, *(p[:4] for p in parts)])
        self.starts = [p[0] for p in self.parts]
        self.text = "".join(out)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source range of a range here; a replaced place counts as a whole."""
        first, last = start, end
        at = bisect.bisect_right(self.starts, start) - 1
        while at >= 0 and self.parts[at][:2] == (start, start):  # what was left out right before the range is not in it
            at -= 1
        if at >= 0:
            _, b, s, e = self.parts[at]
            first = start - b + e if b <= start else s
        at = bisect.bisect_left(self.starts, end) - 1
        if at >= 0:
            _, b, _, e = self.parts[at]
            last = end - b + e if b <= end else e
        return first, last

    def touched(self, start: int, end: int) -> bool:
        at = bisect.bisect_left(self.starts, end) - 1
        return at >= 0 and self.parts[at][1] > start


class Reach:
    """Of intervals, the furthest end among those that start at or before a place."""

    def __init__(self, intervals: Iterable[tuple[int, int]]) -> None:
        ordered_intervals = sorted(intervals)
        self.starts = [s for s, _ in ordered_intervals]
        self.ends = list(itertools.accumulate((e for _, e in ordered_intervals), max))

    def at(self, place: int) -> int:
        found = bisect.bisect_right(self.starts, place)
        return self.ends[found - 1] if found else -1


def _digits_of(m: re.Match[str]) -> str:
    words = _WORD.findall(m[0])
    return "".join("+" if w.lower() == "plus" else DIGIT_WORDS[w.lower()] for w in words)


def rewrite(text: str) -> Rewritten:
    """Homoglyphs first, then spelled digits, then at and dot."""
    out = Rewritten(text)
    out.replace([(*m.span(), _plain_char(m[0])) for m in _STRANGE.finditer(text)])
    out.replace([(*m.span(), _digits_of(m)) for m in _SPELLED.finditer(out.text)])
    out.replace([(*m.span(), ".") for m in _DOT_SIGN.finditer(out.text)])
    out.replace([(*m.span(), "@") for m in _AT_SIGN.finditer(out.text)])
    dots = [a for a, b, _, _ in out.parts if out.text[a:b] == "."]
    if dots:  # a bare " at " before a disguised dot
        edits = []
        for m in re.finditer(r"(?i)(?<=[a-z0-9])[ ]at[ ](?=[a-z0-9-]+\.)", out.text):
            host = _DOMAIN.match(out.text, m.end())
            if host and host[0].rpartition(".")[2].lower() in ENDINGS and out.touched(*host.span()):
                edits.append((*m.span(), "@"))
        out.replace(edits)
    out.replace([(*m.span(), "@") for m in _AT_WORD.finditer(out.text)])
    return out


# A cheap look for anything that the transducer could rewrite, on the lower-cased text.
_BRACKET_HINT = re.compile(r"[\[({<][ ]?(?:at|@|arroba|chez|dot|\.|punto|point|punkt)[ ]?[\])}>]")
_DIGIT_HINT = re.compile(rf"[ ,-]{_DIGIT}[ ,-]")
_AT_HINT = re.compile(r" at (?=[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:" + "|".join(ENDINGS) + r")\b)")


def _may_change(text: str) -> bool:
    low = text.lower()
    return (" dot " in low or "_dot_" in low or "_at_" in low or " @" in low or "@ " in low
            or not text.isascii() and bool(_STRANGE.search(text)) or bool(_BRACKET_HINT.search(low))
            or bool(_DIGIT_HINT.search(low)) or " at " in low and bool(_AT_HINT.search(low)))


def disguised_spans(text: str) -> list[Span]:
    """Identifiers that appear only after rewriting, as source spans."""
    if not _may_change(text):
        return []
    changed = rewrite(text)
    if not changed.parts:
        return []
    found = []
    hits = plain_spans(changed.text)
    # Ten spelled digits and more are a phone number even without its plus sign.
    reach = Reach((s, e) for s, e, _ in hits)
    for a, b, _, _ in changed.parts:
        if 9 <= b - a <= 15 and changed.text[a:b].isdigit() and reach.at(b - 1) <= a:
            hits.append((a, b, "phone"))
    for start, end, kind in hits:
        if changed.touched(start, end):
            found.append((*changed.source(start, end), kind))
    return found


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and these with the added ones."""
    base = plain_spans(text)
    reach = {kind: Reach((s, e) for s, e, k in base if k == kind) for kind in KINDS}
    extra = [s for s in disguised_spans(text) if reach[s[2]].at(s[0]) < s[1]]
    return base, ordered(list(dict.fromkeys([*base, *extra]))) if extra else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find(documents: DataFrame) -> DataFrame:
    """Per document: counts of plain spans by kind, the digest of their list, and all spans."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.pieces(batches):
            rows = [all_spans(t or "") for t in batch.column(1).to_pylist()]
            counts = [[sum(s[2] == kind for s in base) for base, _ in rows] for kind in KINDS]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
                pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows]),
                pa.array([joined(every) for _, every in rows], pa.string()),
                pa.array([len(every) - len(base) for base, every in rows], pa.int64()),
            ], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def masked(text: str, mask: str = "<{}>") -> str:
    """The text with every span replaced by its kind's name; spans that overlap are replaced together, named by the first."""
    out, last = [], 0
    spans = all_spans(text)[1]
    for start, end, kind in spans:
        if start >= last:
            out += [text[last:start], mask.format(kind.upper())]
        last = max(last, end)
    return "".join(out) + text[last:] if spans else text


def redact(documents: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents with personal data masked; changed texts get their new length, null texts stay null."""
    names, schema = documents.schema.names, documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, long = names.index(text), names.index(length)
        for batch in T.pieces(batches, text):
            before, sizes = batch.column(at).to_pylist(), batch.column(long).to_pylist()
            after = [t and masked(t) for t in before]
            sizes = [n if a == b else len(a) for a, b, n in zip(after, before, sizes, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(after, batch.column(at).type)
            columns[long] = pa.array(sizes, batch.column(long).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(run, schema)
