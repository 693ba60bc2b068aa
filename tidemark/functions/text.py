"""Name folding and keys, inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Latin letters that do not decompose, and what they become.
LETTERS = {
    "ø": "o", "Ø": "O", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D",
    "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "ẞ": "SS",
}
# Words that do not tell clubs apart.
TEAM_NOISE = r"\b(fc|afc|and|hove|albion|city|united|town|wanderers)\b"
MIN_TOKEN = 4


def _stripped(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


# Every character of the basic plane that loses its marks and stays one character.
_PLAIN = {c: _stripped(c) for c in map(chr, range(0xA0, 0xFFFF)) if len(_stripped(c)) == 1 and _stripped(c) != c}
# Every character before the East Asian blocks, and the Latin ligatures, that becomes several.
_SEVERAL = {c: _stripped(c) for c in map(chr, [*range(0xA0, 0x2E80), *range(0xFB00, 0xFB07)]) if len(_stripped(c)) > 1}
# A class of so many letters is tried one by one, so the look-ahead lets go of the first hundred characters at once.
_FIRST_SEVERAL = min(_SEVERAL)
_ANY_SEVERAL = f"(?=[{_FIRST_SEVERAL}-\U0010FFFF])[" + "".join(_SEVERAL) + "]"


def _spread(text: Column) -> Column:
    """Ligatures, fractions and their like as their parts; a text without any is only looked at."""
    pairs = F.array(*[F.struct(F.lit(c).alias("one"), F.lit(parts).alias("parts")) for c, parts in _SEVERAL.items()])
    return F.when(text.rlike(_ANY_SEVERAL), F.aggregate(pairs, text, lambda t, p: F.replace(t, p["one"], p["parts"]))).otherwise(text)


def fold(text: Column) -> Column:
    """Special letters spelled out, accents dropped, lower case. Hangul and ideographs stay as they are."""
    single = {**_PLAIN, **{k: v for k, v in LETTERS.items() if len(v) == 1}}
    out = _spread(text)
    for letter, plain in LETTERS.items():
        if len(plain) > 1:
            out = F.replace(out, F.lit(letter), F.lit(plain))
    out = F.translate(out, "".join(single), "".join(single.values()))
    return F.lower(F.regexp_replace(out, r"\p{M}", ""))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def team_key(name: Column) -> Column:
    return squeeze(F.regexp_replace(F.trim(fold(name)), TEAM_NOISE, " "))


def player_key(name: Column) -> Column:
    return squeeze(F.regexp_replace(fold(name), r"[^a-z0-9\s-]", " "))


def tokens(key: Column, least: int = 1) -> Column:
    """Parts split on hyphens and spaces, short ones left out."""
    return F.filter(F.split(key, r"[-\s]+"), lambda t: F.length(t) >= least)


def last_token(key: Column) -> Column:
    return F.element_at(F.split(key, r"\s+"), -1)
