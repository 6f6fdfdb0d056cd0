"""Romanisation of Indic, Cyrillic and Greek letters as Column expressions.

The Indic blocks share one layout, so that letters of all are first brought to the first block's places. Letters get their sound from
their Unicode names (KHA is kh and an inherent a). A consonant keeps its a unless a vowel sign or a virama follows or, in the northern scripts,
the word ends. Only rows with such letters are touched; everything is built in.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BASE = 0x0900
#: Blocks in the layout of the first; in northern ones a word's last consonant loses its a.
NORTHERN, SOUTHERN = (0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00), (0x0B80, 0x0C00, 0x0C80, 0x0D00)
_VIRAMA, _NUKTA = 0x4D, 0x3C
# Sounds that differ from the letter's name.
_SOUNDS = {"c": "ch", "ch": "chh", "ss": "sh", "vocalic r": "ri", "vocalic rr": "ri", "vocalic l": "li", "vocalic ll": "li", "nng": "ng", "yy": "y", "kh ": "kh"}
# Cyrillic and Greek letters in their usual romanisation.
OTHERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "є": "ye", "і": "i", "ї": "yi", "ґ": "g",
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t",
    "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
}


def _sound(name: str) -> str:
    """kh of KHA, t of TTA, sh of SSA: the letter's name without its inherent a, doubled letters once."""
    plain = name.lower()
    base = plain[:-1] if plain.endswith("a") and len(plain) > 1 else plain
    if base in _SOUNDS:
        return _SOUNDS[base]
    while len(base) > 1 and base[0] == base[1]:
        base = base[1:]
    return base


def indic_tables() -> tuple[dict[int, str], dict[int, str], dict[int, str]]:
    """(consonants, vowels, signs) of the first block, by place in the layout."""
    consonants, vowels, signs = {}, {}, {}
    for i in range(0x80):
        name = unicodedata.name(chr(_BASE + i), "").removeprefix("DEVANAGARI ")
        if name.startswith("LETTER ") and (0x15 <= i <= 0x39 or 0x58 <= i <= 0x5F):
            consonants[i] = _sound(name[7:])
        elif name.startswith("LETTER "):
            vowels[i] = _vowel(name[7:])
        elif name.startswith("VOWEL SIGN "):
            signs[i] = _vowel(name[11:])
        elif name.startswith("DIGIT "):
            vowels[i] = str(unicodedata.digit(chr(_BASE + i)))
    signs |= {_VIRAMA: "", 0x01: "n", 0x02: "n", 0x03: "h"}
    return consonants, vowels, signs


def _vowel(name: str) -> str:
    plain = name.lower().removeprefix("candra ").removeprefix("short ")
    return _SOUNDS.get(plain) or {"aa": "a", "ii": "i", "uu": "u"}.get(plain, plain.split()[0][:2])


def _class(blocks: tuple[int, ...], places: set[int]) -> str:
    return "".join(f"\\u{b + i:04X}" for b in blocks for i in sorted(places))


_CONSONANTS, _VOWELS, _SIGNS = indic_tables()
_MARKED = "[\\u0370-\\u052F\\u0900-\\u0D7F]"
_AFTER = {i for i in _SIGNS if i not in (0x01, 0x02, 0x03)}


def _each(text: Column, table: dict[str, str]) -> Column:
    """Letters of table by what stands for them: those with one letter or none in one pass, the few with several one by one."""
    for letter, plain in table.items():
        if len(plain) > 1:
            text = F.replace(text, F.lit(letter), F.lit(plain))
    short = {a: b for a, b in table.items() if len(b) == 1} | {a: b for a, b in table.items() if not b}
    return F.translate(text, "".join(short), "".join(short.values()))


def worked_out_once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that f uses more than once: a variable stands for it, where nested expressions would work it out anew for each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def romanised(text: Column) -> Column:
    """text with Indic, Cyrillic and Greek letters in Latin ones; null stays null, other letters stay."""
    return worked_out_once(text, _romanised)


def _romanised(text: Column) -> Column:
    c, after = set(_CONSONANTS), _AFTER | {_NUKTA}
    out = F.replace(F.replace(text, F.lit("‍"), F.lit("")), F.lit("‌"), F.lit(""))
    out = F.regexp_replace(out, f"[{_class(NORTHERN + SOUTHERN, {_NUKTA})}]", "")
    follows = f"[{_class(NORTHERN + SOUTHERN, after)}]"
    letter = f"[{_class(NORTHERN + SOUTHERN, c | set(_VOWELS) | set(_SIGNS))}]"
    out = F.regexp_replace(out, f"([{_class(SOUTHERN, c)}])(?!{follows})", "$1a")
    out = F.regexp_replace(out, f"(?<!{letter})([{_class(NORTHERN, c)}])(?!{follows})", "$1a")
    out = F.regexp_replace(out, f"([{_class(NORTHERN, c)}])(?={letter})(?!{follows})", "$1a")
    first = lambda i: chr(_BASE + i)
    places = sorted(c | set(_VOWELS) | set(_SIGNS))
    others = [b for b in (*NORTHERN, *SOUTHERN) if b != _BASE]
    out = F.translate(out, "".join(chr(b + i) for b in others for i in places), "".join(first(i) for _ in others for i in places))
    out = _each(out, {first(i): s for i, s in (_CONSONANTS | _VOWELS | _SIGNS).items()})
    out = F.translate(out, "।॥", "  ")
    capital = {a.upper(): b.capitalize() for a, b in OTHERS.items() if len(a.upper()) == 1 and a.upper() not in OTHERS}
    accented = {ch: unicodedata.normalize("NFD", ch)[0] for ch in map(chr, range(0x0370, 0x0400)) if len(unicodedata.normalize("NFD", ch)) > 1}
    out = F.translate(out, "".join(accented), "".join(accented.values()))
    return F.when(text.rlike(_MARKED), _each(_each(out, OTHERS), capital)).otherwise(text)
