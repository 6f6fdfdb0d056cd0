"""Normalisation of business records as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.functions.scripts import romanised, worked_out_once

# Dotted legal forms, replaced wherever they stand.
DOTTED_FORMS = {
    "s.a.r.l.": "sarl", "s.a.r.l": "sarl", "s.a.s.": "sas", "s.a.s": "sas", "s.c.i.": "sci", "s.c.i": "sci", "l.l.c.": "llc", "l.l.c": "llc",
    "l.l.p.": "llp", "l.l.p": "llp", "p.l.c.": "plc", "p.l.c": "plc", "l.p.": "lp", "l.p": "lp", "n.a.": "na", "n.a": "na",
}
# Legal words, replaced between word boundaries.
LEGAL_WORDS = {
    "incorporated": "inc", "corporation": "corp", "limited": "ltd", "company": "co", "private": "pvt",
    "inc.": "inc", "corp.": "corp", "ltd.": "ltd", "pvt.": "pvt",
}
# Address words, replaced between word boundaries.
ADDRESS_WORDS = {
    "street": "st", "road": "rd", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "lane": "ln", "highway": "hwy", "parkway": "pkwy",
    "terrace": "ter", "apartment": "apt", "suite": "ste", "building": "bldg", "floor": "fl", "district": "dist", "nagar": "ngr", "sector": "sec", "colony": "col",
    "st.": "st", "rd.": "rd", "ave.": "ave", "blvd.": "blvd", "dr.": "dr", "apt.": "apt", "ste.": "ste", "bldg.": "bldg", "fl.": "fl", "no.": "no",
}
DOMAIN_SUFFIX = r"\.(com|org|net|in|fr|co\.in)$"
ADDRESS_NUMBERS = 5


def _latin_folds() -> tuple[str, str, dict[str, str]]:
    """Accented Latin letters with a one-letter base, and those that become several letters, by Unicode decomposition."""
    ones, bases, several = [], [], {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
    plain = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ð": "d", "Ð": "D", "ı": "i"}
    for cp in range(0xC0, 0x250):
        base = plain.get(chr(cp)) or "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if chr(cp) not in several and base.isascii() and base:
            if len(base) == 1:
                ones.append(chr(cp))
                bases.append(base)
            else:
                several[chr(cp)] = base
    return "".join(ones), "".join(bases), several


_ONES, _BASES, _SEVERAL = _latin_folds()


def fold_latin(text: Column) -> Column:
    """Latin letters to ASCII; other scripts stay."""
    for letter, plain in _SEVERAL.items():
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.translate(text, _ONES, _BASES)


@F.pandas_udf(T.StringType())
def fold_any(texts: pd.Series) -> pd.Series:
    """Any script by compatibility decomposition; what has no ASCII form is dropped. Only for columns that need it: a Python pass over all rows."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def map_replace(text: Column, mapping: Mapping[str, str], *, bounded: bool) -> Column:
    """All keys replaced in one pass, longest first, as a single regular expression with a callback would.

    Chained replacements aren't the same: they'd see what an earlier one has made.
    """
    pattern = "|".join(re.escape(k) for k in sorted(mapping, key=len, reverse=True))
    if bounded:
        pattern = rf"\b(?:{pattern})\b"
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))

    def replaced(t: Column) -> Column:
        between, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.array_join(F.zip_with(between, found, lambda b, k: F.concat(b, F.coalesce(table[k], F.lit("")))), "")

    return worked_out_once(text, replaced)


def _cleaned(text: Column, transliterate: bool) -> Column:
    text = F.coalesce(text, F.lit(""))
    text = F.lower(fold_latin(romanised(text)) if transliterate else text)
    text = F.regexp_replace(text, r"[\[\](){}]", " ")
    return F.replace(F.replace(text, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and "))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_name(text: Column, transliterate: bool = True) -> Column:
    text = map_replace(_cleaned(text, transliterate), DOTTED_FORMS, bounded=False)
    text = map_replace(text, LEGAL_WORDS, bounded=True)
    text = F.regexp_replace(text, DOMAIN_SUFFIX, "")
    return squeezed(F.regexp_replace(text, r"\bco\.(?=\s|$)", "co"))


def clean_address(text: Column, transliterate: bool = True) -> Column:
    return squeezed(map_replace(_cleaned(text, transliterate), ADDRESS_WORDS, bounded=True))


def country_norm(country: Column) -> Column:
    return F.lower(F.trim(F.coalesce(country, F.lit(""))))


def tokens(text: Column) -> Column:
    """Runs of non-space, in order, with repeats."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)))


def address_numbers(address: Column, n: int = ADDRESS_NUMBERS) -> Column:
    """First n distinct numbers in order of their characters, blank-joined."""
    return F.array_join(F.slice(F.sort_array(numbers(address)), 1, n), " ")


def sorted_three(name: Column) -> Column:
    """First three of the sorted tokens; empty with fewer than two tokens."""
    t = tokens(name)
    return F.when(F.size(t) >= 2, F.array_join(F.slice(F.sort_array(t), 1, 3), " ")).otherwise("")


def normalise(records: DataFrame, *, transliterate: bool = True) -> DataFrame:
    """records plus name_clean, addr_clean, country_norm, combined, addr_nums_str, name_sorted_3tok."""
    clean = records.withColumns({
        "name_clean": clean_name(F.col("business_name"), transliterate),
        "addr_clean": clean_address(F.col("business_address"), transliterate),
        "country_norm": country_norm(F.col("country")),
    })
    return clean.withColumns({
        "combined": F.concat_ws(" ", "name_clean", "addr_clean"),
        "addr_nums_str": address_numbers(F.col("addr_clean")),
        "name_sorted_3tok": sorted_three(F.col("name_clean")),
    })
