"""The first generation's normalisers: token by token, and the chain of replacements."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh.functions.text import DOMAIN_SUFFIX, address_numbers, country_norm, fold_latin, squeezed, tokens

# Legal forms looked up after punctuation is stripped from a token.
LEGAL_FORMS = {
    "llc": "llc", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "ltd": "ltd", "limited": "ltd", "co": "co", "company": "co",
    "llp": "llp", "plc": "plc", "lp": "lp", "pllc": "pllc", "na": "na", "pvt": "pvt", "private": "pvt", "nidhi": "nidhi",
    "sarl": "sarl", "sas": "sas", "sa": "sa", "eurl": "eurl", "sci": "sci", "scp": "scp", "snc": "snc", "gie": "gie",
}
# Address words looked up after punctuation is stripped from a token.
ADDRESS_FORMS = {
    "street": "st", "st": "st", "road": "rd", "rd": "rd", "avenue": "ave", "av": "ave", "boulevard": "blvd", "drive": "dr", "lane": "ln", "court": "ct",
    "place": "pl", "circle": "cir", "highway": "hwy", "parkway": "pkwy", "terrace": "ter", "trail": "trl", "way": "way",
    "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw",
    "apartment": "apt", "apt": "apt", "suite": "ste", "floor": "fl", "flr": "fl", "building": "bldg", "unit": "unit", "number": "no",
    "nagar": "ngr", "ngr": "ngr", "district": "dist", "colony": "colony", "sector": "sec", "block": "blk",
    "rue": "rue", "impasse": "imp", "chemin": "ch", "passage": "pass",
}
# States of one word; a lookup by token can't reach longer ones.
INDIAN_STATES = {
    "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj", "haryana": "hr", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl",
    "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "punjab": "pb", "rajasthan": "rj",
    "sikkim": "sk", "telangana": "tg", "tripura": "tr", "uttarakhand": "uk", "delhi": "dl", "chandigarh": "ch", "puducherry": "py",
}
# Likewise.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky",
    "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo",
    "montana": "mt", "nebraska": "ne", "nevada": "nv", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "tennessee": "tn",
    "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "wisconsin": "wi", "wyoming": "wy",
}


def normalise_unicode(text: Column) -> Column:
    """Accents off Latin letters; other scripts stay."""
    return fold_latin(text)


def clean_text(text: Column) -> Column:
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\[\](){}]", " ")
    return squeezed(F.replace(F.replace(text, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and ")))


def _table(mapping: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))


def _bare(token: Column) -> Column:
    return F.regexp_replace(token, r"[^\w\s]", "")


def normalise_name(name: Column) -> Column:
    text = F.regexp_replace(normalise_unicode(clean_text(name)), DOMAIN_SUFFIX, "")
    forms = _table(LEGAL_FORMS)
    return F.array_join(F.transform(tokens(text), lambda t: F.coalesce(forms[_bare(t)], t)), " ")


def normalise_address(address: Column, country: Column) -> Column:
    text = normalise_unicode(clean_text(address))
    forms, india, us, where = _table(ADDRESS_FORMS), _table(INDIAN_STATES), _table(US_STATES), F.lower(F.coalesce(country, F.lit("")))
    state = lambda t: F.when(where == "india", india[_bare(t)]).when(where == "us", us[_bare(t)])
    return F.array_join(F.transform(tokens(text), lambda t: F.coalesce(forms[_bare(t)], state(t), t)), " ")


def extract_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)))


def extract_numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)))


def extract_alpha(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-zA-Z\\u0900-\\u097F\\u00C0-\\u024F]+"), F.lit(0)))


def name_key(name: Column) -> Column:
    """First four consonants of the normalised name and, after an underscore, its first number."""
    text = normalise_name(name)
    first = F.regexp_extract(text, r"(\d+)", 1)
    consonants = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^aeiou\s\d\W]"), F.lit(0)), 1, 4), "")
    return F.when(first != "", F.concat_ws("_", consonants, first)).otherwise(consonants)


def address_key(address: Column, country: Column) -> Column:
    return F.array_join(F.slice(F.sort_array(extract_numbers(normalise_address(address, country))), 1, 3), "_")


def combined_text(name: Column, address: Column, country: Column) -> Column:
    return F.trim(F.concat_ws(" ", normalise_name(name), normalise_address(address, country)))


def normalise_v1(records: DataFrame) -> DataFrame:
    """records plus name_norm, addr_norm, country_norm, combined, name_tokens, addr_tokens, addr_nums, name_key."""
    out = records.withColumns({
        "name_norm": normalise_name(F.col("business_name")), "addr_norm": normalise_address(F.col("business_address"), F.col("country")),
        "country_norm": country_norm(F.col("country")), "name_key": name_key(F.col("business_name")),
    })
    return out.withColumns({
        "combined": F.trim(F.concat_ws(" ", "name_norm", "addr_norm")), "name_tokens": extract_tokens(F.col("name_norm")),
        "addr_tokens": extract_tokens(F.col("addr_norm")), "addr_nums": extract_numbers(F.col("addr_norm")),
    })


# Replacements of the chain, in order. Unlike a single pass, each sees what those before it have made.
_NAME_CHAIN = (
    (r"s\.a\.r\.l\.?", "sarl"), (r"s\.a\.s\.?", "sas"), (r"s\.c\.i\.?", "sci"), (r"l\.l\.c\.?", "llc"), (r"l\.l\.p\.?", "llp"), (r"p\.l\.c\.?", "plc"), (r"l\.p\.?", "lp"), (r"n\.a\.?", "na"),
    (r"\bincorporated\b", "inc"), (r"\bcorporation\b", "corp"), (r"\blimited\b", "ltd"), (r"\bcompany\b", "co"), (r"\bprivate\b", "pvt"),
    (r"\binc\.", "inc"), (r"\bcorp\.", "corp"), (r"\bltd\.", "ltd"), (r"\bpvt\.", "pvt"), (r"\bco\.(?=\s|$)", "co"), (DOMAIN_SUFFIX, ""),
)


def chain_normalise(records: DataFrame) -> DataFrame:
    """records plus name_clean, addr_clean, country_norm, combined, addr_nums_str by the chain: no transliteration, a trailing dot goes."""
    from kinmesh.functions.text import ADDRESS_WORDS

    def opened(c: str) -> Column:
        text = F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[\[\](){}]", " ")
        return F.replace(F.replace(text, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and "))

    name, address = opened("business_name"), opened("business_address")
    for pattern, plain in _NAME_CHAIN:
        name = F.regexp_replace(name, pattern, plain)
    for word, plain in ADDRESS_WORDS.items():
        address = F.regexp_replace(address, rf"\b{re.escape(word)}" + ("" if word.endswith(".") else r"\b"), plain)
    out = records.withColumns({"name_clean": squeezed(name), "addr_clean": squeezed(address), "country_norm": country_norm(F.col("country"))})
    return out.withColumns({"combined": F.concat_ws(" ", "name_clean", "addr_clean"), "addr_nums_str": address_numbers(F.col("addr_clean"))})
