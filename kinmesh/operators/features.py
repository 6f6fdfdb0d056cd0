"""Pair similarities: 48 columns of the current generation, 29 and 36 of the first.

Those that need edit distance, Jaro-Winkler, subsequences, difflib or phonetic codes are computed together in one Arrow pass over the pairs, as are
the counts of token sets; most are built-in expressions over these counts. A batch holds few texts and many pairs, so texts are cut into tokens once a batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.functions import batch, kernels, setsim

# Address words that are no town.
NO_TOWN = ("st", "rd", "ave", "blvd", "dr", "ln", "ct", "pl", "hwy", "apt", "ste", "bldg", "fl", "no", "ngr", "dist", "sec", "blk", "col", "and", "near", "opp", "behind", "next", "the", "of", "in", "at")

# Feature names in the order of the vector.
FEATURE_NAMES = [
    "name_lev", "name_jw", "name_tsort", "name_tset", "name_partial", "name_ratio", "name_jac", "name_ovl", "name_dice", "name_cont12", "name_cont21", "name_first",
    "name_lr", "name_contain", "name_char3_jac", "name_lcs", "name_first_sorted", "name_tok_ratio", "name_prefix3", "addr_lev", "addr_jw", "addr_tsort", "addr_tset",
    "addr_partial", "addr_jac", "addr_ovl", "addr_dice", "addr_lr", "addr_nonum_jac", "addr_contain", "anum_jac", "anum_ovl", "anum_match12", "anum_first", "anum_cnt_diff",
    "comb_tsort", "comb_tset", "comb_jac", "name_tok_diff", "comb_lev", "phon_soundex_match", "phon_metaphone_match", "phon_soundex_jw", "phon_nysiis_match", "phon_soundex_jac",
    "addr_pin_match", "addr_city_ovl", "addr_num_cnt_match",
]
FEATURE_NAMES_V1 = [
    "name_lev", "name_jw", "name_tsort", "name_tset", "name_partial", "name_ratio", "name_jac", "name_ovl", "name_dice", "name_cont12", "name_cont21", "name_first", "name_lr",
    "addr_lev", "addr_jw", "addr_tsort", "addr_tset", "addr_partial", "addr_jac", "addr_ovl", "addr_dice", "addr_lr", "anum_jac", "anum_ovl", "anum_match12",
    "comb_tsort", "comb_tset", "comb_jac", "name_tok_diff",
]

FEATURE_NAMES_MODULAR = [
    "name_levenshtein", "name_jaro_winkler", "name_token_sort_ratio", "name_token_set_ratio", "name_partial_ratio", "name_jaccard", "name_overlap", "name_dice",
    "name_containment_12", "name_containment_21", "name_first_token_match", "name_length_ratio", "name_token_count_diff", "addr_levenshtein", "addr_jaro_winkler",
    "addr_token_sort_ratio", "addr_token_set_ratio", "addr_partial_ratio", "addr_jaccard", "addr_overlap", "addr_dice", "addr_length_ratio", "addr_num_jaccard",
    "addr_num_overlap", "addr_num_match_ratio_12", "addr_num_match_ratio_21", "combined_token_sort", "combined_token_set", "combined_jaccard", "country_match", "name_in_addr",
    "max_name_containment", "max_addr_num_match", "agg_name_score", "agg_addr_score", "agg_combined_score",
]


def _first_words(texts: Sequence[str]) -> list[str]:
    found = (re.search("[a-zA-Z]+", t) for t in texts)
    return [f[0] if f else "" for f in found]


def _codes(code: Callable[[str], str], texts: Sequence[str]) -> list[str]:
    """Each distinct word is coded once."""
    words = _first_words(texts)
    known = {w: code(w) for w in set(words)}
    return [known[w] for w in words]


def _same_codes(code: Callable[[str], str], left: Sequence[str], right: Sequence[str]) -> list[float]:
    return [float(bool(x) and x == y) for x, y in zip(_codes(code, left), _codes(code, right), strict=True)]


def _joined(names: Sequence[str], addresses: Sequence[str]) -> list[str]:
    return [f"{n} {a}" for n, a in zip(names, addresses, strict=True)]


#: What Spark's regular expressions take for white space and digits.
_BLANKS, _DIGITS = re.compile("[ \t\n\x0b\f\r]+"), re.compile("[0-9]+")


def _tokens(text: str) -> frozenset[str]:
    return frozenset(t for t in _BLANKS.split(text) if t)


def _numbers(text: str) -> frozenset[str]:
    return frozenset(_DIGITS.findall(text))


def _sets(a: Sequence[str], f: Callable[[str], frozenset[str]]) -> list[frozenset[str]]:
    known = {t: f(t) for t in set(a)}
    return [known[t] for t in a]


def token_sets(texts: Sequence[str]) -> list[frozenset[str]]:
    return _sets(texts, _tokens)


#: Sets of a record that are counted, of names and addresses: tokens of either, numbers of the address, tokens of both together, tokens of the address that are no numbers.
SETS = {
    "n": lambda n, a: _sets(n, _tokens),
    "a": lambda n, a: _sets(a, _tokens),
    "d": lambda n, a: _sets(a, _numbers),
    "c": lambda n, a: [x | y for x, y in zip(_sets(n, _tokens), _sets(a, _tokens), strict=True)],
    "r": lambda n, a: _sets(a, lambda t: _tokens(t) - _numbers(t)),
}


def _counts(left: Sequence[frozenset[str]], right: Sequence[frozenset[str]]) -> list[pa.Array]:
    """Sizes of either side's sets and of what they share."""
    return [pa.array(list(x), pa.int32()) for x in (map(len, left), map(len, right), (len(x & y) for x, y in zip(left, right, strict=True)))]


def _same_first(left: Sequence[frozenset[str]], right: Sequence[frozenset[str]], empty: float) -> list[float]:
    """Whether the smallest members are equal; empty: the value of two empty sets, one empty gives 0."""
    known = {s: min(s, default=None) for s in {*left, *right}}
    return [float(known[x] == known[y]) if x or y else empty for x, y in zip(left, right, strict=True)]


#: What the Arrow pass computes from a batch's n1, a1, n2 and a2, each distinct pair of texts once.
KERNELS = {
    "name_lev": lambda n1, a1, n2, a2: batch.edit_similarity(n1, n2),
    "name_jw": lambda n1, a1, n2, a2: batch.jaro_winkler(n1, n2),
    "name_tsort": lambda n1, a1, n2, a2: batch.token_sort(n1, n2),
    "name_tset": lambda n1, a1, n2, a2: batch.token_set(n1, n2),
    "name_partial": lambda n1, a1, n2, a2: batch.partial(n1, n2),
    "name_ratio": lambda n1, a1, n2, a2: batch.ratio(n1, n2),
    "name_lcs": lambda n1, a1, n2, a2: batch.each(kernels.sequence_ratio)(n1, n2),
    "addr_lev": lambda n1, a1, n2, a2: batch.edit_similarity(a1, a2),
    "addr_jw": lambda n1, a1, n2, a2: batch.jaro_winkler(a1, a2),
    "addr_tsort": lambda n1, a1, n2, a2: batch.token_sort(a1, a2),
    "addr_tset": lambda n1, a1, n2, a2: batch.token_set(a1, a2),
    "addr_partial": lambda n1, a1, n2, a2: batch.partial(a1, a2),
    "comb_tsort": lambda n1, a1, n2, a2: batch.token_sort(_joined(n1, a1), _joined(n2, a2)),
    "comb_tset": lambda n1, a1, n2, a2: batch.token_set(_joined(n1, a1), _joined(n2, a2)),
    "comb_lev": lambda n1, a1, n2, a2: batch.edit_similarity(*(["" if not x.strip(" ") else x for x in _joined(n, a)] for n, a in ((n1, a1), (n2, a2)))),
    "name_first": lambda n1, a1, n2, a2: _same_first(SETS["n"](n1, a1), SETS["n"](n2, a2), 0.0),
    "anum_first": lambda n1, a1, n2, a2: _same_first(SETS["d"](n1, a1), SETS["d"](n2, a2), 1.0),
    "phon_metaphone_match": lambda n1, a1, n2, a2: _same_codes(kernels.metaphone, n1, n2),
    "phon_soundex_jw": lambda n1, a1, n2, a2: batch.jaro_winkler(_codes(kernels.soundex, n1), _codes(kernels.soundex, n2)),
    "phon_nysiis_match": lambda n1, a1, n2, a2: _same_codes(kernels.nysiis, n1, n2),
}


def native_columns() -> dict[str, Column]:
    """Built-in features, over the texts and the counts of kernel_pass()."""
    c = F.col
    n1, n2, a1, a2 = (c(x) for x in ("n1", "n2", "a1", "a2"))
    n, a, d, both, rest = (setsim.Sets(c(f"_{k}1"), c(f"_{k}2"), c(f"_{k}")) for k in SETS)
    longest = F.greatest(n.a, n.b)
    word = lambda x: F.regexp_extract(x, "([a-zA-Z]+)", 1)
    codes = lambda x: F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit("[a-zA-Z]{2,}"), F.lit(0)), F.soundex))
    pins = lambda x: F.regexp_extract_all(x, F.lit(r"\b\d{5,6}\b"), F.lit(0))
    towns = lambda x: F.array_except(F.regexp_extract_all(F.lower(x), F.lit("[a-zA-Z]{3,}"), F.lit(0)), F.array(*(F.lit(w) for w in NO_TOWN)))
    count_diff = F.abs(d.a - d.b)
    return {
        "name_jac": setsim.jaccard(n), "name_ovl": setsim.overlap(n), "name_dice": setsim.dice(n),
        "name_cont12": setsim.containment(n), "name_cont21": setsim.containment(n.swapped()),
        "name_lr": setsim.length_ratio(n1, n2), "name_contain": setsim.contained(n1, n2),
        "name_char3_jac": setsim.jaccard(setsim.sets(setsim.char_grams(n1), setsim.char_grams(n2))), "name_first_sorted": c("name_first"),
        "name_tok_ratio": F.when(longest > 0, F.least(n.a, n.b).cast("double") / longest).otherwise(0.0),
        "name_prefix3": F.when((F.length(n1) >= 3) & (F.length(n2) >= 3), (F.substring(n1, 1, 3) == F.substring(n2, 1, 3)).cast("double")).otherwise(0.0),
        "addr_jac": setsim.jaccard(a), "addr_ovl": setsim.overlap(a), "addr_dice": setsim.dice(a), "addr_lr": setsim.length_ratio(a1, a2),
        "addr_nonum_jac": setsim.jaccard(rest), "addr_contain": setsim.contained(a1, a2),
        "anum_jac": setsim.jaccard(d), "anum_ovl": setsim.overlap(d), "anum_match12": setsim.number_match(d), "anum_match21": setsim.number_match(d.swapped()),
        "anum_cnt_diff": count_diff.cast("double"),
        "comb_jac": setsim.jaccard(both), "name_tok_diff": F.abs(n.a - n.b).cast("double"),
        "phon_soundex_match": F.when((word(n1) != "") & (word(n2) != ""), (F.soundex(word(n1)) == F.soundex(word(n2))).cast("double")).otherwise(0.0),
        "phon_soundex_jac": setsim.jaccard(setsim.sets(codes(n1), codes(n2))),
        "addr_pin_match": F.when((F.size(pins(a1)) == 0) & (F.size(pins(a2)) == 0), 1.0).otherwise(F.arrays_overlap(pins(a1), pins(a2)).cast("double")),
        "addr_city_ovl": setsim.overlap(setsim.sets(towns(a1), towns(a2))),
        "addr_num_cnt_match": 1.0 / (1.0 + count_diff),
    }


#: Sets that built-in features count.
COUNTED = {
    "n": ("name_jac", "name_ovl", "name_dice", "name_cont12", "name_cont21", "name_tok_ratio", "name_tok_diff"), "a": ("addr_jac", "addr_ovl", "addr_dice"),
    "d": ("anum_jac", "anum_ovl", "anum_match12", "anum_match21", "anum_cnt_diff", "addr_num_cnt_match"), "c": ("comb_jac",), "r": ("addr_nonum_jac",),
}


def _of_names(feature: str) -> bool:
    """Whether a feature is made of names alone."""
    return feature.startswith(("name_", "phon_"))


def kernel_pass(texts: DataFrame, names: Collection[str], kept: list[str]) -> DataFrame:
    """kept columns, those of the named features that are kernels, and the counts that others of them need (_n1, _n2 and _n: either side's and what they share), in one Arrow pass."""
    names = {"name_first" if n == "name_first_sorted" else n: None for n in names}
    counted = [k for k, users in COUNTED.items() if not names.keys().isdisjoint(users)]
    slow = [n for n in names if n in KERNELS]
    if not counted and not slow:
        return texts.select(*kept)
    # Addresses are only read where a feature or a later column needs them.
    read = [c for c in ("n1", "a1", "n2", "a2") if c in kept or not all(map(_of_names, names))]
    texts = texts.select(*dict.fromkeys([*kept, *read]))
    counts = [T.StructField(f"_{k}{i}", T.IntegerType()) for k in counted for i in (1, 2, "")]
    schema = T.StructType([*(texts.schema[c] for c in kept), *(T.StructField(n, T.DoubleType()) for n in slow), *counts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n1, a1, n2, a2 = (b.column(c).to_pylist() if c in read else None for c in ("n1", "a1", "n2", "a2"))
            values = [pa.array(KERNELS[n](n1, a1, n2, a2), pa.float64()) for n in slow]
            sizes = [x for k in counted for x in _counts(SETS[k](n1, a1), SETS[k](n2, a2))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *values, *sizes], schema.names)

    return texts.mapInArrow(run, schema)


def pair_features(texts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """s1_id, cand_id and the named features. texts: s1_id, cand_id, n1, a1, n2, a2, without nulls."""
    names = FEATURE_NAMES if names is None else names
    native = native_columns()
    kept = ["s1_id", "cand_id", "n1", "n2"] if all(map(_of_names, names)) else ["s1_id", "cand_id", "n1", "a1", "n2", "a2"]
    texts = kernel_pass(texts, names, kept)
    return texts.select("s1_id", "cand_id", *((F.col(n) if n in KERNELS else native[n].cast("double")).alias(n) for n in names))


def pair_features_v1(texts: DataFrame) -> DataFrame:
    """The 29 of the single-file first generation, all of them among the 48."""
    return pair_features(texts, FEATURE_NAMES_V1)


def pair_features_modular(texts: DataFrame) -> DataFrame:
    """The 36 of the modular first generation. texts also has c1 and c2, the countries."""
    native = native_columns()
    df = kernel_pass(texts, [*FEATURE_NAMES_V1, "anum_match21"], ["s1_id", "cand_id", "n1", "a1", "n2", "a2", "c1", "c2"])
    c = F.col
    opening = lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1)
    same_opening = ((opening(c("n1")) != "") & (opening(c("n1")) == opening(c("n2")))).cast("double")
    inside = (((c("n1") != "") & F.contains(c("a2"), c("n1"))) | ((c("n2") != "") & F.contains(c("a1"), c("n2")))).cast("double")
    direct = {
        "name_levenshtein": c("name_lev"), "name_jaro_winkler": c("name_jw"), "name_token_sort_ratio": c("name_tsort"), "name_token_set_ratio": c("name_tset"),
        "name_partial_ratio": c("name_partial"), "name_jaccard": native["name_jac"], "name_overlap": native["name_ovl"], "name_dice": native["name_dice"],
        "name_containment_12": native["name_cont12"], "name_containment_21": native["name_cont21"], "name_first_token_match": same_opening,
        "name_length_ratio": native["name_lr"], "name_token_count_diff": native["name_tok_diff"],
        "addr_levenshtein": c("addr_lev"), "addr_jaro_winkler": c("addr_jw"), "addr_token_sort_ratio": c("addr_tsort"), "addr_token_set_ratio": c("addr_tset"),
        "addr_partial_ratio": c("addr_partial"), "addr_jaccard": native["addr_jac"], "addr_overlap": native["addr_ovl"], "addr_dice": native["addr_dice"],
        "addr_length_ratio": native["addr_lr"], "addr_num_jaccard": native["anum_jac"], "addr_num_overlap": native["anum_ovl"],
        "addr_num_match_ratio_12": native["anum_match12"], "addr_num_match_ratio_21": native["anum_match21"],
        "combined_token_sort": c("comb_tsort"), "combined_token_set": c("comb_tset"), "combined_jaccard": native["comb_jac"],
        "country_match": (c("c1") == c("c2")).cast("double"), "name_in_addr": inside,
    }
    df = df.select("s1_id", "cand_id", *(v.cast("double").alias(k) for k, v in direct.items()))
    mean = lambda *xs: sum((c(x) for x in xs[1:]), c(xs[0])) / len(xs)
    df = df.withColumns({
        "max_name_containment": F.greatest("name_containment_12", "name_containment_21"), "max_addr_num_match": F.greatest("addr_num_match_ratio_12", "addr_num_match_ratio_21"),
        "agg_name_score": mean("name_jaro_winkler", "name_token_sort_ratio", "name_jaccard"), "agg_addr_score": mean("addr_jaro_winkler", "addr_token_sort_ratio", "addr_jaccard"),
    })
    return df.withColumn("agg_combined_score", 0.5 * c("agg_name_score") + 0.5 * c("agg_addr_score"))
