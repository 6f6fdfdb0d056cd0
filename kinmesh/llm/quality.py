"""Quality rules whose cutoffs are certified on labelled documents.

Every rule is a signal (larger is worse) and a ladder of cutoffs. For each stratum and rule, the labelled good
documents above a cutoff are counted; the cutoff may be used only if the exact binomial test rejects a
false-rejection rate of RISK or more, at a level that is divided by the number of all tests made (Bonferroni).
Among certified cutoffs the one that best separates bad from good documents is taken; where none is certified the
rule is off for that stratum. Signals are computed in one pass and written before their two uses.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmesh.llm.common import SPACES, cut, space_words, stored, table

#: Largest false-rejection rate of each rule in each stratum (all rules together: at most their number times that), and the chance that any certificate is wrong.
RISK, DELTA = 0.005, 0.05
#: A good document that a cutoff rejects weighs as much as so many bad ones.
PRICE = 20
#: Cutoffs that are tried, for every rule. Fixed values.
LADDER = (0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8)
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: Strata up to this number are broadcast (about 60 bytes each); beyond it the planner joins by shuffle.
BROADCAST_STRATA = 50_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: Rules: name, numerator, denominator.
RULES = (("symbols", "n_symbols", "word_chars"), ("dup_lines", "n_dup_lines", "n_lines"), ("repeats", "n_repeat_words", "n_words"), ("upper", "n_upper", "word_chars"))


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus COUNTS, all long; columns of docs with these names are replaced, all others keep their values.

    Null and blank texts have zeros; texts of any length are taken whole; repeated rows are measured each. Lines are split at line feeds and only those with a word count. Words in
    repeated windows are told by a 64-bit hash of the window's words within one text.
    """
    kept = [c for c in docs.columns if c.lower() not in COUNTS]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = F.array().cast("array<bigint>")
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = docs.select(*([F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_km_row")] if kept else []), space_words(body).alias("_km_w"), lines.alias("_km_l"), body.alias("_km_body"))
    body = F.col("_km_body")
    df = df.withColumn("_km_h", F.transform("_km_w", lambda w: F.xxhash64(w)))
    last = F.size("_km_w") - WINDOW
    rolled = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get("_km_h", i + j) for j in range(WINDOW))))
    df = df.withColumn("_km_g", F.when(last >= 1, rolled).otherwise(none))
    df = df.withColumn("_km_again", F.size("_km_g") > F.size(F.array_distinct("_km_g")))
    # Only texts that repeat a window are sorted: windows by hash, then those with an equal neighbour by place.
    ranked = F.sort_array(F.transform("_km_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_km_s", F.when(F.col("_km_again"), ranked))
    code = lambda k: F.get("_km_s", k)["h"]
    same = lambda s, k: F.coalesce(code(k - 1) == s["h"], F.lit(False)) | F.coalesce(code(k + 1) == s["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_km_s", same), lambda s: s["i"]))
    df = df.withColumn("_km_p", F.when(F.col("_km_again"), places))
    covered = F.transform("_km_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_km_p", k + 1) - p, F.lit(WINDOW))))
    repeat = F.when(F.col("_km_again"), F.aggregate(covered, F.lit(0), lambda a, b: a + b)).otherwise(0)
    counts = {
        "n_words": F.size("_km_w"),
        "word_chars": F.length(F.array_join("_km_w", "")),
        "n_symbols": F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]+", "")),
        "n_dup_lines": F.size("_km_l") - F.size(F.array_distinct("_km_l")),
        "n_repeat_words": repeat,
        "n_lines": F.size("_km_l"),
        "n_upper": F.length(body) - F.length(F.regexp_replace(body, "[A-Z]+", "")),
    }
    return df.select(*(["_km_row.*"] if kept else []), *(c.cast("bigint").alias(n) for n, c in counts.items()))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _value(over: str, under: str) -> Column:
    return F.when(F.col(under) > 0, F.col(over).cast("double") / F.col(under)).otherwise(F.lit(0.0))


def _allowed(n: Column, level: Column) -> Column:
    """Largest k for which P(X <= k) <= level with X binomial (n, RISK); -1 if there is none."""
    odds, none = math.log(RISK / (1 - RISK)), math.log(1 - RISK)
    start = F.struct((n * none).alias("lp"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("bigint").alias("k"))

    def step(s: Column, i: Column) -> Column:
        cdf = s["cdf"] + F.exp(s["lp"])
        following = s["lp"] + F.ln((n - i).cast("double") / (i + 1)) + odds
        return F.struct(F.coalesce(following, F.lit(float("-inf"))).alias("lp"), cdf.alias("cdf"), F.when(cdf <= level, i).otherwise(s["k"]).alias("k"))

    counted = F.sequence(F.lit(0).cast("bigint"), F.floor(n * RISK).cast("bigint"))
    return F.aggregate(counted, start, step)["k"]


def certify(measured: DataFrame, labels: DataFrame, *, stratum: Column, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """One row a stratum with a cutoff for each rule, null where the rule is off.

    measured: documents with COUNTS. labels: id and 1 for good, 0 for bad; others are ignored, and of an id with
    several labels the worst counts. Rows with the same id are one trial, at their worst value, as the bound asks for independent ones.
    Without labels the result is empty.
    """
    tagged = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("_km_id")).agg(F.min(label).alias("_km_good"))
    marks = F.array(*(F.struct(F.lit(name).alias("rule"), sum((F.when(_value(a, b) > c, 1).otherwise(0) for c in LADDER), F.lit(0)).alias("above")) for name, a, b in RULES))
    seen = measured.filter(~base_failed()).select(F.col(f"`{id_col}`").alias("_km_id"), stratum.alias("stratum"), F.explode(marks).alias("m"))
    seen = seen.join(tagged, "_km_id").groupBy("_km_id", "stratum", F.col("m.rule").alias("rule")).agg(F.max("m.above").alias("above"), F.first("_km_good").alias("_km_good"))
    seen = seen.groupBy("stratum", "rule", "above").agg(F.sum("_km_good").cast("bigint").alias("good"), F.sum(1 - F.col("_km_good")).cast("bigint").alias("bad"))
    rungs = F.array(*(F.struct(F.lit(i).alias("rung"), F.lit(c).alias("cutoff")) for i, c in enumerate(LADDER)))
    # A document counts against every cutoff below its value: the first `above` rungs; rung -1 holds all.
    steps = seen.select("stratum", "rule", "above", "good", "bad", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("rung"), F.lit(-1.0).alias("cutoff"))), rungs)).alias("r"))
    lost = steps.groupBy("stratum", "rule", F.col("r.rung").alias("rung"), F.col("r.cutoff").alias("cutoff")).agg(
        F.sum(F.when(F.col("above") > F.col("r.rung"), F.col("good")).otherwise(0)).alias("good"), F.sum(F.when(F.col("above") > F.col("r.rung"), F.col("bad")).otherwise(0)).alias("bad")
    )
    held = lost.filter("rung = -1").groupBy("stratum").agg(F.max("good").alias("n"))
    tests = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) * len(RULES) * len(LADDER)
    held = held.withColumn("_km_level", F.lit(DELTA) / tests).select("stratum", _allowed(F.col("n"), F.col("_km_level")).alias("allowed"))
    fit = lost.filter("rung >= 0").join(held, "stratum").withColumn("score", F.col("bad") - PRICE * F.col("good"))
    fit = fit.filter((F.col("good") <= F.col("allowed")) & (F.col("score") > 0))
    best = fit.groupBy("stratum", "rule").agg(F.max(F.struct("score", "cutoff"))["cutoff"].alias("cutoff"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"cut_{name}") for name, _, _ in RULES))


def judged(measured: DataFrame, cutoffs: DataFrame, *, stratum: Column) -> DataFrame:
    """measured plus base_failed, failed_rules (comma-joined) and kept."""
    few = cutoffs.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    joined = measured.withColumn("_km_in", stratum).join(F.broadcast(cutoffs) if few else cutoffs, F.col("_km_in") == F.col("stratum"), "left")
    failed = F.concat_ws(",", *(F.when(_value(a, b) > F.col(f"cut_{name}"), F.lit(name)) for name, a, b in RULES))
    joined = joined.withColumns({"base_failed": base_failed(), "failed_rules": failed})
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "")).drop("_km_in", "stratum", *(f"cut_{name}" for name, _, _ in RULES))


def lang_stratum() -> Column:
    return F.coalesce(F.col("lang"), F.lit(""))


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that fail, same columns. Null and short texts fail the base rule; repeated rows are judged
    alike; an empty table stays empty. Signals and rows are written once to the shared folder, then read twice."""
    hidden = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_km_row"), F.col("doc_id"), F.col("text"), lang_stratum().alias("lang"))
    measured = stored(signals(hidden).drop("text"), "quality")
    passed = judged(measured, cut(certify(measured, labels, stratum=lang_stratum())), stratum=lang_stratum()).filter("kept")
    return passed.select("_km_row.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = cut(signals(docs).drop("text"))
    cutoffs = cut(certify(measured, table(spark, sf_dir, "labels"), stratum=lang_stratum()))
    out = judged(measured, cutoffs, stratum=lang_stratum())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def oracle() -> str:
    value = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0 END"
    values = " UNION ALL ".join(f"SELECT id, doc_id, stratum, base_failed, '{n}' AS rule, {value(a, b)} AS v FROM m" for n, a, b in RULES)
    ladder = ", ".join(f"CAST({c} AS DOUBLE)" for c in LADDER)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS stratum FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) > {WINDOW})),
r AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT id, CAST(sum(least({WINDOW}, n - i)) AS BIGINT) AS c FROM (SELECT id, i, coalesce(lead(i) OVER (PARTITION BY id ORDER BY i), i + {WINDOW}) AS n FROM r) GROUP BY id),
s AS (SELECT w.id, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  coalesce(c.c, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper FROM w LEFT JOIN c ON c.id = w.id),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s),
v AS ({values}),
q AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
t AS (SELECT stratum, rule, unnest([{ladder}]) AS cutoff, v, good FROM (SELECT doc_id, stratum, rule, max(v) AS v, good FROM v JOIN q USING (doc_id) WHERE NOT base_failed GROUP BY ALL)),
lost AS (SELECT stratum, rule, cutoff, count(*) FILTER (v > cutoff AND good = 1) AS good, count(*) FILTER (v > cutoff AND good = 0) AS bad, count(*) FILTER (good = 1) AS n FROM t GROUP BY ALL),
n AS (SELECT stratum, max(n) AS n, CAST({DELTA} AS DOUBLE) / (count(*) OVER () * {len(RULES) * len(LADDER)}) AS level FROM lost GROUP BY stratum),
p AS (SELECT stratum, n, level, i, sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))) OVER (PARTITION BY stratum ORDER BY i) AS cdf
  FROM (SELECT stratum, n, level, unnest(range(CAST(floor(n * {RISK}) AS BIGINT) + 1)) AS i FROM n)),
a AS (SELECT stratum, max(i) FILTER (cdf <= level) AS allowed FROM p GROUP BY stratum),
b AS (SELECT stratum, rule, arg_max(cutoff, (bad - {PRICE} * good, cutoff)) AS cutoff FROM lost JOIN a USING (stratum) WHERE good <= allowed AND bad - {PRICE} * good > 0 GROUP BY ALL),
f AS (SELECT v.id, string_agg(v.rule, ',' ORDER BY list_position({[n for n, _, _ in RULES]!r}, v.rule)) AS failed_rules FROM v JOIN b ON b.stratum = v.stratum AND b.rule = v.rule WHERE v.v > b.cutoff GROUP BY v.id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND f.id IS NULL AS kept, coalesce(failed_rules, '') AS failed_rules FROM m LEFT JOIN f ON f.id = m.id"""
