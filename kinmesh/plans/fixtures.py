"""Business records and ground truth derived from the documents table, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.functions.text import fold_latin, normalise
from kinmesh.sources.writers import stored


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang and a document's first words, four (nm) and the eight after them (ad), stored: documents are read and cut up once, whatever is made of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    # Only the first twelve words are looked at: the split stops there, and letters are folded after it.
    cut = F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), r"\s+", 13)
    folded = lambda first, n: fold_latin(F.lower(F.array_join(F.slice("a", first, n), " ")))
    return stored(docs.select("doc_id", "lang", cut.alias("a")).select("doc_id", "lang", folded(1, 4).alias("nm"), folded(5, 8).alias("ad")), "words")


def records(spark: SparkSession, sf_dir: str, x: DataFrame | None = None) -> DataFrame:
    """entity_id, business_name, business_address, country, match_key: names and addresses from a document's first words. x: words(), where a query has them already."""
    x = words(spark, sf_dir) if x is None else x
    owner = (F.col("doc_id") % 3 == 0).cast("int")
    # Of first-source records with the same name and country the first stays.
    firsts = x.filter(owner == 1).groupBy("lang", "nm").agg(F.min("doc_id").alias("doc_id"))
    x = x.filter(owner == 0).unionByName(x.join(firsts.select("doc_id"), "doc_id", "left_semi"))
    kind = lambda n, endings: _case(F.col("doc_id") % n, endings)
    return x.select(
        F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), F.greatest(F.lit(6), F.length(F.col("doc_id").cast("string"))), "0")).alias("entity_id"),
        F.concat("nm", kind(5, (" Corporation", " Private Limited", " S.A.R.L.", " & Company"))).alias("business_name"),
        F.concat((F.length("nm") * 37 % 997).cast("string"), F.lit(" "), "ad", kind(4, (" Street", " Road", " (Avenue)"))).alias("business_address"),
        F.upper("lang").alias("country"),
        F.col("nm").alias("match_key"),
    )


def _case(value: Column, endings: tuple[str, ...]) -> Column:
    out = F
    for i, e in enumerate(endings):
        out = out.when(value == i, e)
    return out.otherwise("")


def first_source(df: DataFrame) -> DataFrame:
    return df.filter(F.startswith("entity_id", F.lit("S1-")))


def secondary(df: DataFrame) -> DataFrame:
    return df.filter(~F.startswith("entity_id", F.lit("S1-")))


def normalised(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = normalise(records(spark, sf_dir))
    return first_source(df), secondary(df)


def stored_records(spark: SparkSession, sf_dir: str, x: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """normalised(), made once for the many branches of a plan, as a run's first stage does."""
    df = stored(normalise(records(spark, sf_dir, x)), "records")
    return first_source(df), secondary(df)


def truth(spark: SparkSession, sf_dir: str, x: DataFrame | None = None) -> DataFrame:
    df = records(spark, sf_dir, x)
    a = first_source(df).select(F.col("entity_id").alias("s1_id"), "country", "match_key")
    b = secondary(df).select(F.col("entity_id").alias("cand_id"), "country", "match_key")
    return a.join(b, ["country", "match_key"]).select("s1_id", "cand_id")


def entities(spark: SparkSession, sf_dir: str, x: DataFrame | None = None) -> DataFrame:
    return first_source(records(spark, sf_dir, x)).select(F.col("entity_id").alias("s1_id"), F.lower("country").alias("country_norm"))


SQL_RECORDS = r"""
t0 AS (SELECT doc_id, lang, string_split(trim(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '\s+', ' ', 'g')), ' ') AS a FROM documents),
w0 AS (SELECT doc_id, lang, array_to_string(a[1:4], ' ') AS nm, array_to_string(a[5:12], ' ') AS ad FROM t0),
x0 AS (SELECT *, CAST(length(nm) * 37 % 997 AS BIGINT) AS hn FROM w0),
recs AS (SELECT 'S' || (doc_id % 3 + 1) || '-' || lpad(CAST(doc_id AS VARCHAR), greatest(6, length(CAST(doc_id AS VARCHAR)))::INT, '0') AS entity_id,
  nm || CASE doc_id % 5 WHEN 0 THEN ' Corporation' WHEN 1 THEN ' Private Limited' WHEN 2 THEN ' S.A.R.L.' WHEN 3 THEN ' & Company' ELSE '' END AS business_name,
  hn || ' ' || ad || CASE doc_id % 4 WHEN 0 THEN ' Street' WHEN 1 THEN ' Road' WHEN 2 THEN ' (Avenue)' ELSE '' END AS business_address,
  upper(lang) AS country, nm AS match_key FROM x0
  WHERE NOT (doc_id % 3 = 0 AND EXISTS (SELECT 1 FROM x0 AS y WHERE y.doc_id % 3 = 0 AND y.lang = x0.lang AND y.nm = x0.nm AND y.doc_id < x0.doc_id)))"""


def _sql_words(expr: str, mapping: dict[str, str]) -> str:
    for word in sorted(mapping, key=len, reverse=True):
        expr = rf"regexp_replace({expr}, '\b{word.replace('.', chr(92) + '.')}\b', '{mapping[word]}', 'g')"
    return expr


def sql_norm() -> str:
    from kinmesh.functions.text import ADDRESS_WORDS, DOTTED_FORMS, LEGAL_WORDS

    opened = lambda c: rf"replace(replace(regexp_replace(lower(coalesce({c}, '')), '[\[\](){{}}]', ' ', 'g'), '&', ' and '), '+', ' and ')"
    name = opened("business_name")
    for form in sorted(DOTTED_FORMS, key=len, reverse=True):
        name = f"replace({name}, '{form}', '{DOTTED_FORMS[form]}')"
    name = _sql_words(name, LEGAL_WORDS)
    name = rf"regexp_replace(regexp_replace({name}, '\.(com|org|net|in|fr|co\.in)$', ''), '\bco\.(\s|$)', 'co\1', 'g')"
    squeeze = lambda e: rf"trim(regexp_replace({e}, '\s+', ' ', 'g'))"
    return rf"""
n0 AS (SELECT *, {squeeze(name)} AS name_clean, {squeeze(_sql_words(opened('business_address'), ADDRESS_WORDS))} AS addr_clean, lower(trim(country)) AS country_norm FROM recs),
norm AS (SELECT *, name_clean || ' ' || addr_clean AS combined, array_to_string(list_sort(list_distinct(regexp_extract_all(addr_clean, '\d+')))[1:5], ' ') AS addr_nums_str,
  CASE WHEN len(list_filter(string_split(name_clean, ' '), lambda x: x <> '')) >= 2 THEN array_to_string(list_sort(list_filter(string_split(name_clean, ' '), lambda x: x <> ''))[1:3], ' ') ELSE '' END AS name_sorted_3tok FROM n0),
s1 AS (SELECT * FROM norm WHERE entity_id LIKE 'S1-%'), pool AS (SELECT * FROM norm WHERE entity_id NOT LIKE 'S1-%'),
truth AS (SELECT s1.entity_id AS s1_id, pool.entity_id AS cand_id FROM s1 JOIN pool ON s1.country = pool.country AND s1.match_key = pool.match_key),
ent AS (SELECT DISTINCT entity_id AS s1_id, country_norm FROM s1)"""
