"""Queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.config import Config
from kinmesh.functions import text, text_v1
from kinmesh.operators import blocking, decide, evaluate, features, ivf, neighbours, tfidf, training, validate
from kinmesh.plans import feature_sql as fq
from kinmesh.plans import first_generation
from kinmesh.plans import fixtures as fx
from kinmesh.sources import readers, samples, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Pair score of the flagship query: the mean of three built-in similarities.
LINEAR = ("name_lev", "name_jac", "name_lr")
THRESHOLD, SINGLETON = 0.7, 0.4
SEED = 42


def query(name: str, sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = "WITH " + ",".join(c for c in (fx.SQL_RECORDS, fx.sql_norm(), ctes) if c) + "\n" + sql
        return f

    return register


# --- Normalisation ---------------------------------------------------------------------------------------------------


def _norm_query(name: str, column: str) -> None:
    @query(name, f"SELECT entity_id, {column} FROM norm")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return text.normalise(fx.records(spark, sf_dir)).select("entity_id", column)


for _name, _column in (("norm_name_clean", "name_clean"), ("norm_addr_clean", "addr_clean"), ("norm_country", "country_norm"), ("norm_addr_nums", "addr_nums_str"), ("norm_sorted_3tok", "name_sorted_3tok"), ("norm_combined", "combined")):
    _norm_query(_name, _column)

# Raw names and what one pass over them must give. Fixed values.
EDGES = (
    ("Acme Private Limited", "acme pvt ltd"), ("Acme Inc.", "acme inc."), ("inc.limited x", "incltd x"), ("limited.x foo inc.", "ltd.x foo inc."), ("Acme L.L.C.", "acme llc"),
    ("john.a", "johna"), ("shop.co.in", "shop"), ("Foo & Bar + Baz (X)", "foo and bar and baz x"), ("Smith Co. Trading", "smith co trading"), (None, ""),
)


#: Each record's name as one word, and one of EDGES after it, in turn.
_WORD = "concat('q', regexp_replace(lower(business_name), '[^a-z]', ''))"


@query(
    "legal_map_replace",
    f"""SELECT entity_id, CASE WHEN raw IS NULL THEN '' ELSE {_WORD.replace("'')", "'', 'g')")} || ' ' || clean END AS clean FROM norm
  JOIN (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {'NULL' if a is None else repr(a)}, {b!r})" for i, (a, b) in enumerate(EDGES)) + f""") AS v(i, raw, clean)) ON CAST(substr(entity_id, 4) AS INT) % {len(EDGES)} = i""",
)
def legal_map_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = F.array(*(F.lit(a) if a is not None else F.lit(None).cast("string") for a, _ in EDGES))
    raw = F.concat(F.expr(_WORD), F.lit(" "), F.get(edges, F.substring("entity_id", 4, 20).cast("int") % len(EDGES)))
    return fx.records(spark, sf_dir).select("entity_id", text.clean_name(raw).alias("clean"))


@query("domain_strip", r"SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '\.(com|org|net|in|fr|co\.in)$', '') AS stripped FROM pages")
def domain_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/?#:]+)", 1)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host.alias("host"), F.regexp_replace(host, text.DOMAIN_SUFFIX, "").alias("stripped"))


def _sql_forms(column: str, forms: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in forms.items())
    return rf"array_to_string(list_transform(list_filter(string_split({column}, ' '), lambda x: x <> ''), lambda x: CASE regexp_replace(x, '[^\w\s]', '', 'g') {cases} ELSE x END), ' ')"


_V1 = rf"""
v0 AS (SELECT entity_id, country_norm, regexp_replace(trim(regexp_replace(replace(replace(regexp_replace(lower(business_name), '[\[\](){{}}]', ' ', 'g'), '&', ' and '), '+', ' and '), '\s+', ' ', 'g')), '\.(com|org|net|in|fr|co\.in)$', '') AS nm,
  trim(regexp_replace(replace(replace(regexp_replace(lower(business_address), '[\[\](){{}}]', ' ', 'g'), '&', ' and '), '+', ' and '), '\s+', ' ', 'g')) AS ad FROM norm),
v1 AS (SELECT *, {_sql_forms('nm', text_v1.LEGAL_FORMS)} AS name_norm, {_sql_forms('ad', text_v1.ADDRESS_FORMS)} AS addr_norm FROM v0),
v2 AS (SELECT *, list_sort(list_distinct(regexp_extract_all(addr_norm, '\d+'))) AS nums, list_distinct(regexp_extract_all(name_norm, '\w+')) AS toks,
  array_to_string(regexp_extract_all(name_norm, '[bcdfghjklmnpqrstvwxyz_]')[1:4], '') || CASE WHEN regexp_matches(name_norm, '\d') THEN '_' || regexp_extract(name_norm, '(\d+)', 1) ELSE '' END AS name_key FROM v1)"""


@query("norm1_names", "SELECT entity_id, name_norm, addr_norm FROM v1", _V1)
def norm1_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_v1.normalise_v1(fx.records(spark, sf_dir)).select("entity_id", "name_norm", "addr_norm")


@query("norm1_keys", "SELECT entity_id, name_key, array_to_string(nums[1:3], '_') AS address_key FROM v2", _V1)
def norm1_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.records(spark, sf_dir).select("entity_id", text_v1.name_key(F.col("business_name")).alias("name_key"), text_v1.address_key(F.col("business_address"), F.col("country")).alias("address_key"))


@query("norm1_tokens", "SELECT entity_id, array_to_string(list_sort(toks), ' ') AS name_tokens, CAST(len(nums) AS BIGINT) AS n_numbers FROM v2", _V1)
def norm1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_v1.normalise_v1(fx.records(spark, sf_dir)).select("entity_id", F.array_join(F.sort_array("name_tokens"), " ").alias("name_tokens"), F.size("addr_nums").cast("bigint").alias("n_numbers"))


def _sql_chain() -> str:
    opened = lambda c: rf"replace(replace(regexp_replace(lower({c}), '[\[\](){{}}]', ' ', 'g'), '&', ' and '), '+', ' and ')"
    name, address = opened("business_name"), opened("business_address")
    for pattern, plain in text_v1._NAME_CHAIN:
        name = f"regexp_replace({name}, '{pattern}', '{plain}', 'g')" if "(?=" not in pattern else rf"regexp_replace({name}, '\bco\.(\s|$)', 'co\1', 'g')"
    for word, plain in text.ADDRESS_WORDS.items():
        address = rf"regexp_replace({address}, '\b{word.replace('.', chr(92) + '.')}" + ("" if word.endswith(".") else r"\b") + f"', '{plain}', 'g')"
    return rf"SELECT entity_id, trim(regexp_replace({name}, '\s+', ' ', 'g')) AS name_clean, trim(regexp_replace({address}, '\s+', ' ', 'g')) AS addr_clean FROM recs"


@query("norm_chain", _sql_chain())
def norm_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_v1.chain_normalise(fx.records(spark, sf_dir)).select("entity_id", "name_clean", "addr_clean")


# --- Sources and sets ------------------------------------------------------------------------------------------------


@query("gt_explode", "SELECT s1_id, cand_id FROM truth")
def gt_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth as comma lists, parsed back."""
    lists = writers.match_lists(fx.entities(spark, sf_dir), fx.truth(spark, sf_dir))
    return readers.parse_truth(lists)


@query("match_lists", "SELECT s1_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '') AS matched_entity_ids FROM ent LEFT JOIN truth USING (s1_id) GROUP BY s1_id")
def match_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.match_lists(fx.entities(spark, sf_dir), fx.truth(spark, sf_dir))


@query("pool_union_distinct", "SELECT substr(entity_id, 1, 2) AS source, country_norm, count(*) AS n FROM pool GROUP BY ALL")
def pool_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pool = fx.normalised(spark, sf_dir)
    s2, s3 = (pool.filter(F.startswith("entity_id", F.lit(p))) for p in ("S2-", "S3-"))
    return readers.union_pool(s2, s3, s2).groupBy(F.substring("entity_id", 1, 2).alias("source"), "country_norm").agg(F.count(F.lit(1)).alias("n"))


@query("pool_must_have_semi", "SELECT entity_id FROM pool WHERE entity_id IN (SELECT cand_id FROM truth)")
def pool_must_have_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pool = fx.normalised(spark, sf_dir)
    return pool.join(fx.truth(spark, sf_dir).select(F.col("cand_id").alias("entity_id")), "entity_id", "left_semi").select("entity_id")


@query("pool_rest_anti", "SELECT entity_id FROM pool WHERE entity_id NOT IN (SELECT cand_id FROM truth)")
def pool_rest_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pool = fx.normalised(spark, sf_dir)
    return pool.join(fx.truth(spark, sf_dir).select(F.col("cand_id").alias("entity_id")), "entity_id", "left_anti").select("entity_id")


@query("pool_sampled", f"SELECT entity_id FROM (SELECT entity_id, m, row_number() OVER (PARTITION BY m, country_norm ORDER BY substr(entity_id, 1, 2), md5(entity_id || '|{SEED}'), entity_id) AS r FROM (SELECT *, entity_id IN (SELECT cand_id FROM truth) AS m FROM pool)) WHERE m OR r <= 20")
def pool_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pool = fx.normalised(spark, sf_dir)
    return samples.sample_pool(pool, fx.truth(spark, sf_dir).select(F.col("cand_id").alias("entity_id")), 20, SEED).select("entity_id")


@query("pool_bernoulli", f"SELECT entity_id FROM pool WHERE entity_id IN (SELECT cand_id FROM truth) OR CAST('0x' || substr(md5(entity_id || '|{SEED}'), 1, 8) AS BIGINT) / 4294967296.0 < 0.25")
def pool_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pool = fx.normalised(spark, sf_dir)
    return samples.bernoulli_pool(pool, fx.truth(spark, sf_dir).select(F.col("cand_id").alias("entity_id")), 0.25, SEED).select("entity_id")


@query("s1_sample", f"SELECT entity_id FROM s1 ORDER BY md5(entity_id || '|{SEED}'), entity_id LIMIT 50")
def s1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, _ = fx.normalised(spark, sf_dir)
    return samples.sample_ids(s1.select("entity_id"), 50, SEED)


@query("country_counts", "SELECT country_norm, count(*) AS n FROM norm GROUP BY ALL")
def country_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.normalise(fx.records(spark, sf_dir)).groupBy("country_norm").agg(F.count(F.lit(1)).alias("n"))


@query("country_restricted_pool", "SELECT entity_id FROM pool WHERE country_norm IN (SELECT country_norm FROM s1 WHERE country_norm <> 'en')")
def country_restricted_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, pool = fx.normalised(spark, sf_dir)
    return samples.restrict_to_countries(pool, s1.filter("country_norm <> 'en'")).select("entity_id")


@query("id_prefix_counts", "SELECT substr(c_name, 1, 10) AS prefix, count(*) AS n FROM customer GROUP BY ALL")
def id_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.substring("c_name", 1, 10).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


# --- Blocking --------------------------------------------------------------------------------------------------------


def _sql_key(name: str, key: str, has: str, cap: int | None = 100, source: str = "", ident: str = "entity_id") -> str:
    s, p = (source or "s1"), (source or "pool")
    left = f"SELECT {ident} AS s1_id, country_norm, {key} AS k FROM {s} WHERE {has}" + (" AND entity_id LIKE 'S1-%'" if source else "")
    right = f"SELECT {ident} AS cand_id, country_norm, {key} AS k, row_number() OVER (PARTITION BY country_norm, {key} ORDER BY {ident}) AS r FROM {p} WHERE {has}" + (" AND entity_id NOT LIKE 'S1-%'" if source else "")
    return f"{name} AS (SELECT DISTINCT s1_id, cand_id FROM ({left}) AS a JOIN ({right}) AS b USING (country_norm, k)" + ("" if cap is None else f" WHERE r <= {cap}") + ")"


_KEYS = {
    "prefix5": _sql_key("prefix5", "substr(name_clean, 1, 5)", "length(name_clean) >= 3"),
    "prefix4": _sql_key("prefix4", "substr(name_clean, 1, 4)", "length(name_clean) >= 3"),
    "sorted3": _sql_key("sorted3", "name_sorted_3tok", "name_sorted_3tok <> ''"),
    "addr_nums": _sql_key("addr_nums", "addr_nums_str", "addr_nums_str <> ''"),
}
_ALL_KEYS = ",".join(_KEYS.values())
_TAGGED = _ALL_KEYS + ", tagged AS (" + " UNION ALL ".join(f"SELECT '{k}' AS strategy, * FROM {k}" for k in _KEYS) + "), uni AS (SELECT DISTINCT s1_id, cand_id FROM tagged)"


#: Strategies whose own query gives all partners of a key.
_WHOLE = {"addr_nums": _sql_key("addr_nums", "addr_nums_str", "addr_nums_str <> ''", None)}


def _key_query(strategy: str) -> None:
    @query(f"block_{strategy}", f"SELECT * FROM {strategy}", _WHOLE.get(strategy, _KEYS[strategy]))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return blocking.key_pairs(*fx.stored_records(spark, sf_dir), None if strategy in _WHOLE else 100, strategy).select("s1_id", "cand_id")


for _name in _KEYS:
    _key_query(_name)


@query("block_union", "SELECT * FROM uni", _TAGGED)
def block_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.key_pairs(*fx.stored_records(spark, sf_dir)).select("s1_id", "cand_id")


@query("block_v1_keys", "SELECT 'name_key' AS strategy, * FROM nk UNION ALL SELECT 'addr_nums', * FROM an", _V1 + "," + _sql_key("nk", "name_key", "name_key <> ''", 50, "v2") + "," + _sql_key("an", "array_to_string(nums[1:3], '_')", "len(nums) > 0", 50, "v2"))
def block_v1_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = text_v1.normalise_v1(fx.records(spark, sf_dir))
    return blocking.tagged(blocking.block_keys_v1(fx.first_source(df), fx.secondary(df)))


@query("block_monolith_keys", "SELECT 'prefix5' AS strategy, * FROM p5 UNION ALL SELECT 'addr_nums', * FROM an", _sql_key("p5", "substr(name_clean, 1, 5)", "length(name_clean) >= 3", 50) + "," + _sql_key("an", "addr_nums_str", "addr_nums_str <> ''", 50))
def block_monolith_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.tagged(blocking.block_keys_monolith(*fx.normalised(spark, sf_dir)))


@query(
    "block_token_overlap",
    """SELECT s1_id, cand_id FROM (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, len(list_intersect(a.toks, b.toks)) AS n, len(a.nums) > 0 AND len(b.nums) > 0 AS two, len(list_intersect(a.nums, b.nums)) AS m
  FROM v2 AS a JOIN v2 AS b ON a.country_norm = b.country_norm WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%') WHERE CASE WHEN two THEN n >= 1 AND m >= 1 ELSE n >= 2 END""",
    _V1,
)
def block_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = text_v1.normalise_v1(fx.records(spark, sf_dir))
    return blocking.token_overlap(fx.first_source(df), fx.secondary(df))


def _sql_tfidf(column: str, kind: str, max_df: float | None, features: int, fitted: str = "", s1: str = "s1", pool: str = "pool") -> str:
    """fitted: how ids of the records begin that vocabulary and idf come from."""
    if kind == "char":
        terms = lambda t: f"""SELECT entity_id AS d, country_norm AS c, substr(p, CAST(i AS BIGINT), n) AS term FROM (SELECT entity_id, country_norm, p, n, unnest(range(1, length(p) - n + 2)) AS i
  FROM (SELECT entity_id, country_norm, ' ' || unnest(list_filter(string_split({column}, ' '), lambda x: x <> '')) || ' ' AS p FROM {t}), (VALUES (2), (3), (4)) AS v(n) WHERE length(p) >= n)"""  # noqa: E731
    else:
        terms = lambda t: rf"""SELECT d, c, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT entity_id AS d, country_norm AS c, regexp_extract_all(lower({column}), '\b\w\w+\b') AS w FROM {t})"""
    prune = f"WHERE df <= {max_df} * n" if max_df is not None else ""
    return f"""
pc AS (SELECT d, c, term, count(*) AS tf FROM ({terms(pool)}) GROUP BY ALL), qc AS (SELECT d, c, term, count(*) AS tf FROM ({terms(s1)}) GROUP BY ALL),
sz AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {pool} WHERE entity_id LIKE '{fitted}%'),
voc AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM pc WHERE d LIKE '{fitted}%' GROUP BY term), sz {prune} ORDER BY total DESC, term LIMIT {features}),
pr AS (SELECT d, c, term, (1 + ln(tf)) * idf AS x FROM pc JOIN voc USING (term)), qr AS (SELECT d, c, term, (1 + ln(tf)) * idf AS x FROM qc JOIN voc USING (term)),
pw AS (SELECT d, c, term, x / sqrt(sum(x * x) OVER (PARTITION BY d)) AS w FROM pr), qw AS (SELECT d, c, term, x / sqrt(sum(x * x) OVER (PARTITION BY d)) AS w FROM qr),
sc AS (SELECT qw.d AS s1_id, pw.d AS cand_id, round(sum(qw.w * pw.w), 5) AS score FROM qw JOIN pw USING (c, term) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS rank FROM sc WHERE score > 0)"""


def _tfidf_query(name: str, kind: str, column: str, max_df: float | None, features: int, k: int) -> None:
    @query(name, f"SELECT s1_id, cand_id, score, rank FROM top WHERE rank <= {k}", _sql_tfidf(column, "word" if kind == "word" else "char", max_df, features))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tfidf.retrieve(*fx.stored_records(spark, sf_dir), kind, k=k, max_df=max_df, max_features=features)


_tfidf_query("tfidf_char_topk", "char", "combined", 0.05, 200_000, 30)
_tfidf_query("tfidf_word_topk", "word", "combined", None, 100_000, 30)
_tfidf_query("tfidf_name_topk", "name", "name_clean", 0.05, 200_000, 30)
_tfidf_query("tfidf_char_topk_v1", "char", "combined", None, 200_000, 20)


_FIRST = "SELECT entity_id, country_norm, trim(name_norm || ' ' || addr_norm) AS combined FROM v2 WHERE entity_id"


@query(
    "first_candidates", "SELECT s1_id, cand_id FROM nk UNION SELECT s1_id, cand_id FROM an UNION SELECT s1_id, cand_id FROM top WHERE rank <= 20",
    ",".join((_V1, _sql_key("nk", "name_key", "name_key <> ''", 50, "v2"), _sql_key("an", "array_to_string(nums[1:3], '_')", "len(nums) > 0", 50, "v2"), f"q1 AS ({_FIRST} LIKE 'S1-%'), p1 AS ({_FIRST} NOT LIKE 'S1-%')", _sql_tfidf("combined", "char", None, 200_000, s1="q1", pool="p1"))),
)
def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = writers.stored(text_v1.normalise_v1(fx.records(spark, sf_dir)), "records")
    return first_generation.candidates(fx.first_source(df), fx.secondary(df), 0)


@query("tfidf_char_weights", "SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM voc", _sql_tfidf("combined", "char", 0.05, 200_000))
def tfidf_char_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tfidf.fit(fx.normalised(spark, sf_dir)[1])
    return index.vocabulary.select("term", "df", F.round("idf", 6).alias("idf"))


_CHEAP = """
txt AS (SELECT u.s1_id, u.cand_id, a.name_clean AS n1, a.addr_clean AS a1, b.name_clean AS n2, b.addr_clean AS a2, list_distinct(list_filter(string_split(a.name_clean, ' '), lambda x: x <> '')) AS t1,
  list_distinct(list_filter(string_split(b.name_clean, ' '), lambda x: x <> '')) AS t2 FROM uni AS u JOIN s1 AS a ON a.entity_id = u.s1_id JOIN pool AS b ON b.entity_id = u.cand_id),
jw AS (SELECT s1_id, cand_id, CASE WHEN n1 = '' AND n2 = '' THEN 1 WHEN n1 = '' OR n2 = '' THEN 0 ELSE jaro_winkler_similarity(n1, n2) END AS jn, CASE WHEN a1 = '' AND a2 = '' THEN 1 WHEN a1 = '' OR a2 = '' THEN 0 ELSE jaro_winkler_similarity(a1, a2) END AS ja,
  CASE WHEN len(t1) = 0 AND len(t2) = 0 THEN 1 WHEN len(t1) = 0 OR len(t2) = 0 THEN 0 ELSE CAST(len(list_intersect(t1, t2)) AS DOUBLE) / least(len(t1), len(t2)) END AS ov FROM txt),
ranked AS (SELECT s1_id, cand_id, score, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS rank, count(*) OVER (PARTITION BY s1_id) AS n FROM (SELECT s1_id, cand_id, round(0.45 * jn + 0.30 * ja + 0.25 * ov, 6) AS score FROM jw))"""


@query("prefilter_ranked", "SELECT s1_id, cand_id, score, rank FROM ranked", _TAGGED + "," + _CHEAP)
def prefilter_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, pool = fx.stored_records(spark, sf_dir)
    return blocking.ranked(blocking.key_pairs(s1, pool, texts=blocking.TEXTS))


def _prefilter_query(name: str, cap: int) -> None:
    @query(name, f"SELECT s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS r FROM ranked WHERE n <= {cap} OR score >= 0.15) WHERE n <= {cap} OR r <= {cap}", _TAGGED + "," + _CHEAP)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s1, pool = fx.stored_records(spark, sf_dir)
        return blocking.prefilter_on_keys(s1, pool, cap=cap)


# The second has the default cap of a run; on the smaller tables nobody has more than 100 candidates, so the first tests the cut.
_prefilter_query("prefilter_topk", 10)
_prefilter_query("prefilter_top100", 100)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("entity_id"), F.col("label").cast("string").alias("country_norm"), "embedding")
    return v.filter("entity_id % 50 = 0"), v


@query(
    "dense_topk_exact",
    """SELECT s1_id, cand_id, score, rank FROM (SELECT s1_id, cand_id, score, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS rank FROM
  (SELECT a.vec_id AS s1_id, b.vec_id AS cand_id, round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)), 5) AS score FROM e AS a JOIN e AS b USING (label) WHERE a.vec_id % 50 = 0)) WHERE rank <= 10""",
    "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
)
def dense_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.dense_top_k(*_vectors(spark, sf_dir), k=10)


@query("dense_topk_lsh")
def dense_topk_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.dense_probe(*_vectors(spark, sf_dir), k=10)


@query("dense_topk_ivf")
def dense_topk_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.top_k(*_vectors(spark, sf_dir), k=10)


@query("minhash_pairs")
def minhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.lsh_pairs(*fx.stored_records(spark, sf_dir))


_SHINGLES = lambda c: f"CASE WHEN length({c}) >= 3 THEN list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3))) ELSE [] END"


@query(
    "minhash_similar",
    "SELECT * FROM (SELECT s1_id, cand_id, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))), 6) AS score FROM ga JOIN gb USING (country_norm) WHERE len(a) > 0 AND len(b) > 0) WHERE score >= 0.6",
    f"ga AS (SELECT entity_id AS s1_id, country_norm, {_SHINGLES('combined')} AS a FROM s1), gb AS (SELECT entity_id AS cand_id, country_norm, {_SHINGLES('combined')} AS b FROM pool)",
)
def minhash_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found by bands, verified exactly; SQL compares all pairs of a country."""
    s1, pool = fx.stored_records(spark, sf_dir)
    return neighbours.lsh_similar(s1, pool, at_least=0.6)


# --- Blocking evaluation ---------------------------------------------------------------------------------------------

def _sql_eval(pred: str) -> str:
    return f"""
e AS (SELECT s1_id, country_norm, (SELECT count(*) FROM truth AS t WHERE t.s1_id = ent.s1_id) AS nt, (SELECT count(*) FROM {pred} AS p WHERE p.s1_id = ent.s1_id) AS np,
  (SELECT count(*) FROM truth AS t JOIN {pred} AS p USING (s1_id, cand_id) WHERE t.s1_id = ent.s1_id) AS tp FROM ent),
ev AS (SELECT *, round(CASE WHEN nt = 0 AND np = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (CAST(tp AS DOUBLE) / np) * (CAST(tp AS DOUBLE) / nt) / (0.25 * (CAST(tp AS DOUBLE) / np) + CAST(tp AS DOUBLE) / nt) END, 6) AS f FROM e)"""


_RECALL = "round(CAST(sum(tp) AS DOUBLE) / sum(nt), 6) AS pair_recall, round(avg(CASE WHEN tp = nt THEN 1.0 ELSE 0.0 END), 6) AS entity_recall"


@query("recall_pair_entity", f"SELECT {_RECALL} FROM ev WHERE nt > 0", _TAGGED + "," + _sql_eval("uni"))
def recall_pair_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fx.words(spark, sf_dir)
    pairs = blocking.key_pairs(*fx.stored_records(spark, sf_dir, x)).select("s1_id", "cand_id")
    return evaluate.recall(fx.entities(spark, sf_dir, x), fx.truth(spark, sf_dir, x), pairs, once=True)


@query("cands_mean_p95", "SELECT round(avg(np), 6) AS mean, round(quantile_cont(np, 0.95), 6) AS p95 FROM e", _TAGGED + "," + _sql_eval("uni"))
def cands_mean_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.candidate_sizes(fx.entities(spark, sf_dir), block_union(spark, sf_dir), once=True)


@query(
    "recall_unique_by_strategy",
    """SELECT strategy, round(coalesce(n, 0) / (SELECT CAST(count(*) AS DOUBLE) FROM truth), 6) AS unique_recall FROM (SELECT DISTINCT strategy FROM tagged) LEFT JOIN
  (SELECT strategy, count(*) AS n FROM (SELECT min(strategy) AS strategy FROM tagged JOIN truth USING (s1_id, cand_id) GROUP BY s1_id, cand_id HAVING count(DISTINCT strategy) = 1) GROUP BY ALL) USING (strategy)""",
    _TAGGED,
)
def recall_unique_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.unique_recall_of(fx.truth(spark, sf_dir), blocking.key_pairs(*fx.stored_records(spark, sf_dir)))


@query("cap_recall_curve", "SELECT CAST(cap AS BIGINT) AS cap, round((SELECT count(*) FROM ranked JOIN truth USING (s1_id, cand_id) WHERE rank <= cap) / (SELECT CAST(count(*) AS DOUBLE) FROM truth), 6) AS recall FROM (VALUES (10), (25), (50), (75), (100), (150), (200)) AS c(cap)", _TAGGED + "," + _CHEAP)
def cap_recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cap_curve(fx.truth(spark, sf_dir), prefilter_ranked(spark, sf_dir))


_REPORT = ",".join(
    f"e_{k} AS (SELECT ent.s1_id, coalesce(nt, 0) AS nt, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp FROM ent LEFT JOIN (SELECT s1_id, count(*) AS nt FROM truth GROUP BY ALL) USING (s1_id) LEFT JOIN (SELECT s1_id, count(*) AS np FROM {k} GROUP BY ALL) USING (s1_id) LEFT JOIN (SELECT s1_id, count(*) AS tp FROM {k} JOIN truth USING (s1_id, cand_id) GROUP BY ALL) USING (s1_id))"
    for k in (*_KEYS, "uni")
)


@query(
    "blocking_report",
    " UNION ALL ".join(
        f"SELECT '{'UNION' if k == 'uni' else k}' AS strategy, (SELECT round(CAST(sum(tp) AS DOUBLE) / sum(nt), 6) FROM e_{k} WHERE nt > 0) AS pair_recall, (SELECT round(avg(CASE WHEN tp = nt THEN 1.0 ELSE 0.0 END), 6) FROM e_{k} WHERE nt > 0) AS entity_recall, round(avg(np), 6) AS mean, round(quantile_cont(np, 0.95), 6) AS p95 FROM e_{k}"
        for k in (*_KEYS, "uni")
    ),
    _TAGGED + "," + _REPORT,
)
def blocking_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.blocking_report_of(fx.entities(spark, sf_dir), fx.truth(spark, sf_dir), blocking.key_pairs(*fx.stored_records(spark, sf_dir)), list(_KEYS))


# --- Features --------------------------------------------------------------------------------------------------------

_SET = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda x: x <> ''))"
_PAIRS = (
    _KEYS["prefix5"]
    + rf""",
px AS (SELECT p.s1_id, p.cand_id, a.name_clean AS n1, a.addr_clean AS a1, b.name_clean AS n2, b.addr_clean AS a2 FROM prefix5 AS p JOIN s1 AS a ON a.entity_id = p.s1_id JOIN pool AS b ON b.entity_id = p.cand_id),
fs AS (SELECT *, {_SET('n1')} AS nt1, {_SET('n2')} AS nt2, {_SET('a1')} AS at1, {_SET('a2')} AS at2, list_distinct(regexp_extract_all(a1, '\d+')) AS an1, list_distinct(regexp_extract_all(a2, '\d+')) AS an2 FROM px)"""
)
_both = lambda a, b: f"CAST(len(list_intersect({a}, {b})) AS DOUBLE)"
_jac = lambda a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {_both(a, b)} / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
_ovl = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {_both(a, b)} / least(len({a}), len({b})) END"
_dice = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE 2 * {_both(a, b)} / (len({a}) + len({b})) END"
_cont = lambda a, b: f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE {_both(a, b)} / len({a}) END"
_ends = lambda a, b, x: f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE {x} END"
_lr = lambda a, b: _ends(a, b, f"CAST(least(length({a}), length({b})) AS DOUBLE) / greatest(length({a}), length({b}))")
_lev = lambda a, b: _ends(a, b, f"1.0 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b}))")
_in = lambda a, b: _ends(a, b, f"CASE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN CAST(least(length({a}), length({b})) AS DOUBLE) / greatest(length({a}), length({b})) ELSE 0.0 END")
_jw = lambda a, b: _ends(a, b, f"jaro_winkler_similarity({a}, {b})")
_first = "CASE WHEN len(nt1) > 0 AND len(nt2) > 0 AND list_min(nt1) = list_min(nt2) THEN 1.0 ELSE 0.0 END"
_grams = lambda c: f"list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3)))"
_towns = lambda c: f"list_filter(list_distinct(regexp_extract_all({c}, '[a-z]{{3,}}')), lambda x: x NOT IN {features.NO_TOWN!r})"
_pins = lambda c: rf"regexp_extract_all({c}, '\b\d{{5,6}}\b')"
_minus = lambda a, b: f"list_filter({a}, lambda x: NOT list_contains({b}, x))"
FEATURE_SQL = {
    "name_lev": _lev("n1", "n2"), "name_jw": _jw("n1", "n2"), "name_jac": _jac("nt1", "nt2"), "name_ovl": _ovl("nt1", "nt2"), "name_dice": _dice("nt1", "nt2"), "name_cont12": _cont("nt1", "nt2"), "name_cont21": _cont("nt2", "nt1"),
    "name_first": _first, "name_lr": _lr("n1", "n2"), "name_contain": _in("n1", "n2"), "name_char3_jac": _jac(_grams("n1"), _grams("n2")), "name_first_sorted": _first,
    "name_tok_ratio": "CASE WHEN greatest(len(nt1), len(nt2)) > 0 THEN CAST(least(len(nt1), len(nt2)) AS DOUBLE) / greatest(len(nt1), len(nt2)) ELSE 0.0 END",
    "name_prefix3": "CASE WHEN length(n1) >= 3 AND length(n2) >= 3 AND substr(n1, 1, 3) = substr(n2, 1, 3) THEN 1.0 ELSE 0.0 END",
    "addr_lev": _lev("a1", "a2"), "addr_jw": _jw("a1", "a2"), "addr_jac": _jac("at1", "at2"), "addr_ovl": _ovl("at1", "at2"), "addr_dice": _dice("at1", "at2"), "addr_lr": _lr("a1", "a2"),
    "addr_nonum_jac": _jac(_minus("at1", "an1"), _minus("at2", "an2")), "addr_contain": _in("a1", "a2"), "anum_jac": _jac("an1", "an2"), "anum_ovl": _ovl("an1", "an2"),
    "anum_match12": f"CASE WHEN len(an1) > 0 THEN {_both('an1', 'an2')} / len(an1) WHEN len(an2) = 0 THEN 1.0 ELSE 0.5 END",
    "anum_first": "CASE WHEN len(an1) = 0 AND len(an2) = 0 THEN 1.0 WHEN len(an1) > 0 AND len(an2) > 0 AND list_min(an1) = list_min(an2) THEN 1.0 ELSE 0.0 END",
    "anum_cnt_diff": "abs(len(an1) - len(an2))", "comb_jac": _jac("list_distinct(list_concat(nt1, at1))", "list_distinct(list_concat(nt2, at2))"), "name_tok_diff": "abs(len(nt1) - len(nt2))",
    "comb_lev": _lev("(n1 || ' ' || a1)", "(n2 || ' ' || a2)"), "addr_pin_match": f"CASE WHEN len({_pins('a1')}) = 0 AND len({_pins('a2')}) = 0 THEN 1.0 WHEN list_has_any({_pins('a1')}, {_pins('a2')}) THEN 1.0 ELSE 0.0 END",
    "addr_city_ovl": _ovl(_towns("a1"), _towns("a2")), "addr_num_cnt_match": "1.0 / (1.0 + abs(len(an1) - len(an2)))",
}
FEATURE_GROUPS = {
    "feat_sets": ["name_jac", "name_ovl", "name_dice", "name_cont12", "name_cont21", "addr_jac", "addr_ovl", "addr_dice", "addr_nonum_jac", "comb_jac"],
    "feat_lev": ["name_lev", "addr_lev", "comb_lev", "name_lr", "addr_lr"],
    "feat_char3": ["name_char3_jac"],
    "feat_numbers": ["anum_jac", "anum_ovl", "anum_match12", "anum_first", "anum_cnt_diff", "addr_num_cnt_match"],
    "feat_first_prefix": ["name_first", "name_first_sorted", "name_prefix3", "name_tok_ratio", "name_tok_diff"],
    "feat_containment": ["name_contain", "addr_contain"],
    "feat_jaro_winkler": ["name_jw", "addr_jw"],
    "feat_pin_city": ["addr_pin_match", "addr_city_ovl"],
    "feat_indel_suite": [*fq.RATIOS],
    "feat_sequence": ["name_lcs"],
    "feat_phonetic": ["phon_soundex_match", "phon_soundex_jw", "phon_soundex_jac"],
    "feat_phonetic_codes": ["phon_metaphone_match", "phon_nysiis_match"],
}
_SOUNDS = {"phon_soundex_match": "CASE WHEN x1 <> '' AND x1 = x2 THEN 1.0 ELSE 0.0 END", "phon_soundex_jw": _jw("x1", "x2"), "phon_soundex_jac": _jac("y1", "y2")}


def pair_texts(spark: SparkSession, sf_dir: str, x: DataFrame | None = None) -> DataFrame:
    return blocking.key_pairs(*fx.stored_records(spark, sf_dir, x), only="prefix5", texts=blocking.TEXTS).drop("found")


def _feature_sql(names: list[str], known: dict[str, str], table: str) -> str | None:
    if not all(n in known for n in names):
        return None
    return "SELECT s1_id, cand_id, " + ", ".join(f"round(CAST({known[n]} AS DOUBLE), 6) AS {n}" for n in names) + f" FROM {table}"


def _feature_query(name: str, names: list[str]) -> None:
    table, more, known = "fs", "", FEATURE_SQL
    if set(names) & set(fq.RATIOS):
        table, more, known = "fr", "," + fq.RATIO_TABLES, FEATURE_SQL | {n: n for n in fq.RATIOS}
    elif set(names) & set(_SOUNDS):
        table, more, known = "fp", "," + fq.SOUND_TABLES, _SOUNDS

    @query(name, _feature_sql(names, known, table), _PAIRS + more)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = features.pair_features(pair_texts(spark, sf_dir), names)
        return df.select("s1_id", "cand_id", *(F.round(n, 6).alias(n) for n in names))


for _name, _names in FEATURE_GROUPS.items():
    _feature_query(_name, _names)


@query("feat_all_48")
def feat_all_48(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.pair_features(pair_texts(spark, sf_dir))


_ALL = FEATURE_SQL | {n: n for n in fq.RATIOS}


@query("feat_v1_29", _feature_sql(features.FEATURE_NAMES_V1, _ALL, "fr"), _PAIRS + "," + fq.RATIO_TABLES)
def feat_v1_29(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.pair_features_v1(pair_texts(spark, sf_dir))
    return df.select("s1_id", "cand_id", *(F.round(n, 6).alias(n) for n in features.FEATURE_NAMES_V1))


def _modular_sql() -> str:
    """The 36 of the modular first generation: 31 from the pair, 5 from those."""
    opening = lambda c: rf"regexp_extract({c}, '^\s*(\S+)', 1)"
    match = lambda a, b: f"CASE WHEN len({a}) > 0 THEN {_both(a, b)} / len({a}) WHEN len({b}) = 0 THEN 1.0 ELSE 0.5 END"
    names = {f"name_{new}": _ALL[f"name_{old}"] for new, old in (("levenshtein", "lev"), ("jaro_winkler", "jw"), ("token_sort_ratio", "tsort"), ("token_set_ratio", "tset"), ("partial_ratio", "partial"), ("jaccard", "jac"), ("overlap", "ovl"), ("dice", "dice"), ("containment_12", "cont12"), ("containment_21", "cont21"), ("length_ratio", "lr"), ("token_count_diff", "tok_diff"))}
    names |= {f"addr_{new}": _ALL[f"addr_{old}"] for new, old in (("levenshtein", "lev"), ("jaro_winkler", "jw"), ("token_sort_ratio", "tsort"), ("token_set_ratio", "tset"), ("partial_ratio", "partial"), ("jaccard", "jac"), ("overlap", "ovl"), ("dice", "dice"), ("length_ratio", "lr"))}
    names |= {"addr_num_jaccard": _ALL["anum_jac"], "addr_num_overlap": _ALL["anum_ovl"], "addr_num_match_ratio_12": match("an1", "an2"), "addr_num_match_ratio_21": match("an2", "an1")}
    names |= {"combined_token_sort": "comb_tsort", "combined_token_set": "comb_tset", "combined_jaccard": _ALL["comb_jac"], "country_match": "CASE WHEN ca = cb THEN 1.0 ELSE 0.0 END"}
    names["name_first_token_match"] = f"CASE WHEN {opening('n1')} <> '' AND {opening('n1')} = {opening('n2')} THEN 1.0 ELSE 0.0 END"
    names["name_in_addr"] = "CASE WHEN (n1 <> '' AND contains(a2, n1)) OR (n2 <> '' AND contains(a1, n2)) THEN 1.0 ELSE 0.0 END"
    later = {"max_name_containment": "greatest(name_containment_12, name_containment_21)", "max_addr_num_match": "greatest(addr_num_match_ratio_12, addr_num_match_ratio_21)"}
    later |= {f"agg_{s}_score": f"({s}_jaro_winkler + {s}_token_sort_ratio + {s}_jaccard) / 3" for s in ("name", "addr")}
    later["agg_combined_score"] = "0.5 * (name_jaro_winkler + name_token_sort_ratio + name_jaccard) / 3 + 0.5 * (addr_jaro_winkler + addr_token_sort_ratio + addr_jaccard) / 3"
    inner = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in names.items())
    outer = ", ".join(f"round({n}, 6) AS {n}" for n in names) + ", " + ", ".join(f"round({e}, 6) AS {n}" for n, e in later.items())
    return f"SELECT s1_id, cand_id, {outer} FROM (SELECT s1_id, cand_id, {inner} FROM fr JOIN (SELECT entity_id AS s1_id, country AS ca FROM s1) USING (s1_id) JOIN (SELECT entity_id AS cand_id, country AS cb FROM pool) USING (cand_id))"


@query("feat_v1_36", _modular_sql(), _PAIRS + "," + fq.RATIO_TABLES)
def feat_v1_36(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = blocking.key_pairs(*fx.stored_records(spark, sf_dir), only="prefix5", texts=blocking.TEXTS | {"c": "country"}).drop("found")
    df = features.pair_features_modular(texts)
    return df.select("s1_id", "cand_id", *(F.round(n, 6).alias(n) for n in df.columns[2:]))


# --- Decisions -------------------------------------------------------------------------------------------------------

_SCORES = _PAIRS + ", scores AS (SELECT s1_id, cand_id, round((" + " + ".join(f"({FEATURE_SQL[n]})" for n in LINEAR) + ") / 3, 6) AS p FROM fs)"
_DECIDED = f"""
dx AS (SELECT *, max(p) OVER (PARTITION BY s1_id) AS best, row_number() OVER (PARTITION BY cand_id ORDER BY p DESC, s1_id) AS own FROM scores),
pred AS (SELECT s1_id, cand_id, p FROM dx WHERE p >= {THRESHOLD} AND own = 1 AND best >= {SINGLETON})"""


def linear_scores(spark: SparkSession, sf_dir: str, x: DataFrame | None = None) -> DataFrame:
    df = features.pair_features(pair_texts(spark, sf_dir, x), list(LINEAR))
    return df.select("s1_id", "cand_id", F.round(sum((F.col(n) for n in LINEAR[1:]), F.col(LINEAR[0])) / 3, 6).alias("p"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.decide(linear_scores(spark, sf_dir), THRESHOLD, singleton_best=SINGLETON)


@query("score_linear", "SELECT s1_id, cand_id, p FROM scores", _SCORES)
def score_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear_scores(spark, sf_dir)


@query("decide_threshold", f"SELECT s1_id, cand_id, p FROM scores WHERE p >= {THRESHOLD}", _SCORES)
def decide_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.decide_v1(linear_scores(spark, sf_dir), THRESHOLD)


@query("decide_one_to_one", f"SELECT s1_id, cand_id, p FROM dx WHERE own = 1 AND p >= {THRESHOLD}", _SCORES + "," + _DECIDED)
def decide_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.decide(linear_scores(spark, sf_dir), THRESHOLD, singleton_best=None)


@query("decide_singleton", "SELECT s1_id, cand_id, p FROM dx WHERE best >= 0.8 AND p >= 0.3", _SCORES + "," + _DECIDED)
def decide_singleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.decide(linear_scores(spark, sf_dir), 0.3, one_to_one=False, singleton_best=0.8)


@query("decide_full", "SELECT s1_id, coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '') AS cands FROM ent LEFT JOIN pred USING (s1_id) GROUP BY s1_id", _SCORES + "," + _DECIDED)
def decide_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decide.grouped(fx.entities(spark, sf_dir), decided(spark, sf_dir))
    return out.select("s1_id", F.array_join("cands", ",").alias("cands"))


@query(
    "tune_threshold",
    f"""SELECT threshold, round((coalesce(f, 0) + em - coalesce(wrong, 0)) / n, 6) AS score FROM g LEFT JOIN
  (SELECT threshold, sum(CASE WHEN nt > 0 AND tp > 0 THEN 1.25 * tp / (np + 0.25 * nt) ELSE 0 END) AS f, count(*) FILTER (nt = 0) AS wrong FROM
    (SELECT threshold, s1_id, count(*) AS np, count(t.cand_id) AS tp FROM g JOIN dx ON p >= threshold LEFT JOIN truth AS t USING (s1_id, cand_id) WHERE own = 1 AND best >= {SINGLETON} GROUP BY ALL) JOIN z USING (s1_id) GROUP BY ALL) USING (threshold),
  (SELECT count(*) AS n, count(*) FILTER (nt = 0) AS em FROM z)""",
    _SCORES + "," + _DECIDED + ", g AS (SELECT CAST(unnest(" + str(list(decide.GRID)) + ") AS DOUBLE) AS threshold), z AS (SELECT ent.s1_id, count(t.cand_id) AS nt FROM ent LEFT JOIN truth AS t USING (s1_id) GROUP BY ALL)",
)
def tune_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.tune(linear_scores(spark, sf_dir), fx.truth(spark, sf_dir), fx.entities(spark, sf_dir), singleton_best=SINGLETON)


@query(
    "pr_curve",
    """SELECT p AS threshold, round(tp / n, 6) AS precision, round(CASE WHEN a > 0 THEN tp / a ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 1.25 * (tp / n) * (tp / a) / (0.25 * (tp / n) + tp / a) ELSE 0 END, 6) AS f FROM
  (SELECT p, CAST(sum(c) OVER (ORDER BY p DESC) AS DOUBLE) AS n, CAST(sum(h) OVER (ORDER BY p DESC) AS DOUBLE) AS tp, CAST(sum(h) OVER () AS DOUBLE) AS a FROM (SELECT p, count(*) AS c, count(t.cand_id) AS h FROM scores LEFT JOIN truth AS t USING (s1_id, cand_id) GROUP BY p))""",
    _SCORES,
)
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fx.words(spark, sf_dir)
    return decide.pr_curve(training.labelled_scores(linear_scores(spark, sf_dir, x), fx.truth(spark, sf_dir, x)))


# --- Evaluation ------------------------------------------------------------------------------------------------------

_EVAL = _SCORES + "," + _DECIDED + "," + _sql_eval("pred")


def _three(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fx.entities(spark, sf_dir), fx.truth(spark, sf_dir), decided(spark, sf_dir)


@query("f05_per_entity", "SELECT s1_id, nt, np, tp, CAST(f AS DOUBLE) AS f FROM ev", _EVAL)
def f05_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.per_entity(*_three(spark, sf_dir))


@query("macro_f05", "SELECT round(avg(f), 6) AS macro_f05, count(*) AS n_entities FROM ev", _EVAL)
def macro_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro(*_three(spark, sf_dir))


@query("loss_breakdown", "SELECT CASE WHEN nt = 0 THEN 'singleton_given_matches' WHEN np = 0 THEN 'matched_left_empty' WHEN tp = 0 THEN 'all_wrong' ELSE 'partly_right' END AS category, count(*) AS n_entities, round(sum(1 - f) / (SELECT count(*) FROM ev), 6) AS loss FROM ev WHERE f < 1 GROUP BY ALL", _EVAL)
def loss_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.loss_breakdown(*_three(spark, sf_dir))


@query("blocking_ceiling", "SELECT round(avg(f), 6) AS macro_f05, count(*) AS n_entities FROM ev", _KEYS["prefix5"] + ", orc AS (SELECT truth.* FROM truth JOIN prefix5 USING (s1_id, cand_id))," + _sql_eval("orc"))
def blocking_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ceiling(fx.entities(spark, sf_dir), fx.truth(spark, sf_dir), blocking.block_keys(*fx.normalised(spark, sf_dir))["prefix5"])


@query(
    "micro_pr",
    """SELECT CAST(sum(tp) AS BIGINT) AS true_positives, CAST(sum(np) - sum(tp) AS BIGINT) AS false_positives, CAST(sum(nt) - sum(tp) AS BIGINT) AS false_negatives, round(CAST(sum(tp) AS DOUBLE) / sum(np), 6) AS precision,
  round(CAST(sum(tp) AS DOUBLE) / sum(nt), 6) AS recall, CAST(count(*) FILTER (nt = 0 AND np = 0) AS BIGINT) AS right_singletons FROM ev""",
    _EVAL,
)
def micro_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t, p = _three(spark, sf_dir)
    return evaluate.micro(t, p, e)


@query(
    "country_rollup",
    """SELECT CASE WHEN grouping(country_norm) = 1 THEN 'ALL' ELSE country_norm END AS country, count(*) AS n_entities, round(avg(CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END), 6) AS singleton_share, round(avg(np), 6) AS avg_matches,
  round(coalesce(avg(np) FILTER (np > 0), 0), 6) AS avg_if_any, CAST(max(np) AS BIGINT) AS max_matches, round(avg((SELECT count(*) FROM prefix5 AS x WHERE x.s1_id = e.s1_id)), 6) AS avg_candidates FROM e GROUP BY ROLLUP (country_norm)""",
    _EVAL,
)
def country_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.country_summary(fx.entities(spark, sf_dir), decided(spark, sf_dir), blocking.block_keys(*fx.normalised(spark, sf_dir))["prefix5"])


@query("match_histogram", "SELECT CAST(least(np, 12) AS BIGINT) AS n_matches, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share FROM e GROUP BY ALL", _EVAL)
def match_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.match_histogram(fx.entities(spark, sf_dir), decided(spark, sf_dir))


# --- Validation ------------------------------------------------------------------------------------------------------

_LISTS = """
ml AS (SELECT s1_id AS sid, coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '') AS m FROM ent LEFT JOIN truth USING (s1_id) GROUP BY s1_id),
bad AS (SELECT sid, CASE hash_n % 7 WHEN 0 THEN m || ',S1-000000' WHEN 1 THEN m || ',X9-1' WHEN 2 THEN m || ',S2-x,S2-x' ELSE m END AS m FROM (SELECT *, CAST(substr(sid, 4) AS BIGINT) AS hash_n FROM ml) WHERE hash_n % 11 <> 0
  UNION ALL SELECT sid, m FROM ml WHERE CAST(substr(sid, 4) AS BIGINT) % 13 = 0 AND CAST(substr(sid, 4) AS BIGINT) % 11 <> 0),
ids AS (SELECT sid, m, list_filter(string_split(m, ','), lambda x: x <> '') AS l FROM bad)"""


def broken_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match lists with one fault or another for each rule."""
    lists = match_lists(spark, sf_dir).withColumn("n", F.substring("source1_entity_id", 4, 20).cast("bigint"))
    m = F.col("matched_entity_ids")
    bad = F.when(F.col("n") % 7 == 0, F.concat(m, F.lit(",S1-000000"))).when(F.col("n") % 7 == 1, F.concat(m, F.lit(",X9-1"))).when(F.col("n") % 7 == 2, F.concat(m, F.lit(",S2-x,S2-x"))).otherwise(m)
    kept = lists.filter("n % 11 <> 0")
    return kept.select("source1_entity_id", bad.alias("matched_entity_ids")).unionByName(kept.filter("n % 13 = 0").select("source1_entity_id", "matched_entity_ids"))


def _findings(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    s1, pool = fx.normalised(spark, sf_dir)
    return validate.check_lists(broken_lists(spark, sf_dir), s1, pool).filter(F.col("rule") == rule).select("entity_id", "detail").distinct()


for _rule, _sql in {
    "duplicate_row": "SELECT sid AS entity_id, CAST(count(*) AS VARCHAR) AS detail FROM ids GROUP BY sid HAVING count(*) > 1",
    "duplicate_id": "SELECT DISTINCT sid AS entity_id, 'S2-x' AS detail FROM ids WHERE m LIKE '%S2-x,S2-x'",
    "self_match": "SELECT DISTINCT sid AS entity_id, 'S1-000000' AS detail FROM ids WHERE list_contains(l, 'S1-000000')",
    "wrong_prefix": "SELECT DISTINCT sid AS entity_id, 'X9-1' AS detail FROM ids WHERE list_contains(l, 'X9-1')",
    "missing_required": "SELECT s1_id AS entity_id, '' AS detail FROM ent WHERE s1_id NOT IN (SELECT sid FROM ids)",
    "unknown_id": "SELECT DISTINCT sid AS entity_id, x AS detail FROM (SELECT sid, unnest(l) AS x FROM ids) WHERE x NOT IN (SELECT entity_id FROM pool)",
}.items():
    QUERIES[f"val_{_rule}"] = lambda spark, sf_dir, rule=_rule: _findings(spark, sf_dir, rule)
    SQL[f"val_{_rule}"] = "WITH " + ",".join((fx.SQL_RECORDS, fx.sql_norm(), _LISTS)) + "\n" + _sql


@query("val_not_subset", "SELECT s1_id AS entity_id, string_agg(cand_id, ',' ORDER BY cand_id) AS detail FROM truth WHERE (s1_id, cand_id) NOT IN (SELECT s1_id, cand_id FROM addr_nums) GROUP BY s1_id", _KEYS["addr_nums"])
def val_not_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.entities(spark, sf_dir)
    candidates = writers.match_lists(e, blocking.block_keys(*fx.normalised(spark, sf_dir))["addr_nums"], "candidate_entity_ids")
    return validate.check_subset(match_lists(spark, sf_dir), candidates).select("entity_id", "detail")


@query("val_counts", "SELECT count(*) AS n_rows, count(*) FILTER (m = '') AS n_empty, count(*) FILTER (m <> '') AS n_filled FROM bad", _LISTS)
def val_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.list_counts(broken_lists(spark, sf_dir))


# --- Training --------------------------------------------------------------------------------------------------------


@query("train_pairs", "SELECT s1_id, cand_id, label FROM (SELECT *, sum(label) OVER (PARTITION BY s1_id) AS pos, row_number() OVER (PARTITION BY s1_id, label ORDER BY md5(s1_id || '|' || cand_id || '|42'), cand_id) AS n FROM (SELECT p.s1_id, p.cand_id, CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS label FROM prefix5 AS p LEFT JOIN truth AS t USING (s1_id, cand_id))) WHERE label = 1 OR n <= greatest(pos * 3, 2)", _KEYS["prefix5"])
def train_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.labelled_pairs_v1(blocking.block_keys(*fx.normalised(spark, sf_dir))["prefix5"], fx.truth(spark, sf_dir))


@query("train_split", f"SELECT s1_id, row_number() OVER (ORDER BY md5(s1_id || '|{SEED}'), s1_id) <= greatest(CAST(floor((SELECT count(*) FROM ent) * 0.1) AS BIGINT), 10) AS validation FROM ent")
def train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.split_entities(fx.entities(spark, sf_dir), Config())


_HARD = Config()


@query(
    "train_hard_negatives",
    f"""SELECT s1_id, cand_id, label FROM lab WHERE label = 1 UNION ALL SELECT s1_id, cand_id, label FROM tough WHERE k <= n_hard
  UNION ALL SELECT s1_id, cand_id, label FROM (SELECT *, row_number() OVER (ORDER BY o, s1_id, cand_id) AS r FROM (SELECT * FROM lab JOIN num ON true WHERE label = 0) AS x WHERE NOT EXISTS (SELECT 1 FROM tough AS t WHERE t.s1_id = x.s1_id AND t.cand_id = x.cand_id AND k <= t.n_hard)) WHERE r <= wanted - n_hard""",
    _SCORES + f""", lab AS (SELECT s1_id, cand_id, p, md5(s1_id || '|' || cand_id || '|{_HARD.seed}') AS o, CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS label FROM scores LEFT JOIN truth AS t USING (s1_id, cand_id)),
cnt AS (SELECT sum(label) AS pos, count(*) FILTER (label = 0 AND p >= {_HARD.hard_floor}) AS hard, count(*) FILTER (label = 0) AS neg FROM lab),
num AS (SELECT least({_HARD.hard_ratio} * pos, neg) AS wanted, least(CAST(floor(least({_HARD.hard_ratio} * pos, neg) * {_HARD.hard_mix}::DOUBLE) AS BIGINT), hard) AS n_hard FROM cnt),
tough AS (SELECT lab.*, n_hard, row_number() OVER (ORDER BY o, s1_id, cand_id) AS k FROM lab, num WHERE label = 0 AND p >= {_HARD.hard_floor})""",
)
def train_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = training.labelled_scores(linear_scores(spark, sf_dir), fx.truth(spark, sf_dir))
    return training.mine_hard_negatives(labelled, _HARD).select("s1_id", "cand_id", "label")


#: Latin letters, and the Kannada consonants, vowels and vowel signs that stand for them in the query's names.
_KANNADA = (("kgtdnpbmyrlvhjs", "\u0c95\u0c97\u0ca4\u0ca6\u0ca8\u0caa\u0cac\u0cae\u0caf\u0cb0\u0cb2\u0cb5\u0cb9\u0c9c\u0cb8"), ("aiueo", "\u0c85\u0c87\u0c89\u0c8e\u0c92"), ("iueo", "\u0cbf\u0cc1\u0cc6\u0cca"))


@query("translit_indic", "SELECT entity_id, trim(regexp_replace(regexp_replace(name_clean, '[^kgtdnpbmyrlvhjsaiueo ]', '', 'g'), ' +', ' ', 'g')) AS name FROM norm")
def translit_indic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written in Kannada letters (consonants with their a, vowel signs or a virama) fold back to what they were."""
    (letters, consonants), (vowels, alone), (signed, signs) = _KANNADA
    name = F.regexp_replace(text.clean_name(F.col("business_name")), f"[^{letters}{vowels} ]", "")
    name = F.translate(name, letters, consonants)
    for vowel, sign in zip(signed, signs, strict=True):
        name = F.regexp_replace(name, f"([{consonants}]){vowel}", f"$1{sign}")
    name = F.regexp_replace(name, f"([{consonants}])(?![a{signs}])", "$1\u0ccd")
    name = F.translate(F.regexp_replace(name, f"([{consonants}])a", "$1"), vowels, alone)
    return fx.records(spark, sf_dir).select("entity_id", text.clean_name(name).alias("name"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to match lists, from end to end."""
    return decide_full(spark, sf_dir)

