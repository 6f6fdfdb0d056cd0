"""Queries over sources and sinks: what is written to a shared folder is read back, and SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.config import Config
from kinmesh.functions import text_v1
from kinmesh.operators import blocking, evaluate, saved_index, tfidf, validate
from kinmesh.plans import fixtures as fx
from kinmesh.plans.queries import _CHEAP, _KEYS, _REPORT, _TAGGED, _V1, _sql_tfidf, query
from kinmesh.sources import readers, samples, writers
from kinmesh.sources.writers import Stages

_COLUMNS = ("entity_id", "business_name", "business_address", "country")
#: Every seventh record has a field that must be read as missing; every eleventh one that looks like it and isn't.
_GAPS = "CASE WHEN CAST(substr(entity_id, 4) AS INT) % 7 = 0 THEN 'N/A' WHEN CAST(substr(entity_id, 4) AS INT) % 11 = 0 THEN 'none' ELSE business_address END"


def _written(spark: SparkSession, sf_dir: str, *, gaps: bool = False) -> dict[str, str]:
    """The records as three tab-separated files, by source."""
    root = writers.scratch(spark, "records")
    rows = fx.records(spark, sf_dir).select(*_COLUMNS)
    if gaps:
        rows = rows.withColumn("business_address", F.expr(_GAPS))
    for n in "123":
        rows.filter(F.startswith("entity_id", F.lit(f"S{n}-"))).write.csv(f"{root}/s{n}.tsv", **writers.WHOLE_FIELDS, header=True, quote='"', escape='"')
    return {f"s{n}": f"{root}/s{n}.tsv" for n in "123"}


@query("src_tsv_scan", f"SELECT entity_id, business_name, nullif({_GAPS}, 'N/A') AS business_address, country FROM recs")
def src_tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_tsv(spark, list(_written(spark, sf_dir, gaps=True).values()))


@query("src_multi_scan", "SELECT entity_id, name_clean, country_norm FROM norm")
def src_multi_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two, three = readers.load_sources(spark, *_written(spark, sf_dir).values())
    return one.unionByName(two).unionByName(three).select("entity_id", "name_clean", "country_norm")


@query("src_country_scan", "SELECT entity_id, addr_clean FROM norm WHERE country_norm = 'de'")
def src_country_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [readers.load_country(spark, p, " DE ") for p in _written(spark, sf_dir).values()]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("entity_id", "addr_clean")


@query("src_ids", "SELECT entity_id FROM pool")
def src_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _written(spark, sf_dir)
    return readers.union_pool(readers.read_ids(spark, paths["s2"]), readers.read_ids(spark, paths["s3"]))


@query("src_union_pool", "SELECT entity_id, CASE WHEN entity_id LIKE 'S2-%' THEN 'first' ELSE 'second' END AS business_name FROM pool")
def src_union_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id that stands in both sources has the record of the first."""
    pool = fx.secondary(fx.records(spark, sf_dir)).select("entity_id")
    one = pool.filter(F.startswith("entity_id", F.lit("S2-"))).withColumn("business_name", F.lit("first"))
    return readers.union_pool(one, pool.withColumn("business_name", F.lit("second")), one.withColumn("business_name", F.lit("a third")))


@query("src_first_generation", "SELECT entity_id, name_norm, addr_norm FROM v1", _V1)
def src_first_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.load_source(spark, list(_written(spark, sf_dir).values()), generation=0).select("entity_id", "name_norm", "addr_norm")


@query(
    "src_quota_pool",
    """SELECT entity_id FROM pool WHERE entity_id IN (SELECT cand_id FROM truth) UNION
  SELECT entity_id FROM (SELECT entity_id, row_number() OVER (PARTITION BY country_norm ORDER BY substr(entity_id, 1, 2), md5(entity_id || '|42'), entity_id) AS n FROM pool WHERE entity_id NOT IN (SELECT cand_id FROM truth)) WHERE n <= 50000""",
)
def src_quota_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    must = fx.truth(spark, sf_dir).select(F.col("cand_id").alias("entity_id"))
    return samples.quota_pool_v1(fx.normalised(spark, sf_dir)[1], must, 100, 42).select("entity_id")


@query("nr1_alpha", "SELECT entity_id, array_to_string(list_sort(list_distinct(regexp_extract_all(name_norm, '[a-zA-Z\\x{0900}-\\x{097F}\\x{00C0}-\\x{024F}]+'))), ' ') AS alpha FROM v1", _V1)
def nr1_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = text_v1.normalise_v1(fx.records(spark, sf_dir))
    return df.select("entity_id", F.array_join(F.sort_array(text_v1.extract_alpha(F.col("name_norm"))), " ").alias("alpha"))


@query("nr1_combined", "SELECT entity_id, trim(name_norm || ' ' || addr_norm) AS combined FROM v1", _V1)
def nr1_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.records(spark, sf_dir)
    return df.select("entity_id", text_v1.combined_text(F.col("business_name"), F.col("business_address"), F.col("country")).alias("combined"))


@query("snk_cache_round_trip", "SELECT entity_id, name_clean, addr_clean FROM norm WHERE entity_id LIKE 'S1-%'")
def snk_cache_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised records from the cache; the second call doesn't make them."""
    paths, root = _written(spark, sf_dir), writers.scratch(spark, "cache")
    writers.cached(spark, root, "s1", [paths["s1"]], lambda: readers.load_source(spark, paths["s1"]))
    return writers.cached(spark, root, "s1", [paths["s1"]], lambda: spark.range(1)).select("entity_id", "name_clean", "addr_clean")


@query(
    "snk_embedding_cache",
    "SELECT entity_id, country_norm, CAST(length(combined) AS BIGINT) AS dims, CASE WHEN combined IN (SELECT combined FROM s1) THEN 0 ELSE 1 END AS again FROM norm",
)
def snk_embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors (here of lengths) by text: first those of the first source, then of all records, of which only texts not seen before are encoded again."""
    from kinmesh.plans.linkage import encoded

    s1, pool = (df.select("entity_id", "country_norm", "combined") for df in fx.stored_records(spark, sf_dir))
    records, root = s1.unionByName(pool), writers.scratch(spark, "cache")
    encode = lambda again: lambda r: r.select("entity_id", F.array(F.length("combined").cast("float"), F.lit(again).cast("float")).alias("embedding"))
    encoded(s1, encode(0), root, encoder="lengths").isEmpty()
    out = encoded(records, encode(1), root, encoder="lengths")
    return out.select("entity_id", "country_norm", F.col("embedding")[0].cast("bigint").alias("dims"), F.col("embedding")[1].cast("int").alias("again"))


@query("snk_saved_index", "SELECT s1_id, cand_id, score, rank FROM top WHERE rank <= 30", _sql_tfidf("name_clean", "char", 0.05, 200_000, "S2-"))
def snk_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best names of an index that is fitted on the second source, saved, extended by the third and asked."""
    s1, pool = fx.stored_records(spark, sf_dir)
    path = f"{writers.scratch(spark, 'index')}/name"
    saved_index.save(tfidf.fit(pool.filter(F.startswith("entity_id", F.lit("S2-"))), text="name_clean"), path)
    saved_index.append(pool.filter(F.startswith("entity_id", F.lit("S3-"))), path)
    return saved_index.query(s1, path, k=30)


@query("snk_stage_resume", "SELECT entity_id, name_clean FROM s1")
def snk_stage_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = writers.scratch(spark, "runs")
    for make in (lambda: fx.normalised(spark, sf_dir)[0].select("entity_id", "name_clean"), lambda: spark.createDataFrame([], "entity_id string, name_clean string")):
        out = Stages(spark, root, "train", Config(), sources="same").stage("records", make)
    return out


_RUNS = (("predict", "scores", True), ("train", "candidates", True), ("train", "split", True))


@query("snk_runs", "SELECT kind, stage, finished, n FROM (VALUES " + ", ".join(f"('{k}', '{s}', {str(f).lower()})" for k, s, f in _RUNS) + ") AS v(kind, stage, finished), (SELECT count(*) AS n FROM s1)")
def snk_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over the records as they are listed, with the rows of a stage, after one of another seed was cleared and a run of its own kind was deleted as a whole."""
    root, s1 = writers.scratch(spark, "runs"), fx.stored_records(spark, sf_dir)[0].select("entity_id")
    for kind, stage, _ in (*_RUNS, ("other", "x", True)):
        kept = Stages(spark, root, kind, Config()).stage(stage, lambda: s1)
    gone = Stages(spark, root, "train", Config(seed=7))
    gone.stage("split", lambda: s1)
    gone.clear()
    writers.clear_all(spark, root, "other")
    rows = Stages(spark, root, "train", Config()).stage("split", lambda: kept.limit(0))
    return writers.list_runs(spark, root).select("kind", "stage", "finished").join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"))))


_HEAD = "\t".join(validate.HEADERS["matching"])
# Files made of the records' ids (a row of header and of each id), and what the validator must say of each.
_FILES: dict[str, tuple[str | None, str | None, dict[str, str]]] = {
    "missing": (None, None, {"file_missing": "1"}),
    "empty": (None, "", {"file_empty": "1"}),
    "comma": (_HEAD.replace("\t", ","), "concat(entity_id, ',')", {"comma_header": "1"}),
    "header": ("id\tmatches", "concat(entity_id, '\t')", {"wrong_header": "1"}),
    "tabs": (_HEAD, "entity_id", {"row_without_tab": "n"}),
    "good": (_HEAD, "concat(entity_id, '\tS2-1')", {}),
    "rows": (_HEAD, "concat(entity_id, '\tS2-1,S2-1,S1-9,X-1')", {"duplicate_id": "n", "self_match": "n", "wrong_prefix": "n"}),
    "other": (_HEAD, "concat(entity_id, 'x\t')", {"missing_required": "n", "unknown_row": "n"}),
}


@query("val_files", "SELECT file, rule, CASE WHEN each THEN n ELSE 1 END AS n FROM (VALUES " + ", ".join(f"('{name}', '{rule}', {str(n == 'n').lower()})" for name, (*_, rules) in _FILES.items() for rule, n in rules.items()) + ") AS v(file, rule, each), (SELECT count(*) AS n FROM s1)")
def val_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, need = writers.scratch(spark, "results"), fx.stored_records(spark, sf_dir)[0].select("entity_id")
    out = None
    for name, (head, row, _) in _FILES.items():
        path = f"{root}/{name}.tsv"
        if row is not None:
            if head:
                need.select(F.expr(row).alias(head)).write.csv(path, header=True, **(writers.WHOLE_FIELDS | {"sep": "\x01"}), quote="", emptyValue="")
            else:
                need.limit(0).write.text(path)
        found = validate.messages(validate.validate(spark, path, None, need).filter("severity = 'error'")).select(F.lit(name).alias("file"), "rule", "n")
        out = found if out is None else out.unionByName(found)
    return out


@query("val_unknown_row", "SELECT 'unknown_row' AS rule, entity_id FROM s1 WHERE CAST(substr(entity_id, 4) AS INT) % 2 = 1")
def val_unknown_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fx.first_source(fx.records(spark, sf_dir)).select("entity_id")
    lists = writers.match_lists(ids.withColumnRenamed("entity_id", "s1_id"), spark.createDataFrame([], "s1_id string, cand_id string"))
    required = ids.filter(F.substring("entity_id", 4, 10).cast("int") % 2 == 0)
    return validate.check_lists(lists, required).select("rule", "entity_id")


def _final_sql() -> str:
    strategies = " UNION ALL ".join(f"SELECT '{'UNION' if k == 'uni' else k}' AS strategy, * FROM e_{k}" for k in (*_KEYS, "uni"))
    return f"""SELECT strategy, round(CAST(sum(tp) FILTER (nt > 0) AS DOUBLE) / sum(nt) FILTER (nt > 0), 6) AS pair_recall FROM ({strategies} UNION ALL SELECT 'FINAL', * FROM e_pool) GROUP BY strategy"""


@query(
    "blocking_report_final",
    _final_sql(),
    _TAGGED + "," + _REPORT + "," + _CHEAP + """,
kept AS (SELECT s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS r FROM ranked WHERE n <= 10 OR score >= 0.15) WHERE n <= 10 OR r <= 10),
e_pool AS (SELECT ent.s1_id, coalesce(nt, 0) AS nt, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp FROM ent LEFT JOIN (SELECT s1_id, count(*) AS nt FROM truth GROUP BY ALL) USING (s1_id)
  LEFT JOIN (SELECT s1_id, count(*) AS np FROM kept GROUP BY ALL) USING (s1_id) LEFT JOIN (SELECT s1_id, count(*) AS tp FROM kept JOIN truth USING (s1_id, cand_id) GROUP BY ALL) USING (s1_id))""",
)
def blocking_report_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report with its last row: what the pre-filter keeps of the union."""
    s1, pool = fx.stored_records(spark, sf_dir)
    final = blocking.prefilter_on_keys(s1, pool, cap=10)
    return evaluate.blocking_report_of(fx.entities(spark, sf_dir), fx.truth(spark, sf_dir), blocking.key_pairs(s1, pool), list(_KEYS), final).select("strategy", F.round("pair_recall", 6).alias("pair_recall"))
