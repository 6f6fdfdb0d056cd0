"""Checks of result files and tables: each finding is a row (rule, severity, entity_id, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADERS = {"matching": ("source1_entity_id", "matched_entity_ids"), "candidate": ("source1_entity_id", "candidate_entity_ids")}
EXAMPLES = 5


def _found(df: DataFrame, rule: str, severity: str, entity: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), entity.alias("entity_id"), detail.alias("detail"))


def _one(spark: SparkSession, rule: str, severity: str, detail: str) -> DataFrame:
    return spark.range(1).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit("").alias("entity_id"), F.lit(detail).alias("detail"))


def check_lists(lists: DataFrame, required: DataFrame, known: DataFrame | None = None, *, column: str = "matched_entity_ids") -> DataFrame:
    """Rules on rows. lists: source1_entity_id and a comma-joined column; required: entity_id; known: entity_id, for the id check."""
    sid = F.col("source1_entity_id")
    ids = F.filter(F.split(F.coalesce(column, F.lit("")), ","), lambda x: x != "")
    rows = lists.select(sid, ids.alias("ids"))
    join = lambda a: F.array_join(F.sort_array(a), ",")
    # Lists with repeats are taken apart, so that a long one costs no more than its ids.
    double = rows.filter(F.size("ids") > F.size(F.array_distinct("ids"))).withColumn("_row", F.monotonically_increasing_id())
    double = double.select("_row", sid, F.explode("ids").alias("id")).groupBy("_row", "source1_entity_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    double = double.groupBy("_row", "source1_entity_id").agg(F.collect_list("id").alias("repeated"))
    own = F.array_distinct(F.filter("ids", lambda x: F.startswith(x, F.lit("S1-"))))
    odd = F.array_distinct(F.filter("ids", lambda x: ~F.startswith(x, F.lit("S1-")) & ~F.startswith(x, F.lit("S2-")) & ~F.startswith(x, F.lit("S3-"))))
    need = required.select(F.col("entity_id").alias("source1_entity_id")).distinct()
    parts = [
        _found(rows.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "duplicate_row", "error", sid, F.col("n").cast("string")),
        _found(double, "duplicate_id", "error", sid, join(F.col("repeated"))),
        _found(rows.filter(F.size(own) > 0), "self_match", "error", sid, join(own)),
        _found(rows.filter(F.size(odd) > 0), "wrong_prefix", "error", sid, join(odd)),
        _found(need.join(rows, "source1_entity_id", "left_anti"), "missing_required", "error", sid, F.lit("")),
        _found(rows.select(sid).distinct().join(need, "source1_entity_id", "left_anti"), "unknown_row", "error", sid, F.lit("")),
    ]
    if known is not None:
        each = rows.select(sid, F.explode("ids").alias("entity_id")).distinct()
        parts.append(_found(each.join(known.select("entity_id").distinct(), "entity_id", "left_anti"), "unknown_id", "error", sid, F.col("entity_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_subset(matching: DataFrame, candidate: DataFrame) -> DataFrame:
    """Matches that are no candidates, a warning for each entity."""
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    m = matching.select("source1_entity_id", split("matched_entity_ids").alias("m"))
    c = candidate.select("source1_entity_id", split("candidate_entity_ids").alias("c"))
    extra = F.array_except("m", F.coalesce("c", F.array().cast("array<string>")))
    return _found(m.join(c, "source1_entity_id", "left").filter(F.size(extra) > 0), "not_a_candidate", "warning", F.col("source1_entity_id"), F.array_join(F.sort_array(extra), ","))


def check_file(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rules on the file: there, not empty, tab-separated, the exact header, a tab in every row."""
    from kinmesh.sources.writers import exists

    one = lambda rule, severity, detail: _one(spark, rule, severity, detail)
    if not exists(spark, path):
        return one("file_missing", "error" if kind == "matching" else "warning", path)
    text = spark.read.text(path)
    head = text.limit(1).collect()
    if not head:
        return one("file_empty", "error", path)
    line, wanted = head[0]["value"], "\t".join(HEADERS[kind])
    if line != wanted:
        return one("comma_header" if "\t" not in line and "," in line else "wrong_header", "error", line)
    return _found(text.filter((F.col("value") != wanted) & (F.col("value") != "") & ~F.contains("value", F.lit("\t"))), "row_without_tab", "error", F.lit(""), F.col("value"))


def list_counts(lists: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    full = F.coalesce(F.col(column), F.lit("")) != ""
    return lists.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(full, 0).otherwise(1)).alias("n_empty"), F.sum(F.when(full, 1).otherwise(0)).alias("n_filled"))


def messages(findings: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(rule, severity, n, examples): counts, and the first few entities in order. Each task keeps the first few of its own before any are shuffled."""
    by = ["rule", "severity"]
    place = F.row_number().over(Window.partitionBy(*by).orderBy("entity_id", "detail"))
    few = findings.select(*by, "entity_id", place.alias("_n")).filter(F.col("_n") <= examples).groupBy(*by).agg(F.sort_array(F.collect_list("entity_id")).alias("examples"))
    return findings.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(few, by)


def validate(spark: SparkSession, matching: str, candidate: str | None, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """All findings on a pair of result files; errors of form come alone, as the rows can't be trusted then. What isn't checked, for want of a candidate file or of known ids, is a warning."""
    from kinmesh.sources.readers import TRUTH_SCHEMA, read_tsv

    def read(path: str, kind: str) -> DataFrame:
        return read_tsv(spark, path, TRUTH_SCHEMA).toDF(*HEADERS[kind])

    out = check_file(spark, matching, "matching")
    if not out.isEmpty():
        return out
    m = read(matching, "matching")
    out = check_lists(m, required, known)
    if known is None:
        out = out.unionByName(_one(spark, "ids_not_checked", "warning", "no known ids were given"))
    if candidate is None:
        out = out.unionByName(_one(spark, "candidates_not_checked", "warning", "no candidate file was given"))
    else:
        form = check_file(spark, candidate, "candidate")
        if not form.isEmpty():
            return out.unionByName(form)
        c = read(candidate, "candidate")
        out = out.unionByName(check_lists(c, required, known, column="candidate_entity_ids")).unionByName(check_subset(m, c))
    return out
