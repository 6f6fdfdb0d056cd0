"""Result files, caches, stages and models."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.config import PREPROCESS_VERSION, Config


#: Tab-separated fields as they are: by itself Spark's writer strips blanks at either end.
WHOLE_FIELDS = {"sep": "\t", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def match_lists(entities: DataFrame, pairs: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """(source1_entity_id, column): one row for each entity, its distinct ids sorted and comma-joined, empty for none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.sort_array(F.collect_set("cand_id")), ",").alias(column))
    joined = entities.select("s1_id").distinct().join(lists, "s1_id", "left")
    return joined.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(F.col(column), F.lit("")).alias(column))


def write_tsv(lists: DataFrame, path: str, *, single_file: bool = True) -> None:
    """Header, one row a line sorted by id, no quoting, empty fields bare. Without single_file the parts are in order of their names."""
    ordered = lists.orderBy(lists.columns[0])
    ordered = ordered.coalesce(1) if single_file else ordered
    ordered.write.mode("overwrite").csv(path, **WHOLE_FIELDS, header=True, quote="", emptyValue="", nullValue="")


def write_results(entities: DataFrame, matches: DataFrame, candidates: DataFrame | None, out_dir: str, *, single_file: bool = True) -> None:
    """single_file: one task writes each table, as its readers expect one file; without it as many as there are parts, each with a header."""
    write_tsv(match_lists(entities, matches), f"{out_dir}/matching_results.tsv", single_file=single_file)
    if candidates is not None:
        write_tsv(match_lists(entities, candidates, "candidate_entity_ids"), f"{out_dir}/candidate_pairs.tsv", single_file=single_file)


def _filesystem(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _filesystem(spark, path)
    return system.exists(target)


def clear(spark: SparkSession, path: str) -> None:
    system, target = _filesystem(spark, path)
    system.delete(target, True)


def identity(spark: SparkSession, *paths: str) -> str:
    """Digest of the name, length and time of change of every file at or below the paths; a path that isn't there counts as empty."""
    found = []
    for path in paths:
        system, target = _filesystem(spark, path)
        if system.exists(target):
            files = system.listFiles(target, True)
            while files.hasNext():
                f = files.next()
                if not f.getPath().getName().startswith((".", "_")):
                    found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        found.append((path, -1, 0))
    return hashlib.sha1(json.dumps(sorted(found)).encode()).hexdigest()


def cached(spark: SparkSession, root: str, name: str, sources: list[str], make: Callable[[], DataFrame], *, version: object = PREPROCESS_VERSION) -> DataFrame:
    """make()'s rows from Parquet below root, written when there is no finished copy for these source files and this version.

    Serves normalised records (sources: their files) and embeddings (version: what names the encoder) alike.
    """
    key = hashlib.sha1(json.dumps([name, str(version), identity(spark, *sources)]).encode()).hexdigest()[:12]
    path = f"{root}/cache-{name}-{key}/rows"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def segments(spark: SparkSession, path: str) -> list[str]:
    """Finished folders below path, in order of their names; what a lost run has left behind has no _SUCCESS."""
    if not exists(spark, path):
        return []
    system, target = _filesystem(spark, path)
    found = [f.getPath().toString() for f in system.listStatus(target) if f.isDirectory()]
    return sorted(p for p in found if exists(spark, f"{p}/_SUCCESS"))


def text_table(df: DataFrame) -> str:
    """A small report as aligned text."""
    rows = [df.columns, *([("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in df.collect())]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, deleted when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='kinmesh-')}"
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    system, target = _filesystem(spark, path)
    system.mkdirs(target)
    system.deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a new shared folder and read back: what several branches of a plan use is made once, and lost executors cost no more than a read."""
    path = f"{scratch(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stages:
    """Named stages of a run below root/<key>; the key changes with every setting that changes results.

    Callers pass what else identifies a run as arguments: identity() of the source files, and of the model when predicting.

    A finished stage is read instead of computed; that also cuts lineage. An unfinished one has no _SUCCESS and is written anew.
    """

    def __init__(self, spark: SparkSession, root: str, kind: str, config: Config, *, resume: bool = True, **args: object) -> None:
        self.spark, self.resume = spark, resume
        self.dir = f"{root}/{kind}-{config.key(kind, **args)}"

    def stage(self, name: str, make) -> DataFrame:
        path = f"{self.dir}/{name}"
        if not (self.resume and exists(self.spark, f"{path}/_SUCCESS")):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def clear(self) -> None:
        clear(self.spark, self.dir)


def clear_all(spark: SparkSession, root: str, kind: str | None = None) -> int:
    """Deletes all runs below root, or those of a kind; gives their number."""
    runs = [r["run"] for r in list_runs(spark, root).select("run", "kind").distinct().collect() if kind in (None, r["kind"]) or kind and r["kind"].startswith(f"{kind}-")]
    for run in runs:
        clear(spark, f"{root}/{run}")
    return len(runs)


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run, kind, stage, finished) of all runs below root."""
    rows = []
    if exists(spark, root):
        system, target = _filesystem(spark, root)
        for run in system.listStatus(target):
            for stage in system.listStatus(run.getPath()):
                path = stage.getPath()
                rows.append((run.getPath().getName(), run.getPath().getName().rpartition("-")[0], path.getName(), system.exists(path.suffix("/_SUCCESS"))))
    return spark.createDataFrame(rows, "run string, kind string, stage string, finished boolean")


def save_model(spark: SparkSession, models: list, threshold: float, feature_names: list[str], path: str) -> None:
    """Each model, trees of our own as a table of nodes and Spark's in their format, and a sidecar with what load_model checks."""
    for i, m in enumerate(models):
        (m.frame(spark).coalesce(1).write.mode("overwrite").parquet if hasattr(m, "frame") else m.write().overwrite().save)(f"{path}/model-{i}")
    side = {"models": len(models), "kinds": ["nodes" if hasattr(m, "frame") else "spark" for m in models], "threshold": threshold, "preprocess_version": PREPROCESS_VERSION, "feature_names": list(feature_names)}
    spark.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/sidecar")


def json_report(tables: dict[str, DataFrame], meta: dict) -> str:
    """Small report tables as one JSON text."""
    return json.dumps({"meta": meta} | {name: [r.asDict(True) for r in df.collect()] for name, df in tables.items()}, default=str, sort_keys=True)
