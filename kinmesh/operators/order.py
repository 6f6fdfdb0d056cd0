"""Running sums and smallest rows of a whole table without a task that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.sources.writers import stored

#: Hex digits by which a digest's range is divided at a time, and the rows below which a range is read.
DIGITS, FEW = 3, 1000


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> tuple[DataFrame, dict[str, int]]:
    """(df with a column for each of sums, {new column: column}: its sum over the rows up to this one, in order, and those that tie with it; the totals).

    Rows are dealt by ranges of order, so ties lie together; each range is summed by itself, and the driver adds up the ranges, one row each.
    """
    part = F.spark_partition_id().alias("_part")
    rows = stored(df.repartitionByRange(*order).select("*", part), "ranges")
    parts = sorted(rows.groupBy("_part").agg(*(F.sum(c).alias(n) for n, c in sums.items())).collect(), key=lambda r: r["_part"])
    before, total = [], dict.fromkeys(sums, 0)
    for r in parts:
        before.append((r["_part"], *total.values()))
        total = {n: total[n] + (r[n] or 0) for n in sums}
    schema = ", ".join(["_part int", *(f"_b_{n} long" for n in sums)])
    upto = Window.partitionBy("_part").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()}).join(F.broadcast(df.sparkSession.createDataFrame(before, schema)), "_part")
    return out.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).drop("_part", *(f"_b_{n}" for n in sums)), total


def smallest(df: DataFrame, digest: str, ties: list[str], n: int) -> DataFrame:
    """The n rows of df that come first by a column of hex digits and then by ties; rows alike in all of these come together.

    The digest's range is divided until the n-th row is known, from counts of ranges; no rows are sorted but the last range's few.
    """
    if n <= 0:
        return df.limit(0)
    keys = df.select(digest, *ties)
    prefix, need = "", n
    while True:
        at = F.substring(digest, len(prefix) + 1, DIGITS)
        counts = sorted((r["at"], r["count"]) for r in keys.filter(F.startswith(F.col(digest), F.lit(prefix))).groupBy(at.alias("at")).count().collect())
        for name, count in counts:
            if count >= need:
                break
            need -= count
        else:
            return df
        prefix += name
        if count <= FEW or not name:
            break
    last = keys.filter(F.startswith(F.col(digest), F.lit(prefix))).orderBy(digest, *ties).limit(need).collect()[-1]
    same, bound = F.lit(True), F.lit(False)
    for c in (digest, *ties):
        bound |= same & (F.col(c) < F.lit(last[c]))
        same &= F.col(c) == F.lit(last[c])
    return df.filter(bound | same)
