"""Mixing sources to target weights by hierarchical budgeting.

Documents hang under a tree of domain, language and source. A token budget starts at the root; every
node shares its budget among its children by weight, no child getting more than the tokens under it
can give over max_epochs. What a child can't use goes to its siblings with room; only what all of them
together can't use was never given to their parent, because the parent's own share was limited by the
sum below it: shortages are made up among siblings first and by ancestors after.

A leaf with budget b and a tokens gives each document b div a times, and of one more epoch the prefix of
b mod a tokens in that epoch's seeded order (digest of id, seed and epoch). The prefix is a bound on the digest,
found from sums over digest ranges, so that no task ever holds a leaf, however large.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmesh.llm.common import cut, space_words, table

#: Ranges of the digest in which tokens are summed, and of that one of a leaf in which its budget ends, again; only one of about a million
#: ranges of each leaf is looked at row by row.
RANGES, LEVELS = 1024, 2
_BITS = 60
#: Leaves up to this number are broadcast (about 100 bytes each); beyond it the planner joins by shuffle.
BROADCAST_LEAVES = 50_000
#: Production parameters. Weights by path; a path not named weighs 1.
WEIGHTS: dict[tuple[str, ...], float] = {("web",): 2.0, ("books",): 3.0, ("web", "en"): 3.0, ("books", "en"): 2.0, ("web", "en", "src0"): 0.5}
SHARE = 0.6
MAX_EPOCHS = 3
SEED = 17

Level = tuple[str, Column]


def levels() -> list[Level]:
    """The tree of documents: web for even source numbers and those without, books for odd ones; then lang, then source."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]+)$", 1)
    domain = F.when(F.substring(number, -1, 1).isin("1", "3", "5", "7", "9"), "books").otherwise("web")
    return [("domain", domain), ("lang", F.coalesce(F.col("lang"), F.lit(""))), ("source", F.coalesce(F.col("source"), F.lit("")))]


def _weight(cols: Sequence[str], weights: Mapping[tuple[str, ...], float]) -> Column:
    """Weight of a node with as many levels as cols."""
    out = F
    for path, w in weights.items():
        if w <= 0:
            raise ValueError("weights must be above zero")
        if len(path) == len(cols):
            same = F.lit(True)
            for c, v in zip(cols, path, strict=True):
                same &= F.col(c) == v
            out = out.when(same, float(w))
    return F.lit(1.0) if out is F else out.otherwise(1.0)


def order(id_col: Column, seed: int, epoch: Column) -> Column:
    """Place of a document in an epoch's order: 60 bits of a digest. Rows with one id share a place."""
    text = F.concat_ws("|", F.coalesce(id_col.cast("string"), F.lit("")), F.lit(str(seed)), epoch.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def budgets(leaves: DataFrame, names: Sequence[str], *, share: float, max_epochs: int, weights: Mapping[tuple[str, ...], float]) -> DataFrame:
    """leaves: names and tokens. Adds budget, epochs (whole ones) and rest (tokens of one more). Without leaves there is nothing to plan; a leaf without tokens has no budget."""
    tree = leaves.withColumn("_km_cap", (F.col("tokens") * max_epochs).cast("double"))
    given = None
    for depth in range(1, len(names) + 1):
        path, up = list(names[:depth]), list(names[: depth - 1])
        parent = Window.partitionBy(*up) if up else Window.partitionBy(F.lit(0))
        nodes = tree.groupBy(*path).agg(F.sum("_km_cap").alias("_km_c"), F.sum("tokens").alias("_km_t"), *([F.first(given).alias("_km_b")] if given else [])).withColumn("_km_w", _weight(path, weights))
        if not given:
            nodes = nodes.withColumn("_km_b", F.floor(F.sum("_km_t").over(parent) * F.lit(share)).cast("double"))
        ranked = parent.orderBy(F.col("_km_c") / F.col("_km_w"), names[depth - 1])
        full = F.coalesce(F.sum("_km_c").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        left = F.sum("_km_w").over(ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        nodes = nodes.withColumn("_km_level", (F.col("_km_b") - full) / left)
        # The level rises while children fill up and falls after: its largest value is where the water stands.
        nodes = nodes.withColumn("_km_got", F.least("_km_c", F.col("_km_w") * F.max("_km_level").over(parent)))
        if depth == len(names):
            break
        down = nodes.select(*(F.col(c).alias(f"_km_n{i}") for i, c in enumerate(path)), F.col("_km_got").alias(f"_km_d{depth}"))
        on = None
        for i, c in enumerate(path):
            same = F.col(c) == F.col(f"_km_n{i}")
            on = same if on is None else on & same
        tree = tree.join(down, on).drop(*(f"_km_n{i}" for i in range(depth)))
        given = f"_km_d{depth}"
    budget = F.floor(F.round("_km_got", 3)).cast("bigint")
    tokens = (F.col("_km_c") / max_epochs).cast("bigint")
    out = nodes.select(*names, tokens.alias("tokens"), F.greatest(budget, F.lit(0).cast("bigint")).alias("budget"))
    some = F.col("tokens") > 0
    return out.withColumns({
        "epochs": F.when(some, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("bigint"),
        "rest": F.when(some, F.col("budget") % F.col("tokens")).otherwise(0).cast("bigint"),
    })


def cutoffs(sized: DataFrame, plan: DataFrame, names: Sequence[str], seed: int, few: bool) -> DataFrame:
    """plan with cutoff: a document is in the last, partial epoch if its place is at most cutoff (-1: none is).

    sized: id, names and tokens of each document. Places up to the cutoff hold at most rest tokens; rows with
    the same place go together.
    """
    some = plan.filter("rest > 0").select(*names, "epochs", "rest")
    placed = sized.join(F.broadcast(some) if few else some, list(names)).select(*names, "rest", "tokens", order(F.col("id"), seed, F.col("epochs")).alias("place"))
    bits, below = RANGES.bit_length() - 1, F.lit(0).cast("bigint")
    for level in range(1, LEVELS + 1):
        placed = placed.withColumn("range", F.shiftright("place", _BITS - level * bits))
        sums = placed.groupBy(*names, "range").agg(F.sum("tokens").alias("_km_t"), F.first("rest").alias("rest"), F.first(below).alias("_km_base"))
        before = F.coalesce(F.sum("_km_t").over(Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
        edge = sums.withColumn("_km_below", before + F.col("_km_base")).filter((F.col("_km_below") <= F.col("rest")) & (F.col("_km_below") + F.col("_km_t") > F.col("rest")))
        # Cut: the next level, and the rows at the end, look at one range of each leaf only.
        edge = cut(edge.select(*names, "range", "_km_below"))
        placed = placed.drop("_km_below").join(F.broadcast(edge) if few else edge, [*names, "range"])
        below = F.col("_km_below")
    inside = placed
    running = F.sum("tokens").over(Window.partitionBy(*names, "range").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = inside.withColumn("_km_sum", running + F.col("_km_below")).filter("_km_sum <= rest").groupBy(*names).agg(F.max("place").alias("_km_in"))
    start = edge.select(*names, (F.shiftleft(F.col("range").cast("bigint"), _BITS - LEVELS * bits) - 1).alias("_km_start"))
    bounds = start.join(found, list(names), "left").select(*names, F.coalesce("_km_in", "_km_start").alias("_km_cut"))
    return plan.join(bounds, list(names), "left").withColumn("cutoff", F.coalesce(F.col("_km_cut"), F.lit(-1).cast("bigint"))).drop("_km_cut")


def sizes(docs: DataFrame, tree: Sequence[Level], id_col: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """id, levels and tokens of each row: white-space words, or what tokens gives. Null texts and null counts are 0; repeated rows count each."""
    counted = F.size(space_words(F.col("text"))) if tokens is None else tokens
    return docs.select(F.col(f"`{id_col}`").alias("id"), *(c.alias(n) for n, c in tree), F.coalesce(counted, F.lit(0)).cast("bigint").alias("tokens"))


def plan_mix(docs: DataFrame, tree: Sequence[Level], *, share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: Mapping[tuple[str, ...], float] = WEIGHTS, seed: int = SEED, id_col: str = "doc_id", tokens: Column | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(sized documents, leaves with epochs and cutoff, whether the leaves are few enough to broadcast). An empty table has no leaves."""
    names = [n for n, _ in tree]
    sized = cut(sizes(docs, tree, id_col, tokens))
    leaves = sized.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    plan = cut(budgets(leaves, names, share=share, max_epochs=max_epochs, weights=weights))
    few = plan.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return sized, cut(cutoffs(sized, plan, names, seed, few)), few


def chosen(rows: DataFrame, plan: DataFrame, names: Sequence[str], few: bool, id_col: Column, seed: int) -> DataFrame:
    """One row for each time that a row is taken, with epoch from 0."""
    plan = plan.filter("budget > 0").select(*(F.col(n).alias(f"_km_p_{n}") for n in names), F.col("epochs").alias("_km_epochs"), F.col("cutoff").alias("_km_cutoff"))
    on = F.lit(True)
    for n in names:
        on &= F.col(f"_km_l_{n}") == F.col(f"_km_p_{n}")
    joined = rows.join(F.broadcast(plan) if few else plan, on)
    times = F.col("_km_epochs") + F.when(order(id_col, seed, F.col("_km_epochs")) <= F.col("_km_cutoff"), 1).otherwise(0)
    taken = joined.withColumn("_km_times", times).filter("_km_times > 0")
    return taken.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_km_times") - 1)))


def mix(docs: DataFrame, *, tree: Sequence[Level] | None = None, id_col: str = "doc_id", **how) -> DataFrame:
    """docs with all its columns, each row as often as its leaf's budget takes it.

    Null levels count as empty names, null texts as no tokens; a document without tokens is taken if its place is in
    the prefix. Rows with the same id stand at the same place and are taken or left together. All columns keep their values, whatever
    their names: the tree is worked out beside them. An empty table gives an empty table. Tokens are words unless tokens says otherwise.
    """
    tree = levels() if tree is None else list(tree)
    names, seed = [n for n, _ in tree], how.get("seed", SEED)
    _, plan, few = plan_mix(docs, tree, id_col=id_col, **how)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_km_row"), F.col(f"`{id_col}`").alias("_km_id"), *(c.alias(f"_km_l_{n}") for n, c in tree))
    return chosen(rows, plan, names, few, F.col("_km_id"), seed).select("_km_row.*")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, its leaf, tokens and epoch for every time that a document is taken."""
    tree = levels()
    names = [n for n, _ in tree]
    sized, plan, few = plan_mix(table(spark, sf_dir, "documents"), tree)
    rows = sized.select("id", "tokens", *names, *(F.col(n).alias(f"_km_l_{n}") for n in names))
    return chosen(rows, plan, names, few, F.col("id"), SEED).select(F.col("id").alias("doc_id"), *names, "tokens", "epoch")


def oracle() -> str:
    def weight(depth: int) -> str:
        names = ["domain", "lang", "source"][:depth]
        cases = [f"WHEN {' AND '.join(f'{c} = {v!r}' for c, v in zip(names, p, strict=True))} THEN {w}" for p, w in WEIGHTS.items() if len(p) == depth]
        return f"CAST(CASE {' '.join(cases)} ELSE 1.0 END AS DOUBLE)" if cases else "CAST(1.0 AS DOUBLE)"

    def fill(depth: int) -> str:
        path = ["domain", "lang", "source"][:depth]
        part = f"PARTITION BY {', '.join(path[:-1])}" if depth > 1 else ""
        up = f"JOIN g{depth - 1} USING ({', '.join(path[:-1])})" if depth > 1 else "CROSS JOIN (SELECT floor(sum(tokens) * CAST(" + str(SHARE) + " AS DOUBLE)) AS got FROM leaf) AS g0"
        return f"""
n{depth} AS (SELECT {', '.join(path)}, sum(CAST(tokens * {MAX_EPOCHS} AS DOUBLE)) AS c, {weight(depth)} AS w FROM leaf GROUP BY ALL),
l{depth} AS (SELECT n.*, (got - coalesce(sum(c) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM n{depth} AS n {up} WINDOW o AS ({part} ORDER BY c / w, {path[-1]})),
g{depth} AS (SELECT {', '.join(path)}, least(c, w * max(lev) OVER ({part})) AS got FROM l{depth})"""

    place = f"CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|{SEED}|' || CAST(epochs AS VARCHAR)), 1, 15) AS BIGINT)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1)[-1:] IN ('1', '3', '5', '7', '9') THEN 'books' ELSE 'web' END AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),{fill(1)},{fill(2)},{fill(3)},
p AS (SELECT domain, lang, source, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
  FROM (SELECT domain, lang, source, leaf.tokens, greatest(CAST(floor(round(got, 3)) AS BIGINT), 0) AS budget FROM g3 JOIN leaf USING (domain, lang, source))),
o AS (SELECT d.*, budget, epochs, rest, {place} AS place FROM d JOIN p USING (domain, lang, source)),
t AS (SELECT *, epochs + CASE WHEN rest > 0 AND sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS times FROM o)
SELECT doc_id, domain, lang, source, tokens, CAST(unnest(range(times)) AS BIGINT) AS epoch FROM t WHERE budget > 0"""
