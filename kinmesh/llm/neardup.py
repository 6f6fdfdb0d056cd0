"""Near-duplicate documents by bottom-k sketches of one hash function.

Every document has the set of its word shingles' hashes; its sketch is the K smallest of them. Documents with equal
sets form a class, and only one of each goes on. Inverted lists of the values kept in sketches bring documents
together: of each sketch only the rarest values are listed, as many as are needed for two sketches that overlap as two
linked documents' do to have one in common (all but a chance of less than 1e-6; sets that fit a sketch: for certain). Common passages are
in no list, then, unless nearly all of a document is common.

A list is led by its most connected document, and the lists with the same leader are one group. Groups are dealt into blocks of
bounded size. First each block is compared by itself with the leader in it; then only the documents that this has not joined to the
leader meet the other blocks. A task counts sketch overlaps of all pairs as a matrix product, estimates similarity on the
union of the two sketches, and compares the full sets of the pairs that remain and aren't joined yet. What leaves a
task are links that join something, fewer than it has documents, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.llm.bytesvec import SOLID, Words, groups, mix, text_bytes
from kinmesh.llm.common import cut, stored, table
from kinmesh.llm.components import components

SHINGLE = 5
K = 64
#: Two documents are linked if 100 * intersection >= percent * union: the operators' default, and what op9 asks for.
PERCENT, OP9_PERCENT = 80, 85
#: Chance at most that a sketch's overlap, or its estimate, keeps a pair at exactly the threshold from the check of its sets.
MISSED = 1e-9
#: Documents and shingles of a block.
BLOCK, BLOCK_SHINGLES = 256, 400_000
#: Documents to compare are broadcast up to this number of (task, document) rows (40 bytes each); beyond it texts are shuffled by id.
BROADCAST_TASKS = 200_000
#: Ids of documents to be left out are broadcast up to this number (8 bytes each).
BROADCAST_IDS = 500_000

_SALT = tuple(np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xE7037ED1A0B428DB, 0xA24BAED4963EE407))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle codes of each text. A text of fewer words is one shingle; without words there are none."""
    data, offsets = text_bytes(column)
    for low, high in groups(offsets):
        w = Words(data, offsets, low, high, SOLID)
        codes, first = w.grams(SHINGLE), w.first.tolist()
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= SHINGLE:
                yield np.unique(codes[a : b - SHINGLE + 1])
            elif b > a:
                short = np.zeros(1, np.uint64)
                for c in w.codes[a:b]:
                    short = mix(short + c + _SALT[2])
                yield short
            else:
                yield np.empty(0, np.uint64)


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (size of the set), k1 and k2 (128 bits that equal sets share), sketch (K smallest codes)."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, held = [], ([], []), []
            for s in shingle_sets(batch.column(text)):
                n.append(len(s))
                keys[0].append(mix(s ^ _SALT[0]).sum(dtype=np.uint64))
                keys[1].append(mix(s ^ _SALT[1]).sum(dtype=np.uint64))
                held.append(s[:K].view(np.int64))
            k1, k2 = (np.array(k, np.uint64).view(np.int64) for k in keys)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in held])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *held])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2), lists], schema.names)

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias(text)).mapInArrow(run, schema)


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity from two sketches: the share of the K smallest values of their union that both hold."""
    union = np.union1d(a, b)[:K]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / max(1, len(union))


def listed_share(percent: int) -> float:
    """Sketches of linked documents overlap in at least this share of the smaller one: 5.6 standard deviations below the mean."""
    p = percent / 100
    return round(p - 5.6 * (p * (1 - p) / K) ** 0.5, 2)


@cache
def checked_share(percent: int) -> float:
    """Pairs whose sketches overlap in less than this share of the smaller one, or that are less similar by estimate, go without a check of
    their sets. Both numbers are binomial at worst (one set in the other), and fall below it with a chance of MISSED at most."""
    p, below, n = percent / 100, 0.0, 0
    while below + comb(K, n) * p**n * (1 - p) ** (K - n) <= MISSED:
        below += comb(K, n) * p**n * (1 - p) ** (K - n)
        n += 1
    return n / K


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def overlaps(held: list[np.ndarray]) -> np.ndarray:
    """Numbers of common values of all pairs of sketches."""
    sizes = [len(s) for s in held]
    values, inverse, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(held)), sizes)
    shared = count[inverse] > 1
    names = np.cumsum(count > 1) - 1
    row, col = row[shared], names[inverse[shared]]
    out = np.zeros((len(held), len(held)), np.float32)
    for begin in range(0, int((count > 1).sum()), 4096):
        part = (col >= begin) & (col < begin + 4096)
        m = np.zeros((len(held), 4096), np.float32)
        m[row[part], col[part] - begin] = 1
        out += m @ m.T
    return out


def spanning_links(ids: list[int], sets: list[np.ndarray], side: np.ndarray, across: bool, percent: int) -> list[tuple[int, int]]:
    """Verified links that join the linked documents of two blocks (side 0 and 1) or, unless across, of one."""
    held = [s[:K] for s in sets]
    size = np.array([len(s) for s in sets], np.float64)
    small, large = np.minimum.outer(size, size), np.maximum.outer(size, size)
    m = np.minimum(small, K)
    maybe = (overlaps(held) >= np.maximum(1, m * checked_share(percent))) & (100 * small >= percent * large)
    maybe = np.triu(maybe, 1)
    if across:
        maybe &= side[:, None] != side[None, :]
    left, right = np.nonzero(maybe)
    forest, out = Forest(len(ids)), []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        if ids[a] == ids[b] or forest.find(a) == forest.find(b):
            continue
        if estimate(held[a], held[b]) >= checked_share(percent) and linked(sets[a], sets[b], percent):
            forest.join(a, b)
            out.append((ids[a], ids[b]))
    return out


_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_LED = T.StructType([T.StructField("leader", T.LongType()), *_LINKS.fields])


def _sets(group: pa.Table, text: str) -> list[np.ndarray]:
    texts = group.column(text).combine_chunks()
    return list(shingle_sets(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts))


def _compare(text: str, percent: int):
    """Links of a task of two blocks, or of one block with itself."""

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_pylist()
        low, high, block = (group.column(c).to_numpy() for c in ("low", "high", "block"))
        across = bool(low[0] != high[0])
        found = spanning_links(ids, _sets(group, text), (block == high).astype(int), across, percent) if len(ids) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _compare_led(text: str, percent: int):
    """Links of a block that holds its group's leader; documents joined to the leader in the block are linked to it directly."""

    def run(group: pa.Table) -> pa.Table:
        ids, leader = group.column("doc_id").to_pylist(), group.column("leader")[0].as_py()
        found = spanning_links(ids, _sets(group, text), np.zeros(len(ids), int), False, percent) if len(ids) > 1 else []
        known = {v: i for i, v in enumerate(dict.fromkeys([leader, *ids]))}
        forest = Forest(len(known))
        for a, b in found:
            forest.join(known[a], known[b])
        # The leader is number 0, so it is the root of all that are joined to it.
        led = [v for v, i in known.items() if i and forest.find(i) == 0]
        rest = [(a, b) for a, b in found if forest.find(known[a])]
        ends = [*((v, leader) for v in led), *rest]
        return pa.table({"leader": pa.array([leader] * len(ends), pa.int64()), "a": pa.array([a for a, _ in ends], pa.int64()), "b": pa.array([b for _, b in ends], pa.int64())})

    return run


def _run_tasks(rows: DataFrame, tasks: DataFrame, task, schema: T.StructType) -> DataFrame:
    """Of rows with the same id all texts are compared; they are one document with several texts."""
    few = tasks.limit(BROADCAST_TASKS + 1).count() <= BROADCAST_TASKS
    full = rows.join(F.broadcast(tasks) if few else tasks, "doc_id")
    return full.groupBy("leader", "low", "high").applyInArrow(task, schema)


def _blocks(count, shingles):
    return F.greatest(F.ceil(count / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def links(docs: DataFrame, classes: DataFrame, *, percent: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Links (a, b) between representatives of classes that join all linked ones, transitively. classes: rep, n, sketch."""
    kept = classes.select(F.col("rep").alias("doc_id"), "n", "sketch")
    listed = kept.select("doc_id", F.explode("sketch").alias("value"))
    # Cut before it is joined: only then can Spark split a value that very many documents hold.
    shared = cut(listed.groupBy("value").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"))
    hits = listed.join(shared.hint("merge"), "value").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("f", "value"))).alias("v"))
    hits = hits.join(kept.select("doc_id", "n").hint("merge"), "doc_id").withColumn("m", F.least(F.col("n"), F.lit(K)))
    # Values of one document alone come first in its order; what is left of the prefix goes to the rarest others.
    prefix = F.col("m") - F.ceil(F.col("m") * F.lit(listed_share(percent))) + 1 - (F.col("m") - F.size("v"))
    lists = hits.filter(prefix > 0).select("doc_id", "n", F.size("v").alias("known"), F.explode(F.slice("v", F.lit(1), prefix.cast("int"))).alias("s")).select("doc_id", "n", "known", F.col("s.value").alias("value"))
    lists = cut(lists)
    lead = cut(lists.groupBy("value").agg(F.min(F.struct((-F.col("known")).alias("k"), F.col("doc_id").alias("d"))).alias("l"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("value", F.col("l.d").alias("leader")))
    member = cut(lists.join(lead.hint("merge"), "value").select("leader", "doc_id", "n").distinct())
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias(text))

    # First every block by itself, the group's leader being in each: linear in the group.
    blocks = cut(member.groupBy("leader").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks")))
    dealt = member.filter("doc_id <> leader").join(blocks.hint("merge"), "leader").select("leader", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"))
    leaders = blocks.select("leader", F.col("leader").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    tasks = cut(dealt.unionByName(leaders).select("leader", "doc_id", F.col("block").alias("low"), F.col("block").alias("high")))
    near = cut(_run_tasks(rows, tasks, _compare_led(text, percent), _LED))

    # Then, in groups of several blocks, documents that aren't joined to the leader yet with all others.
    large = blocks.filter("blocks > 1").select("leader")
    led = near.filter("b = leader").select("leader", F.col("a").alias("doc_id")).distinct().withColumn("led", F.lit(True))
    open_ = member.join(large.hint("merge"), "leader").join(led.hint("merge"), ["leader", "doc_id"], "left")
    open_ = cut(open_.select("leader", "doc_id", "n", (F.coalesce("led", F.lit(False)) | (F.col("doc_id") == F.col("leader"))).alias("led")))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    shingles = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    split = cut(open_.groupBy("leader").agg(_blocks(count(~F.col("led")), shingles(~F.col("led"))).alias("u"), _blocks(count(F.col("led")), shingles(F.col("led"))).alias("r")).filter("u > 0"))
    # Blocks below u hold open documents, the others those that are joined; every task has a block of open ones.
    spread = F.xxhash64("doc_id", F.lit(1))
    again = open_.join(split.hint("merge"), "leader").withColumn("block", F.when(F.col("led"), F.col("u") + F.pmod(spread, F.col("r"))).otherwise(F.pmod(spread, F.col("u"))).cast("int"))
    again = again.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("led"), F.col("u")).otherwise(F.col("u") + F.col("r")) - 1)))
    tasks = cut(again.select("leader", "doc_id", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))
    far = _run_tasks(rows, tasks, _compare(text, percent), _LINKS)
    return near.select("a", "b").unionByName(far)


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept, class_id (smallest id with the same set).

    Null, empty and blank texts have no shingles and are linked with nothing. Rows with the same id are one document: they share
    the links of all their texts, which are taken whole, however long. A row without an id is linked with nothing, has no component and is kept. An empty table
    gives an empty table; other columns of docs play no part.
    """
    base = stored(sketches(docs, id_col=id_col, text=text), "sketches")
    some = base.filter("n > 0 AND doc_id IS NOT NULL")
    classes = stored(some.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    found = links(docs, classes, percent=percent, id_col=id_col, text=text)
    inside = base.select("doc_id", "n", "k1", "k2").join(classes.select("n", "k1", "k2", "rep").hint("merge"), ["n", "k1", "k2"], "left")
    inside = cut(inside.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id")))
    # Rows of one id with different texts tie their classes together.
    several = inside.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).filter("a < b")
    ties = inside.join(several.select("doc_id"), "doc_id", "left_semi").filter("class_id <> doc_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    joined = cut(components(found.unionByName(ties)))
    out = inside.join(joined.hint("merge"), F.col("class_id") == F.col("node"), "left")
    component = F.least(F.coalesce("component", "class_id"), "class_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "class_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def keep_one(docs: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near duplicates of a document with a smaller id, same columns. Of rows with the same id all stay or go."""
    gone = cut(near_duplicates(docs, percent=percent, id_col=id_col, text=text).filter("NOT kept").select(F.col("doc_id").alias("_km_gone")).distinct())
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col(f"`{id_col}`").cast("bigint") == F.col("_km_gone"), "left_anti")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=OP9_PERCENT)
