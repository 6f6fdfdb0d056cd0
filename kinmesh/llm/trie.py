"""Prefix trie of conversations by partition refinement.

A conversation is its turns in order; a node is a distinct sequence of first turns, and its members are the conversations that start
with it. Conversations with equal sequences are one sequence with a number of members. Refinement starts with one class that holds
every sequence. In each round a class runs on as a chain as long as all its sequences have the same next turn, and is split by the next one
where they don't. A class of a single sequence is retired at once; its tail is emitted as a chain of its own. What a class
covers, from the node where it began to the node where it is split or retired, is a segment, and the segments are a tree. Fold
back: from the last round to the first, totals of segments are added to the segment they were split from, and each node takes the
running total of its own segment beside that.

Rounds are as many as there are nodes with several children on a path, not as there are turns. No step brings the turns of
a conversation, or the members of a node, together in one place: turns are numbered by ranges, and members are digested in chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.llm.common import cut, running, space_words, stored, table

#: Conversations c take their first turns from c - c % HOSTS, HEADS - 1 of them at most.
HOSTS, HEADS = 20, 4
#: Members of a sequence are digested in chunks of 2 ** CHUNK_BITS ids at most.
CHUNK_BITS = 8
#: Classes of a round (100 bytes each) are broadcast up to this number; beyond it the joins are by shuffle.
BROADCAST_CLASSES = 100_000

EMPTY = hashlib.sha256().hexdigest()
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), key (digest of role and text), words. Rows without a conv_id belong to no conversation and go.

    Turns are in order of turn, null first; those with the same turn by role, then by digest. Null role or text is the empty one.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.when(text == "", 0).otherwise(F.size(space_words(text))).cast("bigint")
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), key.alias("key"), words.alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("key").asc()]
    return running(rows, ["conv_id"], order, F.lit(1), "pos", "turns").select("conv_id", "pos", "key", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) of conversations rebuilt from numbered ones: the first h turns of conversation c - c % HOSTS, then all but the first h of
    c's own, h being crc32 of the decimal c, modulo HEADS. ids holds every conversation, those without turns too."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    heads = cut(turns.filter(F.col("pos") < HEADS - 1).select(F.col("conv_id").alias("host"), "pos", "key", "words"))
    ids = cut(turns.filter("pos = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % HOSTS).alias("host"), h.alias("h")))
    lent = ids.filter("h > 0").join(heads.hint("merge"), "host").filter("pos < h").select("conv_id", "pos", "key", "words")
    # Own turns move up where the host has fewer than h; a host has HEADS - 1 turns to lend at most.
    host = heads.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    short = ids.filter("h > 0").join(host.hint("merge"), "host", "left").select("conv_id", (F.col("h") - F.least("h", F.coalesce("n", F.lit(0)))).alias("short")).filter("short > 0")
    own = turns.filter(F.col("pos") >= h).join(short.hint("merge"), "conv_id", "left")
    own = own.select("conv_id", (F.col("pos") - F.coalesce("short", F.lit(0))).alias("pos"), "key", "words")
    return stored(lent.unionByName(own), "rebuilt"), ids.select("conv_id")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sequence lie together, its chunks in order: one row for each sequence, with its smallest member and the digest of all."""
    names = ["rep", "len", "m", "sha"]
    open_, out = None, []

    def flushed() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)

    for batch in batches:
        for n, a, b, low, m, ids in zip(*(batch.column(c).to_pylist() for c in ("len", "a", "b", "low", "m", "ids")), strict=True):
            if open_ and open_[0] == (n, a, b):
                open_[2] += m
                open_[3].update(b"," + ids.encode())
            else:
                if open_:
                    out.append((open_[1], open_[0][0], open_[2], open_[3].hexdigest()))
                open_ = [(n, a, b), low, m, hashlib.sha256(ids.encode())]
        yield flushed()
        out = []
    if open_:
        out = [(open_[1], open_[0][0], open_[2], open_[3].hexdigest())]
        yield flushed()


def sequences(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each distinct sequence: rep (smallest member), len, m (members), sha (digest of the members' ids)."""
    bits = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "pos", "key"))
    sums = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"), bits(1).alias("a"), bits(2).alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    all_ = ids.join(sums.hint("merge"), "conv_id", "left").select("conv_id", zero("len"), zero("a"), zero("b"))
    chunks = all_.groupBy("len", "a", "b", F.shiftright("conv_id", CHUNK_BITS).alias("chunk"))
    chunks = chunks.agg(F.min("conv_id").alias("low"), F.count(F.lit(1)).alias("m"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    # Only chunks, a row for members whose ids lie close, meet where a digest is made; it is made as they come by.
    dealt = cut(chunks).repartition("len", "a", "b").sortWithinPartitions("len", "a", "b", "chunk")
    return stored(dealt.mapInArrow(_digest, "rep long, len long, m long, sha string"), "sequences")


def _side(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_CLASSES else df.hint("merge")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each node of the trie of turns (conv_id, pos from 0 without gaps, key, words), members being the conversations of ids.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A node is named by its smallest member and its depth.
    Conversations of ids without turns end at the root. Without conversations there is no node, not even the root.
    """
    spark = ids.sparkSession
    found = sequences(turns, ids)
    total = found.agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"), F.min("rep").alias("low")).first()
    node = "conv_id long, depth long, parent_conv_id long, n_convs long, words long, top long"
    if not total["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    root = total["low"]
    rows = stored(turns.join(found.select(F.col("rep").alias("conv_id"), "len", "m").hint("merge"), "conv_id").select(F.col("conv_id").alias("rep"), "pos", "key", "words", "m", "len"), "sequence-turns")

    nodes = [spark.createDataFrame([(root, 0, None, total["m"], 0, 0)], node)]
    rounds = [spark.createDataFrame([(root, 0, None, None, total["n"] == 1)], "conv_id long, top long, up long, up_top long, single boolean")]
    single = [rounds[0].filter("single").select(F.col("conv_id").alias("rep"), "top", F.lit(0).cast("bigint").alias("since"))]
    ends = [found.filter(F.lit(total["n"] == 1)).select(F.col("rep").alias("conv_id"), F.col("len").alias("depth"), "rep")]
    active = found.select("rep", "m", "len", F.lit(root).alias("cls"), F.lit(0).cast("bigint").alias("top"))
    work = rows.withColumn("cls", F.lit(root))
    n_classes = 0 if total["n"] == 1 else 1
    while n_classes:
        sizes = cut(active.groupBy("cls").agg(F.count(F.lit(1)).alias("seqs"), F.sum("m").alias("n_convs"), F.min("top").alias("top")))
        level = work.groupBy("cls", "pos").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("k0"), F.max("key").alias("k1"), F.max("words").alias("words"))
        level = cut(level.join(_side(sizes, n_classes), "cls").select("cls", "pos", "words", "n_convs", "top", (~((F.col("c") == F.col("seqs")) & (F.col("k0") == F.col("k1")))).alias("splits")))
        stops = _side(cut(level.filter("splits").groupBy("cls").agg(F.min("pos").alias("stop"), F.min("top").alias("top"))), n_classes)
        chain = level.drop("top").join(stops, "cls").filter("pos < stop")
        nodes.append(chain.select(F.col("cls").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("cls").alias("parent_conv_id"), "n_convs", "words", "top"))
        ends.append(active.drop("top").join(stops, "cls").filter("len = stop").select(F.col("cls").alias("conv_id"), F.col("stop").alias("depth"), "rep"))
        here = work.join(stops, "cls").filter("pos = stop")
        kids = here.groupBy("cls", "key").agg(F.min("rep").alias("kid"), F.count(F.lit(1)).alias("seqs"), F.sum("m").alias("n_convs"), F.max("words").alias("words"), F.min("stop").alias("stop"), F.min("top").alias("up_top"), F.min("len").alias("len"))
        kids = cut(kids.withColumn("top", F.col("stop") + 1))
        nodes.append(kids.select(F.col("kid").alias("conv_id"), F.col("top").alias("depth"), F.col("cls").alias("parent_conv_id"), "n_convs", "words", "top"))
        rounds.append(kids.select(F.col("kid").alias("conv_id"), "top", F.col("cls").alias("up"), "up_top", (F.col("seqs") == 1).alias("single")))
        alone, several = kids.filter("seqs = 1"), kids.filter("seqs > 1").select("cls", "key", "kid", F.col("top").alias("kid_top"))
        single.append(alone.select(F.col("kid").alias("rep"), "top", F.col("top").alias("since")))
        ends.append(alone.select(F.col("kid").alias("conv_id"), F.col("len").alias("depth"), F.col("kid").alias("rep")))
        n_classes = several.count()
        if n_classes:
            active = cut(here.drop("top").join(_side(several, n_classes), ["cls", "key"]).select("rep", "m", "len", F.col("kid").alias("cls"), F.col("kid_top").alias("top")))
            work = cut(work.drop("cls").join(active.select("rep", "cls", "top").hint("merge"), "rep").filter("pos >= top").drop("top"))

    tails = rows.join(_union(single).hint("merge"), "rep").filter("pos >= since")
    nodes.append(tails.select(F.col("rep").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("m").alias("n_convs"), "words", "top"))
    saved = (F.col("n_convs") - 1) * F.col("words")
    every = stored(running(_union(nodes), ["conv_id", "top"], [F.col("depth").desc()], saved, "after", "nodes").withColumn("below", F.col("after") + saved), "nodes")
    segments = cut(every.groupBy("conv_id", "top").agg(F.max("below").alias("own"), F.max("depth").alias("last")))

    totals, lower = [], None
    for known in reversed(rounds):
        part = known.join(segments.hint("merge"), ["conv_id", "top"])
        if lower is None:
            part = part.select("*", *(F.lit(0).cast("bigint").alias(c) for c in ("kids", "kid_leaves", "kid_saved")))
        else:
            sums = lower.groupBy(F.col("up").alias("conv_id"), F.col("up_top").alias("top")).agg(F.count(F.lit(1)).alias("kids"), F.sum("leaves").alias("kid_leaves"), F.sum("saved").alias("kid_saved"))
            part = part.join(sums.hint("merge"), ["conv_id", "top"], "left").fillna(0, ["kids", "kid_leaves", "kid_saved"])
        leaves = F.when(F.col("single"), F.lit(1)).otherwise(F.col("kid_leaves")).cast("bigint")
        lower = cut(part.select("conv_id", "top", "up", "up_top", "last", "kids", "kid_saved", leaves.alias("leaves"), (F.col("own") + F.col("kid_saved")).alias("saved")))
        totals.append(lower)
    out = every.join(_union(totals).select("conv_id", "top", "last", "kids", "kid_saved", "leaves").hint("merge"), ["conv_id", "top"])
    ended = _union(ends).join(found.select("rep", "sha").hint("merge"), "rep").select("conv_id", "depth", "sha")
    out = out.join(ended.hint("merge"), ["conv_id", "depth"], "left")
    children = F.when(F.col("depth") < F.col("last"), F.lit(1)).otherwise(F.col("kids")).cast("bigint")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", children.alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("below") + F.col("kid_saved")).alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are (conv_id, turn, role, text); further columns play no part.

    Rows without a conv_id go. Null turns come first; turns with the same number are in order of role, then of a digest; repeated rows are turns of their own. Null role
    or text is empty, and an empty turn is a turn without words. Texts are taken whole. An empty table gives an empty table.
    """
    turns = stored(numbered(conversations), "numbered")
    return prefix_trie(turns, turns.filter("pos = 0").select("conv_id"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(numbered(table(spark, sf_dir, "conversations")), "numbered")
    return prefix_trie(*rebuilt(turns))


def oracle() -> str:
    """SQL of op11: a node is the string of its turns' digests, and its ancestors are the beginnings of that string."""
    return f"""
with own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos,
    md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as k,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) as words
  from conversations where conv_id is not null
), ids as (
  select conv_id, conv_id - conv_id % {HOSTS} as host, xor(list_reduce(list_concat([4294967295::bigint],
    flatten(list_transform(regexp_extract_all(conv_id::varchar, '.'), lambda ch: list_concat([ascii(ch)::bigint], list_transform(range(7), lambda i: 0::bigint))))),
    lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295) % {HEADS} as h
  from (select distinct conv_id from own)
), turns as (
  select i.conv_id, o.pos as q, k, words from ids i join own o on o.conv_id = i.host and o.pos < h
  union all
  select i.conv_id, 1000000 + o.pos, k, words from ids i join own o on o.conv_id = i.conv_id and o.pos >= h
), paths as (
  select conv_id, row_number() over w as depth, string_agg(k, '') over w as path, words from turns
  window w as (partition by conv_id order by q rows between unbounded preceding and current row)
  union all
  select conv_id, 0, '', 0 from ids
), last as (
  select conv_id, max(depth) as depth, max_by(path, depth) as path from paths group by conv_id
), ended as (
  select path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as sha from last group by path
), nodes as (
  select path, depth, min(conv_id) as conv_id, count(*) as n, max(words) as words from paths group by path, depth
), kids as (
  select left(path, 32 * (depth - 1)) as path, count(*) as c from nodes where depth > 0 group by 1
), below as (
  select left(n.path, 32 * e.d) as path, count(*) filter (k.c is null) as leaves, sum((n.n - 1) * n.words) as saved
  from nodes n left join kids k using (path), lateral (select unnest(range(0, n.depth + 1)) as d) e group by 1
)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n as n_convs, coalesce(k.c, 0)::bigint as n_children, b.leaves::bigint as n_leaves,
  b.saved::bigint as saved_tokens, coalesce(e.sha, '{EMPTY}') as ends_sha256
from nodes n join below b using (path) left join kids k using (path) left join ended e using (path)
left join nodes p on n.depth > 0 and p.path = left(n.path, 32 * (n.depth - 1))
"""
