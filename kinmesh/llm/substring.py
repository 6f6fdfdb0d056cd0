"""Substring dedup by hashing lines and paragraphs.

Lines: texts are split at line feeds; units of MIN_WORDS words or more are normalised (A-Z lowered, white space collapsed) and
digested. Digests are grouped over the whole corpus; the occurrence with the smallest (rank, unit) stays, the others are removed.

Line feeds can't show a passage that is broken into short lines, or set inside longer lines that differ. So paragraphs of PASSAGE
words are hashed too, wherever they begin, and every one that stands earlier is removed. To keep that small, paragraphs are taken in
bundles whose ends the words themselves decide, so that copies have the same ones: the paragraphs one after the other that have the same
place as their least gram of GRAM words make a bundle. Bundles are grouped by that gram. A bundle that stands
earlier as a whole goes as a whole; only of the first of its kind, and where its gram has bundles of other kinds, are paragraphs digested one by one.

No step broadcasts; every join is by shuffle on a key whose other side is grouped and written before, so that Spark can split a key that very
many documents hold. Each removal keeps its place in the original text. Codes of grams, bundles and paragraphs are 64 bits each, and two of them together tell a
bundle or a paragraph.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.llm.bytesvec import SOLID, Words, groups, mix, text_bytes
from kinmesh.llm.common import cut, stored, table

MIN_WORDS = 20
#: Words of a paragraph, and of the grams whose least one stands for it.
PASSAGE, GRAM = 50, 25

_LINE = T.StructType([*(T.StructField(n, T.LongType()) for n in ("unit", "start", "end", "n_words")), T.StructField("digest", T.BinaryType())])
#: Of a bundle: gram, code of all its paragraphs, first word, number of paragraphs, and its characters.
_BUNDLE = T.StructType([T.StructField("gram", T.LongType()), T.StructField("code", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in ("word", "n", "start", "end"))])
#: A document is told by its id and a hash of its text; rows equal in both are one document.
_KEY = ["_km_id", "_km_x"]


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("_km_id"), F.xxhash64(F.col(f"`{text}`")).alias("_km_x"), F.col(f"`{text}`").alias("_km_text"))


def _rank(place: str) -> Column:
    return F.struct(F.col("_km_id").isNull().alias("last"), F.col("_km_id").alias("id"), F.col("_km_x").alias("x"), F.col(place).cast("bigint").alias("at"))


def _lines(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Number of units of each text, and the columns of _LINE."""
    count, rows = np.zeros(len(offsets) - 1, np.int64), ([], [], [], [], [])
    for d in range(len(offsets) - 1):
        at = 0
        for unit, line in enumerate(data[offsets[d] : offsets[d + 1]].tobytes().split(b"\n")):
            size = len(line.decode())
            words = line.split()
            if len(words) >= min_words:
                count[d] += 1
                for out, v in zip(rows, (unit, at, at + size, len(words), hashlib.blake2b(b" ".join(words).lower(), digest_size=16).digest()), strict=True):
                    out.append(v)
            at += size + 1
    return count, [*(pa.array(x, pa.int64()) for x in rows[:4]), pa.array(rows[4], pa.binary())]


def _characters(w: Words, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters before each byte, and before each document's first byte."""
    chars = np.concatenate([[0], np.cumsum((w.text & 0xC0) != 0x80)])
    return chars, chars[docs]


def _bundles(data: np.ndarray, offsets: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Number of bundles of each text, and the columns of _BUNDLE."""
    count, parts = np.zeros(len(offsets) - 1, np.int64), []
    for low, high in groups(offsets):
        w = Words(data, offsets, low, high, SOLID)
        whole = np.flatnonzero(w.within(words))
        if not len(whole):
            continue
        codes, least = w.grams(gram), np.empty(len(whole), np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(codes, words - gram + 1)
        for at in range(0, len(whole), 65_536):
            part = whole[at : at + 65_536]
            least[at : at + 65_536] = part + windows[part].argmin(axis=1)
        begin = np.flatnonzero(np.concatenate([[True], np.diff(least) != 0]))
        n = np.diff(np.append(begin, len(whole)))
        first = whole[begin]
        of = np.add.reduceat(mix(w.grams(words)[whole] ^ mix((least - whole).astype(np.uint64))), begin)
        doc = w.doc[first]
        count[low:high] = np.bincount(doc, minlength=high - low)
        chars, base = _characters(w, offsets[low:high] - offsets[low])
        parts.append((codes[least[begin]].view(np.int64), of.view(np.int64), first - w.first[doc], n, chars[w.starts[first]] - base[doc], chars[w.ends[first + n + words - 2]] - base[doc]))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 6
    return count, [pa.array(c, pa.int64()) for c in columns[:2]] + [pa.array(c.astype(np.int32)) for c in columns[2:]]


def _read(docs: DataFrame, id_col: str, text: str, *, min_words: int | None = None, words: int | None = None, gram: int = GRAM) -> DataFrame:
    """One row a row of docs in the shared folder: its key, its lines and its bundles, as far as asked for."""
    rows = _rows(docs, id_col, text)
    wanted = [*([("lines", _LINE, lambda d, o: _lines(d, o, min_words))] if min_words is not None else []), *([("bundles", _BUNDLE, lambda d, o: _bundles(d, o, words, gram))] if words is not None else [])]
    schema = T.StructType([*(rows.schema[c] for c in _KEY), *(T.StructField(name, T.ArrayType(kind)) for name, kind, _ in wanted)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_km_text"))
            lists = []
            for _, kind, find in wanted:
                count, columns = find(data, offsets)
                ends = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                lists.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, kind.names)))
            yield pa.RecordBatch.from_arrays([batch.column("_km_id"), batch.column("_km_x"), *lists], schema.names)

    return stored(rows.mapInArrow(run, schema), "units")


def _later_lines(read: DataFrame) -> DataFrame:
    """Key, the columns of a line, and first, the place of the occurrence that stays."""
    found = read.select(*_KEY, F.explode("lines").alias("u")).select(*_KEY, "u.*")
    # Cut before they are joined: only then can Spark split a digest that very many documents hold.
    first = cut(found.groupBy("digest").agg(F.count(F.lit(1)).alias("c"), F.min(_rank("unit")).alias("first")).filter("c > 1").drop("c"))
    return found.join(first.hint("merge"), "digest").filter(_rank("unit") > F.col("first")).drop("digest")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each line to be removed: id, unit, start, end, n_words, and first_<id> and first_unit of the occurrence that stays.

    The smallest (id, hash of the text, unit) stays; a null id ranks last. Repeats within a text count too. Null and empty texts have no
    units. Rows equal in id and text are one document and keep the same places, rows with the same id and other texts are
    others. An empty table gives an empty result; texts of any length are taken whole; other columns of docs play no part.
    """
    return _line_rows(_later_lines(_read(docs, id_col, text, min_words=min_words)), id_col)


def _line_rows(later: DataFrame, id_col: str) -> DataFrame:
    return later.select(F.col("_km_id").alias(id_col), "_km_x", "unit", "start", "end", "n_words", F.col("first.id").alias(f"first_{id_col}"), F.col("first.at").alias("first_unit")).distinct().drop("_km_x")


def _hidden(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Whole rows in one column beside the key and the text, so that no name clashes."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_km_row"), F.col(f"`{id_col}`").alias("_km_id"), F.xxhash64(F.col(f"`{text}`")).alias("_km_x"), F.col(f"`{text}`").alias("_km_text"))


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return (a["_km_x"] == b["_km_y"]) & a["_km_id"].eqNullSafe(b["_km_of"])


def _with_spans(hidden: DataFrame, spans: DataFrame) -> DataFrame:
    """hidden plus _km_spans of its document: null where there are none."""
    spans = spans.select(F.col("_km_id").alias("_km_of"), F.col("_km_x").alias("_km_y"), "_km_spans")
    return hidden.join(spans, _same_document(hidden, spans), "left")


def _with_text(cleaned: DataFrame, docs: DataFrame, text: str, *more: Column) -> DataFrame:
    return cleaned.select(*(F.col("_km_done").alias(c) if c == text else F.col(f"_km_row.`{c}`") for c in docs.columns), *more)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the repeated lines left out of their texts, same columns, and removed: unit, start and end of each, in order (null where there are none).

    Rows are told apart by id and text, as in repeats. A column named removed is replaced. Null texts stay null; an empty table stays empty.
    """
    later = _later_lines(_read(docs, id_col, text, min_words=min_words))
    spans = later.groupBy(*_KEY).agg(F.sort_array(F.collect_set(F.struct("unit", "start", "end"))).alias("_km_spans"))
    joined = _with_spans(_hidden(docs, id_col, text), spans)
    gone = F.transform("_km_spans", lambda r: r["unit"])
    lines = F.filter(F.split("_km_text", "\n"), lambda x, i: ~F.array_contains(gone, i.cast("bigint")))
    joined = joined.withColumn("_km_done", F.when(F.col("_km_spans").isNull(), F.col("_km_text")).otherwise(F.array_join(lines, "\n")))
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "removed"))
    return _with_text(joined, kept, text, F.col("_km_spans").alias("removed"))


_PARAGRAPH = T.StructType([T.StructField("gram", T.LongType()), T.StructField("k", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in ("word", "start", "end"))])


def _single(rows: DataFrame, words: int) -> DataFrame:
    """rows: key, text and spans (gram, word, n). Every paragraph of the spans: key and _PARAGRAPH."""
    schema = T.StructType([*(rows.schema[c] for c in _KEY), *_PARAGRAPH.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_km_text"))
            spans = batch.column("spans")
            ends, flat = spans.offsets.to_numpy(), spans.flatten()
            gram, word, n = (flat.field(i).to_numpy() for i in range(3))
            ends = ends - ends[0]
            for low, high in groups(offsets):
                w = Words(data, offsets, low, high, SOLID)
                own = slice(ends[low], ends[high])
                doc = np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))
                size = n[own].astype(np.int64)
                first = word[own] + w.first[doc]
                at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                doc = np.repeat(doc, size)
                chars, base = _characters(w, offsets[low:high] - offsets[low])
                key = pa.array(doc + low)
                codes = (np.repeat(gram[own], size), w.grams(words)[at].view(np.int64))
                places = (at - w.first[doc], chars[w.starts[at]] - base[doc], chars[w.ends[at + words - 1]] - base[doc])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(key) for c in _KEY), *(pa.array(c, pa.int64()) for c in codes), *(pa.array(p.astype(np.int32)) for p in places)], schema.names)

    return rows.mapInArrow(run, schema)


def _later_passages(docs: DataFrame, read: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """Runs of words that stand earlier: key, word, n_words, start, end, first. They overlap; together they hold every such paragraph."""
    bundles = read.select(*_KEY, F.explode("bundles").alias("b")).select(*_KEY, "b.*")
    kinds = bundles.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), (F.min("code") < F.max("code")).alias("several")).filter("c > 1").drop("c")
    again = stored(bundles.join(cut(kinds).hint("merge"), "gram"), "bundles")
    first = cut(again.groupBy("gram", "code").agg(F.count(F.lit(1)).alias("c"), F.min(_rank("word")).alias("first")).filter("c > 1").drop("c"))
    judged = again.join(first.hint("merge"), ["gram", "code"], "left").withColumn("later", F.coalesce(_rank("word") > F.col("first"), F.lit(False)))
    judged = stored(judged.filter("later OR several").drop("code", "several"), "judged")
    spans = judged.filter("NOT later").groupBy(*_KEY).agg(F.collect_list(F.struct("gram", "word", "n")).alias("spans"))
    spans = spans.select(F.col("_km_id").alias("_km_of"), F.col("_km_x").alias("_km_y"), "spans")
    rows = _rows(docs, id_col, text)
    single = stored(_single(rows.join(spans.hint("merge"), _same_document(rows, spans)).select(*_KEY, "_km_text", "spans"), words), "paragraphs")
    stays = cut(single.groupBy("gram", "k").agg(F.count(F.lit(1)).alias("c"), F.min(_rank("word")).alias("first")).filter("c > 1").drop("c"))
    alone = single.join(stays.hint("merge"), ["gram", "k"]).filter(_rank("word") > F.col("first"))
    columns = lambda n: [*_KEY, F.col("word").cast("bigint").alias("word"), n.cast("bigint").alias("n_words"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "first"]
    return judged.filter("later").select(columns(F.col("n") + (words - 1))).unionByName(alone.select(columns(F.lit(words))))


def _merged(later: DataFrame, by: list[str]) -> DataFrame:
    """Runs that touch or overlap made one: by, word, n_words, start, end, first (of the first of them)."""
    over = Window.partitionBy(*by).orderBy("word", "n_words")
    before = F.max(F.col("word") + F.col("n_words")).over(over.rowsBetween(Window.unboundedPreceding, -1))
    new = later.withColumn("_km_new", F.when(F.col("word") <= before, 0).otherwise(1))
    runs = new.withColumn("_km_run", F.sum("_km_new").over(over))
    return runs.groupBy(*by, "_km_run").agg(
        F.min("word").alias("word"), (F.max(F.col("word") + F.col("n_words")) - F.min("word")).alias("n_words"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("first").alias("first")
    )


def passages(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """One row for each run of words to be removed: id, word (from 0), n_words, start and end (characters), first_<id> and first_word of an earlier place of the same run.

    Every `words` consecutive words that stand earlier, in the order of (id, hash of the text, word) with a null id last, are in a row; the earliest
    place of each stays. Words are as in repeats, and so are rows with the same id. Rows of one text overlap where the places they repeat change.
    Null and empty texts and those of fewer words have no rows; an empty table gives an empty result; texts are taken whole; other columns play no part.
    """
    later = _later_passages(docs, _read(docs, id_col, text, words=words, gram=gram), id_col, text, words)
    source = ["_km_first", "_km_fx", "_km_shift"]
    later = later.select("*", F.col("first.id").alias("_km_first"), F.col("first.x").alias("_km_fx"), (F.col("word") - F.col("first.at")).alias("_km_shift"))
    out = _merged(later, [*_KEY, *source])
    return out.select(F.col("_km_id").alias(id_col), "word", "n_words", "start", "end", F.col("_km_first").alias(f"first_{id_col}"), F.col("first.at").alias("first_word"))


def remove_passages(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """docs with the repeated passages cut out of their texts, same columns. Rows are told apart by id and text. Null texts stay null; an empty
    table stays empty. Run remove_repeats as well for lines of fewer words."""
    later = _later_passages(docs, _read(docs, id_col, text, words=words, gram=gram), id_col, text, words)
    spans = _merged(later, _KEY).groupBy(*_KEY).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_km_spans"))
    body = F.col("_km_text")
    piece = lambda a, r: F.struct(F.concat(a["out"], F.substring(body, (a["at"] + 1).cast("int"), F.greatest(F.lit(0), r["start"] - a["at"]).cast("int"))).alias("out"), F.greatest(a["at"], r["end"]).alias("at"))
    done = F.aggregate("_km_spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")), piece, lambda a: F.concat(a["out"], F.substring(body, (a["at"] + 1).cast("int"), F.length(body))))
    joined = _with_spans(_hidden(docs, id_col, text), spans)
    return _with_text(joined.withColumn("_km_done", F.when(F.col("_km_spans").isNull(), body).otherwise(done)), docs, text)


def removals(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, words: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """All that is to be removed, from one pass over the texts: kind, id, unit, start, end, n_words, first_<id>, first_unit.

    kind line: the rows of repeats. kind passage: one row for each longest run of words that are in a repeated paragraph (unit: its first word;
    no single first place, as parts of it may stay in several). What repeats and passages say of awkward rows holds here.
    """
    read = _read(docs, id_col, text, min_words=min_words, words=words, gram=gram)
    lines = _line_rows(_later_lines(read), id_col).select(F.lit("line").alias("kind"), "*")
    runs = _merged(_later_passages(docs, read, id_col, text, words), _KEY)
    none = lines.schema
    runs = runs.select(F.lit("passage").alias("kind"), F.col("_km_id").alias(id_col), F.col("word").alias("unit"), "start", "end", "n_words", *(F.lit(None).cast(none[c].dataType).alias(c) for c in (f"first_{id_col}", "first_unit")))
    return lines.unionByName(runs)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT doc_id, unit - 1 AS unit, l[unit] AS line, coalesce(list_sum(list_transform(l[1 : unit - 1], lambda x: length(x) + 1)), 0) AS start FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS unit FROM l)),
w AS (SELECT *, regexp_extract_all(translate(line, '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM u),
r AS (SELECT doc_id, unit, CAST(start AS BIGINT) AS start, CAST(start + length(line) AS BIGINT) AS "end", CAST(len(w) AS BIGINT) AS n_words,
  row_number() OVER o AS k, first_value(doc_id) OVER o AS first_doc_id, first_value(unit) OVER o AS first_unit FROM w WHERE len(w) >= {MIN_WORDS}
  WINDOW o AS (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id NULLS LAST, unit)),
t AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
c AS (SELECT id, doc_id, i, x, sum(length(x)) OVER (PARTITION BY id ORDER BY i) AS stop FROM (SELECT id, doc_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS x FROM t)),
p AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS word, stop - length(x) AS start, stop FROM c WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
g AS (SELECT id, doc_id, i - 1 AS word, md5(array_to_string(w[i : i + {PASSAGE - 1}], ' ')) AS g
  FROM (SELECT id, doc_id, w, unnest(range(1, len(w) - {PASSAGE - 2})) AS i FROM (SELECT id, doc_id, list_filter(t, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS w FROM t) WHERE len(w) >= {PASSAGE})),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, word) AS k FROM g) WHERE k > 1),
n AS (SELECT *, CASE WHEN word <= lag(word) OVER (PARTITION BY id ORDER BY word) + {PASSAGE} THEN 0 ELSE 1 END AS fresh FROM f),
m AS (SELECT id, doc_id, min(word) AS word, max(word) + {PASSAGE} AS stop FROM (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY word) AS run FROM n) GROUP BY id, doc_id, run)
SELECT 'line' AS kind, doc_id, unit, start, "end", n_words, first_doc_id, first_unit FROM r WHERE k > 1
UNION ALL SELECT 'passage', m.doc_id, m.word, CAST(a.start AS BIGINT), CAST(b.stop AS BIGINT), CAST(m.stop - m.word AS BIGINT), NULL, NULL
  FROM m JOIN p AS a ON a.id = m.id AND a.word = m.word JOIN p AS b ON b.id = m.id AND b.word = m.stop - 1"""
