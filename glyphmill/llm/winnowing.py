"""Benchmark decontamination by winnowing.

A document word is contaminated if it lies in a window of `window` consecutive words that a benchmark item has too (an item of
fewer words is one window as a whole). Of every `w` consecutive k-gram hashes the smallest is kept as a fingerprint, the
rightmost of equals; with k + w - 1 = window, texts that share a window share a fingerprint at the same place in it.

Fingerprints of documents and of the benchmark's distinct texts are joined in Spark; only hashes and row names travel. A pair that
shares one is extended: a task gets a document with the item texts it met, about CHUNK bytes of them at once, numbers the windows
of all of them by their words, and marks the document's windows that an item has. The work is linear in both texts, however often
words or windows repeat, and exact, whatever the hashes. Neither the documents nor the benchmark pass through the driver; it sees
the distinct lengths of short items.

Cases: a null text has no words; an item without words has no window; an item without id marks words but is not listed; repeated
rows get equal results, items of equal texts are compared once; an empty benchmark or table gives no hits or no rows; all columns
of the documents are kept by `with_hits`, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import fresh, row_key, saved

#: Bytes of item texts that a document is held against at once.
CHUNK = 1 << 20
HITS = "struct<n_words: bigint, starts: array<bigint>, ends: array<bigint>, items: array<string>>"
NO_HASH = np.uint64(0xFFFFFFFFFFFFFFFF)


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; NO_HASH where a word is unknown (negative)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, "uint64")
    x = ids.astype("uint64") + np.uint64(1)
    h = np.zeros(n, "uint64")
    for j in range(k):
        h = (h ^ x[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    bad = np.concatenate([[0], np.cumsum(ids < 0)])
    return np.where(bad[k:] > bad[:-k], NO_HASH, np.minimum(h, NO_HASH - np.uint64(1)))


def winnow(ids: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprints of all windows of w k-grams without unknown words."""
    h = _grams(ids, k)
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, "int64"), np.zeros(0, "uint64")
    known = np.concatenate([[0], np.cumsum(h == NO_HASH)])
    at = np.flatnonzero(known[w:] == known[:-w])
    best, where = h[at], at.copy()
    for j in range(1, w):
        here = h[at + j]
        least = here <= best
        best, where = np.where(least, here, best), np.where(least, at + j, where)
    where = np.unique(where)
    return where, h[where]


def _lengths(n: np.ndarray, window: int) -> np.ndarray:
    return np.minimum(n, window)


def _prints(texts: pa.Array, lengths: list[int], own: int | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words per text, distinct fingerprints of every text) for windows of all the lengths; with `own`, the window's
    number of words, a text has fingerprints of the one length it has itself."""
    codes, starts, values = words.split(words.translated(texts, words.ALNUM_LOWER))
    n = np.diff(starts)
    hashed = (np.fromiter(map(xxhash.xxh64_intdigest, values), "uint64", len(values)) >> np.uint64(1)).astype("int64")
    doc = np.repeat(np.arange(len(n)), n)
    ids = np.full(len(codes) + len(n), -1, "int64")  # an unknown word after every text
    ids[np.arange(len(codes)) + doc] = hashed[codes]
    first = starts[:-1] + np.arange(len(n))
    of, prints = [np.zeros(0, "int64")], [np.zeros(0, "uint64")]
    for length in lengths:
        k = (length + 1) // 2
        at, h = winnow(ids, k, length - k + 1)
        text = np.searchsorted(first, at, "right") - 1
        keep = slice(None) if own is None else _lengths(n, own)[text] == length
        of.append(text[keep])
        prints.append((h[keep] ^ np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15))
    of, prints = np.concatenate(of), np.concatenate(prints).view("int64")
    order = np.lexsort((prints, of))
    of, prints = of[order], prints[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (prints[1:] != prints[:-1])
    of, prints = of[new], prints[new]
    return n, np.split(prints, np.searchsorted(of, np.arange(1, len(n)))) if len(n) else []


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, "int64")])))


def marks(docs: DataFrame, lengths: list[int], text: str = "text") -> DataFrame:
    """(doc_id, id, h, n_words, prints) of every row; id and h name the row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch, 1):
                n, prints = _prints(piece.column(1), lengths, None)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), piece.column(3), pa.array(n, pa.int64()), _lists(prints)], ["doc_id", "id", "h", "n_words", "prints"])

    return docs.select("doc_id", F.col(f"`{text}`"), *row_key(docs)).mapInArrow(run, f"doc_id {kind}, id string, h long, n_words long, prints array<long>")


def items_of(benchmark: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, t, n_words, names): distinct texts with words, and the ids that have them."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null")
    rows = rows.groupBy("t").agg(F.array_sort(F.collect_set("i")).alias("names")).withColumn("item", F.xxhash64("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.diff(words.split(words.translated(batch.column(0), words.ALNUM_LOWER))[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, "n_words"])

    return rows.mapInArrow(run, "t string, names array<string>, item long, n_words long").where("n_words > 0")


def item_prints(items: DataFrame, window: int, lengths: list[int]) -> DataFrame:
    """(print, item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch, 1):
                yield pa.RecordBatch.from_arrays([piece.column(0), _lists(_prints(piece.column(1), lengths, window)[1])], ["item", "prints"])

    return items.select("item", "t").mapInArrow(run, "item long, prints array<long>").select("item", F.explode("prints").alias("print")).distinct()


def _numbered(ids: np.ndarray, n: int, starts: list[int]) -> np.ndarray:
    """Equal numbers for equal windows of n words; starts are the places where windows begin."""
    view = np.lib.stride_tricks.sliding_window_view(ids, n)
    at = np.array(starts, "int64")
    h = np.zeros(len(at), "uint64")
    for j in range(n):
        h = (h ^ (ids[at + j].astype("uint64") + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    like = at[first][number]
    if all((view[at[a:a + 65536]] == view[like[a:a + 65536]]).all() for a in range(0, len(at), 65536)):
        return number
    return np.unique(view[at], axis=0, return_inverse=True)[1].ravel()  # two windows with one hash


def extend(text: str, items: list[str], window: int) -> tuple[list[int], list[int], list[int]]:
    """(starts, ends) of the runs of words that lie in a window of an item, and the numbers of the items that have one there."""
    codes, starts, _ = words.split(words.translated(pa.array([text, *items], pa.large_string()), words.ALNUM_LOWER))
    size, edge, found = np.diff(starts), np.zeros(starts[1] + 1, "int64"), []
    length = _lengths(size, window)
    for n in sorted({*length[1:].tolist()} - {0}):
        own = [j for j in range(1, len(size)) if length[j] == n]
        if size[0] < n:
            continue
        places = [np.arange(starts[j], starts[j + 1] - n + 1) for j in [0, *own]]
        number = np.split(_numbered(codes, n, np.concatenate(places)), np.cumsum([len(p) for p in places])[:-1])
        in_doc = np.zeros(max(x.max() for x in number) + 1, bool)
        in_items = np.zeros(len(in_doc), bool)
        in_doc[number[0]] = True
        for j, x in zip(own, number[1:]):
            if in_doc[x].any():
                found.append(j - 1)
                in_items[x] = True
        at = places[0][in_items[number[0]]]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
    inside = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype("int64"), [0]])
    step = np.diff(inside)
    return np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), sorted(found)


def hits_of(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(marks of all rows, hits(id, h, starts, ends, items) of the rows that have some)."""
    items = saved(items_of(benchmark, window), "winnow-items")
    lengths = [r[0] for r in items.select(F.least("n_words", F.lit(window)).cast("int").alias("n")).distinct().orderBy(F.desc("n")).collect()]  # at most `window` numbers
    rows = saved(marks(docs, lengths, text), "winnow-marks")
    prints = saved(item_prints(items, window, lengths), "winnow-prints")
    met = rows.select("id", "h", F.explode("prints").alias("print")).join(prints, "print").select("id", "h", "item").distinct()
    met = saved(met.join(items.select("item", F.octet_length("t").alias("bytes")), "item"), "winnow-pairs")
    parts = met.groupBy("id", "h").agg(F.ceil(F.sum("bytes") / F.lit(CHUNK)).cast("int").alias("parts"))
    dealt = met.join(parts, ["id", "h"]).withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts"))).join(items.select("item", "t"), "item")
    dealt = dealt.groupBy("id", "h", "part").agg(F.collect_list(F.struct("item", "t")).alias("own"))
    texts = docs.select(F.col(f"`{text}`").alias("text"), *row_key(docs)).join(parts.select("id", "h"), ["id", "h"], "left_semi").dropDuplicates(["id", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.string()), ("h", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("found", pa.list_(pa.int64()))])
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                starts, ends, found = extend(row["text"], [x["t"] for x in row["own"]], window)
                if found:
                    out.append({"id": row["id"], "h": row["h"], "starts": starts, "ends": ends, "found": [row["own"][j]["item"] for j in found]})
            yield pa.RecordBatch.from_pylist(out, schema)

    spans = dealt.join(texts, ["id", "h"]).select("id", "h", "own", "text").mapInArrow(run, "id string, h long, starts array<long>, ends array<long>, found array<long>")
    spans = saved(spans, "winnow-hits")
    names = spans.select("id", "h", F.explode("found").alias("item")).join(items.select("item", "names"), "item").groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("items"))
    merged = spans.groupBy("id", "h").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")])
    return rows, merged.join(names, ["id", "h"])


def with_hits(docs: DataFrame, benchmark: DataFrame, out: str, window: int = 13, text: str = "text") -> DataFrame:
    """The documents with one more column: HITS (spans of several chunks of items may overlap)."""
    key = [fresh(docs, "id"), fresh(docs, "h")]
    rows, hits = hits_of(docs, benchmark, window, text)
    none = [F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("starts", "array<bigint>"), ("ends", "array<bigint>"), ("items", "array<string>"))]
    found = rows.select("id", "h", "n_words").distinct().join(hits, ["id", "h"], "left").select(F.col("id").alias(key[0]), F.col("h").alias(key[1]), F.struct("n_words", *none).alias(out))
    keyed = docs.withColumns({k: c for k, c in zip(key, row_key(docs))})
    return keyed.join(found, key).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{out}`"))


def n_hit(hits: Column) -> Column:
    """Number of distinct words in the spans."""
    spans = F.array_sort(F.arrays_zip(hits.getField("starts").alias("a"), hits.getField("ends").alias("b")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(spans, start, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"),
        F.greatest(acc["end"], s["b"]).alias("end")), lambda acc: acc["n"])


def contaminated(n_words: Column, hit: Column) -> Column:
    return (hit > 0) & (20 * hit >= n_words)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    rows, hits = hits_of(docs.select("doc_id", "text"), benchmark)
    hits = hits.select("id", "h", n_hit(F.struct("starts", "ends")).alias("n_hit"), F.array_sort("items").alias("items"))
    rows = rows.drop("prints").join(hits, ["id", "h"], "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that aren't contaminated, with the columns of the input."""
    key = [fresh(docs, "id"), fresh(docs, "h")]
    rows, hits = hits_of(docs, benchmark)
    size = rows.select("id", "h", "n_words").join(hits, ["id", "h"]).where(contaminated(F.col("n_words"), n_hit(F.struct("starts", "ends"))))
    bad = size.select(F.col("id").alias(key[0]), F.col("h").alias(key[1])).distinct()
    return docs.withColumns({k: c for k, c in zip(key, row_key(docs))}).join(bad, key, "left_anti").drop(*key)


SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
il as (select item_id, ws, least(len(ws), 13) n from iw where len(ws) > 0),
windows as (select distinct item_id, n, array_to_string(ws[i:i + n - 1], ' ') w from (select item_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from il)),
lengths as (select distinct n from il),
places as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') w
           from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from dw, lengths where len(ws) >= n)),
hits as (select p.doc_id, p.n, p.i, x.item_id from places p join windows x using (n, w)),
covered as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + n)) j from (select distinct doc_id, n, i from hits)) group by 1),
listed as (select doc_id, count(*) n_items, sha256(string_agg(item, ',' order by item)) sha from (select distinct doc_id, item_id::varchar item from hits) group by 1)
select dw.doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       coalesce(sha, sha256('')) items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(ws), false) contaminated
from dw left join covered using (doc_id) left join listed using (doc_id)
"""
