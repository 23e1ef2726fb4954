"""Line dedup by overlapping windows of three lines.

Every window of three consecutive lines is hashed (lines without a visible character are passed over); a text of one or two such
lines is one window as a whole. Windows that occur more than
once anywhere are repeated; their first occurrence, by document id and position, stays, and all later ones are removed: the
positions that later windows cover are merged per document, and those lines go. Lines of the first occurrence itself are never
removed by an overlapping later window of the same document.

Windows travel as two 64-bit hashes with id and position, never as text. Occurrences are counted with partial aggregates, so a
passage that a third of all documents share is one row before the join, and the join's skewed side can be split. Removed
positions are merged into runs per document and joined to the documents by id.

Cases: a null text stays null; a text without visible characters has no window and stays as it is; a text that only has later
occurrences loses all its visible lines; rows without id stay as they are and are not counted; rows with the same id are one document (each keeps its text less the lines
removed for that id; of different texts under one id the positions are those of both); an empty table gives an empty
result; other columns are kept by `dedup`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

LINES = 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, p, q, r, a, b): positions of a window's lines, null for those that a short text lacks, and its two hashes."""
    some = docs.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select("doc_id", _lines(text).alias("ls"))
    marked = F.filter(F.transform("ls", lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: x["s"].rlike(r"[^\x20\x09-\x0D]"))
    some = some.select("doc_id", marked.alias("ls")).where(F.size("ls") > 0)
    last = F.greatest(F.size("ls") - LINES, F.lit(0))
    each = some.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("ls", i + 1, LINES))).alias("w"))
    line = [F.get("w", F.lit(j)) for j in range(LINES)]
    return each.select("doc_id", *[x["i"].alias(c) for x, c in zip(line, "pqr")], F.xxhash64(*[x["s"] for x in line]).alias("a"),
                       F.xxhash64(F.lit(1), *[F.reverse(x["s"]) for x in line]).alias("b"))


def removed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, lines): positions (from 0) of the lines to remove, in order."""
    w = windows(docs, text)
    first = w.groupBy("a", "b").agg(F.min(F.struct("doc_id", "p", "q", "r")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = w.join(first, ["a", "b"]).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("p") != F.col("first.p")))
    own = F.when(F.col("doc_id") == F.col("first.doc_id"), F.array("first.p", "first.q", "first.r")).otherwise(F.array().cast("array<int>"))
    covered = later.select("doc_id", F.explode(F.array_except(F.array("p", "q", "r"), own)).alias("line")).where("line is not null")
    return covered.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup(docs: DataFrame, text: str = "text", n_removed: str | None = None) -> DataFrame:
    """The documents with the lines of later occurrences removed; `n_removed` names a column for their number."""
    gone, mark = fresh(docs, "lines"), n_removed or fresh(docs, "n_removed")
    lines = removed(docs, text).withColumnRenamed("lines", gone)
    kept = F.filter(_lines(text), lambda s, i: ~F.array_contains(gone, i))
    out = docs.join(lines, "doc_id", "left").withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
    out = out.withColumn(mark, F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    return out.select(*docs.columns, *([mark] if n_removed else []))


SQL = r"""
with lines as (select doc_id, unnest(string_split(text, chr(10))) s, unnest(range(len(string_split(text, chr(10))))) i from documents where doc_id is not null),
marked as (select doc_id, i p, lead(i) over o q, lead(i, 2) over o r, s s1, lead(s) over o s2, lead(s, 2) over o s3, count(*) over (partition by doc_id) c, row_number() over o k
           from lines where regexp_matches(s, '[^\x20\x09-\x0D]') window o as (partition by doc_id order by i)),
w as (select doc_id, p, q, r, concat_ws(chr(10), s1, s2, s3) t from marked where r is not null or c < 3 and k = 1),
f as (select t, min({'d': doc_id, 'p': p, 'q': q, 'r': r}) f from w group by t having count(*) > 1),
later as (select w.*, f.f from w join f using (t) where w.doc_id <> f.f.d or w.p <> f.f.p),
covered as (select distinct doc_id, line i from (select doc_id, f, unnest([p, q, r]) line from later) where line is not null and (doc_id <> f.d or line not in (f.p, f.q, f.r))),
gone as (select doc_id, count(*) n from covered group by 1),
kept as (select doc_id, string_agg(s, chr(10) order by i) text from lines anti join covered using (doc_id, i) group by 1)
select d.doc_id, coalesce(n, 0)::bigint n_removed, case when n is null then d.text else coalesce(k.text, '') end as text
from documents d left join gone using (doc_id) left join kept k using (doc_id)
"""
