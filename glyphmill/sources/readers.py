"""Scans. Column lists go into the select right above the scan, so parquet reads only those columns."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import h32
from ..session import materialise


def read_table(spark: SparkSession, folder: str, name: str, cols: list[str] | None = None) -> DataFrame:
    """A Parquet table. Splits follow spark.sql.files.maxPartitionBytes; a session that sets glyphmill.read.partitions (one
    machine over files of a single row group) gets that many partitions instead, by one shuffle."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df.select(*cols) if cols else df
    n = spark.conf.get("glyphmill.read.partitions", None)
    return df.repartition(int(n)) if n else df


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines (plain or .gz); lines that do not parse are skipped. `schema` is DDL, so no inference pass runs."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", quote: str | None = '"', header: bool = True,
                   schema: str | None = None, cols: list[str] | None = None) -> DataFrame:
    """CSV/TSV/other separators, plain or .gz; quote=None switches quoting off."""
    r = spark.read.option("sep", sep).option("header", header).option("quote", quote or "").option("escape", '"')
    if schema:
        r = r.schema(schema)
    if quote and sep == ",":
        r = r.option("multiLine", False)
    df = r.csv(path)
    return df.select(*cols) if cols else df


def read_conll(spark: SparkSession, path: str, token_col: int = 0, tag_col: int = -1) -> DataFrame:
    """CoNLL text (blank line between sentences, `# id ...` comments) -> sent_id, tokens, tags."""
    block = spark.read.option("lineSep", "\n\n").text(path)
    lines = F.filter(F.split("value", "\n"), lambda x: F.length(F.trim(x)) > 0)
    rows = F.filter(lines, lambda x: ~x.startswith("# "))
    cell = lambda x, i: F.element_at(F.split(x, r"[ \t]+"), i + 1 if i >= 0 else i)
    return (
        block.select(
            F.regexp_extract("value", r"(?m)^# id (\S+)", 1).alias("sent_id"),
            F.transform(rows, lambda x: cell(x, token_col)).alias("tokens"),
            F.transform(rows, lambda x: cell(x, tag_col)).alias("tags"),
        ).where(F.size("tokens") > 0)
    )


def read_at_labels(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Lines `text@label`; the label follows the last @."""
    lines = spark.read.option("encoding", encoding).option("header", False).option("sep", "\x01").option(
        "quote", "").schema("value string").csv(path)
    rx = r"^(.*)@([^@]*)$"
    return lines.where(F.col("value").rlike(rx)).select(
        F.trim(F.regexp_extract("value", rx, 1)).alias("text"), F.trim(F.regexp_extract("value", rx, 2)).alias("label"))


def read_sets(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """Every file of a folder in one table; the file stem becomes column `set`."""
    df = spark.read.option("pathGlobFilter", pattern).parquet(folder)
    return df.withColumn("set", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def zip_lines(a: DataFrame, b: DataFrame, line: str = "line_no") -> DataFrame:
    """Line i of one file beside line i of the other (columns text_a, text_b)."""
    return a.select(line, F.col("text").alias("text_a")).join(b.select(line, F.col("text").alias("text_b")), line)


def paragraphs(df: DataFrame, k: int, doc: str, line: str = "line_no", text: str = "text") -> DataFrame:
    """k consecutive lines of a document joined into one paragraph."""
    g = F.floor(F.col(line) / F.lit(k))
    return (
        df.groupBy(doc, g.alias("para"))
        .agg(F.sort_array(F.collect_list(F.struct(line, text))).alias("_l"))
        .select(doc, "para", F.size("_l").alias("n_lines"), F.array_join(F.col(f"_l.{text}"), " ").alias("text"))
    )


def melt_lang(df: DataFrame, ids: list[str], prefix: str = "text_") -> DataFrame:
    """Columns text_de, text_fr, ... -> rows (ids, lang, text)."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    return df.unpivot(ids, cols, "lang", "text").withColumn("lang", F.col("lang").substr(F.lit(len(prefix) + 1), F.length("lang")))


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    """Named and numeric entities; SQL functions have no table of them."""
    return texts.map(html.unescape, na_action="ignore")


def pages_text(df: DataFrame, page: str = "html") -> Column:
    """Visible text of a page: scripts, styles, comments and tags out, all entities decoded, blanks collapsed."""
    t = F.regexp_replace(F.col(page), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    t = _unescape(t)  # once for every page: a condition on the text would have the patterns run again for each of its branches
    return F.trim(F.regexp_replace(t, r"[\s\x{A0}]+", " "))


def tag_source(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("source", F.lit(name))


def with_ids(df: DataFrame, order: list[str], start: int = 0, name: str = "pid", salt: int = 5,
             buckets: int = 4096) -> DataFrame:
    """Dense ids 0..n-1 in hash order of the key: per-bucket counts, offsets, then a rank inside each bucket.

    No un-partitioned sort: the only global step is a running sum over at most `buckets` counts."""
    from ..operators.sampling import hash_rank

    ranked = hash_rank(df, [], salt, order, bits=buckets.bit_length() - 1)
    return ranked.withColumn(name, F.col("_rank") - 1 + F.lit(start)).drop("_rank")


def read_until_full(spark: SparkSession, paths: list[str], by: str, quotas: dict, seed, key: list[str], keep: Column | None = None,
                    cols: list[str] | None = None, first: int = 1, grow: int = 4) -> tuple[DataFrame, int]:
    """(rows, number of files read): the first quotas[g] rows of every group g, by file and inside a file by hash of the key.

    Files are read in rounds of `first`, first * grow, ... files, and reading stops once every quota is full; what a round brings
    for groups that are full already is dropped at the scan. The rows don't depend on the rounds. Parquet files that Spark can
    list, in the given order; a group's rows of one round are cut to its quota in every task before they are shuffled."""
    need, at, step, parts = dict(quotas), 0, first, []
    rank = Window.partitionBy(by).orderBy("_file", h32(seed, *key), *key)
    while at < len(paths) and any(n > 0 for n in need.values()):
        files = paths[at:at + step]
        rows = None
        for i, path in enumerate(files):
            one = spark.read.parquet(path)
            one = one.where(keep) if keep is not None else one
            one = (one.select(*cols) if cols else one).withColumn("_file", F.lit(i))
            rows = one if rows is None else rows.unionByName(one)
        left = {g: n for g, n in need.items() if n > 0}
        limit = F.coalesce(*[F.when(F.col(by) == g, F.lit(n)) for g, n in left.items()])
        some = rows.where(F.col(by).isin(*left)).withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= max(left.values())).where(F.col("_r") <= limit)
        part = materialise(some.drop("_file", "_r"))
        for r in part.groupBy(by).count().collect():  # a row per wanted group
            need[r[0]] -= r["count"]
        parts.append(part)
        at, step = at + len(files), step * grow
    out = parts[0] if parts else spark.read.parquet(*paths).select(*(cols or ["*"])).limit(0)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, at
