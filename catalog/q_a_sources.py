"""Scans, sources and sinks."""

from pyspark.sql import functions as F

from glyphmill import sources as S
from glyphmill.operators import sampling

from . import query
from . import sqlkit as q
from .common import docs, labelled, scratch, table


@query("a1_parquet_scan", "select lang, count(*)::BIGINT as n, sum(n_chars)::BIGINT as chars from documents where n_chars > 200 group by lang")
def _(spark, d):
    return docs(spark, d, "lang", "n_chars").where("n_chars > 200").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("a2_pool_scan", f"""
select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by {q.h32(1, 'doc_id')}, doc_id) rn
from documents where length(text) >= 100) where rn <= 60""")
def _(spark, d):
    return sampling.quota(docs(spark, d, "doc_id", "lang", "text").where(F.length("text") >= 100), ["lang"], 60, 1,
                          ["doc_id"]).select("doc_id", "lang")


QUOTAS = {"en": 40, "de": 20, "es": 15, "fr": 10}


def pool_files(spark, d, n=8):
    """Documents as n Parquet folders, by id; no task writes a whole one."""
    path, t = scratch(spark), docs(spark, d, "doc_id", "lang", "text")
    for i in range(n):
        t.where(F.col("doc_id") % n == i).write.parquet(f"{path}/{i:03}")
    return [f"{path}/{i:03}" for i in range(n)]


@query("a2_scan_until_full", f"""select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by doc_id % 8, {q.h32(2, 'doc_id')}, doc_id) rn from documents where length(text) >= 100)
where rn <= case lang when 'en' then 40 when 'de' then 20 when 'es' then 15 when 'fr' then 10 else 0 end""")
def _(spark, d):
    rows, _ = S.read_until_full(spark, pool_files(spark, d), "lang", QUOTAS, 2, ["doc_id"], F.length("text") >= 100, ["doc_id", "lang"])
    return rows


ROUND_TRIP = "select doc_id, lang, length(text)::BIGINT as n, md5(text) as h from documents"


@query("a3_jsonl_scan", ROUND_TRIP)
def _(spark, d):
    # documents as JSON lines with broken lines in between
    path = scratch(spark)
    rows = docs(spark, d, "doc_id", "lang", "text")
    rows.select(F.to_json(F.struct("*")).alias("value")).union(
        rows.where("doc_id % 10 = 0").select(F.concat(F.lit('{"doc_id": '), F.col("doc_id"), F.lit(', "te')))).write.text(path)
    return S.read_jsonl(spark, path, "doc_id long, lang string, text string").select(
        "doc_id", "lang", F.length("text").alias("n"), F.md5("text").alias("h"))


DELIM_SQL = "select doc_id, lang, source, md5(regexp_replace(text, '[\\n\\r;\"]', ' ', 'g')) as h from documents"


def _delimited(spark, d, sep, quote, **opts):
    path = scratch(spark)
    one_line = F.regexp_replace("text", '[\\n\\r;"]', " ").alias("text")
    w = docs(spark, d, "doc_id", "lang", "source", "text").select("doc_id", "lang", "source", one_line).write
    w.option("sep", sep).option("header", True).option("quote", quote or "").options(**opts).csv(path)
    # the full file schema is named; only the wanted columns are parsed
    return S.read_delimited(spark, path, sep=sep, quote=quote,
                            schema="doc_id long, lang string, source string, text string").select(
        "doc_id", "lang", "source", F.md5(F.col("text")).alias("h"))


@query("a4_delimited_semicolon", DELIM_SQL)
def _(spark, d):
    return _delimited(spark, d, ";", '"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


@query("a4_delimited_tab_unquoted", DELIM_SQL)
def _(spark, d):
    return _delimited(spark, d, "\t", None, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


@query("a5_gzip_scan", ROUND_TRIP)
def _(spark, d):
    path = scratch(spark)
    docs(spark, d, "doc_id", "lang", "text").write.option("compression", "gzip").json(path)
    return S.read_jsonl(spark, path, "doc_id long, lang string, text string").select(
        "doc_id", "lang", F.length("text").alias("n"), F.md5("text").alias("h"))


@query("a6_conll_scan", rf"""
with w as (select doc_id, unnest([x for x in string_split(regexp_replace(text, '[^\p{{L}}]+', ' ', 'g'), ' ') if x <> '']) as tok from documents)
select doc_id::VARCHAR as sent_id, count(*)::BIGINT as n_tokens,
       sum(case when regexp_matches(tok, '^\p{{Lu}}') then 1 else 0 end)::BIGINT as n_tagged from w group by doc_id""")
def _(spark, d):
    path = scratch(spark)
    toks = F.filter(F.split(F.regexp_replace("text", r"[^\p{L}]+", " "), " "), lambda x: x != "")
    tag = lambda t: F.when(t.rlike(r"^\p{Lu}"), "B-X").otherwise("O")
    block = F.concat(F.lit("# id "), F.col("doc_id"), F.lit("\n"),
                     F.array_join(F.transform(toks, lambda t: F.concat(t, F.lit(" _ _ "), tag(t))), "\n"))
    docs(spark, d, "doc_id", "text").where(F.size(toks) > 0).select(block.alias("value")).write.option(
        "lineSep", "\n\n").text(path)
    return S.read_conll(spark, path).select("sent_id", F.size("tokens").alias("n_tokens"),
                                            F.size(F.filter("tags", lambda t: t == "B-X")).alias("n_tagged"))


@query("a7_at_label_scan", rf"""
select md5(trim(regexp_replace(text, '[^A-Za-z@ ]+', ' ', 'g'))) as h, lang as label, count(*)::BIGINT as n from documents group by all""")
def _(spark, d):
    path = scratch(spark)
    flat = F.trim(F.regexp_replace("text", r"[^A-Za-z@ ]+", " "))
    docs(spark, d, "text", "lang").select(F.concat(flat, F.lit("@"), "lang").alias("value")).write.text(path)
    return S.read_at_labels(spark, path).groupBy(F.md5("text").alias("h"), "label").agg(F.count(F.lit(1)).alias("n"))


@query("a8_read_sets", "select lang as name, count(*)::BIGINT as n, sum(n_chars)::BIGINT as chars from documents group by lang")
def _(spark, d):
    # one folder per set; the file stem rule is tested on single files in tests/
    path = scratch(spark)
    docs(spark, d, "lang", "n_chars").write.partitionBy("lang").parquet(path)
    df = S.read_sets(spark, path)
    return df.groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("a9_zip_lines", "select c.conv_id, c.turn, length(c.text)::BIGINT as n_a, length(e.text)::BIGINT as n_b from conversations c join conversations e on e.conv_id = c.conv_id and e.turn = c.turn + 1")
def _(spark, d):
    # two aligned files: a turn and its successor under one line key
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    a = c.withColumn("line_no", F.struct("conv_id", "turn")).select("line_no", "text")
    b = c.withColumn("line_no", F.struct("conv_id", (F.col("turn") - 1).alias("turn"))).select("line_no", "text")
    return S.zip_lines(a, b).select("line_no.conv_id", "line_no.turn", F.length("text_a").alias("n_a"), F.length("text_b").alias("n_b"))


@query("a9_paragraphs", "select conv_id, (turn // 3)::BIGINT as para, count(*)::BIGINT as n_lines, md5(string_agg(text, ' ' order by turn)) as h from conversations group by all")
def _(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    return S.paragraphs(c, 3, "conv_id", "turn").select("conv_id", "para", "n_lines", F.md5("text").alias("h"))


@query("a10_melt_lang", """
select doc_id, 'raw' as lang, md5(text) as h from documents union all select doc_id, 'low', md5(lower(text)) from documents
union all select doc_id, 'up', md5(upper(lang)) from documents""")
def _(spark, d):
    wide = docs(spark, d, "doc_id", "text", "lang").select("doc_id", F.col("text").alias("text_raw"), F.lower("text").alias("text_low"),
                                                           F.upper("lang").alias("text_up"))
    return S.melt_lang(wide, ["doc_id"]).select("doc_id", "lang", F.md5("text").alias("h"))


@query("a11_write_splits", f"select case when {q.u(0, 'doc_id')} < 0.1 then 'val' else 'train' end as split, count(*)::BIGINT as n, sum(length(text))::BIGINT as chars from documents group by 1")
def _(spark, d):
    path = scratch(spark)
    S.write_splits(sampling.split_hash(docs(spark, d), ["doc_id"], 0.1), path, ["doc_id", "text", "lang"])
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("a12_write_jsonl", ROUND_TRIP)
def _(spark, d):
    path = scratch(spark)
    S.write_jsonl(docs(spark, d, "doc_id", "lang", "text"), path)
    return S.read_jsonl(spark, path, "doc_id long, lang string, text string").select(
        "doc_id", "lang", F.length("text").alias("n"), F.md5("text").alias("h"))


@query("a13_build_report", """
with t as (select d.lang, d.source, l.quality, l.toxic from documents d join labels l using (doc_id))
select case when grouping(lang) = 0 then 'lang' when grouping(source) = 0 then 'source' when grouping(quality) = 0 then 'quality' else 'total' end as dim,
       coalesce(lang, source, quality::VARCHAR, '') as value, count(*)::BIGINT as n, round(avg(toxic), 6) as mean_label
from t group by grouping sets ((lang), (source), (quality), ())""")
def _(spark, d):
    return S.build_report(labelled(spark, d, "lang", "source"), ["lang", "source", "quality"], "toxic")


@query("a14_append_missing", "select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def _(spark, d):
    return S.append_missing(docs(spark, d, "doc_id", "lang"), table(spark, d, "labels", "doc_id"), "doc_id")


PAGE_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"""


@query("a15_pages_text", f"select page_id, url, md5({PAGE_TEXT}) as h, length({PAGE_TEXT})::BIGINT as n from pages")
def _(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", "url", F.md5(S.pages_text(p)).alias("h"), F.length(S.pages_text(p)).alias("n"))


@query("a16_dense_ids", f"select doc_id, (1000 + row_number() over (order by {q.h32(5, 'doc_id')}, doc_id) - 1)::BIGINT as pid from documents")
def _(spark, d):
    return S.with_ids(docs(spark, d, "doc_id"), ["doc_id"], start=1000)


@query("a16_tagged_ids", "select 'doc:' || doc_id as id, length(text)::BIGINT as n from documents union all select 'conv:' || conv_id || '-' || turn, length(text) from conversations")
def _(spark, d):
    a = docs(spark, d, "doc_id", "text").select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.length("text").alias("n"))
    b = table(spark, d, "conversations").select(F.concat(F.lit("conv:"), "conv_id", F.lit("-"), "turn").alias("id"), F.length("text").alias("n"))
    return a.union(b)


@query("a17_provenance", "select 'documents:text' as source, count(*)::BIGINT as n from documents union all select 'benchmark:text', count(*) from benchmark")
def _(spark, d):
    parts = [S.tag_source(table(spark, d, t, "text"), f"{t}:text") for t in ("documents", "benchmark")]
    return parts[0].unionByName(parts[1]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
