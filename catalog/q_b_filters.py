"""Projections, filters and predicates."""

from pyspark.sql import functions as F

from glyphmill.functions import keys as K
from glyphmill.functions import text as X
from glyphmill.functions.units import explode_rows
from glyphmill.operators import filters as B

from . import query
from . import sqlkit as q
from .common import docs, labelled, table

# fixed values: word lists and patterns used by the demo queries
TRIGGERS = ["ignore", "system", "the", "prompt", "rules"]
URLS = {"mobile": r"^https?://m\.", "fr": r"/fr/", "paged": r"[?&]page="}
LABEL = "case lang when 'de' then 'deu_Latn' when 'fr' then 'fra_Latn' when 'es' then 'spa_Latn' else 'eng_Latn' end"
LABEL_MAP = {"de": "deu_Latn", "fr": "fra_Latn", "es": "spa_Latn", "en": "eng_Latn"}

for _name, _f, _s in (("k1_norm_key", K.norm_key, q.k1), ("k2_norm_ws", K.norm_ws, q.k2)):
    @query(_name, f"select doc_id, md5({_s('text')}) as h from documents")
    def _(spark, d, _f=_f):
        return docs(spark, d, "doc_id", "text").select("doc_id", F.md5(_f("text")).alias("h"))


@query("k3_norm_500", f"select doc_id, md5(substr({q.k1('text')}, 1, 500)) as h from documents")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", F.md5(K.norm_500("text")).alias("h"))


@query("k4_answer_norm", rf"""
select doc_id, array_to_string([x for x in regexp_split_to_array(regexp_replace(lower(nfc_normalize(text)), '[\p{{P}}\p{{S}}]', ' ', 'g'), '{q.WS}+')
  if x not in ('', 'a', 'an', 'the')], '|') as toks from documents""")
def _(spark, d):
    # NFC in the SQL twin equals NFKC on this corpus; tests/ compare NFKC itself with Python
    return docs(spark, d, "doc_id", "text").select("doc_id", F.array_join(K.answer_tokens("text"), "|").alias("toks"))


@query("k5_asr_norm", r"select lang, count(*)::BIGINT as n, sum(length(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')))::BIGINT as chars from documents group by lang")
def _(spark, d):
    return docs(spark, d, "lang", "text").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(K.asr_norm("text"))).alias("chars"))


@query("s1_sentence_split", f"select doc_id, i::BIGINT as pos, md5(s[i]) as h from (select doc_id, {q.sents('text')} as s from documents), unnest(range(1, len(s) + 1)) as r(i)")
def _(spark, d):
    return explode_rows(docs(spark, d, "doc_id", "text"), ["doc_id"], K.sentences("text"), "s").select(
        "doc_id", (F.col("pos") + 1).alias("pos"), F.md5("s").alias("h"))


@query("r1_hash_uniform", f"select doc_id, round({q.u(42, 'doc_id')}, 6) as u from documents")
def _(spark, d):
    return docs(spark, d, "doc_id").select("doc_id", K.u(42, "doc_id").alias("u"))


@query("r2_md5_mod", f"select doc_id, {q.md5_mod('text', 33)}::BIGINT as m33, {q.md5_mod('text', 2)}::BIGINT as m2, (doc_id % 50)::BIGINT as id50 from documents")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", K.md5_mod("text", 33).alias("m33"), K.md5_mod("text", 2).alias("m2"),
                                                   F.pmod("doc_id", F.lit(50)).alias("id50"))


# CRC-32 by its table, which follows from the polynomial
CRC = """crc_table as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i::UBIGINT, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
 crc as (select doc_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda j: ascii(substr(doc_id::VARCHAR, j::INT, 1))::UBIGINT)),
   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295) as x from documents, crc_table)"""


@query("r2_crc_mod", f"with {CRC} select doc_id, (x % 1000)::BIGINT as bucket, (x % 1000 < 15)::INT::BIGINT as val from crc")
def _(spark, d):
    return docs(spark, d, "doc_id").select("doc_id", K.crc_mod("doc_id", 1000).alias("bucket"), (K.crc_mod("doc_id", 1000) < 15).alias("val"))


@query("b1_to_record", f"select {q.strip('d.text')} as text, l.toxic::BIGINT as label, 'documents' as source, 'direct' as kind, d.lang from documents d join labels l using (doc_id)")
def _(spark, d):
    return B.to_record(labelled(spark, d, "text", "lang"), "text", F.col("toxic"), "documents", "direct", F.col("lang"))


@query("b2_len_between", "select doc_id, lang from documents where length(text) between 120 and 1200")
def _(spark, d):
    return B.len_between(docs(spark, d, "doc_id", "lang", "text"), "text", 120, 1200).drop("text")


@query("b3_drop_sources", "select doc_id, source from documents where not regexp_matches(source, '^(?:src1|src7)')")
def _(spark, d):
    return B.drop_sources(docs(spark, d, "doc_id", "source"), "src1|src7")


@query("b4_trigger", r"select doc_id, lang from documents where regexp_matches(' ' || regexp_replace(lower(text), '[^\p{L}\p{N}_]', ' ', 'g') || ' ', ' (ignore|system|the|prompt|rules) ')")
def _(spark, d):
    return docs(spark, d, "doc_id", "lang", "text").where(X.has_trigger("text", TRIGGERS)).drop("text")


@query("b5_url_class", r"""select page_id, case when regexp_matches(url, '^https?://m\.') then 'mobile' when regexp_matches(url, '/fr/') then 'fr'
  when regexp_matches(url, '[?&]page=') then 'paged' else 'other' end as cls from pages""")
def _(spark, d):
    return table(spark, d, "pages", "page_id", "url").select("page_id", B.url_class("url", URLS).alias("cls"))


def _sql_frac(cls, empty):
    return rf"""case when length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) = 0 then {empty} else
  length(regexp_replace(regexp_replace(text, '[^\p{{L}}]', '', 'g'), '[^{cls}]', '', 'g')) / length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) end"""


@query("b6_script_frac", rf"""select doc_id, round({_sql_frac(chr(92) + 'p{Latin}', '1.0')}, 6) as latin, round({_sql_frac(chr(92) + 'p{Cyrillic}', '1.0')}, 6) as own
  from documents""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "text").withColumn("sc", F.lit("Cyrl"))
    return t.select("doc_id", X.script_frac("text", "Latn").alias("latin"), X.script_frac("text", F.col("sc")).alias("own"))


@query("b7_latin_share", rf"select doc_id from documents where {_sql_frac(chr(92) + 'p{Latin}', '0.0')} >= 0.8")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").where(X.latin_share("text") >= 0.8).select("doc_id")


EN_WORDS = ",".join(f"'{w}'" for w in X.ENGLISH_WORDS)
ENGLISH_SQL = f"(len(w) >= 4 and len([x for x in w if x in ({EN_WORDS})]) / len(w) >= 0.25)"


@query("b8_english_like", f"""select lang, {ENGLISH_SQL}::INT::BIGINT as english, count(*)::BIGINT as n
  from (select lang, regexp_extract_all(lower(text), '[a-z]+') as w from documents) group by all""")
def _(spark, d):
    return docs(spark, d, "lang", "text").groupBy("lang", X.english_like("text").alias("english")).agg(F.count(F.lit(1)).alias("n"))


@query("b9_confident_other", f"select doc_id, lang from documents where lang <> 'en' and {q.u(3, 'doc_id')} > 0.9")
def _(spark, d):
    t = docs(spark, d, "doc_id", "lang").withColumn("p", K.u(3, "doc_id"))
    return t.where(B.confident_other("lang", "p", "en")).drop("p")


@query("b10_filter_report", f"""
with t as (select {LABEL} as label, {q.u(3, 'doc_id')} > 0.9 and lang <> 'en' as d_model, false as d_script,
  lang <> 'en' and {ENGLISH_SQL} as d_english from (select *, regexp_extract_all(lower(text), '[a-z]+') as w from documents))
select label, count(*)::BIGINT as n, sum(d_model::INT)::BIGINT as d_model, sum(d_script::INT)::BIGINT as d_script, sum(d_english::INT)::BIGINT as d_english,
  sum((d_model or d_script or d_english)::INT)::BIGINT as dropped from t group by label""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "lang", "text").withColumn("label", B.map_const("lang", LABEL_MAP)).withColumn("p", K.u(3, "doc_id"))
    return B.filter_report(B.contamination_flags(t, "text", "label", "p"), ["d_model", "d_script", "d_english"], "label")


@query("b11_letter_share", rf"select doc_id from documents where length(regexp_replace(text, '[^\p{{L}}\p{{M}}]', '', 'g')) >= 0.6 * length(regexp_replace(text, '{q.WS}+', '', 'g')) and length(regexp_replace(text, '{q.WS}+', '', 'g')) > 0")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").where(X.letter_share("text") >= 0.6).select("doc_id")


@query("b12_ends_sentence", rf"select doc_id from documents where length({q.strip('text')}) >= 30 and regexp_matches({q.strip('text')}, '[.!?…。！？।؟።][\"''”’»)」』】]*$')")
def _(spark, d):
    return docs(spark, d, "doc_id", "text").where(X.ends_sentence("text")).select("doc_id")


@query("b13_mark_density", f"""with w as (select doc_id, unnest(l) as tok, generate_subscripts(l, 1) as i from (select doc_id, regexp_split_to_array({q.strip('text')}, '\\s+') as l from documents)),
 f as (select doc_id, i, regexp_matches(tok, '[.,?:!]$')::INT as m from w), r as (select *, sum(m) over (partition by doc_id order by i rows unbounded preceding) as g from f),
 z as (select doc_id, g, sum(1 - m) as gap from r group by all), n as (select doc_id, count(*) as n, sum(m) as marks from f group by doc_id)
select n.doc_id, n.n::BIGINT as n_units from n join (select doc_id, max(gap) as gap from z group by doc_id) x using (doc_id) where marks > 0 and marks <= n * 0.35 and gap < 60""")
def _(spark, d):
    # per document: words, 1 where a word carries a mark
    labs = F.transform(F.split(K.strip("text"), r"\s+"), lambda w: F.when(w.rlike(r"[.,?:!]$"), 1).otherwise(0))
    return docs(spark, d, "doc_id", "text").select("doc_id", labs.alias("labs")).where(B.mark_density(F.col("labs"))).select(
        "doc_id", F.size("labs").alias("n_units"))


P = q.u(9, "doc_id")


@query("b14_decided", f"select doc_id, lang from documents where ({P} <= 0.2 or {P} >= 0.8 or source = 'src3') and not {q.u(10, 'doc_id')} > 0.95")
def _(spark, d):
    t = docs(spark, d, "doc_id", "lang", "source").withColumn("p", K.u(9, "doc_id"))
    return B.decided(t, "p", exempt=F.col("source") == "src3", veto=K.u(10, "doc_id") > 0.95).select("doc_id", "lang")


@query("b15_faithful_filter", f"""
with t as (select doc_id, case when {q.u(21, 'doc_id')} < 0.9 then 'stop' else 'length' end as finish, 0.8 + 0.2 * {q.u(22, 'doc_id')} as faithful,
  {q.u(23, 'doc_id')} as kept, len(regexp_split_to_array({q.strip('text')}, '[ \\t\\n\\x0B\\f\\r]+'))::BIGINT as n_units from documents)
select doc_id, n_units from t where finish = 'stop' and faithful >= 0.9 and n_units >= 30 and kept between 0.10 and 0.95""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "text").select(
        "doc_id", F.when(K.u(21, "doc_id") < 0.9, "stop").otherwise("length").alias("finish"), (0.8 + 0.2 * K.u(22, "doc_id")).alias("faithful"),
        K.u(23, "doc_id").alias("kept"), F.size(F.split(K.strip("text"), r"\s+")).alias("n_units"))
    return B.faithful_filter(t).select("doc_id", "n_units")


TURNS = "with t as (select c.conv_id, c.turn, c.text as src, e.text as out from conversations c left join conversations e on e.conv_id = c.conv_id and e.turn = c.turn + 1)"


def _turn_pairs(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    e = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("out"))
    return c.withColumnRenamed("text", "src").join(e, ["conv_id", "turn"], "left")


@query("b16_translation_reason", TURNS + r""" select case when out is null or length(trim(out)) = 0 then 'parse'
  when regexp_matches(out, '(?i)(I can(?:''|no)t|I cannot|I''m sorry|I am sorry|as an AI|I won''t|unable to (?:help|assist|translate))') and not
       regexp_matches(src, '(?i)(I can(?:''|no)t|I cannot|I''m sorry|I am sorry|as an AI|I won''t|unable to (?:help|assist|translate))') then 'refusal'
  when length(out) / greatest(length(src), 1) < 0.3 or length(out) / greatest(length(src), 1) > 3.5 then 'length' when src = out then 'same' else 'ok' end as reason,
  count(*)::BIGINT as n from t group by 1""")
def _(spark, d):
    # a turn and its successor stand for source and translation
    return _turn_pairs(spark, d).groupBy(B.translation_reason("src", "out").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


INJ = f"""with t as (select doc_id, text as clean, lang, case when doc_id % 3 = 0 then text else text || ' ' || upper(substr(text, 1, 80)) end as injected,
  substr(text, case when doc_id % 5 = 0 then 90 else 1 end, 80) as span from documents)"""


def _injected(spark, d):
    t = docs(spark, d, "doc_id", "text")
    return t.select("doc_id", F.col("text").alias("clean"),
                    F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" "), F.upper(F.substring("text", 1, 80)))).alias("injected"),
                    F.expr("substring(text, if(doc_id % 5 = 0, 90, 1), 80)").alias("span"))


@query("b17_valid_injection", INJ + f"select doc_id from t where clean <> injected and length(substr({q.k1('span')}, 1, 60)) > 0 and instr({q.k1('injected')}, substr({q.k1('span')}, 1, 60)) > 0")
def _(spark, d):
    return _injected(spark, d).where(B.valid_injection("clean", "injected", "span")).select("doc_id")


@query("b18_span_only_in", INJ + "select doc_id from t where contains(injected, upper(span)) and not contains(clean, upper(span))")
def _(spark, d):
    return _injected(spark, d).withColumn("span", F.upper("span")).where(B.span_only_in("span", "injected", "clean")).select("doc_id")


@query("b19_root_turns", "select conv_id, turn, role from conversations c where role = 'user' and turn = (select min(turn) from conversations x where x.conv_id = c.conv_id)")
def _(spark, d):
    return B.root_turns(table(spark, d, "conversations", "conv_id", "turn", "role"))


@query("b20_drop_unusable", "select doc_id from documents where text is not null and length(trim(text)) > 0 and not regexp_matches(text, '(?i)licen[sc]e|redacted')")
def _(spark, d):
    return B.drop_unusable(docs(spark, d, "doc_id", "text"), "text", ["licen[sc]e", "redacted"]).select("doc_id")


@query("b21_map_labels", """with dim as (select n_name as k, r_name as v from nation join region on n_regionkey = r_regionkey where r_name <> 'ASIA')
select coalesce(dim.v, 'unmapped') as region, count(*)::BIGINT as n from customer join nation on c_nationkey = n_nationkey left join dim on dim.k = n_name group by 1""")
def _(spark, d):
    n, r = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), table(spark, d, "region", "r_regionkey", "r_name")
    dim = n.join(r, n.n_regionkey == r.r_regionkey).where("r_name <> 'ASIA'").select("n_name", "r_name")
    cust = table(spark, d, "customer", "c_nationkey").join(n, F.col("c_nationkey") == n.n_nationkey).select("n_name")
    return B.map_labels(cust, dim, "n_name", "region", default="unmapped").groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("b21_map_const", f"select {LABEL} as label, count(*)::BIGINT as n from documents group by 1")
def _(spark, d):
    return docs(spark, d, "lang").groupBy(B.map_const("lang", LABEL_MAP).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("b22_bin_label", "select case when n_chars <= 200 then 'short' when n_chars <= 2000 then 'medium' else 'long' end as bin, count(*)::BIGINT as n from documents group by 1")
def _(spark, d):
    return docs(spark, d, "n_chars").groupBy(B.bin_label("n_chars", [200, 2000], ["short", "medium", "long"]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("b23_any_flag", "select doc_id, greatest(quality, toxic)::BIGINT as flag from labels")
def _(spark, d):
    return table(spark, d, "labels").select("doc_id", B.any_flag(["quality", "toxic"]).alias("flag"))


@query("b24_score_cats", f"select doc_id, array_to_string([x for x in [case when {q.u(31, 'doc_id')} >= 0.5 then 'insult' end, case when {q.u(32, 'doc_id')} >= 0.5 then 'threat' end, case when {q.u(33, 'doc_id')} >= 0.5 then 'obscene' end] if x is not null], ',') as cats from labels")
def _(spark, d):
    t = table(spark, d, "labels", "doc_id")
    for i, n in enumerate(("insult", "threat", "obscene")):
        t = t.withColumn(n, K.u(31 + i, "doc_id"))
    return t.select("doc_id", F.array_join(B.score_cats({n: n for n in ("insult", "threat", "obscene")}), ",").alias("cats"))


@query("b25_argmax_label", f"""with t as (select doc_id, floor({q.u(41, 'doc_id')} * 4) as a, floor({q.u(42, 'doc_id')} * 4) as b, floor({q.u(43, 'doc_id')} * 4) as c from documents)
select doc_id, case when a >= b and a >= c then 'neg' when b >= c then 'neu' else 'pos' end as label from t""")
def _(spark, d):
    t = docs(spark, d, "doc_id")
    for i, n in enumerate("abc"):
        t = t.withColumn(n, F.floor(K.u(41 + i, "doc_id") * 4))
    return t.select("doc_id", B.argmax_label(["a", "b", "c"], ["neg", "neu", "pos"]).alias("label"))


for _name, _last, _fn in (("b26_first_user", False, "arg_min"), ("b26_last_user", True, "arg_max")):
    @query(_name, f"select conv_id, {_fn}(text, turn) as text from conversations where role = 'user' group by conv_id")
    def _(spark, d, _last=_last):
        return B.edge_user(table(spark, d, "conversations"), _last)


PROMPT_RESPONSE = """with f as (select conv_id, min(turn) as t0, arg_min(text, turn) as prompt from conversations where role = 'user' group by conv_id),
r as (select c.conv_id, arg_min(c.text, c.turn) as response from conversations c join f on f.conv_id = c.conv_id and c.turn > f.t0 where role = 'assistant' group by c.conv_id),
pr as (select conv_id, 'prompt' as kind, prompt as text, '' as text_pair from f union all select conv_id, 'response', prompt, response from f join r using (conv_id))"""


@query("b27_prompt_response", PROMPT_RESPONSE + "select conv_id, kind, text, text_pair from pr")
def _(spark, d):
    return B.prompt_response_rows(table(spark, d, "conversations"))


@query("b28_json_leaves", """with c as (select conv_id, turn, text from conversations)
select conv_id, '$.turns[' || (row_number() over (partition by conv_id order by turn) - 1) || '].text' as path, length(text)::BIGINT as n from c qualify length(text) > 60""")
def _(spark, d):
    # every conversation as one nested JSON environment
    c = table(spark, d, "conversations")
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    env = c.groupBy("conv_id").agg(F.to_json(F.struct(F.lit("env").alias("name"), turns.alias("turns"))).alias("js"))
    return B.json_leaves(env, ["conv_id"], "js", 60).select("conv_id", "path", F.length("text").alias("n"))


@query("b29_drop_missing", "select d.doc_id, l.quality::BIGINT as quality from documents d join labels l using (doc_id) where d.doc_id % 7 <> 0")
def _(spark, d):
    t = docs(spark, d, "doc_id").join(table(spark, d, "labels"), "doc_id", "left").withColumn(
        "score", F.when(F.col("doc_id") % 7 == 0, float("nan")).otherwise(1.0))
    return B.drop_missing(t, ["quality", "score"]).select("doc_id", "quality")


@query("b30_accept_items", r"select conv_id, turn, role, length(trim(text))::BIGINT as n from conversations where length(trim(text)) between 50 and 800 and role in ('user', 'assistant')")
def _(spark, d):
    return B.accept_items(table(spark, d, "conversations"), "text", "role", 50, 800, ["user", "assistant"]).select("conv_id", "turn", "role", F.length("text").alias("n"))


@query("b30_both_classes", "select d.source, d.doc_id from documents d join labels l using (doc_id) where d.source in (select source from documents join labels using (doc_id) group by source having min(toxic) <> max(toxic))")
def _(spark, d):
    return B.both_classes(labelled(spark, d, "source"), "source", "toxic").select("source", "doc_id")


@query("b31_edgy", f"select doc_id from documents where {q.u(51, 'doc_id')} < 0.5 and (regexp_matches(source, '^src1') or {q.u(52, 'doc_id')} >= 0.8)")
def _(spark, d):
    t = docs(spark, d, "doc_id", "source").withColumn("s", K.u(51, "doc_id")).withColumn("t", K.u(52, "doc_id"))
    return t.where(B.edgy("s", 0.5, "^src1", "t", 0.8)).select("doc_id")


@query("b32_valid_label_set", r"""with t as (select conv_id, turn, string_split(text, '. ') as a, string_split(upper(text), '. ') as b, replace(text, ',', '{}') as tpl from conversations)
select conv_id, turn from t where len(a) = len(b) and len([x for x in b if length(trim(x)) = 0]) = 0 and len(string_split(tpl, '{}')) = 2""")
def _(spark, d):
    t = table(spark, d, "conversations", "conv_id", "turn", "text").select(
        "conv_id", "turn", F.split("text", r"\. ").alias("a"), F.split(F.upper("text"), r"\. ").alias("b"), F.replace("text", F.lit(","), F.lit("{}")).alias("tpl"))
    return t.where(B.valid_label_set("a", "b", "tpl")).select("conv_id", "turn")


@query("b33_quality_cut", f"select doc_id, round_even(least(greatest({q.u(61, 'doc_id')} * 7 - 1, 0.0), 5.0), 0)::BIGINT as int_score from documents where round_even(least(greatest({q.u(61, 'doc_id')} * 7 - 1, 0.0), 5.0), 0) >= 3")
def _(spark, d):
    return B.quality_cut(docs(spark, d, "doc_id").withColumn("score", K.u(61, "doc_id") * 7 - 1), "score").select("doc_id", "int_score")
