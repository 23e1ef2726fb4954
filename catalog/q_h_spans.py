"""Character spans."""

from pyspark.sql import functions as F

from glyphmill.functions import keys as K
from glyphmill.functions import units as U
from glyphmill.operators import spans as S

from . import query
from . import sqlkit as q
from .common import docs, table


def positions_sql(rx, label):
    """List of {s, e, l} for every match of a pattern, in DuckDB."""
    return rf"""[{{'s': (list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0))::BIGINT,
      'e': (list_sum([length(x) for x in p[1:i]]) + list_sum([length(x) for x in m[1:i]]))::BIGINT, 'l': '{label}'}} for i in range(1, len(m) + 1)]"""


def detect_sql(patterns=None, source="documents", ids="doc_id"):
    parts = []
    for lab, rx in (patterns or S.PII_PATTERNS).items():
        r = rx.replace("'", "''")
        parts.append(f"select {ids}, text, unnest({positions_sql(rx, lab)}) as x from (select {ids}, text, regexp_split_to_array(text, '{r}') as p, regexp_extract_all(text, '{r}') as m from {source})")
    return " union all ".join(parts)


DETECT = f"det as ({detect_sql()})"


def pii_docs(spark, d):
    return docs(spark, d, "doc_id", "text").withColumn("spans", S.detect_pii("text"))


@query("h25_detect_pii", f'with {DETECT} select doc_id, x.s as start, x.e as "end", x.l as label from det')
def _(spark, d):
    return S.explode_spans(pii_docs(spark, d), "doc_id", "spans")


# cleaning as a fold over the sorted span list, spelled with list_reduce
CLEAN = f"""{DETECT}, lst as (select doc_id, any_value(text) as text, list_sort(list({{'s': x.s, 'e': x.e, 'l': x.l}})) as v from det group by doc_id),
 cl as (select doc_id, text, list_reduce([[y] for y in v], lambda a, b:
   case when a[-1].l = b[1].l and b[1].s - a[-1].e between 0 and 1 and length(trim(substr(text, a[-1].e + 1, b[1].s - a[-1].e))) = 0
          then a[1:len(a) - 1] || [{{'s': a[-1].s, 'e': b[1].e, 'l': b[1].l}}]
        when b[1].s < a[-1].e then a else a || b end) as c from lst)"""


@query("h20_clean_spans", f'with {CLEAN} select doc_id, z.s as start, z.e as "end", z.l as label from (select doc_id, unnest(c) as z from cl)')
def _(spark, d):
    t = pii_docs(spark, d).withColumn("clean", S.clean_spans("text", "spans"))
    return S.explode_spans(t, "doc_id", "clean")


@query("h21_locate_entities", f"""with e as (select doc_id, text, unnest(list_distinct([x for x in string_split(regexp_replace(text, '[^\\p{{L}}]+', ' ', 'g'), ' ') if length(x) >= 4])) as w from documents)
select doc_id, w as label, (len(string_split(text, w)) - 1)::BIGINT as n, (instr(text, w) - 1)::BIGINT as first from e""")
def _(spark, d):
    # entities: the distinct words of four letters or more of the whole text; the label is the word itself
    words = F.array_distinct(F.filter(F.split(F.regexp_replace("text", r"[^\p{L}]+", " "), " "), lambda w: F.length(w) >= 4))
    t = docs(spark, d, "doc_id", "text").withColumn("ents", F.transform(words, lambda w: F.struct(w.alias("text"), w.alias("label"))))
    s = S.explode_spans(t.withColumn("spans", S.locate_all("text", "ents", 2)), "doc_id", "spans")
    return s.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"))


def _entities(text="text"):
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(text, r"[^\p{L}]+", " "), " "), lambda w: F.length(w) >= 3))
    return F.transform(words, lambda w: F.struct(w.alias("text"), F.when(w.rlike(r"^\p{Lu}"), "PERSON").otherwise("TERM").alias("label")))


# occurrences by running lengths of the parts between them; overlapping ones form groups in which the longest goes first
GREEDY = """isl as (select *, sum(fresh) over (partition by doc_id order by s, e, l rows unbounded preceding) as island from (
   select *, case when s >= coalesce(max(e) over (partition by doc_id order by s, e, l rows between unbounded preceding and 1 preceding), 0) then 1 else 0 end as fresh from cand)),
 grp as (select doc_id, list([{'s': s, 'e': e, 'l': l}] order by e - s desc, s, e, l) as v from isl group by doc_id, island),
 chosen as (select doc_id, unnest(list_reduce(v, lambda a, b: case when len(list_filter(a, lambda y: y.s < b[1].e and b[1].s < y.e)) > 0 then a else a || b end)) as x from grp)"""


@query("h22_align_entities", f"""with w as (select doc_id, text, unnest(list_distinct([x for x in string_split(regexp_replace(text, '[^\\p{{L}}]+', ' ', 'g'), ' ') if length(x) >= 3])) as w from documents),
 parts as (select doc_id, text, w, unnest(string_split(text, w)) as p, generate_subscripts(string_split(text, w), 1) as i, len(string_split(text, w)) as n from w),
 occ as (select doc_id, text, w, i, n, sum(length(p) + length(w)) over (partition by doc_id, w order by i rows unbounded preceding) as e from parts),
 found as (select doc_id, text, (e - length(w))::BIGINT as s, e::BIGINT as e, case when regexp_matches(w, '^\\p{{Lu}}') then 'PERSON' else 'TERM' end as l from occ where i < n),
 cand as (select doc_id, s, e, l from found where not (s > 0 and regexp_matches(substr(text, s, 1), '^[\\p{{L}}\\p{{N}}]$') and regexp_matches(substr(text, s + 1, 1), '^[\\x00-\\x7F]$'))
   and not (e < length(text) and regexp_matches(substr(text, e + 1, 1), '^[\\p{{L}}\\p{{N}}]$') and regexp_matches(substr(text, e, 1), '^[\\x00-\\x7F]$'))), {GREEDY}
select doc_id, x.s as start, x.e as "end", x.l as label from chosen""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "text").withColumn("spans", S.align_entities("text", _entities()))
    return S.explode_spans(t, "doc_id", "spans")


@query("h23_propagate", f"""with f as (select doc_id, text, regexp_extract(text, '^(\\p{{Lu}}[\\p{{L}}]+)', 1) as w from documents), v as (select * from f where length(w) > 1),
 parts as (select doc_id, text, w, unnest(string_split(text, w)) as p, generate_subscripts(string_split(text, w), 1) as i, len(string_split(text, w)) as n from v),
 occ as (select doc_id, text, w, i, n, sum(length(p) + length(w)) over (partition by doc_id order by i rows unbounded preceding) as e from parts)
select doc_id, (e - length(w))::BIGINT as start, e::BIGINT as "end", 'PERSON' as label from occ where i < n and (e = length(w) or (
  not (e > length(w) and regexp_matches(substr(text, (e - length(w))::BIGINT, 1), '^[\\p{{L}}\\p{{N}}_]$')) and not regexp_matches(substr(text, e::BIGINT + 1, 1), '^[\\p{{L}}\\p{{N}}_]$')))""")
def _(spark, d):
    # seed spans: the first word of every text that starts with a capital
    first = F.regexp_extract("text", r"^(\p{Lu}[\p{L}]+)", 1)
    t = docs(spark, d, "doc_id", "text").withColumn("spans", F.when(F.length(first) > 1, F.array(S.span(F.lit(0), F.length(first), F.lit("PERSON")))).otherwise(F.array().cast(S.SPANS)))
    return S.explode_spans(t.withColumn("all", S.propagate("text", "spans")), "doc_id", "all")


@query("h24_relabel_by_context", f"""with {DETECT} select doc_id, x.s as start, x.e as "end",
 case when x.l = 'SECRET' and regexp_matches(substr(text, greatest(x.s - 30, 0) + 1, x.s - greatest(x.s - 30, 0)), '(?i)(token|iban)') then 'API_TOKEN' else x.l end as label from det""")
def _(spark, d):
    t = pii_docs(spark, d).withColumn("r", S.relabel_by_context("text", "spans", "SECRET", "(?i)(token|iban)", "API_TOKEN"))
    return S.explode_spans(t, "doc_id", "r")


def luhn_sql(c):
    return f"(select sum(case when i % 2 = 1 then case when dg * 2 > 9 then dg * 2 - 9 else dg * 2 end else dg end) from (select i, substr(reverse({c}), (i + 1)::INT, 1)::INT as dg from range(0, length({c})) r(i))) % 10 = 0"


@query("h26_luhn", f"""with n as (select doc_id, unnest(regexp_extract_all(text, '\\b\\d{{16}}\\b')) as number from documents)
select doc_id, number, ({luhn_sql('number')})::INT::BIGINT as ok from n""")
def _(spark, d):
    n = docs(spark, d, "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\b\d{16}\b)"), F.lit(1))).alias("number"))
    return n.select("doc_id", "number", S.luhn_ok("number").alias("ok"))


@query("h26_luhn_complete", f"""with n as (select doc_id, lpad(({q.h32(5, 'doc_id')})::VARCHAR, 15, '4') as p from documents), c as (select doc_id, p, unnest(range(10)) as k from n)
select doc_id, p || k as card from c where {luhn_sql('(p || k)')}""")
def _(spark, d):
    return docs(spark, d, "doc_id").select("doc_id", S.luhn_complete(F.lpad(K.h32(5, "doc_id").cast("string"), 15, "4")).alias("card"))


@query("h27_iban", f"""with b as (select c_custkey, lpad(({q.h32(27, 'c_custkey')})::VARCHAR, 18, '7') as b from customer), i as (select c_custkey, 'DE' || lpad((98 - (b || '131400')::HUGEINT % 97)::VARCHAR, 2, '0') || b as iban from b),
 t as (select c_custkey, case when c_custkey % 3 = 0 then translate(iban, '7', '8') else iban end as iban from i)
select c_custkey, iban, ((substr(iban, 5) || '1314' || substr(iban, 3, 2))::HUGEINT % 97 = 1)::INT::BIGINT as ok from t""")
def _(spark, d):
    # one number per customer, completed with its check digits, then checked; every third one is damaged
    c = table(spark, d, "customer", "c_custkey")
    iban = S.iban_complete(F.lit("DE"), F.lpad(K.h32(27, "c_custkey").cast("string"), 18, "7"))
    t = c.withColumn("iban", F.when(F.col("c_custkey") % 3 == 0, F.translate(iban, "7", "8")).otherwise(iban))
    return t.select("c_custkey", "iban", S.iban_ok("iban").alias("ok"))


_EMAIL = S.PII_PATTERNS["EMAIL"]
_IP = S.PII_PATTERNS["IP_ADDRESS"]


@query("h28_redact_pattern", f"select doc_id, md5(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g')) as h from documents")
def _(spark, d):
    t = docs(spark, d, "doc_id", "text").withColumn("spans", S.detect_pii("text", {"EMAIL": _EMAIL}))
    return t.select("doc_id", F.md5(S.redact("text", "spans")).alias("h"))


@query("h29_merge_pieces", rf"""with w as (select doc_id, text, regexp_split_to_array(text, '\d+') as p, regexp_extract_all(text, '\d+') as m from documents),
 x as (select doc_id, any_value(text) as text, list_sort(list(x)) as v from (select doc_id, text, unnest({positions_sql('', 'NUMBER')}) as x from w) group by doc_id),
 sc as (select doc_id, text, [{{'s': y.s, 'e': y.e, 'p': round(((y.s * 7 + doc_id) % 100) / 100.0, 2)}} for y in v] as v from x),
 f as (select doc_id, text, list_reduce([[y] for y in v], lambda a, b: case when b[1].s - a[-1].e <= 3 and not regexp_matches(substr(text, a[-1].e + 1, b[1].s - a[-1].e), '\p{{L}}')
   then a[1:len(a) - 1] || [{{'s': a[-1].s, 'e': greatest(a[-1].e, b[1].e), 'p': greatest(a[-1].p, b[1].p)}}] else a || b end) as c from sc)
select doc_id, z.s as start, z.e as "end", round(z.p, 6) as score from (select doc_id, unnest(c) as z from f) where z.p >= 0.5""")
def _(spark, d):
    # numbers as pieces with a score derived from place and document
    t = docs(spark, d, "doc_id", "text").withColumn("m", U.match_spans("text", r"\d+"))
    pieces = F.transform("m", lambda x: F.struct(x["start"], x["end"], F.lit("NUMBER").alias("label"), F.round(((x["start"] * 7 + F.col("doc_id")) % 100) / 100.0, 2).alias("score")))
    s = t.select("doc_id", F.explode(S.merge_pieces("text", pieces)).alias("s"))
    return s.select("doc_id", "s.start", "s.end", "s.score")


@query("h30_presidio_names", f"""with {DETECT} select case x.l when 'EMAIL' then 'EMAIL_ADDRESS' when 'PHONE' then 'PHONE_NUMBER' when 'BANK_ACCOUNT' then 'IBAN_CODE' else x.l end as label, count(*)::BIGINT as n
 from det where x.l <> 'SECRET' group by 1""")
def _(spark, d):
    t = pii_docs(spark, d).select(F.explode(S.map_spans("spans", S.PRESIDIO)).alias("s"))
    return t.groupBy(F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


# ---- token tags: words of a document, tagged PER for capitalised words, NUM for numbers --------------------------------

TOK = r"tk as (select doc_id, lang, [x for x in string_split(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g'), ' ') if x <> ''] as toks from documents)"
TAGS = TOK + r""", un as (select doc_id, lang, unnest(range(1, len(toks) + 1)) as i, unnest(toks) as tok from tk),
 tg as (select *, case when regexp_matches(tok, '^\p{Lu}') then 'PER' when regexp_matches(tok, '^[0-9]') then 'NUM' else 'O' end as typ from un)"""

# every white-space word with its offsets, by running sums
WORDS = r"""wl as (select doc_id, regexp_split_to_array(text, '\S+') as p, regexp_extract_all(text, '\S+') as m from documents),
 wu as (select doc_id, unnest(range(1, len(m) + 1)) as i, unnest(p[1:len(m)]) as p, unnest(m) as tok from wl),
 words as (select doc_id, i, tok, sum(length(p) + length(tok)) over (partition by doc_id order by i) - length(tok) as s, sum(length(p) + length(tok)) over (partition by doc_id order by i) as e from wu)"""


def _tagged(spark, d):
    toks = F.filter(F.split(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")
    tag = lambda x: F.when(x.rlike(r"^\p{Lu}"), "I-PER").when(x.rlike("^[0-9]"), "I-NUM").otherwise("O")
    # pinned: a filter on the tokens would split the text a second time
    return U.pin(docs(spark, d, "doc_id", "lang", "text"), "tokens", toks).select("doc_id", "lang", "tokens", F.transform("tokens", tag).alias("tags"))


@query("h31_bio_to_spans", f"""with {TAGS}, fl as (select *, (lag(typ) over w is distinct from typ)::INT as chg from tg window w as (partition by doc_id order by i)),
 isl as (select *, sum(chg) over (partition by doc_id order by i) as g from fl)
select doc_id, (min(i) - 1)::BIGINT as start, max(i)::BIGINT as "end", any_value(typ) as label from isl where typ <> 'O' group by doc_id, g""")
def _(spark, d):
    return S.explode_spans(_tagged(spark, d).withColumn("spans", S.bio_to_spans("tags")), "doc_id", "spans")


@query("h32_spans_to_bio", rf"""with {WORDS}, {DETECT}, el as (select doc_id, x.s as s, x.e as e from det where x.l in ('EMAIL', 'IP_ADDRESS')),
 hit as (select w.doc_id, w.i, min(el.s) as hs from words w join el on el.doc_id = w.doc_id and el.s < w.e and el.e > w.s group by all)
select w.doc_id, count(*)::BIGINT as n_units, count(hit.i)::BIGINT as n_tagged, coalesce(sum((hit.i is not null and h2.i is null)::INT), 0)::BIGINT as n_begin
from words w left join hit on hit.doc_id = w.doc_id and hit.i = w.i left join hit h2 on h2.doc_id = hit.doc_id and h2.i = hit.i - 1 and h2.hs = hit.hs group by w.doc_id""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "text").withColumn("spans", S.detect_pii("text", {"EMAIL": _EMAIL, "IP_ADDRESS": _IP}))
    t = t.withColumn("units", U.word_units("text"))
    t = t.where(F.size("units") > 0).withColumn("tags", S.spans_to_bio("spans", "units"))
    return t.select("doc_id", F.size("units").alias("n_units"), F.size(F.filter("tags", lambda x: x != "O")).alias("n_tagged"),
                    F.size(F.filter("tags", lambda x: x.startswith("B-"))).alias("n_begin"))


@query("h33_detokenize", f"""with {TOK} select doc_id, md5(array_to_string(toks, ' ')) as h, (length(array_to_string(toks, ' ')) - length(toks[-1]))::BIGINT as last_start, len(toks)::BIGINT as n from tk where len(toks) > 0""")
def _(spark, d):
    t = _tagged(spark, d).where(F.size("tokens") > 0).withColumn("d", S.detokenize("tokens", "lang"))
    return t.select("doc_id", F.md5("d.text").alias("h"), F.element_at("d.units", -1)["start"].alias("last_start"), F.size("d.units").alias("n"))


OVER = """w as (select user_id, list_sort(list({'s': (event_id % 997)::BIGINT, 'e': (event_id % 997 + 2 + event_id % 7)::BIGINT, 'l': event_type})) as v from events group by user_id)"""


def _windows_spans(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    s = S.span(F.col("event_id") % 997, F.col("event_id") % 997 + 2 + F.col("event_id") % 7, F.col("event_type"))
    return e.groupBy("user_id").agg(F.collect_list(s).alias("spans"))


@query("h34_merge_overlaps", f"""with {OVER}, f as (select user_id, list_reduce([[y] for y in list_sort(list_distinct(v))], lambda a, b: case when a[-1].l = b[1].l and b[1].s <= a[-1].e
  then a[1:len(a) - 1] || [{{'s': a[-1].s, 'e': greatest(a[-1].e, b[1].e), 'l': b[1].l}}] else a || b end) as c from w)
select user_id as doc_id, z.s as start, z.e as "end", z.l as label from (select user_id, unnest(c) as z from f)""")
def _(spark, d):
    t = _windows_spans(spark, d).withColumn("m", S.merge_overlaps("spans"))
    return S.explode_spans(t.withColumnRenamed("user_id", "doc_id"), "doc_id", "m")


@query("h35_strip_spans", rf"""with {WORDS}
select doc_id, count(*)::BIGINT as n, sum(s + length(tok) - length(regexp_replace(tok, '^[^\p{{L}}\p{{N}}]+', '')))::BIGINT as starts,
 sum(length(regexp_replace(regexp_replace(tok, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', '')))::BIGINT as chars from words group by doc_id""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "text")
    t = t.withColumn("spans", F.transform(U.word_units("text"), lambda x: S.span(x["start"], x["end"], F.lit("W"))))
    s = S.explode_spans(t.withColumn("st", S.strip_spans("text", "spans")), "doc_id", "st")
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query("h18_fill_spans", """select c_custkey, 'Dear ' || c_name || ', your number is ' || c_mktsegment || '.' as text, 5::BIGINT as s1, (5 + length(c_name))::BIGINT as e1,
 (5 + length(c_name) + 17)::BIGINT as s2, (22 + length(c_name) + length(c_mktsegment))::BIGINT as e2 from customer""")
def _(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    val = lambda v, l: F.struct(v.alias("value"), F.lit(l).alias("label"))
    m = F.create_map(F.lit("NAME"), val(F.col("c_name"), "PERSON"), F.lit("PHONE"), val(F.col("c_mktsegment"), "PHONE"))
    f = c.select("c_custkey", S.fill_spans(F.lit("Dear {NAME}, your number is {PHONE}."), m).alias("f"))
    at = lambda i, k: F.get("f.spans", F.lit(i))[k]
    return f.select("c_custkey", "f.text", at(0, "start").alias("s1"), at(0, "end").alias("e1"), at(1, "start").alias("s2"), at(1, "end").alias("e2"))


@query("h19_strip_marks", """select c_custkey, 'Dear ' || c_name || ', your number is ' || c_mktsegment || '.' as text, 1::BIGINT as n, 5::BIGINT as start, (5 + length(c_name))::BIGINT as "end" from customer""")
def _(spark, d):
    # PHONE is no known type here, so its value stays in the text without a span
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    marked = F.concat(F.lit("Dear ⟦PERSON:"), "c_name", F.lit("⟧, your number is ⟦PHONE:"), "c_mktsegment", F.lit("⟧."))
    text, spans = S.strip_marks(F.col("m"), ["PERSON"])
    r = c.withColumn("m", marked).select("c_custkey", text.alias("text"), spans.alias("sp"))
    return r.select("c_custkey", "text", F.size("sp").alias("n"), F.get("sp", F.lit(0))["start"].alias("start"), F.get("sp", F.lit(0))["end"].alias("end"))


# ---- span metrics: gold = detected spans, predictions = the same with one in ten dropped and one in ten shifted ---------

def gold_pred(spark, d):
    gold = S.explode_spans(docs(spark, d, "doc_id", "text").withColumn("spans", S.clean_spans("text", S.detect_pii("text"))), "doc_id", "spans")
    r = K.u(77, "doc_id", "start")
    pred = gold.where(r >= 0.1).withColumn("end", F.when(r >= 0.9, F.col("end") - 2).otherwise(F.col("end")))
    return gold, pred


GOLD = f"""{CLEAN}, gold as (select doc_id, z.s as s, z.e as e, z.l as l from (select doc_id, unnest(c) as z from cl)),
 pred as (select doc_id, s, case when {q.u(77, 'doc_id', 's')} >= 0.9 then e - 2 else e end as e, l from gold where {q.u(77, 'doc_id', 's')} >= 0.1)"""

for _name, _by in (("n14_entity_f1", ""), ("n14_entity_f1_by_label", "label")):
    @query(_name, f"""with {GOLD}, m as (select coalesce(g.l, p.l) as label, (g.doc_id is not null)::INT as g, (p.doc_id is not null)::INT as p from gold g full join pred p on g.doc_id = p.doc_id and g.s = p.s and g.e = p.e and g.l = p.l),
 c as (select {_by + ',' if _by else ''} sum(g * p) as tp, sum((1 - g) * p) as fp, sum(g * (1 - p)) as fn from m {'group by label' if _by else ''})
select {_by + ',' if _by else ''} tp::BIGINT as tp, fp::BIGINT as fp, fn::BIGINT as fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c""")
    def _(spark, d, _by=_by):
        g, p = gold_pred(spark, d)
        return S.entity_f1(g, p, "doc_id", per_label=bool(_by))


@query("n15_redaction_metrics", f"""with {GOLD}, cc as (select doc_id, lang, unnest(string_split(text, '')) as c, unnest(range(1, length(text) + 1)) as i from documents where doc_id in (select doc_id from gold)), ch as (select doc_id, lang, i, not regexp_matches(c, '{q.WS}') as solid from cc),
 gm as (select distinct doc_id, unnest(range(s + 1, e + 1)) as i from gold where l not in ('IP_ADDRESS')), ga as (select distinct doc_id, unnest(range(s + 1, e + 1)) as i from gold),
 pm as (select distinct doc_id, unnest(range(s + 1, e + 1)) as i from pred),
 t as (select ch.doc_id, ch.lang, ch.i, gm.i is not null as g, ga.i is not null as a, pm.i is not null as p from ch left join gm using (doc_id, i) left join ga using (doc_id, i) left join pm using (doc_id, i) where solid),
 c as (select lang, sum((g and p)::INT) as hit, sum(g::INT) as want, sum((p and a)::INT) as rgt, sum(p::INT) as prd from t group by lang),
 en as (select d.lang, gold.doc_id, gold.s, sum(t.p::INT) as cov, count(*) as n from gold join documents d using (doc_id) join t on t.doc_id = gold.doc_id and t.i between gold.s + 1 and gold.e where gold.l <> 'IP_ADDRESS' group by all),
 er as (select lang, avg((cov >= 0.9 * n)::INT) as er from en group by lang),
 rp as (select l.lang, coalesce(hit, 0) / greatest(coalesce(want, 0), 1) as r, coalesce(rgt, 0) / greatest(coalesce(prd, 0), 1) as p, coalesce(er, 0) as er from (select distinct lang from documents) l left join c using (lang) left join er using (lang))
select lang, round(r, 6) as redact_recall, round(p, 6) as redact_precision, round(er, 6) as entity_recall, round(2 * r * p / greatest(r + p, 1e-9), 6) as redact_f1 from rp""")
def _(spark, d):
    t = docs(spark, d, "doc_id", "lang", "text").withColumn("gold", S.clean_spans("text", S.detect_pii("text")))
    r = lambda x: K.u(77, "doc_id", x["start"])
    pred = F.transform(F.filter("gold", lambda x: r(x) >= 0.1), lambda x: S.span(x["start"], F.when(r(x) >= 0.9, x["end"] - 2).otherwise(x["end"]), x["label"]))
    t = t.withColumn("pred", pred).withColumn("may", F.filter("gold", lambda x: x["label"] == "IP_ADDRESS")).withColumn("must", F.filter("gold", lambda x: x["label"] != "IP_ADDRESS"))
    return S.redaction_metrics(t, "text", "must", "may", "pred", ["lang"])
