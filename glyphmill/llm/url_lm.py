"""URL filter by a character language-model ratio, in DataFrame operations only.

A rule list names hosts and path beginnings whose URLs are blocked or allowed; the longest rule that fits decides. URLs that a rule
decides also train two smoothed variable-order Markov models of characters, one of allowed and one of blocked URLs (host and path).
For a character c after a context h of up to ORDER characters
    P(c | h) = (count(h c) + T(h) P(c | h')) / (count(h) + T(h)),
where T(h) is the number of different characters seen after h and h' the context without its first character (Witten-Bell); the
recursion ends in a uniform distribution over ALPHABET characters. Unseen contexts fall back to shorter ones. The score of a URL
is its log-likelihood difference per character, allowed less blocked; a URL that no rule decides is blocked if its score is below a
threshold, calibrated as the midpoint of the two classes' mean scores over all URLs that rules decide.

Counts of the longest context are grouped over all URLs; shorter contexts are sums of these, so everything after the first
aggregate works on distinct n-grams. Scores come from joining each distinct n-gram's log ratio back to the URLs' n-grams; a very
frequent n-gram is one row on one side of that join, so its rows can be split.

Cases: a null URL, or one without `://`, has empty host and path, an empty text with the score 0, and no rule; without URLs of both
classes every unruled URL is allowed; repeated rows get equal verdicts and each count for training; an empty table gives an empty
result; other columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

ORDER = 4
ALPHABET = 128
#: (rule, verdict): fixed by the contract of op1.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def with_parts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of every row."""
    rest = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select("page_id", host.alias("host"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))


def fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def with_rule(parts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds rule and ruled (its verdict), both null where no rule fits; the longest rule comes first."""
    found = [F.when(fits(r, F.col("host"), F.col("path")), F.struct(F.lit(r).alias("rule"), F.lit(v).alias("ruled")))
             for r, v in sorted(rules, key=lambda x: (-len(x[0]), x[0]))]
    none = F.lit(None).cast("struct<rule:string,ruled:string>")
    return parts.withColumn("_r", F.coalesce(*found, none)).select("*", "_r.rule", "_r.ruled").drop("_r")


def grams(rows: DataFrame) -> DataFrame:
    """One row per character of host and path: the character after its ORDER predecessors (spaces before the start)."""
    padded = F.concat(F.lit(" " * ORDER), F.col("host"), F.col("path"))
    n = F.length(F.concat("host", "path"))
    at = rows.withColumn("text", padded).withColumn("i", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
    return at.withColumn("gram", F.expr(f"substring(text, i, {ORDER + 1})")).drop("text", "i")


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log P(last character | the others) of allowed less that of blocked; counts has (gram, ruled, n)."""
    grams_ = counts.groupBy("gram").agg(*[F.coalesce(F.sum(F.when(F.col("ruled") == v, F.col("n"))), F.lit(0)).alias(v) for v in ("allow", "block")])
    out = grams_.select("gram", *[F.lit(1.0 / ALPHABET).alias(f"p_{v}") for v in ("allow", "block")])
    for order in range(ORDER + 1):
        tail = grams_.select(F.substring("gram", ORDER + 1 - order, order + 1).alias("tail"), "allow", "block")
        tail = tail.groupBy("tail").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        head = tail.groupBy(F.substring("tail", 1, order).alias("head")).agg(
            *[F.sum(v).alias(f"n_{v}") for v in ("allow", "block")], *[F.sum((F.col(v) > 0).cast("long")).alias(f"t_{v}") for v in ("allow", "block")])
        out = out.withColumn("tail", F.substring("gram", ORDER + 1 - order, order + 1)).withColumn("head", F.substring("tail", 1, order))
        out = out.join(tail, "tail").join(head, "head")
        mixed = [F.when(F.col(f"n_{v}") + F.col(f"t_{v}") > 0, (F.col(v) + F.col(f"t_{v}") * F.col(f"p_{v}")) / (F.col(f"n_{v}") + F.col(f"t_{v}"))).otherwise(F.col(f"p_{v}")).alias(f"p_{v}")
                 for v in ("allow", "block")]
        out = out.select("gram", *mixed)
    return out.select("gram", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, threshold) of every row."""
    rows = with_rule(with_parts(pages), rules)
    # a URL's text decides its score, so distinct texts are scored once, however often they occur
    texts = saved(rows.groupBy("host", "path", "ruled").agg(F.count(F.lit(1)).alias("n")), "url-texts")
    each = grams(texts)
    counts = each.groupBy("gram", "ruled").agg(F.sum(F.when(F.col("ruled").isNotNull(), F.col("n")).otherwise(0)).alias("n"))
    ratios = saved(log_ratios(counts), "url-ratios")
    scored = each.join(ratios, "gram").groupBy("host", "path", "ruled", "n").agg(F.avg("ratio").alias("score"))
    scored = saved(scored.withColumn("score", F.round("score", 9)), "url-scores")
    mean = lambda v: F.sum(F.when(F.col("ruled") == v, F.col("score") * F.col("n"))) / F.sum(F.when(F.col("ruled") == v, F.col("n")))
    threshold = scored.agg(F.round((mean("allow") + mean("block")) / 2, 9).alias("threshold"))  # one row
    back = scored.select("host", "path", "score")
    out = rows.join(back, ["host", "path"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))).join(F.broadcast(threshold))
    verdict = F.coalesce("ruled", F.when(F.col("score") < F.col("threshold"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "threshold")


_ORDERS = "\n".join(f"""
tail{o} as (select gram[{ORDER + 1 - o}:] tail, sum(allow) allow, sum(block) block from g group by 1),
head{o} as (select tail[1:{o}] head, sum(allow) n_allow, sum(block) n_block, sum((allow > 0)::int) t_allow, sum((block > 0)::int) t_block from tail{o} group by 1),
p{o} as (select gram, {', '.join(f'case when n_{v} + t_{v} > 0 then (t.{v} + t_{v} * p_{v}) / (n_{v} + t_{v}) else p_{v} end p_{v}' for v in ('allow', 'block'))}
  from p{o - 1} p join tail{o} t on t.tail = p.gram[{ORDER + 1 - o}:] join head{o} h on h.head = t.tail[1:{o}]),""" for o in range(ORDER + 1)).replace("p-1 p", "start p")
_FITS = " ".join(f"when (host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}') then '{r}'"
                 for r, _ in sorted(RULES, key=lambda x: (-len(x[0]), x[0])))
_VERDICTS = " ".join(f"when '{r}' then '{v}'" for r, v in RULES)
SQL = f"""
with rest as (select page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') path from rest),
found as (select *, case {_FITS} end rule from parts),
ruled as (select *, case rule {_VERDICTS} end ruled from found),
texts as (select host, path, ruled, count(*) n from ruled group by 1, 2, 3),
chars as (select *, unnest(range(1, length(host || path) + 1)) i, repeat(' ', {ORDER}) || host || path txt from texts where length(host || path) > 0),
each_ as (select host, path, ruled, n, txt[i:i + {ORDER}] gram from chars),
g as (select gram, coalesce(sum(n) filter (ruled = 'allow'), 0)::double allow, coalesce(sum(n) filter (ruled = 'block'), 0)::double block from each_ group by 1),
start as (select gram, 1.0::double / {ALPHABET} p_allow, 1.0::double / {ALPHABET} p_block from g),{_ORDERS}
scored as (select host, path, ruled, n, round(avg(ln(p_allow) - ln(p_block)), 9) score from each_ join p{ORDER} using (gram) group by 1, 2, 3, 4),
cut as (select round((sum(score * n) filter (ruled = 'allow') / sum(n) filter (ruled = 'allow')
                    + sum(score * n) filter (ruled = 'block') / sum(n) filter (ruled = 'block')) / 2, 9) threshold from scored)
select page_id, r.host, r.path, rule, coalesce(r.ruled, case when coalesce(score, 0) < threshold then 'block' else 'allow' end) verdict,
       coalesce(score, 0) score, threshold
from ruled r left join scored s on r.host = s.host and r.path = s.path cross join cut
"""
