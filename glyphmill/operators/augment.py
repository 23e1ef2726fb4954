"""Augmentation jobs. The same operators hit both classes, so noise never tells the label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import WS, _c, h32, sentences, u
from ..functions.perturb import EVAL_OPS, OPS, draw, perturb, typo_hashes, weighted, word_typos
from ..functions.text import english_like, fold, latin_share, script_frac
from ..functions.units import NO_SPACE_LANGS, cut, explode_rows, pin, short_span
from .dedup import dedup
from .sampling import hash_rank
from .spans import fill_spans, iban_complete, luhn_complete


def perturb_random(df: DataFrame, text: str, key: str, ops: list[str] = OPS, seed=0) -> DataFrame:
    """A hash-chosen operator per row; `source` becomes augment/<operator>. Branches are lazy: one operator runs per row."""
    pick = F.pmod(h32(f"{seed}.op", key), F.lit(len(ops)))
    out, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, op in reversed(list(enumerate(ops))):
        out = F.when(pick == i, perturb(text, op, seed=seed, key=key)).otherwise(out)
        name = F.when(pick == i, f"augment/{op}").otherwise(name)
    return df.withColumn("_new", out).withColumn("source", name).withColumn(text, F.col("_new")).drop("_new")


def perturb_window(df: DataFrame, text: str, key: str, op: str, lo: int = 100, hi: int = 400, seed=0, r: float | None = None) -> DataFrame:
    """Only lo..hi characters from a hashed place are perturbed."""
    t = F.col(text)
    s = F.pmod(h32(f"{seed}.s", key), (F.greatest(F.length(t) - hi, F.lit(0)) + 1).cast("bigint"))
    e = s + lo + F.pmod(h32(f"{seed}.e", key), F.lit(hi - lo + 1))
    return df.withColumn(text, F.concat(cut(t, F.lit(0), s), perturb(cut(t, s, e), op, r, seed, key), cut(t, e)))


#: Own choice: share of payloads per place.
PLACES = {"start": 0.2, "end": 0.2, "sentence": 0.4, "line": 0.2}


def insert_at(carrier: Column, payload: Column, key: Column | str, seed, places: dict[str, float] = PLACES) -> Column:
    """Payload at a named place of the carrier, drawn by hash: as its first or last block, or behind the last sentence end or
    line end before a hashed position (as the last block where there is none)."""
    head = cut(carrier, F.lit(0), F.pmod(h32(f"{seed}.c", key), (F.length(carrier) + 1).cast("bigint")))

    def behind(mark: str) -> Column:
        """Length of the head up to and including the last mark; 0 without one."""
        back = F.instr(F.reverse(head), mark[::-1])
        return F.when(back > 0, F.length(head) - back + 1).otherwise(F.lit(0))

    last = F.concat(carrier, F.lit("\n\n"), payload)
    inside = lambda at, glue: F.when(at > 0, F.concat(cut(carrier, F.lit(0), at), payload, F.lit(glue), cut(carrier, at))).otherwise(last)
    texts = {"start": F.concat(payload, F.lit("\n\n"), carrier), "end": last, "sentence": inside(behind(". "), " "), "line": inside(behind("\n"), "\n")}
    p, upto, out = u(f"{seed}.p", key), 1.0, last
    for name in reversed(places):
        out = F.when(p < upto, texts[name]).otherwise(out)
        upto = round(upto - places[name], 9)
    return out


def insert_payloads(carriers: DataFrame, payloads: DataFrame, frames: list[str], cid: str, pid: str, text: str = "text", payload: str = "payload", seed=0) -> DataFrame:
    """Every second carrier (by hash) gets a framed payload, the others stay clean: (cid, text, label, kind).

    Payloads have dense hash ranks and a carrier draws one rank: an equi-join instead of pairing everything."""
    ranked = hash_rank(payloads.select(pid, payload), [], f"{seed}.r", [pid], name="_pr")
    n = payloads.agg(F.count(F.lit(1)).alias("_np"))
    attacked = u(f"{seed}.a", cid) < 0.5
    c = carriers.crossJoin(n).withColumn("_pr", F.when(attacked & (F.col("_np") > 0), F.pmod(h32(f"{seed}.k", cid), F.col("_np")) + 1))
    j = c.join(ranked, "_pr", "left")
    frame = F.get(F.array(*[F.lit(f) for f in frames]), F.pmod(h32(f"{seed}.f", cid), F.lit(len(frames))).cast("int"))
    framed = F.replace(frame, F.lit("{p}"), F.col(payload))
    return j.select(cid, F.when(attacked, insert_at(F.col(text), framed, cid, seed)).otherwise(F.col(text)).alias("text"), attacked.cast("int").alias("label"),
                    F.when(attacked, "insert").otherwise("carrier").alias("kind"), pid)


def paired_contexts(df: DataFrame, context: str, attack: str, ids: list[str]) -> DataFrame:
    """A context with its attack string (1) and the same context without it (0), where the string occurs."""
    t, a = F.col(context), F.col(attack)
    clean = F.trim(F.replace(t, a, F.lit("")))
    rows = F.array(F.struct(t.alias("text"), F.lit(1).alias("label")), F.struct(clean.alias("text"), F.lit(0).alias("label")))
    return df.where((F.length(a) > 0) & t.contains(a)).select(*ids, F.explode(rows).alias("r")).select(*ids, "r.*")


def split_words(sentence: Column | str, lang: Column | str | None = None) -> Column:
    """Words between white space; single characters in languages that are written without spaces."""
    spaced = F.filter(F.split(_c(sentence), rf"{WS}+"), lambda x: x != "")
    if lang is None:
        return spaced
    single = F.filter(F.split(_c(sentence), ""), lambda x: ~x.rlike(rf"^{WS}*$"))
    return F.when(F.coalesce(_c(lang).isin(*NO_SPACE_LANGS), F.lit(False)), single).otherwise(spaced)


def join_words(words: Column, lang: Column | str | None = None) -> Column:
    glued = F.lit(False) if lang is None else F.coalesce(_c(lang).isin(*NO_SPACE_LANGS), F.lit(False))
    return F.when(glued, F.array_join(words, "")).otherwise(F.array_join(words, " "))


#: Own choice: what happens to a word of mild gibberish, by weight, and the share of letters that slip in a mistyped one.
MILD = {"type": 45, "lose": 17, "move": 13, "keep": 25}
MILD_SLIPS = 0.3


def mild_gibberish(words: Column | str, key: Column | str, seed, chars: Column, lang: Column | str | None = None, fate: dict[str, float] = MILD) -> Column:
    """Every word meets a fate by hash: mistyped, lost, moved behind its right neighbour, or kept; NULL below four words."""
    k = _c(key)
    # a value bound to a variable of an array function is computed once, however often it is asked for
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))

    def hashed(ws: Column) -> Column:
        met = F.transform(ws, lambda w, i: F.struct(w.alias("w"), weighted(f"{seed}.fate", k, fate, i).alias("fate"), i.alias("i")))
        left = once(once(met, lambda m: F.struct(m.alias("all"), F.filter(m, lambda x: x["fate"] != "lose").alias("left"))), lambda m: F.when(F.size(m["left"]) > 0, m["left"]).otherwise(m["all"]))
        placed = F.transform(left, lambda x: F.struct((x["i"] + F.when(x["fate"] == "move", 1.5).otherwise(0.0)).alias("place"), x["i"].alias("i"), x["fate"].alias("fate"), x["w"].alias("w")))
        return F.transform(F.array_sort(placed), lambda x: F.struct(x["w"].alias("w"), F.when(x["fate"] == "type", typo_hashes(f"{seed}.slip", F.concat_ws(".", k, x["i"].cast("string")))).alias("hashes")))

    return join_words(word_typos(once(_c(words), lambda ws: F.when(F.size(ws) >= 4, hashed(ws))), MILD_SLIPS, chars), lang)


def word_salad(df: DataFrame, lang: str, sid: list[str], sentence: str, seed=0, size: int = 3, max_words: int = 16) -> DataFrame:
    """Shuffled words of `size` unrelated sentences of one language: sentences are grouped by dense hash rank, so each
    group is small whatever the size of the language."""
    r = hash_rank(df.select(lang, *sid, sentence), [lang], f"{seed}.g", sid)
    r = r.withColumn("grp", F.floor((F.col("_rank") - 1) / size))
    w = explode_rows(r, [lang, "grp", "_rank"], split_words(sentence, lang), "w")
    w = w.withColumn("_o", h32(f"{seed}.o", lang, "grp", "_rank", "pos"))
    g = w.groupBy(lang, "grp").agg(F.sort_array(F.collect_list(F.struct("_o", "_rank", "pos", "w"))).alias("l"))
    n = 3 + F.pmod(h32(f"{seed}.n", lang, "grp"), F.lit(max_words - 2))
    return g.where(F.size("l") >= 3).select(lang, "grp", join_words(F.slice(F.col("l.w"), F.lit(1), n.cast("int")), lang).alias("text"))


# Keyboard rows.
KEYBOARD = ["qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю"]
#: ASCII without letters and space.
SYMBOLS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalpha())
HEX = "0123456789abcdef"


def _pool(s: str) -> Column:
    return F.array(*[F.lit(c) for c in s])


def _strings(pool: Column, k: Column, tag: str, most: int, longest: int) -> Column:
    """1..most strings of 2..longest characters of the pool."""
    size = F.greatest(F.size(pool), F.lit(1))
    one = lambda i: F.array_join(F.transform(F.sequence(F.lit(0), 1 + draw(f"{tag}.len", k, longest - 1, i)), lambda j: F.get(pool, draw(f"{tag}.char", k, size, i, j))), "")
    return F.array_join(F.transform(F.sequence(F.lit(0), draw(f"{tag}.n", k, most)), one), " ")


def noise_kinds(chars: Column, other: Column | None, k: Column, tag: str) -> dict[str, tuple[float, Column]]:
    """The generators of noise, each with its weight (own choice)."""
    row = F.get(F.array(*[_pool(r) for r in KEYBOARD]), draw(f"{tag}.row", k, len(KEYBOARD)))
    letter = F.get(chars, draw(f"{tag}.letter", k, F.greatest(F.size(chars), F.lit(1))))
    return {
        "letters": (4, _strings(chars, k, f"{tag}.l", 8, 12)), "keys": (2, _strings(row, k, f"{tag}.k", 5, 10)),
        "repeat": (1, F.repeat(letter, 4 + draw(f"{tag}.r", k, 24))), "symbols": (1, _strings(_pool(SYMBOLS), k, f"{tag}.s", 2, 30)),
        "hex": (1, _strings(_pool(HEX), k, f"{tag}.h", 3, 40)),
        "mixed": (1, _strings(F.concat(chars, other if other is not None else _pool(KEYBOARD[4])), k, f"{tag}.m", 6, 10)),
    }


def noise(key: Column | str, chars: Column, seed=0, other: Column | None = None) -> Column:
    """Noise string of a kind drawn by hash: letters of the language, one keyboard row, a repeated letter, symbols, hexadecimal
    digits or two scripts in one."""
    k = _c(key)
    kinds = noise_kinds(chars, other, k, f"{seed}.noise")
    kind, out = weighted(f"{seed}.kind", k, {n: w for n, (w, _) in kinds.items()}), F.lit(None).cast("string")
    for name, (_, text) in kinds.items():
        out = F.when(kind == name, text).otherwise(out)
    return out


# Template texts; the evaluation templates never occur in training.
PAYMENT_TRAIN = ["Card number: {CARD}, expires {EXP}, CVV {CVV}.", "{NAME} paid with card {CARD} (exp {EXP}).", "IBAN {IBAN}, account holder {NAME}",
                 "Please move the amount to {IBAN}.", "card {CARD}\nexpiry {EXP}\ncode {CVV}"]
PAYMENT_EVAL = ["Payment details: {CARD}; valid until {EXP}; check code {CVV}. Regards, {NAME}", "Refund to {IBAN} for {NAME}."]


def payment_snippets(df: DataFrame, key: str, name: str, seed=0, eval_share: float = 0.1) -> DataFrame:
    """One payment text per row with exact spans; a share of the rows uses held-out templates: (key, text, spans, split)."""
    held = u(f"{seed}.e", key) < eval_share
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.pmod(h32(f"{seed}.t", key), F.lit(len(xs))).cast("int"))
    digits = lambda tag, n: F.lpad(F.concat(h32(f"{seed}.{tag}1", key).cast("string"), h32(f"{seed}.{tag}2", key).cast("string")), n, "7")
    df = pin(df, "_card", luhn_complete(F.concat(F.lit("4"), digits("c", 14))))
    card = F.col("_card")
    spaced = F.concat_ws(" ", *[F.substring(card, 1 + 4 * i, 4) for i in range(4)])
    month = F.lpad((1 + F.pmod(h32(f"{seed}.m", key), F.lit(12))).cast("string"), 2, "0")
    year = (25 + F.pmod(h32(f"{seed}.y", key), F.lit(10))).cast("string")
    v = lambda c, l: F.struct(c.alias("value"), F.lit(l).alias("label"))
    slots = F.create_map(
        F.lit("CARD"), v(F.when(u(f"{seed}.sp", key) < 0.5, spaced).otherwise(card), "CREDIT_CARD"), F.lit("EXP"), v(F.concat(month, F.lit("/"), year), "DATE"),
        F.lit("CVV"), v(F.lpad(F.pmod(h32(f"{seed}.v", key), F.lit(1000)).cast("string"), 3, "0"), "CREDIT_CARD_CVV"),
        F.lit("IBAN"), v(iban_complete(F.lit("DE"), digits("i", 18)), "BANK_ACCOUNT"), F.lit("NAME"), v(F.col(name), "PERSON"))
    # numbers, slots and texts are made once per row, not at every place of a template that asks for them
    f = pin(pin(df, "_slots", slots), "_f", fill_spans(F.when(held, pick(PAYMENT_EVAL)).otherwise(pick(PAYMENT_TRAIN)), F.col("_slots")))
    f = f.select(key, F.when(held, "eval").otherwise("train").alias("split"), "_f")
    return f.select(key, F.col("_f.text").alias("text"), F.col("_f.spans").alias("spans"), "split")


def folded_copies(df: DataFrame, text: str, key: str, f: float = 0.3, seed=0) -> DataFrame:
    """Diacritic-free copies of a share of the mostly Latin rows, where folding changes something."""
    share = pin(df.where((u(seed, key) < f) & (latin_share(text) >= 0.8)), "_f", fold(text))
    copies = share.where(F.col("_f") != F.col(text)).withColumn(text, F.col("_f")).drop("_f").withColumn("copy", F.lit(1))
    return df.withColumn("copy", F.lit(0)).unionByName(copies)


def no_context_copies(df: DataFrame, context: str, key: str, f: float = 0.3, seed=0) -> DataFrame:
    """Copies of a share of the rows with their context emptied."""
    copies = df.where((u(seed, key) < f) & (F.length(context) > 0)).withColumn(context, F.lit("")).withColumn("copy", F.lit(1))
    return df.withColumn("copy", F.lit(0)).unionByName(copies)


def short_copies(df: DataFrame, text: str, key: str, label: str, lo: int = 10, hi: int = 40, seed=0) -> DataFrame:
    """Short spans of long samples that still pass the script and English filters, each text once."""
    s = pin(df, text, short_span(text, key, seed, lo, hi)).where(F.length(text) >= 5)
    script = F.element_at(F.split(label, "_"), -1)
    ok = (script_frac(text, script) >= 0.5) & ~((F.col(label) != "eng_Latn") & (script == "Latn") & english_like(text))
    return dedup(s.where(ok), [text], key)


def gibberish_set(sents: DataFrame, alphabet: DataFrame, lang: str, sid: list[str], sentence: str, seed=0) -> DataFrame:
    """Four classes per language: clean, mild gibberish, word salad, noise -> (lang, text, label).

    alphabet(lang, chars ARRAY) is one short row per language; sentences are split between the classes by hash."""
    part = F.pmod(h32(f"{seed}.part", *sid), F.lit(4))
    s = sents.withColumn("_part", part).withColumn("_key", F.concat_ws(".", *sid))
    clean = s.where("_part = 0").select(lang, F.col(sentence).alias("text"), F.lit("clean").alias("label"))
    with_chars = s.where("_part in (1, 3)").join(alphabet, lang)
    # texts are pinned: the test on their length would make each of them a second time
    mild = pin(with_chars.where("_part = 1"), "text", mild_gibberish(split_words(sentence, lang), "_key", seed, F.col("chars"), lang)).select(lang, "text", F.lit("mild gibberish").alias("label"))
    salad = word_salad(s.where("_part = 2"), lang, sid, sentence, seed).select(lang, "text", F.lit("word salad").alias("label"))
    junk = pin(with_chars.where("_part = 3"), "text", noise("_key", F.col("chars"), seed)).select(lang, "text", F.lit("noise").alias("label"))
    return clean.unionByName(mild).unionByName(salad).unionByName(junk).where(F.length(F.trim("text")) >= 2)


def robustness(df: DataFrame, text: str, gold: str, key: str, scorer, ops: list[str] = EVAL_OPS) -> DataFrame:
    """Recall per perturbation family and flag rate on perturbed benign rows, for a scoring column function."""
    from .metrics import binary_metrics

    rows = F.array(F.struct(F.lit("clean").alias("op"), F.col(text).alias("t")), *[F.struct(F.lit(op).alias("op"), perturb(text, op, 1.0, 0, key).alias("t")) for op in ops])
    x = df.select(key, F.col(gold).alias("gold"), F.explode(rows).alias("r")).select(key, "gold", "r.op", scorer(F.col("r.t")).alias("score"))
    return binary_metrics(x, by=["op"]).select("op", "n", "recall", "fpr")
