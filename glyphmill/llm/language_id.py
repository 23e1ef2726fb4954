"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords: runs of SIZES characters of every lower-cased word between its two ends, and the
word as a whole, each hashed into one of BUCKETS rows. A linear layer with a softmax turns the mean into one probability per language.
Embeddings and layer are trained by stochastic gradient descent in numpy, texts in a fixed random order from a fixed seed, on at most
EXAMPLES labelled documents (as many of each language as there are, first by hash of the id).

Training sees every example whole and one excerpt of 1 to 30 words of it as well, so that short texts are known too. A fifth of the
examples, by hash, takes no part in the descent: on them and their excerpts a temperature is fitted that makes probabilities agree with
accuracy, and the confidence below which an answer is rejected: the lowest cut above which at most ERRORS of the answers are wrong.

Since mean and layer are linear, a trained model is one row of language scores per bucket. A task looks distinct words up once per
piece of a batch, and adds their rows per text; the model is of fixed size: BUCKETS times the number of languages.

Cases: a null text or one without any letter is `und` with score 0, as is every text if nothing could be learned; a single known
language is the answer for all others, with score 1; texts with a null language teach nothing; words of any script count, and in
scripts without spaces a whole run is a word; repeated rows get equal answers; an empty table gives an empty result; `with_language`
keeps all columns, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words
from .common import saved
from .toxicity import held_out

EXAMPLES = 3000
BUCKETS = 1 << 15
DIM = 16
SIZES = (2, 3, 4)
ERRORS = 0.01
UNKNOWN = "und"
ANSWER = "struct<lang: string, score: double, accepted: boolean>"
#: A longer run of characters counts as several words, so no word's table of subwords is large.
LONGEST = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashed(x: np.ndarray, size: int) -> np.ndarray:
    """Buckets of the runs of `size` characters that start at each place (shorter ones at the end)."""
    h = np.full(len(x), size, "uint64") * _MIX
    for j in range(size):
        c = np.zeros(len(x), "uint64")
        c[:max(len(x) - j, 0)] = x[j:]
        h = (h ^ c) * _MIX
        h ^= h >> np.uint64(31)
    return (h % np.uint64(BUCKETS)).astype("int64")


def subwords(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of subwords of every word, their buckets in order)."""
    if not values:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    texts = [v.decode("utf-8", "replace") for v in values]
    chars = np.frombuffer("".join(f"\x02{t}\x03" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    length = np.fromiter(map(len, texts), "int64", len(texts)) + 2
    end = np.cumsum(length)
    word = np.repeat(np.arange(len(texts)), length)
    left = end[word] - np.arange(len(chars))  # characters from here to the word's end
    of, bucket = [], []
    for size in SIZES:
        at = np.flatnonzero(left >= size)
        of.append(word[at])
        bucket.append(_hashed(chars, size)[at])
    h = np.add.reduceat((chars * _MIX ^ (chars << np.uint64(17))) * (np.uint64(2) * left.astype("uint64") + np.uint64(1)), end - length)
    of.append(np.arange(len(texts)))
    bucket.append(((h ^ (h >> np.uint64(29))) * _MIX % np.uint64(BUCKETS)).astype("int64"))
    of, bucket = np.concatenate(of), np.concatenate(bucket)
    order = np.argsort(of, kind="stable")
    return np.bincount(of, minlength=len(texts)), bucket[order]


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words as codes, starts of the texts, distinct words; a run longer than LONGEST characters is cut into pieces of that length."""
    codes, starts, values = words.split(words.translated(texts, words.ALNUM_LOWER))
    long = [i for i, v in enumerate(values) if len(v) > LONGEST]
    if not long:
        return codes, starts, values
    number = {v: i for i, v in enumerate(values)}
    parts: list[list[int]] = [[i] for i in range(len(values))]
    for i in long:
        t = values[i].decode("utf-8", "replace")
        parts[i] = [number.setdefault(t[a:a + LONGEST].encode(), len(number)) for a in range(0, len(t), LONGEST)]
    size = np.fromiter(map(len, parts), "int64", len(parts))
    ends = np.concatenate([[0], np.cumsum(size[codes])])
    return words.gather(codes, size, np.array([p for ps in parts for p in ps], "int64")), ends[starts], list(number)


class Model:
    """Language scores per bucket; without languages it knows nothing."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.table, self.bias = np.zeros((len(languages), BUCKETS)), np.zeros(len(languages))
        self.heat, self.cut = 1.0, 0.0

    def logits(self, texts: pa.Array) -> np.ndarray:
        codes, starts, values = split_words(texts)
        n, bucket = subwords(values)
        size, doc = len(starts) - 1, np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        total = np.maximum(np.bincount(doc, n[codes], size), 1) if len(codes) else np.ones(size)
        out = np.tile(self.bias, (size, 1))
        if len(codes):
            first = np.cumsum(n) - n
            for c, scores in enumerate(self.table):  # one language at a time, so memory doesn't grow with their number
                out[:, c] += np.bincount(doc, np.add.reduceat(scores[bucket], first)[codes], size) / total
        return out

    def answer(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language, calibrated confidence) of every text."""
        z = self.logits(texts) / self.heat
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best]

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 4, rate: float = 2.0) -> None:
        """Descent on bags (buckets, their counts), one text after the other; the rate falls to nothing."""
        rng = np.random.default_rng(13)
        e = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
        w, b = np.zeros((DIM, len(self.languages))), np.zeros(len(self.languages))
        weight = len(y) / np.maximum(np.bincount(y, minlength=len(self.languages)), 1) / len(self.languages)
        total, step = epochs * len(y), 0
        for _ in range(epochs):
            for i in rng.permutation(len(y)):
                now = rate * (1 - step / total)
                step += 1
                at, n = bags[i]
                if not len(at):
                    continue
                share = (n / n.sum())[:, None]
                x = (share * e[at]).sum(0)
                z = x @ w + b
                p = np.exp(z - z.max())
                error = p / p.sum()
                error[y[i]] -= 1
                error *= weight[y[i]]
                back = w @ error
                w -= now * 0.1 * np.outer(x, error)
                b -= now * 0.01 * error
                # a step in the mean is divided among the subwords by their share
                e[at] -= now * share * back * min(len(at), 50)
        self.table, self.bias = np.ascontiguousarray((e @ w).T), b

    def calibrate(self, z: np.ndarray, y: np.ndarray, errors: float) -> None:
        """Temperature of least log loss, then the lowest cut that keeps the share of wrong answers above it within `errors`."""
        if not len(y):
            return

        def loss(heat: float) -> float:
            s = z / heat
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

        self.heat = min(np.geomspace(0.02, 20, 121).tolist(), key=loss)
        p = np.exp((z - z.max(1, keepdims=True)) / self.heat)
        sure, right = p.max(1) / p.sum(1), z.argmax(1) == y
        order = np.argsort(-sure, kind="stable")
        # one more wrong answer is assumed than seen, so few examples give no cut of false certainty
        wrong = (np.cumsum(~right[order]) + 1) / (np.arange(len(order)) + 2)
        fine = np.flatnonzero(wrong <= errors)
        self.cut = float(sure[order[fine[-1]]]) if len(fine) else float(sure.max())


def _bags(texts: pa.Array) -> list[tuple[bytes, bytes]]:
    """The distinct subwords of every text and their counts, BUCKETS of them at most."""
    codes, starts, values = split_words(texts)
    n, bucket = subwords(values)
    out = []
    for a, b in zip(starts.tolist(), starts[1:].tolist()):
        word, times = np.unique(codes[a:b], return_counts=True)
        count = np.bincount(words.gather(word, n, bucket), np.repeat(times, n[word]), BUCKETS) if len(word) else np.zeros(0)
        at = np.flatnonzero(count)
        out.append((at.astype("<u2").tobytes(), count[at].astype("<f4").tobytes()))
    return out


def excerpt(text: str, number: int) -> str:
    """1 to 30 words from a place that the number names."""
    ws = text.split()
    size = 1 + number % 30
    at = (number // 30) % max(1, len(ws) - size + 1)
    return " ".join(ws[at:at + size])


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", examples: int = EXAMPLES, errors: float = ERRORS) -> Model:
    """Only rows where `train` holds (an expression on doc_id) are read. `examples` rows at most, shared out among the languages."""
    known = docs.where(train & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.col("doc_id").cast("string").alias("id"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(examples)
    languages = sorted(r["lang"] for r in counts.collect())
    model = Model(languages)
    if len(languages) < 2:
        return model
    limit = max(1, examples // len(languages))
    # a hash cut leaves about twice the wanted rows of a language wherever they are; only those are ranked
    draw = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(1 << 30)).alias("draw")
    few = known.join(counts, "lang").where(F.col("count") * draw <= 2 * limit).groupBy("lang", "id").agg(F.min(F.xxhash64("id")).alias("at"))
    picked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("at", "id"))).where(F.col("r") <= limit)
    own = docs.select(F.col("doc_id").cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).join(F.broadcast(picked.select("lang", "id")), ["lang", "id"])  # at most `examples` rows
    sample = saved(own.dropDuplicates(["lang", "id", "text"]).withColumn("n", F.xxhash64("id", "text")), "language-examples")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch, 1):
                texts, number = piece.column(1).to_pylist(), piece.column(2).to_pylist()
                short = pa.array([excerpt(t, abs(n) >> 8) for t, n in zip(texts, number)], pa.string())
                bags = [pa.array(list(x), pa.binary()) for t in (piece.column(1), short) for x in zip(*_bags(t))]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), *bags], ["lang", "n", "whole", "whole_n", "short", "short_n"])

    schema = "lang string, n long, whole binary, whole_n binary, short binary, short_n binary"
    rows = sample.select("lang", "text", "n").mapInArrow(vectors, schema).collect()  # at most `examples` rows of bounded size
    rows = sorted(rows, key=lambda r: (r["n"], r["lang"]))
    place = {v: i for i, v in enumerate(languages)}
    y = np.array([place[r["lang"]] for r in rows])
    kept = np.array([r["n"] % 5 == 0 for r in rows], bool)
    if kept.all():
        kept[:] = False

    def bags(which: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        at = np.flatnonzero(which).tolist()
        return [(np.frombuffer(rows[i][c], "<u2").astype("int64"), np.frombuffer(rows[i][f"{c}_n"], "<f4").astype("float64")) for c in ("whole", "short") for i in at], np.concatenate([y[at], y[at]])

    model.fit(*bags(~kept))
    test, truth = bags(kept if kept.any() else ~kept)
    z = np.array([model.bias + (model.table[:, at] @ n / n.sum() if len(at) else 0) for at, n in test])
    model.calibrate(z, truth, errors)
    return model


def with_language(docs: DataFrame, model: Model, out: str, text: str = "text") -> DataFrame:
    """The documents with one more column of type ANSWER; what is not accepted should not be relied on."""
    if not model.languages:
        return docs.withColumn(out, F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of one number per language

    @F.arrow_udf(ANSWER)
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        names = pa.array(model.languages, pa.string())
        for texts in batches:
            got = [model.answer(p.column(0)) for p in words.pieces(pa.RecordBatch.from_arrays([texts], ["t"]), 0)]
            best, score = (np.concatenate([*(g[i] for g in got), np.zeros(0, kind)]) for i, kind in enumerate(("int64", "float64")))
            yield pa.StructArray.from_arrays([names.take(pa.array(best, pa.int64())), pa.array(score, pa.float64()), pa.array(score >= model.cut)], ["lang", "score", "accepted"])

    letters = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    return docs.withColumn(out, answer(F.col(f"`{text}`"))).withColumn(out, F.when(letters, F.col(f"`{out}`")).otherwise(none))


def digest(docs: DataFrame, model: Model, parts: int = 4, which: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every row."""
    rows = with_language(docs.select("doc_id", "text"), model, "answer")
    return rows.select("doc_id", held_out(F.col("doc_id"), parts, which).alias("held_out"), F.col("answer.lang").alias("lang_pred"), F.col("answer.score").alias("score"), F.col("answer.accepted").alias("accepted"))
