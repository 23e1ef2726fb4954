"""Text models on Spark ML: the data-parallel counterparts of the classifiers the datasets are built for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.units import Points, pin, slices, text_bytes


class _Features:
    """Hashed n-gram counts: the n-gram arrays are concatenated so that one hashing stage sees them all.

    Units are characters, words, or with `tokens` whatever stands between blanks, marks and symbols included; tokens are marked as
    present, not counted, and a text's vector has length one, so that long texts weigh no more than short ones."""

    def __init__(self, text: str, sizes: tuple, features: int, word: bool = False, tokens: bool = False):
        self.text, self.sizes, self.features, self.word, self.tokens = text, sizes, features, word or tokens, tokens

    def __call__(self, df: DataFrame) -> DataFrame:
        t = F.lower(F.col(self.text))
        unit = F.filter(F.split(t, r"\s+" if self.tokens else r"[^\p{L}\p{N}]+" if self.word else ""), lambda x: x != "")
        d = pin(pin(df, "_u", unit), "_g", F.concat(*[self._grams(n) for n in self.sizes]))
        if self.tokens:
            d = HashingTF(inputCol="_g", outputCol="_f", numFeatures=self.features, binary=True).transform(d)
            return Normalizer(inputCol="_f", outputCol="features").transform(d).drop("_u", "_g", "_f")
        return HashingTF(inputCol="_g", outputCol="features", numFeatures=self.features).transform(d).drop("_u", "_g")

    def _grams(self, n: int):
        pos = F.sequence(F.lit(1), F.greatest(F.size("_u") - (n - 1), F.lit(1)))
        sep = " " if self.word else ""
        return F.transform(pos, lambda i: F.array_join(F.slice("_u", i, n), sep))


def _bucket(gram: str | None, features: int) -> int:
    """Bucket that HashingTF gives a term: its 32-bit murmur3 (seed 42) modulo the number of features."""
    data, h, full = (gram or "").encode(), 42, 0xFFFFFFFF
    if gram is None:
        return h % features

    def mix(h: int, k: int) -> int:
        k = k * 0xCC9E2D51 & full
        k = ((k << 15 | k >> 17) & full) * 0x1B873593 & full
        h ^= k
        return ((h << 13 | h >> 19) & full) * 5 + 0xE6546B64 & full

    whole = len(data) // 4 * 4
    for at in range(0, whole, 4):
        h = mix(h, int.from_bytes(data[at:at + 4], "little"))
    tail = int.from_bytes(data[whole:], "little")
    if len(data) > whole:
        tail = tail * 0xCC9E2D51 & full
        h ^= ((tail << 15 | tail >> 17) & full) * 0x1B873593 & full
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & full
    h = (h ^ h >> 13) * 0xC2B2AE35 & full
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % features


class CharGrams:
    """Buckets of the 1-, 2- and 3-grams of characters of lower-cased texts; a text shorter than n has itself as its n-gram."""

    def __init__(self, features: int):
        self.features, self.known = features, {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket) of every n-gram of a slice of texts."""
        p = Points(texts)
        codes, rows, keys = p.codes.astype("int64") + 1, [], []
        row = np.repeat(np.arange(len(texts)), p.n + 1)
        left = p.at[1:][row] - 1 - np.arange(len(codes))  # characters from here to the end of the text
        grams = np.zeros(len(codes), dtype="int64")
        for n in (1, 2, 3):
            grams[:len(codes) - n + 1] |= codes[n - 1:] << 21 * (n - 1)
            whole = left >= n
            rows.append(row[whole])
            keys.append(grams[whole])
        keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        found = np.array([self.known.get(k, -1) for k in keys.tolist()], dtype="int64")
        for i in np.flatnonzero(found < 0).tolist():
            k = int(keys[i])
            found[i] = _bucket("".join(chr((k >> s & 0x1FFFFF) - 1) for s in (0, 21, 42) if k >> s), self.features)
            if len(self.known) < 1 << 18:
                self.known[k] = found[i]
        short = [(i, _bucket(t, self.features)) for i, t in zip(np.flatnonzero(p.n < 3).tolist(), texts.filter(pa.array(p.n < 3)).to_pylist()) for _ in range(3 - len(t or ""))]
        rows.append(np.array([i for i, _ in short], dtype="int64"))
        return np.concatenate(rows), np.concatenate([found[inverse], np.array([b for _, b in short], dtype="int64")])


class LanguageModel:
    """Fitted language identifier: multinomial naive Bayes with one row of log probabilities per class."""

    def __init__(self, text: str, labels: list[str], prior: np.ndarray, theta: np.ndarray):
        self.text, self.labels, self.prior, self.theta = text, labels, prior, theta

    def transform(self, df: DataFrame, name: str = "pred") -> DataFrame:
        labels, prior, theta = self.labels, self.prior, np.ascontiguousarray(self.theta.T)

        @F.arrow_udf(StructType([StructField("label", StringType()), StructField("confidence", DoubleType())]))
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            grams = CharGrams(len(theta))
            for column in batches:
                for (texts,) in slices(text_bytes(column), column):
                    row, bucket = grams(texts)
                    raw = prior + np.stack([np.bincount(row, weights=theta[bucket, k], minlength=len(texts)) for k in range(len(labels))], 1)
                    p = np.exp(raw - raw.max(1, keepdims=True))
                    best = raw.argmax(1)
                    yield pa.StructArray.from_arrays([pa.array([labels[k] for k in best.tolist()], pa.string()), pa.array(p.max(1) / p.sum(1))], ["label", "confidence"])

        out = pin(df, "_score", score(F.lower(F.col(self.text))))
        return out.select(*df.columns, F.col("_score.label").alias(name), F.col("_score.confidence").alias("confidence"))


def train_lid(df: DataFrame, text: str, label: str, features: int = 1 << 16) -> LanguageModel:
    """Language identifier on character 1-3-grams: naive Bayes (smoothing 1) needs one pass of counts per class.

    The buckets are those of Spark ML's HashingTF. Every task adds up the n-grams of its texts and returns a row per class and
    block of buckets; the sums, as large as the model, go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total, rows = CharGrams(features), {}, {}
        for batch in batches:
            for names, texts in slices(text_bytes(batch.column(1)), batch.column(0), batch.column(1)):
                at = {n: i for i, n in enumerate(dict.fromkeys(names.to_pylist()))}
                own = np.array([at[n] for n in names.to_pylist()], dtype="int64")
                row, bucket = grams(texts)
                counts = np.bincount(own[row] * features + bucket, minlength=len(at) * features).reshape(len(at), features)
                for n, i in at.items():
                    total[n] = total[n] + counts[i] if n in total else counts[i]
                    rows[n] = rows.get(n, 0) + int((own == i).sum())
        for n in total:
            used = np.flatnonzero(total[n])
            yield pa.RecordBatch.from_arrays([pa.array([n] * (len(used) + 1), pa.string()), pa.array(np.append(used, -1).astype("int32")), pa.array(np.append(total[n][used], rows[n]).astype("int64"))], ["label", "bucket", "n"])

    known = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.lower(F.col(text)).alias("text"))
    sums = known.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    name, bucket, n = (sums.column(c).to_numpy(zero_copy_only=False) if c != "label" else np.array(sums.column(c).to_pylist(), dtype=object) for c in ("label", "bucket", "n"))
    docs = {a: float(c) for a, b, c in zip(name, bucket, n) if b < 0}
    labels = sorted(docs, key=lambda x: (-docs[x], x))
    count = np.zeros((len(labels), features))
    for i, l in enumerate(labels):
        own = (name == l) & (bucket >= 0)
        count[i, bucket[own]] = n[own]
    prior = np.log(np.array([docs[l] for l in labels]) + 1) - np.log(sum(docs.values()) + len(labels))
    return LanguageModel(text, labels, prior, np.log(count + 1) - np.log(count.sum(1, keepdims=True) + features))


class ScoreModel:
    """Fitted scorer: adds a probability (classifier) or a value (regressor)."""

    def __init__(self, features: _Features, model, regression: bool = False):
        self.features, self.model, self.regression = features, model, regression

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        out = self.model.transform(self.features(df))
        value = F.col("prediction") if self.regression else vector_to_array("probability")[1]
        return out.select(*df.columns, value.alias(name))


def train_binary(df: DataFrame, text: str, label: str, soft: str | None = None, alpha: float = 0.5, features: int = 1 << 16, iterations: int = 30) -> ScoreModel:
    """Binary classifier; with soft targets every row stands in twice, as 1 and as 0, weighted by the mixed target, which
    is the mixed cross-entropy exactly."""
    f = _Features(text, (1,), features, tokens=True)
    x = f(df)
    y = F.col(label).cast("double")
    target = y if soft is None else F.when(F.col(soft).isNotNull(), (1 - alpha) * y + alpha * F.col(soft)).otherwise(y)
    pair = F.explode(F.array(F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - target).alias("w"))))
    rows = x.select("features", pair.alias("r")).select("features", F.col("r.y").alias("y"), F.col("r.w").alias("w")).where("w > 0")
    return ScoreModel(f, LogisticRegression(labelCol="y", weightCol="w", maxIter=iterations, regParam=0.001, standardization=False).fit(rows))


def train_multilabel(df: DataFrame, text: str, labels: list[str], features: int = 1 << 16, iterations: int = 20) -> dict[str, ScoreModel]:
    """One weighted model per label; labels may be soft (0..1)."""
    return {l: train_binary(df.withColumn("_hard", (F.col(l) > 0.5).cast("int")).withColumn("_soft", F.col(l).cast("double")), text, "_hard", "_soft", 1.0, features, iterations) for l in labels}


def train_regressor(df: DataFrame, text: str, target: str, features: int = 1 << 12, reg: float = 0.1) -> ScoreModel:
    f = _Features(text, (1,), features, word=True)
    x = f(df).select("features", F.col(target).cast("double").alias("y"))
    return ScoreModel(f, LinearRegression(labelCol="y", regParam=reg, maxIter=30, solver="l-bfgs").fit(x), regression=True)


def score_and_filter(df: DataFrame, model: ScoreModel, thr: float, keep_above: bool = True) -> DataFrame:
    s = model.transform(df)
    return s.where(F.col("score") >= thr if keep_above else F.col("score") < thr)


def score_batches(df: DataFrame, text: str, make_scorer: Callable[[], Callable[[list[str]], list[float]]], name: str = "score") -> DataFrame:
    """External scorer seam: built once per task, called per Arrow batch; rows are sorted by length inside a partition so
    that batches hold texts of similar size."""
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        scorer = make_scorer()
        for b in batches:
            yield b.assign(**{name: pd.Series(scorer(b[text].tolist()), index=b.index, dtype="float64")})

    return df.withColumn("_n", F.length(text)).sortWithinPartitions("_n").drop("_n").mapInPandas(run, schema)
