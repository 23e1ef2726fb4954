"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all pairwise interactions of low rank, in time
linear in the features by the sum-of-squares identity. Features of a whole text:
- its distinct words, hashed into WORDS buckets, together of length 1;
- structure: shares of upper case, digits, symbols, exclamation marks, bars and line feeds, word length, distinct words, longest run
  and most frequent word, repeated lines and repeated word triples - each as one of BINS intervals (quantiles of the examples);
- metadata: numbers of bytes, words and lines, in the same way.
Labels, language, source and id are no features. Weights are fitted by Adam on logistic loss over at most EXAMPLES labelled rows
(first by hash of the id), in a fixed order from a fixed seed.

Cases: a null or empty text has its structure features only; without labelled rows of both classes every score is the known rate
(1 if there is none: nothing to reject by); labels with a null are ignored; repeated rows get equal scores; other columns are
not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import saved
from .toxicity import held_out

EXAMPLES = 10_000
WORDS = 1 << 13
BINS = 16
RANK = 8
STATS = ["bytes", "words", "lines", "upper", "digit", "symbol", "exclamation", "bar", "feed", "other", "word_bytes", "distinct", "longest_run", "top_word", "repeated_lines", "repeated_triples"]

_CLASS = np.full(256, 0, "u1")
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>@^~=+_\\{}[]", "!", "|", "\n", "?.,;:\"'()-/"), 1):
    _CLASS[[ord(c) for c in _chars]] = _i


def _spread(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the values between consecutive starts."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[starts])


def _most(doc: np.ndarray, n: np.ndarray, docs: int) -> np.ndarray:
    out = np.zeros(docs, "int64")
    np.maximum.at(out, doc, n)
    return out


def _repeated(doc: np.ndarray, what: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct values, and the count of the most frequent one."""
    order = np.lexsort((what, doc))
    d, w = doc[order], what[order]
    at = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])])) if len(d) else np.zeros(0, "int64")
    n = np.diff(np.append(at, len(d)))
    return np.bincount(d[at], minlength=docs), _most(d[at], n, docs)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics of every text, text, word bucket): a row per text, and a pair per distinct word of a text."""
    texts = words.translated(texts, bytes(range(256)))
    size = len(texts)
    ends = np.frombuffer(texts.buffers()[1], "int64") if size else np.zeros(1, "int64")
    kinds = _CLASS[np.frombuffer(texts.buffers()[2], "u1")] if ends[-1] else np.zeros(0, "u1")
    counts = [_spread(kinds == c, ends) for c in range(1, 8)]
    codes, starts, values = words.split(words.translated(texts, words.SPACED_LOWER))
    doc, n = np.repeat(np.arange(size), np.diff(starts)), np.diff(starts)
    length = np.fromiter(map(len, values), "int64", len(values))
    distinct, top = _repeated(doc, codes, size)
    same = np.concatenate([[False], (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])]) if len(codes) else np.zeros(0, bool)
    run = np.arange(len(codes)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(codes)))) + 1 if len(codes) else np.zeros(0, "int64")
    lists = pc.split_pattern(texts, "\n")
    flat = pc.dictionary_encode(lists.flatten())
    line, first = flat.indices.to_numpy(), lists.offsets.to_numpy().astype("int64")
    empty = flat.dictionary.index(b"").as_py()
    line_doc = np.repeat(np.arange(size), np.diff(first))
    line, line_doc = line[line != empty], line_doc[line != empty]
    n_lines = np.bincount(line_doc, minlength=size)
    lines, _ = _repeated(line_doc, line, size)
    h = codes.astype("uint64") + np.uint64(1)
    triple = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] if len(h) > 2 else h[:0]
    inside = doc[:-2] == doc[2:] if len(h) > 2 else np.zeros(0, bool)
    triple_doc, triple = (doc[:-2][inside], triple[inside]) if len(h) > 2 else (doc[:0], triple)
    triples, _ = _repeated(triple_doc, triple, size)
    n_triples = np.bincount(triple_doc, minlength=size)
    size_bytes = np.diff(ends)
    share = lambda a, b: a / np.maximum(b, 1)
    stats = np.stack([np.log1p(size_bytes), np.log1p(n), np.log1p(n_lines), *[share(c, size_bytes) for c in counts], share(_spread(length[codes], starts), n),
                      share(distinct, n), share(_most(doc, run, size), n), share(top, n), share(n_lines - lines, n_lines), share(n_triples - triples, n_triples)], 1)
    bucket = np.fromiter((xxhash.xxh32_intdigest(v) % WORDS for v in values), "int64", len(values))
    pairs = np.unique(doc * WORDS + bucket[codes]) if len(codes) else np.zeros(0, "int64")
    return stats, pairs // WORDS, pairs % WORDS


class Model:
    """A fitted machine; feature numbers are word buckets, then BINS per statistic."""

    def __init__(self, prior: float):
        self.prior, self.edges = prior, None

    def inputs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of every text, feature, value)."""
        stats, doc, bucket = features(texts)
        return self.rows(stats, doc, bucket)

    def rows(self, stats: np.ndarray, doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = len(stats)
        bins = np.stack([np.searchsorted(e, s, "right") for e, s in zip(self.edges, stats.T)], 1) + WORDS + BINS * np.arange(len(self.edges))
        n = np.bincount(doc, minlength=size)
        of = np.concatenate([doc, np.repeat(np.arange(size), bins.shape[1])])
        order = np.argsort(of, kind="stable")
        feature = np.concatenate([bucket, bins.ravel()])[order]
        value = np.concatenate([1 / np.sqrt(np.maximum(n, 1))[doc], np.full(bins.size, 1 / np.sqrt(bins.shape[1]))])[order].astype("float32")
        return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=size))]), feature, value

    def raw(self, starts: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds, sum of v x per rank) of every row; no row is empty."""
        vx = self.v[feature] * value[:, None]
        sums = np.add.reduceat(vx, starts[:-1])
        squares = np.add.reduceat((vx * vx).sum(1), starts[:-1])
        return self.w0 + np.add.reduceat(self.w[feature] * value, starts[:-1]) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.edges is None or not len(texts):
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.inputs(texts))[0].astype("float64"), -30, 30)))

    def fit(self, stats: np.ndarray, buckets: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 200, rate: float = 0.02, ridge: float = 2e-5) -> None:
        self.edges = [np.unique(np.quantile(s, np.linspace(0, 1, BINS + 1)[1:-1])) for s in stats.T]
        rng = np.random.default_rng(3)
        n_features = WORDS + BINS * stats.shape[1]
        self.w0 = np.float32(np.log(max(self.prior, 1e-3) / max(1 - self.prior, 1e-3)))
        self.w, self.v = np.zeros(n_features, "float32"), rng.normal(0, 0.05, (n_features, RANK)).astype("float32")
        params = [np.concatenate([self.w[:, None], self.v], 1)]
        m, s, step = np.zeros_like(params[0]), np.zeros_like(params[0]), 0
        p = params[0]
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), batch):
                own = order[at:at + batch]
                doc = np.repeat(np.arange(len(own)), [len(buckets[i]) for i in own])
                starts, feature, value = self.rows(stats[own], doc, np.concatenate([buckets[i] for i in own]))
                self.w, self.v = p[:, 0], p[:, 1:]
                z, sums = self.raw(starts, feature, value)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
                row = np.repeat(np.arange(len(own)), np.diff(starts))
                grad = np.zeros_like(p)
                np.add.at(grad, feature, np.concatenate([(error[row] * value)[:, None],
                                                         (error[row] * value)[:, None] * (sums[row] - self.v[feature] * value[:, None])], 1))
                grad += ridge * p
                step += 1
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
                self.w0 -= np.float32(0.1 * error.sum())
        self.w, self.v = p[:, 0].copy(), p[:, 1:].copy()


def fit(docs: DataFrame, labels: DataFrame, label: str, train: Column, examples: int = EXAMPLES) -> Model:
    """labels(doc_id, <label>): only rows where `train` holds (an expression on doc_id) are read."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(train & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    sample = saved(docs.select("doc_id", "text").join(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples), "doc_id"), "quality-examples")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch, 2):
                stats, doc, bucket = features(piece.column(2))
                at = np.searchsorted(doc, np.arange(piece.num_rows + 1))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(stats.tolist(), pa.list_(pa.float64())),
                                                  pa.array([bucket[a:b].astype("<u2").tobytes() for a, b in zip(at, at[1:])])], ["doc_id", "label", "stats", "buckets"])

    vectors_ = sample.select(F.col("doc_id").cast("string"), "label", "text").mapInArrow(vectors, "doc_id string, label int, stats array<double>, buckets binary")
    rows = sorted(vectors_.collect(), key=lambda r: (r["doc_id"], r["label"], r["stats"]))  # at most `examples` rows
    y = np.array([r["label"] for r in rows], "float32")
    model = Model(float(y.mean()) if len(y) else 1.0)
    if 0 < model.prior < 1:
        model.fit(np.array([r["stats"] for r in rows]), [np.frombuffer(r["buckets"], "<u2").astype("int64") for r in rows], y)
    return model


def digest(docs: DataFrame, model: Model, parts: int = 4, which: int = 2, cut: float = 0.7) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: one row of weights per feature

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = [shared.value.score(p.column(0)) for p in words.pieces(pa.RecordBatch.from_arrays([texts], ["t"]), 0)]
            yield pa.array(np.concatenate([*got, np.zeros(0)]), pa.float64())

    rows = docs.select("doc_id", "text").withColumn("score", score(F.col("text")))
    return rows.select("doc_id", held_out(F.col("doc_id"), parts, which).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
