"""Toxicity by nearest labelled examples.

Examples are labelled documents as TF-IDF vectors over a selected vocabulary; a text is scored by its `k` nearest examples by
exact cosine, found in a block-max inverted index. Votes are weighted by distance and by how strongly a class was sampled, and
their share is calibrated by a logistic curve fitted on the examples themselves, each left out of its own search. The neighbours
and the terms in common are returned as evidence.

Terms are words and word beginnings of 4 to 6 letters (inflected forms share them). The vocabulary holds the terms whose presence
depends on the label (G statistic), so that long texts are not compared by their rare words; all words of a text together count
as one more term, so that a passing mention in a long text is far from a short text of nothing else.

Bounds: EXAMPLES labelled rows (half per class, first by hash), and of their terms those that depend on the label; the index that
tasks receive has a row of BLOCK weights per term and block of examples that has it. Document frequencies are counted over all documents, in partial counts per task, and every text is read whole.

Block-max search: the postings of a term are cut by blocks of BLOCK examples, each block a row of weights with its largest one
beside it. A query adds up the largest weights per block, visits blocks from the highest bound down, a few at a time, and stops
where the bound falls below the k-th similarity: the result is that of comparing all examples (ties by example number).

Cases: null and empty texts, and texts without a term of the vocabulary, get the rate of examples without neighbours; without
labelled rows of both classes every score is the known rate (0 if there is none); labels with a null are ignored; repeated rows
get equal scores; all columns are kept by `with_scores`."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import fresh, saved

EXAMPLES = 8000
BLOCK = 128
BEGINNINGS = (4, 5, 6)
SCORE = "struct<score: double, neighbours: array<struct<id: string, similarity: double, label: int>>, terms: array<string>>"


def terms_of(word: bytes) -> list[str]:
    text = word.decode()
    return [text, *[text[:n] + "*" for n in BEGINNINGS if len(text) >= n]]


class Terms:
    """Maps texts to the terms of a vocabulary; the number after the last is that of all words together."""

    def __init__(self, vocabulary: list[str]):
        self.number = {t: i for i, t in enumerate(vocabulary)}
        self.heads = {t.rstrip("*")[:BEGINNINGS[0]] for t in vocabulary}  # a word with another head has no term

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of the terms of every text that has one, ordered by text and term."""
        codes, starts, values = words.split(words.translated(texts, words.ALNUM_LOWER))
        known: dict[int, list[int]] = {}
        for i, v in enumerate(v.decode()[:BEGINNINGS[0]] for v in values):
            if v in self.heads and (found := [self.number[t] for t in terms_of(values[i]) if t in self.number]):
                known[i] = found
        lens = np.zeros(len(values), "int64")
        lens[list(known)] = [len(ts) for ts in known.values()]
        flat = np.array([t for ts in known.values() for t in ts], "int64")
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        hit = np.flatnonzero(lens[codes]) if len(codes) else np.zeros(0, "int64")
        term = words.gather(codes[hit], lens, flat)
        size, of = len(self.number) + 1, np.repeat(doc[hit], lens[codes[hit]])
        some = np.unique(of)
        keys, n = np.unique(of * size + term, return_counts=True)
        keys, n = np.concatenate([keys, some * size + size - 1]), np.concatenate([n, np.diff(starts)[some]])
        order = np.argsort(keys, kind="stable")
        return keys[order] // size, keys[order] % size, n[order]


def example_terms(examples: DataFrame) -> DataFrame:
    """(term, label) once per example that has the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), words.translated(batch.column(1), words.ALNUM_LOWER)):
                got = sorted({t for w in set(text.as_py().split()) for t in terms_of(w)})
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(got), pa.array([label] * len(got), pa.int32())], ["term", "label"])

    return examples.select("label", "text").mapInArrow(run, "term string, label int")


def select_terms(examples: DataFrame, n: dict[int, int], least: float = 20.0) -> list[str]:
    """The terms whose G statistic of (has the term, label) reaches `least`, or half of the best term's where that is less, so that
    few examples have terms as well as many; n: examples per label."""
    seen = example_terms(examples).groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    pos, neg = float(n[1]), float(n[0])
    total = pos + neg

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(F.lit(0.0))

    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    has, hasnt = a + b, F.lit(total) - a - b
    g = 2 * (part(a, has * pos / total) + part(b, has * neg / total) + part(pos - a, hasnt * pos / total) + part(neg - b, hasnt * neg / total))
    rows = saved(seen.select("term", g.alias("g")), "toxicity-terms")
    cut = min(least, max(0.5 * (rows.agg(F.max("g")).first()[0] or 0.0), 1e-6))
    return sorted(r["term"] for r in rows.where(F.col("g") >= cut).collect())


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """(documents with each term, documents), over all documents: one partial count per task and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df, n = Terms(vocabulary), np.zeros(len(vocabulary) + 1, "int64"), 0
        for batch in batches:
            for piece in words.pieces(batch, 0):
                df[:-1] += np.bincount(terms.counts(piece.column(0))[1], minlength=len(vocabulary) + 1)[:-1]
                n += piece.num_rows
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "n"])

    out = np.zeros(len(vocabulary) + 1, "int64")
    for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


class BlockMaxIndex:
    """Unit vectors of examples by term, in blocks with the largest weight of each term."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int):
        self.n_blocks = -(-n // BLOCK)
        key = term * self.n_blocks + example // BLOCK
        runs, at = np.unique(key, return_inverse=True)
        # row 0 is that of a term without examples in a block
        self.rows = np.zeros((len(runs) + 1, BLOCK))
        self.rows[at + 1, example % BLOCK] = weight
        self.largest = self.rows.max(1)
        self.run_of = np.zeros((n_terms, self.n_blocks), "int32")
        self.run_of.ravel()[runs] = np.arange(1, len(runs) + 1)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, examples) of the k examples of the highest cosine above 0, in order."""
        runs = self.run_of[terms]
        bound = weights @ self.largest[runs]
        order = np.argsort(-bound, kind="stable")
        sims, found, done, take = np.zeros(0), np.zeros(0, "int64"), 0, 8
        floor = 1e-12
        while done < len(order) and bound[order[done]] >= floor:
            blocks = order[done:done + take]
            blocks = blocks[bound[blocks] >= floor]
            own = runs[:, blocks].T
            at, of = np.nonzero(own)  # by block; each has a run, as its bound is above 0
            part = np.add.reduceat(self.rows[own[at, of]] * weights[of][:, None], np.searchsorted(at, np.arange(len(blocks)))).ravel()
            at = np.flatnonzero(part >= floor)
            sims, found = np.concatenate([sims, part[at]]), np.concatenate([found, blocks[at // BLOCK] * BLOCK + at % BLOCK])
            if without >= 0:
                sims, found = sims[found != without], found[found != without]
            if len(sims) > k:
                floor = np.partition(sims, len(sims) - k)[len(sims) - k] - 1e-9
                sims, found = sims[sims >= floor], found[sims >= floor]
            done, take = done + take, take * 4
        first = np.lexsort((found, -np.round(sims, 9)))[:k]
        return sims[first], found[first]


class Model:
    """Everything a task needs to score texts."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, k: int):
        self.vocabulary, self.idf, self.k = vocabulary, idf, k
        self.names: list[str] = []
        self.labels = np.zeros(0, "int64")
        self.votes = np.ones(2)
        self.prior, self.curve, self.index = 0.0, (0.0, 1.0), None

    def weigh(self, doc: np.ndarray, term: np.ndarray, n: np.ndarray, n_docs: int) -> np.ndarray:
        w = (1 + np.log(n)) * self.idf[term]
        norm = np.sqrt(np.bincount(doc, w * w, n_docs))
        return w / norm[doc]

    def fit(self, names: list[str], labels: list[int], doc: np.ndarray, term: np.ndarray, n: np.ndarray, of_class: dict[int, int]) -> None:
        """The index over the examples, then the calibration on each example without itself."""
        self.names, self.labels = names, np.array(labels)
        sampled = np.bincount(self.labels, minlength=2)
        self.votes = np.array([of_class[c] / sampled[c] for c in (0, 1)])
        self.prior = of_class[1] / (of_class[0] + of_class[1])
        w = self.weigh(doc, term, n, len(names))
        self.index = BlockMaxIndex(doc, term, w, len(names), len(self.vocabulary) + 1)
        starts = np.searchsorted(doc, np.arange(len(names) + 1))
        none = (np.zeros(0), np.zeros(0, "int64"))
        x = np.array([self.logit(*(self.index.nearest(term[a:b], w[a:b], self.k, i) if b > a else none)) for i, (a, b) in enumerate(zip(starts, starts[1:]))])
        weight, y = self.votes[self.labels], self.labels.astype("float64")
        a, b = 0.0, 1.0
        for _ in range(50):  # Newton steps of a ridge-regularised logistic curve
            p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
            r, h = weight * (y - p), weight * p * (1 - p)
            grad = np.array([r.sum() - 1e-3 * a, (r * x).sum() - 1e-1 * (b - 1)])
            hess = np.array([[h.sum() + 1e-3, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 1e-1]])
            da, db = np.linalg.solve(hess, grad)
            size = max(1.0, abs(da) / 2, abs(db) / 2)
            a, b = a + da / size, b + db / size
        self.curve = (float(a), float(max(b, 0.05)))

    def logit(self, sims: np.ndarray, found: np.ndarray) -> float:
        """Log-odds of the distance-weighted share of votes, drawn to the prior by half a vote."""
        label = self.labels[found]
        vote = (self.votes / self.votes.max())[label] / (1.1 - np.minimum(sims, 1.0))
        yes = float(vote @ label)
        yes, no = 0.5 * self.prior + yes, 0.5 * (1 - self.prior) + float(vote.sum()) - yes
        return math.log(max(yes, 1e-9) / max(no, 1e-9))

    def score(self, texts: pa.Array) -> pa.Array:
        """One SCORE struct per text."""
        size, none = len(texts), (np.zeros(0), np.zeros(0, "int64"))
        doc, term, n = Terms(self.vocabulary).counts(texts) if self.index else (np.zeros(0, "int64"),) * 3
        starts = np.searchsorted(doc, np.arange(size + 1))
        w = self.weigh(doc, term, n, size) if self.index else n
        near = [self.index.nearest(term[a:b], w[a:b], self.k) if b > a else none for a, b in zip(starts.tolist(), starts[1:].tolist())]
        if self.index:
            x = self.curve[0] + self.curve[1] * np.array([self.logit(*p) for p in near] or [0.0])[:size]
            score = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        else:
            score = np.full(size, self.prior)
        sims, found = (np.concatenate([p[j] for p in near] or [none[j]]) for j in (0, 1))
        ids = pa.array(self.names, pa.string()).take(pa.array(found))
        neighbours = pa.StructArray.from_arrays([ids, pa.array(sims), pa.array(self.labels[found], pa.int32())], ["id", "similarity", "label"])
        cuts = lambda lens: pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32())
        own = term < len(self.vocabulary)
        terms = pa.array(self.vocabulary, pa.string()).take(pa.array(term[own]))
        return pa.StructArray.from_arrays(
            [pa.array(score), pa.ListArray.from_arrays(cuts([len(p[0]) for p in near]), neighbours), pa.ListArray.from_arrays(cuts(np.bincount(doc[own], minlength=size)), terms)],
            ["score", "neighbours", "terms"])


def fit(docs: DataFrame, labels: DataFrame, label: str, train: Column, k: int = 15, examples: int = EXAMPLES) -> Model:
    """labels(doc_id, <label>): only rows where `train` holds (an expression on doc_id) are read."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(train & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    of_class = {0: 0, 1: 0, **{r["label"]: r["count"] for r in known.groupBy("label").count().collect()}}
    model = Model([], np.zeros(0), k)
    model.prior = of_class[1] / max(1, sum(of_class.values()))
    if not min(of_class.values()):
        return model
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples // 2) for c in (0, 1)]
    sample = saved(docs.select("doc_id", "text").join(parts[0].unionAll(parts[1]), "doc_id"), "toxicity-examples")
    n = {0: 0, 1: 0, **{r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}}
    if not min(n.values()):
        return model
    vocabulary = select_terms(sample, n)
    if not vocabulary:
        return model
    df, n_docs = document_frequency(docs, vocabulary)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(vocabulary)
        for batch in batches:
            for piece in words.pieces(batch, 2):
                doc, term, count = known.counts(piece.column(2))
                at = np.searchsorted(doc, np.arange(piece.num_rows + 1))
                cut = lambda x: pa.array([x[a:b].tolist() for a, b in zip(at, at[1:])], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), cut(term), cut(count)], ["doc_id", "label", "terms", "counts"])

    rows = sample.select(F.col("doc_id").cast("string"), "label", "text").mapInArrow(vectors, "doc_id string, label int, terms array<bigint>, counts array<bigint>").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["label"], r["terms"]))  # at most `examples` rows of a few terms each
    doc = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
    idf = np.append(np.log((1 + n_docs) / (1 + df)) + 0.1, 1.0)
    model = Model(vocabulary, idf, k)
    model.fit([r["doc_id"] for r in rows], [r["label"] for r in rows], doc, np.array([t for r in rows for t in r["terms"]], "int64"),
              np.array([c for r in rows for c in r["counts"]], "int64"), of_class)
    return model


def with_scores(docs: DataFrame, model: Model, out: str, text: str = "text") -> DataFrame:
    """The documents with one more column of type SCORE."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by `examples` and their terms

    @F.arrow_udf(SCORE)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            got = [model.score(p.column(0)) for p in words.pieces(pa.RecordBatch.from_arrays([texts], ["t"]), 0)]
            yield pa.concat_arrays(got) if got else model.score(texts)

    return docs.withColumn(out, score(F.col(f"`{text}`")))


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    """True where the checksum of the id, as text, has this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(False))


def digest(docs: DataFrame, model: Model, parts: int = 5, which: int = 0, cut: float = 0.5) -> DataFrame:
    rows = with_scores(docs.select("doc_id", "text"), model, "s")
    return rows.select("doc_id", held_out(F.col("doc_id"), parts, which).alias("held_out"), F.col("s.score").alias("score"),
                       (F.col("s.score") >= cut).cast("int").alias("predicted"), F.col("s.neighbours").alias("neighbours"), F.col("s.terms").alias("terms"))


def clean(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """The rows that aren't toxic, with the columns of the input."""
    name = fresh(docs, "s")
    rows = with_scores(docs, model, name)
    return rows.where(F.col(name).getField("score") < cut).select(*[F.col(f"`{c}`") for c in docs.columns])
