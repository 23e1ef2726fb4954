"""Hard negatives by segment summaries: the rows most similar to an anchor, but not too similar, that have another label.

Scores are inner products of vectors whose components are scaled and floored to integers, so they are exact. Every vector keeps
summaries beside it: cut into 1, 4 and 16 segments, the mean and the deviation of each segment. For two vectors, a segment of L
components adds L * (mean * mean' +- deviation * deviation') to their product at most or at least (Cauchy-Schwarz), so summaries bound
the score from both sides. A pair goes on to finer segments only while its bounds still allow a place among the best, and pairs
that no summary rules out are scored exactly. Nothing is approximate: results are those of scoring all pairs.

An anchor's positives are its first `positives` other rows of the same label. For each of them the first `negatives` rows of another
label are taken whose score lies between two shares of the positive's score. Higher scores come first, then smaller ids.

Rows are packed into blocks of BLOCK vectors where they are read. Anchors are dealt into sets of about SET, and every set meets all
blocks: tasks get a set, then blocks one after the other, and keep the best rows of each anchor. A task's memory is a set and a block;
labels play no part in the dealing, so a label with a third of all rows is no group. A set leaves at most `k` rows per anchor and
task, which are merged by rank.

Cases: rows with a null id, a null label, a null vector or a null or non-finite component take no part; an empty vector scores 0;
vectors of different lengths never meet; equal rows count each, and no row meets a row of its own id; an anchor without positives or
a positive without rows between its limits returns nothing; scores beyond 64 bits raise an error; an empty table gives no rows;
other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

BLOCK = 2048
SET = 4096
CHUNK = 128
SEGMENTS = (1, 4, 16)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
BLOCK_ROW = "block long, dim int, n int, anchors int, ids binary, labels binary, kind string, vectors binary, sums binary"


def levels_of(dim: int) -> list[int]:
    """Numbers of segments that are worth their summaries: four components or more each."""
    return [s for s in SEGMENTS if s == 1 or 4 * s <= dim]


def summaries(x: np.ndarray) -> np.ndarray:
    """Per vector and level: means, then deviations of the segments, both times the root of the segment's length."""
    n, dim = x.shape
    if not dim:
        return np.zeros((n, 2))
    out = []
    for s in levels_of(dim):
        edges = np.linspace(0, dim, s + 1).astype("int64")
        length = np.diff(edges)
        mean = np.add.reduceat(x, edges[:-1], axis=1) / length
        rest = x - np.repeat(mean, length, axis=1)
        out += [mean * np.sqrt(length), np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1))]
    return np.concatenate(out, axis=1)


def _kind(x: np.ndarray) -> str:
    most = np.abs(x).max(initial=0)
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"


def blocks_of(rows: DataFrame, scale: float, anchor_every: int) -> DataFrame:
    """rows(id, label, vector) packed into BLOCK_ROW rows of at most BLOCK vectors of one length each."""

    def packed(dim: int, number: int, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> dict:
        kind = _kind(x)
        return {"block": TaskContext.get().partitionId() << 32 | number, "dim": dim, "n": len(ids), "anchors": int((ids % anchor_every == 0).sum()), "ids": ids.tobytes(),
                "labels": labels.tobytes(), "kind": kind, "vectors": x.astype(kind).tobytes(), "sums": summaries(x).tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        number = 0
        schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("anchors", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()),
                            ("kind", pa.string()), ("vectors", pa.binary()), ("sums", pa.binary())])
        for last, batch in _with_last(batches):
            if batch is not None:
                ids, labels, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
                starts = lists.offsets.to_numpy().astype("int64")
                flat = np.floor(scale * lists.flatten().to_numpy().astype("float64"))
                starts, dims = starts - starts[0], np.diff(starts)
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    held.setdefault(dim, []).append((ids[at], labels[at], flat[starts[at][:, None] + np.arange(dim)]))
            for dim, parts in held.items():
                full = [np.concatenate(p) for p in zip(*parts)]
                size = len(full[0])
                cut = size if last else size - size % BLOCK
                for a in range(0, cut, BLOCK):
                    yield pa.RecordBatch.from_pylist([packed(dim, number, *(p[a:min(a + BLOCK, cut)] for p in full))], schema)
                    number += 1
                held[dim] = [tuple(p[cut:] for p in full)]

    return rows.select("id", "label", "vector").mapInArrow(run, BLOCK_ROW)


def _with_last(batches: Iterator) -> Iterator[tuple[bool, object]]:
    """(False, batch) for each, then (True, None)."""
    for batch in batches:
        yield False, batch
    yield True, None


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors as doubles, summaries) of a packed row."""
    ids = np.frombuffer(row["ids"], "int64")
    x = np.frombuffer(row["vectors"], row["kind"]).reshape(len(ids), row["dim"]).astype("float64")
    return ids, np.frombuffer(row["labels"], "int64"), x, np.frombuffer(row["sums"], "float64").reshape(len(ids), -1)


def anchors_of(blocks: DataFrame, anchor_every: int, sets: int) -> DataFrame:
    """One packed row per anchor with its set; key names the anchor's row, so equal rows have keys of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, x, sums = _unpack(row)
                at = np.flatnonzero(ids % anchor_every == 0)
                n = len(at)
                if n:
                    key = row["block"] * BLOCK + at
                    raw = lambda a: [a[i].tobytes() for i in range(n)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(((key.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype("int64") % sets), pa.array(np.full(n, row["dim"], "int32")),
                         pa.array(ids[at]), pa.array(raw(ids[at])), pa.array(raw(labels[at])), pa.array([row["kind"]] * n), pa.array(raw(x[at].astype(row["kind"]))), pa.array(raw(sums[at]))],
                        ["key", "part", "dim", "id", "ids", "labels", "kind", "vectors", "sums"])

    return blocks.where("anchors > 0").mapInArrow(run, "key long, part long, dim int, id long, ids binary, labels binary, kind string, vectors binary, sums binary")


class Anchors:
    """Anchors of one vector length with the best rows seen so far between each pair of limits."""

    def __init__(self, rows: list[dict], k: int, same_label: bool):
        self.keys = np.array([r["key"] for r in rows])
        self.ids, self.labels, self.x, self.sums = (np.concatenate(p) for p in zip(*(_unpack(r) for r in rows)))
        self.low, self.high = (np.array([r[c] for r in rows], "int64") for c in ("lows", "highs"))
        self.k, self.same = k, same_label
        shape = (len(rows), self.low.shape[1], k)
        self.score, self.found = np.full(shape, LEAST), np.full(shape, LEAST)
        self.seen = np.zeros(shape, bool)
        self.norm = np.sqrt((self.sums[:, :2] ** 2).sum(1))
        self.most = np.abs(self.x).max(initial=0)

    def meet(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, sums: np.ndarray) -> None:
        """Take one block of rows into account."""
        norm = np.sqrt((sums[:, :2] ** 2).sum(1))
        exact = self.x.shape[1] * self.most * np.abs(x).max(initial=0) < 2 ** 53  # doubles hold all partial sums
        for at in range(0, len(self.keys), CHUNK):
            own = slice(at, at + CHUNK)
            i, j = np.nonzero(((self.labels[own, None] == labels) == self.same) & (self.ids[own, None] != ids))
            i += at
            first = 0
            for segments in levels_of(x.shape[1]):
                if not len(i):
                    break
                m, d = slice(first, first + segments), slice(first + segments, first + 2 * segments)
                first += 2 * segments
                if 4 * len(i) > CHUNK * len(ids):  # most pairs are left: a product of matrices is cheaper
                    pick = (i - at, j)
                    middle, reach = (self.sums[own, m] @ sums[:, m].T)[pick], (self.sums[own, d] @ sums[:, d].T)[pick]
                else:
                    middle, reach = np.einsum("ij,ij->i", self.sums[i, m], sums[j, m]), np.einsum("ij,ij->i", self.sums[i, d], sums[j, d])
                reach += 0.5 + 1e-9 * self.norm[i] * norm[j]  # scores are integers; doubles round
                keep = self.wanted(i, middle - reach, middle + reach)
                i, j = i[keep], j[keep]
            if len(i):
                score = self.scores(i, j, x, exact)
                keep = self.wanted(i, score, score)
                self.take(i[keep], score[keep], ids[j[keep]])

    def wanted(self, i: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Pairs that may still come among the best between some limits, given bounds of their scores."""
        floor = np.maximum(self.low, self.score[:, :, -1])
        out = np.zeros(len(i), bool)
        for c in range(self.low.shape[1]):
            out |= (most >= floor[i, c]) & (least <= self.high[i, c])
        return out

    def scores(self, i: np.ndarray, j: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
        out = np.empty(len(i), "int64")
        for a in range(0, len(i), 1 << 14):
            u, v = self.x[i[a:a + (1 << 14)]], x[j[a:a + (1 << 14)]]
            if exact:
                out[a:a + len(u)] = np.einsum("ij,ij->i", u, v)
            else:
                out[a:a + len(u)] = [sum(int(p) * int(q) for p, q in zip(*pair)) for pair in zip(u.tolist(), v.tolist())]
        return out

    def take(self, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(i)
        for c in range(self.low.shape[1]):
            at = np.flatnonzero((score >= self.low[i, c]) & (score <= self.high[i, c]))
            old, place = np.nonzero(self.seen[rows, c])
            of = np.concatenate([rows[old], i[at]])
            s, f = np.concatenate([self.score[rows[old], c, place], score[at]]), np.concatenate([self.found[rows[old], c, place], ids[at]])
            order = np.lexsort((f, -s, of))
            of, s, f = of[order], s[order], f[order]
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            best = rank < self.k
            for into, values in ((self.score, s), (self.found, f), (self.seen, np.ones(len(s), bool))):
                into[of[best], c, rank[best]] = values[best]

    def best(self) -> pa.RecordBatch:
        """(key, limit, score, id) of the best rows."""
        i, c, place = np.nonzero(self.seen)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (self.keys[i], c, self.score[i, c, place], self.found[i, c, place])], ["key", "limit", "score", "found"])


def best_rows(anchors: DataFrame, blocks: DataFrame, sets: int, k: int, same_label: bool) -> DataFrame:
    """(key, limit, score, found, rank): the first k rows of every anchor between each of its limits lows[i] and highs[i]."""
    spark = blocks.sparkSession
    tasks, n_blocks = int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count()
    salts = max(1, min(n_blocks, -(-3 * tasks // sets)))  # enough tasks; a set stays with its blocks of one salt
    common = ["dim", "ids", "labels", "kind", "vectors", "sums"]
    none = F.lit(None).cast("array<bigint>")
    left = anchors.select("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("side"), "key", "lows", "highs", *common)
    right = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sets - 1).cast("long"))).alias("part"), F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"),
                          F.lit(1).alias("side"), F.col("block").alias("key"), none.alias("lows"), none.alias("highs"), *common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, side, held, ready = None, 0, {}, {}
        for batch in batches:
            for start in range(0, batch.num_rows, 64):  # a few blocks as Python values at once
                for row in batch.slice(start, 64).to_pylist():
                    if (row["part"], row["salt"]) != now:
                        yield from (a.best() for a in ready.values())
                        now, held, ready = (row["part"], row["salt"]), {}, {}
                    if row["side"] == 0:
                        held.setdefault(row["dim"], []).append(row)
                        continue
                    if held:
                        ready, held = {dim: Anchors(rows, k, same_label) for dim, rows in held.items()}, {}
                    if row["dim"] in ready:
                        ready[row["dim"]].meet(*_unpack(row))
        yield from (a.best() for a in ready.values())

    dealt = left.unionByName(right).repartition(tasks, "part", "salt").sortWithinPartitions("part", "salt", "side")
    found = dealt.mapInArrow(run, "key long, limit long, score long, found long")
    order = Window.partitionBy("key", "limit").orderBy(F.col("score").desc(), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(rows: DataFrame, vector: str) -> Column:
    """Neither the vector nor a component is null, and all are finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def mine(rows: DataFrame, scale: float = 256.0, anchor_every: int = 50, positives: int = 5, negatives: int = 3, shares: tuple[int, int] = (50, 95)) -> DataFrame:
    """rows(id, label, vector) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by anchor_every; shares are the limits of a negative's score in percent of the positive's."""
    some = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(rows, "vector"))
    some = some.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector")
    blocks = saved(blocks_of(some, scale, anchor_every), "negatives-blocks")
    n = blocks.agg(F.sum("anchors")).first()[0] or 0
    sets = max(1, -(-n // SET))
    anchors = saved(anchors_of(blocks, anchor_every, sets), "negatives-anchors")
    every = anchors.withColumns({"lows": F.array(F.lit(LEAST)), "highs": F.array(F.lit(MOST))})
    first = saved(best_rows(every, blocks, sets, positives, True).select("key", F.col("found").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "negatives-positives")
    low, high = (F.col("positive_score").cast("decimal(20,0)") * F.lit(share).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)") for share in shares)
    low, high = F.ceil(low).cast("long"), F.floor(high).cast("long")
    limits = first.withColumns({"low": low, "high": high}).where("low <= high").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("positive_score", "low", "high"))).alias("ls"))
    # every anchor of a set needs as many limits; the empty range 1 to 0 fills up
    fill = F.array_repeat(F.struct(F.lit(0).cast("long").alias("positive_score"), F.lit(1).cast("long").alias("low"), F.lit(0).cast("long").alias("high")), positives)
    ls = F.slice(F.concat("ls", fill), 1, positives)
    asked = saved(anchors.join(limits, "key").withColumn("ls", ls).select(*anchors.columns, F.col("ls.positive_score").alias("of"), F.col("ls.low").alias("lows"), F.col("ls.high").alias("highs")), "negatives-limits")
    second = best_rows(asked, blocks, sets, negatives, False)
    named = asked.select("key", F.col("id").alias("anchor_id"), F.posexplode("of").alias("limit", "positive_score"))
    second = second.join(named, ["key", "limit"]).select("key", "anchor_id", "positive_score", "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    return first.drop("rank").join(second, ["key", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def digest(embeddings: DataFrame) -> DataFrame:
    """The rows of `mine` for embeddings(vec_id, label, embedding); a seventh of the ids has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")))


SQL = """
with v as (select row_number() over () k, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end lab, list_transform(embedding, lambda x: floor(256 * x::double)) e
           from embeddings where vec_id is not null and label is not null and embedding is not null
           and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.k, a.vec_id a, b.vec_id b, a.lab = b.lab same, list_inner_product(a.e, b.e)::bigint s
      from v a join v b on a.vec_id % 50 = 0 and b.vec_id <> a.vec_id and len(a.e) = len(b.e)),
p as (select *, row_number() over (partition by k order by s desc, b) r from s where same qualify r <= 5),
n as (select p.k, p.a, p.b, p.r, p.s ps, s.b nb, s.s ns, row_number() over (partition by p.k, p.r order by s.s desc, s.b) rank
      from p join s on s.k = p.k and not s.same and 50 * p.s <= 100 * s.s and 100 * s.s <= 95 * p.s qualify rank <= 3)
select a anchor_id, b positive_id, rank::int rank, nb negative_id, ps positive_score, ns negative_score from n
"""
