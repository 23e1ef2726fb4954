"""Near copies by the exact Jaccard similarity of five-word shingles.

Two texts are linked if their sets of lower-cased N-word shingles agree in 8 of 10 or more, and linked documents form components.

Texts of equal sets are one node, however many copies there are. Candidates come from buckets: BANDS keys of ROWS min-hashes
each, which a pair at 0.8 misses with probability (1 - 0.8 ** ROWS) ** BANDS, 0.00007; and from buckets that the caller names.
No candidate is linked unseen: shingle hashes of both texts are joined and counted. Each bucket is first held against its
smallest node, which ties a group of many copies together in as many pairs as it has nodes. Where a bucket still has several
components, all its nodes are then held against each other through postings of their shingles, in tasks of at most two parts of
about SHARD nodes. So every pair of a bucket is compared or connected, and nothing is dropped.

Cases: null, empty and wordless texts are one node, linked to nothing else; a text of fewer words than a shingle is one shingle;
equal rows are one row; the first row of a component is that of the smallest id that isn't null; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import repeat_rows, row_key, saved
from .components import components

N = 5
ROWS = 5
BANDS = 24
SHARD = 1024
_RANDOM = np.random.default_rng(5)
_XOR, _MUL = (_RANDOM.integers(0, 1 << 64, ROWS * BANDS, "uint64") for _ in range(2))
_MUL |= np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    h = (h ^ v) * _M
    return h ^ (h >> np.uint64(29))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, start of every text in them)."""
    codes, starts, values = words.split(words.translated(texts, words.SPACED_LOWER))
    word = np.append(np.fromiter(map(xxhash.xxh64_intdigest, values), "uint64", len(values))[codes], np.uint64(0))
    n = np.diff(starts)
    count = np.where(n > 0, np.maximum(n - N + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) + np.repeat(starts[:-1] - first[:-1], count)
    end = np.repeat(starts[1:], count)
    h = np.full(len(at), N, "uint64")
    for j in range(N):
        h = _mixed(h, np.where(at + j < end, word[np.minimum(at + j, len(codes))], np.uint64(0)))
    return _mixed(h, h >> np.uint64(32)), first


def band_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys of the bands, one row per text that has shingles."""
    some = first[:-1][np.diff(first) > 0]
    out, buffer = np.zeros((len(some), BANDS), "uint64"), np.empty_like(h)
    if len(some):
        for k in range(ROWS * BANDS):
            np.multiply(np.bitwise_xor(h, _XOR[k], out=buffer), _MUL[k], out=buffer)
            band = k // ROWS
            out[:, band] = _mixed(out[:, band] + np.uint64(band), np.minimum.reduceat(buffer, some))
    return out


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    h, first = shingles(texts)
    return h, first, [np.unique(h[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist())]


def _node(x: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(x.tobytes())


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, id, h, node, n, buckets): id and h name the row, node its set of n shingles, buckets the keys of its bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch, 1):
                h, first, sets = _sets(piece.column(1))
                keys = band_keys(h, first)
                ends = np.concatenate([[0], np.cumsum(np.diff(first) > 0)]) * BANDS
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view("int64")))
                node = np.fromiter(map(_node, sets), "uint64", len(sets)).view("int64")
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), piece.column(3), pa.array(node), pa.array([len(x) for x in sets], pa.int64()), lists],
                                                 ["doc_id", "id", "h", "node", "n", "buckets"])

    return docs.select("doc_id", "text", *row_key(docs)).mapInArrow(run, f"doc_id {kind}, id string, h long, node long, n long, buckets array<long>")


def sets_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, hashes) of the rows (id, h) of docs, one row per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch, 0):
                sets = _sets(piece.column(0))[2]
                node = np.fromiter(map(_node, sets), "uint64", len(sets)).view("int64")
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                flat = np.concatenate(sets).view("int64") if sets else np.zeros(0, "int64")
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["node", "hashes"])

    texts = docs.select("text", *row_key(docs)).join(rows, ["id", "h"], "left_semi").select("text")
    return texts.mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard similarity of 0.8 or more."""
    one, other = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"of_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(other, "b")
    # common / (|a| + |b| - common) >= 8 / 10
    return both.where(9 * F.size(F.array_intersect("of_a", "of_b")) >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes(node, n, first, buckets): enough verified links to connect all that are linked within a bucket."""
    like = (5 * F.least("m", "n") >= 4 * F.greatest("m", "n")) & (F.col("a") != F.col("b"))
    each = saved(nodes.where("n > 0").select("node", "n", F.explode("buckets").alias("bucket")), "near-buckets")
    least = each.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = saved(each.join(least, "bucket").select("bucket", "node", "n", F.col("least.node").alias("a"), F.col("least.n").alias("m")), "near-shared")
    sets = saved(sets_of(docs, nodes.join(shared.select("node").distinct(), "node").select("first.id", "first.h")), "near-sets")
    stars = saved(shared.withColumnRenamed("node", "b").where(like).select("a", "b").distinct(), "near-stars")
    tied = saved(verified(stars, sets), "near-links")
    roots = components(tied)
    rooted = saved(shared.select("bucket", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-rooted")
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    return tied.unionAll(_compared(rooted.join(mixed.select("bucket", "size"), "bucket").join(sets, "node")))


def _spanning(node: list[int], root: list[int], sets: list[np.ndarray], home: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that tie together different roots; with `home` only between nodes that are in it and nodes that aren't."""
    parent = {r: r for r in root}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    if len(parent) < 2:
        return []
    lens = np.array([len(x) for x in sets])
    ends = np.cumsum(lens)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    posting = np.repeat(np.arange(len(sets)), lens)[np.argsort(code, kind="stable")]
    size = np.bincount(code)
    first, out = np.cumsum(size) - size, []
    for x in range(len(sets)):
        own = code[ends[x] - lens[x]:ends[x]]
        upto = np.cumsum(size[own])
        common = np.bincount(posting[np.arange(upto[-1]) + np.repeat(first[own] - upto + size[own], size[own])], minlength=len(sets))
        like = 9 * common >= 4 * (lens + lens[x])  # common / (|a| + |b| - common) >= 8 / 10
        like[:x + 1] = False
        if home is not None:
            like &= home != home[x]
        for y in np.flatnonzero(like).tolist():
            a, b = find(root[x]), find(root[y])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((node[x], node[y]))
    return out


def _compared(rest: DataFrame) -> DataFrame:
    """(a, b) of rest(bucket, size, node, root, hashes): links between different roots of a bucket."""
    parts = rest.withColumn("parts", F.ceil(F.col("size") / SHARD).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # a part meets itself and each other part: (lower part, higher part) names the task's group
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j")))
    spread = parts.withColumn("p", F.explode(pairs)).select("bucket", "p.i", "p.j", "own", "node", "root", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def finish() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            own, node, root, sets = zip(*held)
            return _spanning(node, root, sets, np.array(own) == name[1] if name[1] != name[2] else None)

        def frame(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            found, lists = [], batch.column(6)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for k, (*group, own, node, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)))):
                if group != name:
                    found += finish()
                    name, held = group, []
                held.append((own, node, root, flat[ends[k]:ends[k + 1]].copy()))
            yield frame(found)
        yield frame(finish())

    group = ["bucket", "i", "j"]
    return spread.repartition(*group).sortWithinPartitions(*group, "own", "node").mapInArrow(run, "a long, b long")


def one_per_group(docs: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """The first row of every component, with the columns of the input; of equal rows one.

    buckets(id, h, bucket) names further candidates by row, beside those of the min-hashes."""
    rows = marks(docs)
    if buckets is not None:
        own = F.concat("buckets", F.when(F.col("bucket").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("bucket")))
        rows = rows.join(buckets.distinct(), ["id", "h"], "left").withColumn("buckets", own)
    rows = saved(rows.select("doc_id", "id", "h", "node", "n", "buckets"), "near-marks")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "id", "h")
    plain = rows.groupBy("node").agg(F.min(row).alias("first"), F.first("n").alias("n"),
                                     (F.first("buckets") if buckets is None else F.array_distinct(F.flatten(F.collect_set("buckets")))).alias("buckets"))
    nodes = saved(plain, "near-nodes")
    roots = components(links(docs, nodes))
    rooted = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.h")
    counts = rows.groupBy("id", "h").agg(F.count(F.lit(1)).alias("rows"), F.lit(1).cast("long").alias("copies"))
    return repeat_rows(docs, counts.join(first, ["id", "h"]), "near-kept")
