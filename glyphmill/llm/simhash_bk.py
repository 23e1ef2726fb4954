"""SimHash near-duplicates, linked through BK-trees.

A text's fingerprint has bit j set if over half of its word shingles' hashes have it set. Fingerprints that differ in at most
`radius` bits are linked, and linked documents form components.

Equal fingerprints are merged first, so what follows works on distinct fingerprints however many copies a text has. A BK-tree
keeps the children of a node by their Hamming distance to it; a search follows only edges within the radius of the query's own
distance. One tree over everything would be visited in large part by every query, so trees are sharded: the 64 bits are cut
into radius + 2 blocks, two fingerprints within the radius agree on two blocks at least, and each pair of blocks (with their
values) names a shard. Shards hold few fingerprints; one that grows past SHARD is cut into several trees, and every tree of it
is sent to the tasks that hold another part of the shard, so no task ever has more than two parts. Tasks return the spanning
links of what they found (at most one per fingerprint), not all pairs. Nothing is dropped or capped.

Cases: null, empty and wordless texts have fingerprint 0 and are linked to each other; a text of fewer words than a shingle is one
shingle; repeated rows share their fingerprint; a component id is the smallest id that isn't null in it; an empty table gives an
empty result; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import repeat_rows, row_key, saved
from .components import components

SHARD = 1024


def fingerprints_of(texts: pa.Array, n: int, seed: int = 42) -> np.ndarray:
    """SimHash of every text over lower-cased n-word shingles, as unsigned 64-bit integers."""
    h, data = xxhash.xxh64_intdigest, words.translated(texts, words.SPACED_LOWER)
    out = np.zeros(len(texts), "uint64")
    for i, text in enumerate(data):
        w = text.as_py().split()
        if not w:
            continue
        hashes = [h(b" ".join(w[j:j + n]), seed) for j in range(max(1, len(w) - n + 1))]
        votes = np.zeros(64, "int64")
        for at in range(0, len(hashes), 4096):
            part = np.array(hashes[at:at + 4096], "<u8")
            votes += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
        out[i] = np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, id, h, fp): fp holds the fingerprint's 64 bits as a signed integer; id and h name the row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch, 1):
                fp = pa.array(fingerprints_of(piece.column(1), n).view("int64"))
                yield pa.RecordBatch.from_arrays([piece.column(0), fp, piece.column(2), piece.column(3)], ["doc_id", "fp", "id", "h"])

    return docs.select("doc_id", "text", *row_key(docs)).mapInArrow(run, f"doc_id {kind}, fp long, id string, h long")


def block_keys(fp: Column, radius: int) -> Column:
    """Array of structs (blocks, value): one for every pair of the radius + 2 blocks of bits."""
    cuts = np.linspace(0, 64, radius + 3).round().astype(int).tolist()
    out = []
    for number, (i, j) in enumerate(combinations(range(radius + 2), 2)):
        mask = 0
        for b in (i, j):
            mask |= (1 << cuts[b + 1]) - (1 << cuts[b])
        mask -= (mask >> 63) << 64
        out.append(F.struct(F.lit(number).alias("blocks"), fp.bitwiseAND(F.lit(mask)).alias("value")))
    return F.array(*out)


class BKTree:
    """Fingerprints as nodes; the children of a node are keyed by their Hamming distance to it."""

    def __init__(self, radius: int):
        self.radius, self.value, self.children = radius, [], []

    def add(self, x: int) -> None:
        if self.value:
            at = 0
            while True:
                d = (self.value[at] ^ x).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = len(self.value)
                    break
                at = below
        self.value.append(x)
        self.children.append({})

    def near(self, x: int) -> list[int]:
        """Numbers of all nodes within the radius."""
        r, value, children, out = self.radius, self.value, self.children, []
        todo = [0] if value else []
        while todo:
            at = todo.pop()
            d = (value[at] ^ x).bit_count()
            if d <= r:
                out.append(at)
            if below := children[at]:
                todo.extend(n for e, n in below.items() if d - r <= e <= d + r)
        return out


def _spanning(home: list[int], guests: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that tie together what is linked inside `home`, or between `home` and `guests`."""
    tree, parent = BKTree(radius), {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []

    def tie(x: int) -> None:
        for at in tree.near(x):
            a, b = find(x), find(tree.value[at])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((max(x, tree.value[at]), min(x, tree.value[at])))

    for x in home:
        if guests is None:
            tie(x)
        tree.add(x)
    for x in guests or ():
        tie(x)
    return out


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) of distinct fingerprints: enough of the links within the radius to connect all that are connected."""
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("k")).select("fp", "k.blocks", "k.value")
    keyed = saved(keyed, "bk-keys")
    sizes = keyed.groupBy("blocks", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keyed.join(sizes.withColumn("parts", F.ceil(F.col("n") / SHARD).cast("int")), ["blocks", "value"])
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    shared = shared.withColumn("own", own)
    # a part meets itself and each other part: (lower part, higher part) names the task's group
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                        lambda o: F.struct(F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j")))
    spread = shared.select("fp", "blocks", "value", "own", F.explode(pairs).alias("p")).select("fp", "blocks", "value", "own", "p.i", "p.j")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, home, guests = None, [], []

        def finish() -> list[tuple[int, int]]:
            if name is None or len(home) + len(guests) < 2:
                return []
            return _spanning(home, guests if name[2] != name[3] else None, radius)

        for frame in frames:
            out = []
            for blocks, value, i, j, own, fp in zip(*(frame[c].tolist() for c in ("blocks", "value", "i", "j", "own", "fp"))):
                if (blocks, value, i, j) != name:
                    out += finish()
                    name, home, guests = (blocks, value, i, j), [], []
                (home if own == i else guests).append(fp & 0xFFFFFFFFFFFFFFFF)
            yield _frame(out)
        yield _frame(finish())

    group = ["blocks", "value", "i", "j"]
    return spread.repartition(*group).sortWithinPartitions(*group, "own", "fp").mapInPandas(run, "a long, b long")


def _frame(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    both = np.array(pairs, "uint64").reshape(-1, 2).view("int64")
    return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, id, h, fp, component_id, first) of every row; `first` is the component's first row: by id, then by text."""
    marks = saved(fingerprints(docs, n), "simhash")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "id", "h")
    distinct = saved(marks.groupBy("fp").agg(F.min(row).alias("first")), "simhash-distinct")
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    classes = rooted.select("fp", "root").join(least, "root").select("fp", "first")
    return marks.join(classes, "fp").select("doc_id", "id", "h", "fp", F.col("first.doc_id").alias("component_id"), "first")


def one_per_group(docs: DataFrame, n: int = 3, radius: int = 3) -> DataFrame:
    """The first row of every component, with the columns of the input; of equal rows one."""
    near = near_duplicates(docs, n, radius).where((F.col("id") == F.col("first.id")) & (F.col("h") == F.col("first.h")))
    counts = near.groupBy("id", "h").agg(F.count(F.lit(1)).alias("rows"), F.lit(1).cast("long").alias("copies"))
    return repeat_rows(docs, counts, "simhash-kept")
