"""Merkle manifest of a dataset by checkpoint and recompute.

Every row is a leaf: the digest of its fields. Leaves of a group (a language, a source, ...) are put in order, runs of FAN
consecutive nodes become the digest of their digests until one is left, the group's subroot; the subroots, in order of their
groups, become the root in the same way. A proof of a row is the list of its siblings from the leaf to the root: whoever holds the
row, its proof and the root can check the row without the rest of the data.

Only the leaves and every EVERY-th level above them are written. The FAN ** EVERY stored nodes below one stored node are an aligned
subtree; proof extraction hands each subtree to a task, which computes its missing interior nodes anew, emits the siblings of its
stored nodes and forgets the interior. Paths of the level above are extracted first and joined once per subtree, not once per row.

Places in the order come from a range sort that is written once with its partition and row numbers, and from the prefix sums of the
counts per (group, partition). So a group of any size is spread over tasks, and the driver sees one number per stored level.

Cases: a null field is `-` and never equals a text; a null group is a group of its own and the first; null order values come first;
rows that tie in the order are ordered by their digests, and equal rows are leaves of their own; a group of one row has its leaf as
subroot, a single group's subroot is the root; an empty table has no leaves, no root and no proofs; other columns may have any name."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

FAN = 8
EVERY = 3
TREE = FAN ** EVERY
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = "struct<before: string, after: string>"


def digest_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(values: list[Column]) -> Column:
    """Digest of the values, each as its length in bytes, a colon and the value, or `-`; so no two rows read alike."""
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return digest_of(F.concat(*parts))


def _group(group: Column) -> Column:
    """The group as a text that is never null; its order is that of the groups, null first."""
    return F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group.cast("string")))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows(g, h, <order>, ...) with idx, the place in group g from 0, and n, the rows of the group."""
    ranges = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("g", F.col(order).asc_nulls_first(), "h", "tie")
    at = F.monotonically_increasing_id()
    placed = ranges.sortWithinPartitions("g", F.col(order).asc_nulls_first(), "h").drop("tie").withColumn("at", at)
    placed = saved(placed.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}), "merkle-leaves")
    count = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    own = Window.partitionBy("g")  # a row per partition that holds a part of the group
    count = count.select("g", "part", "first", (F.sum("rows").over(own.orderBy("part")) - F.col("rows")).alias("base"), F.sum("rows").over(own).alias("n"))
    return placed.join(count, ["g", "part"]).withColumn("idx", F.col("at") - F.col("first") + F.col("base")).drop("part", "at", "first", "base")


def _heights(n: int) -> int:
    """Levels between a stored level of n nodes and the next one."""
    levels = 0
    while n > 1 and levels < EVERY:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _levels(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of an aligned subtree, from the given ones up."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i:i + FAN]).encode()).hexdigest() for i in range(0, len(below), FAN)])
    return out


def _subtrees(nodes: DataFrame) -> DataFrame:
    """(g, t, n, items): the stored nodes of every aligned subtree in order, TREE of them at most."""
    rest = [c for c in nodes.columns if c not in ("g", "n", "idx")]
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.withColumn("t", F.floor(F.col("idx") / TREE)).repartition(parts, "g", "t")
    return rows.groupBy("g", "t").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", *rest))).alias("items"))


def _tops(trees: DataFrame) -> DataFrame:
    """The next stored level (g, idx, n, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, t, n, items = batch.columns
            tops = [_levels(own, _heights(size))[-1][0] for own, size in zip(items.to_pylist(), n.to_pylist())]
            above = pa.array([-(-size // TREE) for size in n.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([g, t, above, pa.array(tops, pa.string())], ["g", "idx", "n", "h"])

    return trees.select("g", "t", "n", F.col("items.h").alias("hs")).mapInArrow(run, "g string, idx long, n long, h string")


def stored_levels(nodes: DataFrame) -> list[DataFrame]:
    """The stored levels above nodes(g, idx, n, h, ...), which come first; a group is in all levels up to that of its last node."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(saved(_tops(_subtrees(out[-1].where("n > 1").select("g", "idx", "n", "h"))), "merkle-level"))
    return out


def last_nodes(levels: list[DataFrame]) -> DataFrame:
    """(g, h): the node that remains of every group."""
    out = [nodes.where("n = 1").select("g", "h") for nodes in levels]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def _siblings(trees: DataFrame) -> DataFrame:
    """One row per stored node: (g, item, path, <other columns>), path: (before, after) per level of its subtree, as texts."""

    def paths(hs: list[str], levels: int) -> tuple[list[str], list[str], np.ndarray]:
        before, after, at = [], [], []
        for level, nodes in enumerate(_levels(hs, levels)[:-1]):
            at.append(len(before) + (np.arange(len(hs)) >> (3 * level)))
            for i in range(len(nodes)):
                run = i - i % FAN
                before.append("".join(nodes[run:i]))
                after.append("".join(nodes[i + 1:run + FAN]))
        return before, after, np.stack(at, 1).ravel() if at else np.zeros(0, "int64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            size = np.cumsum(np.diff(items.offsets.to_numpy()))
            row = 0
            while row < batch.num_rows:  # about TREE nodes at once, whatever the groups' sizes
                end = max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + TREE, "right")))
                piece = batch.slice(row, end - row)
                own = piece.column("items").flatten().field("h").to_pylist()
                ends = np.cumsum([0, *np.diff(piece.column("items").offsets.to_numpy())])
                before, after, at, steps = [], [], [np.zeros(0, "int64")], []
                for a, b, n in zip(ends, ends[1:], piece.column("n").to_pylist()):
                    x, y, z = paths(own[a:b], levels := _heights(n))
                    at.append(z + len(before))
                    before += x
                    after += y
                    steps += [levels] * int(b - a)
                at = pa.array(np.concatenate(at))
                each = pa.StructArray.from_arrays([pa.array(x, pa.string()).take(at) for x in (before, after)], ["before", "after"])
                path = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *steps]), pa.int32()), each)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), path)], [*piece.schema.names, "paths"])
                row = end

    schema = ", ".join(f"{name} {kind}" for name, kind in trees.dtypes) + f", paths array<array<{STEP}>>"
    rows = trees.mapInArrow(run, schema).select(*[c for c in trees.columns if c != "items"], F.explode(F.arrays_zip("items", "paths")).alias("x"))
    return rows.select("*", F.col("x.items").alias("item"), F.col("x.paths").alias("path")).drop("x")


def sibling_paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, item, path, end) of every node of the lowest level. above(g, up, end): path and payload beyond a group's last node."""
    upper = None
    for i in range(len(levels) - 1, -1, -1):
        ending = levels[i].where("n = 1").select("g").join(above, "g").withColumn("t", F.lit(0).cast("long"))
        joined = ending if upper is None else ending.unionByName(upper)
        rows = _siblings(_subtrees(levels[i]).join(joined, ["g", "t"])).select("g", "item", F.concat("path", "up").alias("path"), "end")
        if not i:
            return rows
        upper = saved(rows.select("g", F.col("path").alias("up"), "end", F.col("item.idx").alias("t")), "merkle-paths")
    raise AssertionError("no level")


class Manifest:
    """Stored levels of all groups, and of the tree over the groups' subroots."""

    def __init__(self, docs: DataFrame, fields: list[str], group: str, order: str, carry: dict[str, Column]):
        values = [F.col(f"`{c}`") for c in fields]
        rows = docs.select(_group(F.col(f"`{group}`")).alias("g"), F.col(f"`{order}`").alias("o"), leaf_digest(values).alias("h"), F.struct(F.lit(0).alias("none"), *[c.alias(k) for k, c in carry.items()]).alias("carry"))
        self.carry = list(carry)
        self.levels = stored_levels(numbered(saved(rows, "merkle-digests"), "o").drop("o"))
        self.subroots = saved(last_nodes(self.levels).select(F.lit("").alias("g"), F.col("g").alias("o"), "h"), "merkle-subroots")
        self.top_levels = stored_levels(numbered(self.subroots, "o"))

    def root(self) -> DataFrame:
        """One row (root), none for an empty dataset."""
        return last_nodes(self.top_levels).select(F.col("h").alias("root"))

    def proofs(self) -> DataFrame:
        """(<carried columns>, leaf, subroot, root, path) of every row; path: the texts of siblings before and after, per level."""
        root = last_nodes(self.top_levels).select("g", F.array().cast(f"array<{STEP}>").alias("up"), F.struct(F.col("h").alias("root")).alias("end"))
        tops = sibling_paths(self.top_levels, root)
        above = saved(tops.select(F.col("item.o").alias("g"), F.col("path").alias("up"), F.struct(F.col("item.h").alias("subroot"), F.col("end.root").alias("root")).alias("end")), "merkle-top")
        rows = sibling_paths(self.levels, above)
        return rows.select(*[F.col("item.carry").getField(c).alias(c) for c in self.carry], F.col("item.h").alias("leaf"), "end.subroot", "end.root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda h, s: digest_of(F.concat(s["before"], h, s["after"])))


def proof_text(path: Column) -> Column:
    return F.concat_ws("", F.transform(path, lambda s: F.concat(s["before"], s["after"])))


def tampered(fields: list[str]) -> Column:
    """The leaf digest where the text's A-Z are lower-cased, for a third of the ids; null elsewhere."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(third, leaf_digest([lower if c == "text" else F.col(c) for c in fields]))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): a third of the rows is checked with a changed text."""
    manifest = Manifest(docs.select(*FIELDS), FIELDS, "lang", "doc_id", {"doc_id": F.col("doc_id"), "tampered": tampered(FIELDS)})
    rows = manifest.proofs().withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", digest_of(proof_text(F.col("path"))).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_field(c: str, value: str) -> str:
    return f"case when {c} is null then '-' else strlen({value}::varchar) || ':' || {value}::varchar end"


_LEAF = " || ".join(_sql_field(c, c) for c in FIELDS)
_CHANGED = " || ".join(_sql_field(c, "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if c == "text" else c) for c in FIELDS)
_CRC_TABLE = "(list_reduce(list_prepend(i::ubigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"

#: The same in DuckDB: all levels by recursion, then the siblings of every leaf and a fold along them.
SQL = f"""
with recursive crc_table as (select list(c order by i) t from (select i, {_CRC_TABLE} c from range(256) r(i))),
docs as (select *, list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda j: ascii(substr(doc_id::varchar, j::int, 1))::ubigint)),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::int + 1])) x from documents, crc_table),
leaf as (select doc_id, lang, sha256({_LEAF}) h, case when xor(x, 4294967295) % 3 = 0 then sha256({_CHANGED}) end changed from docs),
leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 i, count(*) over (partition by lang) n,
           dense_rank() over (order by lang nulls first) - 1 g from leaf),
nodes as (select g, 0 lv, i, h, n from leaves
          union all select g, lv + 1, i // 8, sha256(string_agg(h, '' order by i)), (any_value(n) + 7) // 8 from nodes where n > 1 group by g, lv, i // 8),
subroots as (select g i, h, count(*) over () n from nodes where n = 1),
tops as (select 0 lv, i, h, n from subroots
         union all select lv + 1, i // 8, sha256(string_agg(h, '' order by i)), (any_value(n) + 7) // 8 from tops where n > 1 group by lv, i // 8),
steps as (select l.g, l.i, s.lv, coalesce(string_agg(s.h, '' order by s.i) filter (s.i < l.i >> (3 * s.lv)), '') a,
                 coalesce(string_agg(s.h, '' order by s.i) filter (s.i > l.i >> (3 * s.lv)), '') b
          from leaves l join nodes s on s.g = l.g and s.n > 1 and s.i // 8 = l.i >> (3 * s.lv + 3) group by 1, 2, 3),
over_steps as (select l.i g, s.lv, coalesce(string_agg(s.h, '' order by s.i) filter (s.i < l.i >> (3 * s.lv)), '') a,
                      coalesce(string_agg(s.h, '' order by s.i) filter (s.i > l.i >> (3 * s.lv)), '') b
               from subroots l join tops s on s.n > 1 and s.i // 8 = l.i >> (3 * s.lv + 3) group by 1, 2),
every_step as (select g, i, lv, a, b from steps union all select l.g, l.i, 100 + o.lv, a, b from leaves l join over_steps o using (g)),
path as (select g, i, list(struct_pack(a := a, b := b) order by lv) p from every_step group by 1, 2),
fold as (select l.g, l.i, 1 k, coalesce(changed, h) h, coalesce(p, []) p from leaves l left join path using (g, i)
         union all select g, i, k + 1, sha256(p[k].a || h || p[k].b), p from fold where k <= len(p))
select l.doc_id, l.h leaf, s.h subroot, r.h root, sha256(array_to_string(list_transform(f.p, lambda x: x.a || x.b), '')) proof_sha256, f.h folded_root, f.h = r.h verified
from leaves l join fold f on f.g = l.g and f.i = l.i and f.k > len(f.p) join subroots s on s.i = l.g, (select h from tops where n = 1) r
"""
