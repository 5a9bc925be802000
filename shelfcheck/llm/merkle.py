"""Merkle manifest of a dataset: a tree of SHA-256 digests per group, one over the groups, and each row's witness.

Leaves of a group are in order; every `ARITY` consecutive nodes (the last run may be shorter) become the digest of their
joined hexadecimal digests, until one is left. The groups' roots, in order, become the dataset's root in the same way.

A witness holds, level by level from the leaf up, the digests of the node's run before it and those after it. It is
made by appending: a leaf that is appended gets an empty witness in an open subtree; when its run closes, every witness
in the run's subtrees grows by the run's other digests, and the digest of the run is appended one level higher.
Leaves are appended in aligned blocks of `ARITY ** BLOCK_LEVELS`, each in its own task; the roots of the blocks are
appended to blocks in turn, round by round, so a block only ever holds its own nodes, and the witnesses of the higher
rounds are handed down one row per block.

Null is written as `-`, other values by their byte count, so that no two rows have the same form; an empty text has
count 0. Repeated rows are leaves of their own. Rows with equal order columns are ordered by digest. No rows: no result.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Fixed value: nodes of a run.
ARITY = 8
#: Levels that one task builds: a block holds 4,096 nodes.
BLOCK_LEVELS = 4

WITNESS = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def joined(digests: Sequence[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


class Appender:
    """Appends nodes to a tree of `levels` levels. `witnesses` holds one list of (before, after) for each node appended."""

    def __init__(self, levels: int):
        self.levels, self.witnesses = levels, []
        #: Per level, the open run: (digest, first and last number of the nodes below).
        self.open = [[] for _ in range(levels + 1)]

    def append(self, digest: str) -> None:
        self.witnesses.append([])
        number = len(self.witnesses)
        self._add(0, (digest, number - 1, number))

    def _add(self, level: int, node: tuple[str, int, int]) -> None:
        self.open[level].append(node)
        if level < self.levels and len(self.open[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        for i, (_, begin, end) in enumerate(run):
            step = ("".join(digests[:i]), "".join(digests[i + 1 :]))
            for k in range(begin, end):
                self.witnesses[k].append(step)
        self._add(level + 1, (joined(digests), run[0][1], run[-1][2]))

    def finish(self) -> str:
        """Closes the runs that are still open; returns the root."""
        for level in range(self.levels):
            if self.open[level]:
                self._close(level)
        return self.open[self.levels][0][0]


def folded(start: Column, witness: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(witness, start, lambda node, w: F.sha2(F.concat(w["before"], node, w["after"]), 256))


def siblings(witness: Column) -> Column:
    """All digests of a witness, joined."""
    return F.array_join(F.transform(witness, lambda w: F.concat(w["before"], w["after"])), "")


def numbered(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """`rows` with the columns `number` (from 0, in its group) and `size` (of the group), in order of `order`. Written twice:
    in order, and read back with the counts of the written pieces, of which there are as many as partitions and groups."""
    keys = [group, *order]
    placed = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys])
    # In a sorted partition the low bits number its rows, the high ones the partitions.
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_piece", F.shiftright("_at", 33)), name)
    pieces = placed.groupBy(group, "_piece").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    pieces = pieces.select(F.col(group).alias("_group"), F.col("_piece").alias("_of"), "_first", "_n")
    before = "coalesce(sum(_n) over (partition by _group order by _of rows between unbounded preceding and 1 preceding), 0)"
    pieces = pieces.withColumns({"_before": F.expr(before), "size": F.expr("sum(_n) over (partition by _group)")})
    found = placed.join(pieces, (F.col("_piece") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return found.withColumn("number", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_piece", "_group", "_of", "_first", "_n", "_before")


def _levels(size: int) -> int:
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def _appended(nodes: pa.Table) -> tuple[Appender, str]:
    """The block of `nodes`, whose groups have `size` nodes at this round."""
    nodes = nodes.sort_by("number")
    block = Appender(min(BLOCK_LEVELS, _levels(nodes["size"][0].as_py())))
    for digest in nodes["digest"].to_pylist():
        block.append(digest)
    return block, block.finish()


def _root(nodes: pa.Table) -> pa.Table:
    return pa.table({"grp": nodes["grp"][:1], "number": nodes["block"][:1], "digest": [_appended(nodes)[1]]})


def _with_witness(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Each node's witness in its block and after it that of the block's root, and what else is told of the block."""
    nodes = nodes.sort_by("number")
    rest = [(w["before"], w["after"]) for w in above["witness"][0].as_py()]
    made = [w + rest for w in _appended(nodes)[0].witnesses]
    flat = pa.StructArray.from_arrays([pa.array([step[k] for w in made for step in w], pa.string()) for k in (0, 1)], ["before", "after"])
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(w) for w in made])]), pa.int32())
    told = {c: pa.array(above[c].to_pylist() * nodes.num_rows, pa.string()) for c in above.column_names if c not in ("grp", "block", "witness")}
    kept = nodes.drop_columns(["digest", "size", "block"])
    return pa.table({**{c: kept[c] for c in kept.column_names}, "witness": pa.ListArray.from_arrays(offsets, flat), **told})


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"number div {ARITY**BLOCK_LEVELS}"))


def _kind(df: DataFrame, *without: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in without)


def witnessed(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """`nodes` (grp, number, digest, size of the group, further columns) without digest and size, with `witness` and the
    further columns (strings) of `above`, which has (grp, block, witness, ...) for each of their blocks."""
    kind = f"{_kind(nodes, 'digest', 'size')}, {_kind(above, 'grp', 'block')}"
    return _blocked(nodes).groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(_with_witness, kind)


def blocks(nodes: DataFrame) -> DataFrame:
    """(grp, block, witness, top) for each block of `nodes`: the witness of its root, and the root of its group."""
    kind = f"grp {nodes.schema['grp'].dataType.simpleString()}, number bigint, digest string"
    roots = _blocked(nodes).select("grp", "number", "digest", "size", "block").groupBy("grp", "block").applyInArrow(_root, kind)
    roots = written(roots, "merkle-blocks")
    if roots.filter("number > 0").isEmpty():
        return roots.select("grp", F.col("number").alias("block"), F.expr(f"cast(array() as {WITNESS})").alias("witness"), F.col("digest").alias("top"))
    sizes = roots.groupBy(F.col("grp").alias("of")).agg(F.count("*").alias("size"))
    roots = roots.join(sizes, F.col("grp").eqNullSafe(F.col("of"))).drop("of")
    return written(witnessed(roots, blocks(roots)).withColumnRenamed("number", "block"), "merkle-witnesses")


def manifest(rows: DataFrame, group: str, order: str, digest: str, others: Sequence[str] = ()) -> DataFrame:
    """(group, order, digest, others..., witness, subroot, root) for each row of `rows`; other columns are not read.

    `digest` is the leaf. Rows of a group are ordered by `order` (null first) and, where that is equal, by digest; groups
    by bytes, a null one first. The witness leads from the leaf through the group's `subroot` to `root`.
    """
    names = [order, *others]
    leaves = rows.select(F.col(group).alias("grp"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(names)], F.col(digest).alias("digest"))
    # One more column tells equal rows apart, so that no partition gets all copies of one.
    leaves = written(leaves.withColumn("copy", F.xxhash64(F.monotonically_increasing_id())), "merkle-leaves")
    placed = numbered(leaves, "grp", ["v0", "digest", "copy"], "merkle-order").drop("copy")
    above = blocks(placed)
    tops = above.filter("block = 0").select(F.lit(0).alias("grp"), F.col("grp").alias("of"), F.col("top").alias("digest"))
    tops = numbered(tops, "grp", ["of"], "merkle-groups")
    tops = witnessed(tops, blocks(tops)).select("of", F.col("witness").alias("rest"), F.col("top").alias("root"))
    above = above.join(tops, F.col("grp").eqNullSafe(F.col("of"))).select("grp", "block", F.concat("witness", "rest").alias("witness"), F.col("top").alias("subroot"), "root")
    found = witnessed(placed.withColumn("leaf", F.col("digest")), above)
    return found.select(F.col("grp").alias(group), *[F.col(f"v{i}").alias(c) for i, c in enumerate(names)], F.col("leaf").alias(digest), "witness", "subroot", "root")
