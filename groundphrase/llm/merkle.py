"""Merkle manifests of datasets with incremental witnesses.

Leaves are appended one after another at the right edge of a tree. Of an open subtree the nodes of its last run are kept,
and for every leaf the part of its witness that is known by now. When the last sibling of a run arrives, the run's nodes
get each other as left and right siblings, which extends the witnesses of all leaves below them at once: the leaves
under a node share what lies above it, so one entry a node is all that is written.

Distribution. Leaves are numbered by their order in a group (counts of sorted stretches, summed up) and cut into aligned
blocks of `arity ** height`. A block is a subtree of its own: its leaves are appended in one task, whatever share of the
rows a group has. The roots of a group's blocks are appended in their turn, in blocks again, until one node is left; the
groups' roots are the leaves of the last tree. Then witnesses go the other way: a block's root has got one by now, and it
extends those of the block's leaves. Only digests move, never texts.

Appending to a manifest. New leaves are numbered on from those that are there. Blocks that were full before stand; only
the open block of a group that gets leaves, the new blocks, and the blocks of block roots are made again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from groundphrase.operators.lineage import cut

#: Children of a node; levels of a block: 8 ** 4 leaves.
ARITY, HEIGHT = 8, 4
#: One entry a level, from the leaf up: the digests of the node's run to its left and to its right.
WITNESS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as part of a leaf: its bytes in UTF-8, counted, a colon, the value; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the fields in their order."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _node(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Appender:
    """Digests appended to a tree, `levels` levels high at most.

    `open` has the nodes of the last run of every level; `known` the siblings (left, right) of the nodes whose runs are
    complete, in order, so node i of level k belongs to the leaves from i * arity ** k on.
    """

    def __init__(self, levels: int, arity: int = ARITY):
        self.levels, self.arity = levels, arity
        self.open: list[list[str]] = [[] for _ in range(levels + 1)]
        self.known: list[tuple[list[str], list[str]]] = [([], []) for _ in range(levels)]

    def append(self, node: str, level: int = 0) -> None:
        run = self.open[level]
        run.append(node)
        if len(run) == self.arity and level < self.levels:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """The last sibling has come: the run's nodes have all their siblings, their parent goes to the next level."""
        run, (left, right) = self.open[level], self.known[level]
        self.open[level] = []
        for i in range(len(run)):
            left.append("".join(run[:i]))
            right.append("".join(run[i + 1 :]))
        self.append(_node(run), level + 1)

    def close(self) -> str:
        """No more leaves: open runs end as they are. The root."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.open[self.levels][0]

    def witnesses(self, n: int) -> pa.ListArray:
        """Witnesses of the n leaves, from the leaf to the root."""
        ends = pa.array(np.arange(n + 1, dtype="int32") * self.levels)
        begin = np.cumsum([0, *(len(left) for left, _ in self.known)])
        at = np.stack([begin[k] + np.arange(n) // self.arity**k for k in range(self.levels)], axis=1).ravel() if self.levels else np.zeros(0, "int64")
        sides = [pa.array([x for level in self.known for x in level[side]], pa.string()).take(pa.array(at)) for side in (0, 1)]
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(sides, ["left", "right"]))


def _levels(total: int, height: int, arity: int) -> int:
    """Levels of a block of a group of this many nodes: all of them, or as many as leave one node."""
    levels = 0
    while total > 1 and levels < height:
        total, levels = -(-total // arity), levels + 1
    return levels


def _roots(height: int, arity: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def work(key: tuple, block: pa.Table) -> pa.Table:
        total, digests = block["total"][0].as_py(), block.sort_by("pos")["digest"].to_pylist()
        tree = Appender(_levels(total, height, arity), arity)
        for d in digests:
            tree.append(d)
        size = arity**height
        row = (key[0].as_py(), key[1].as_py(), -(-total // size), tree.close(), len(digests) == size)
        return pa.table({n: [v] for n, v in zip(("tree", "pos", "total", "digest", "full"), row, strict=True)})

    return work


def _extended(inner: pa.ListArray, outer: list[dict]) -> pa.ListArray:
    """inner with outer after each of its lists (all of one length)."""
    n, size = len(inner), len(outer)
    if not size:
        return inner
    own = len(inner.values) // n
    at = np.hstack([np.arange(n * own).reshape(n, own), np.broadcast_to(n * own + np.arange(size), (n, size))]).ravel()
    sides = [pa.concat_arrays([inner.values.field(s), pa.array([x[s] for x in outer], pa.string())]).take(pa.array(at)) for s in ("left", "right")]
    ends = pa.array(np.arange(n + 1, dtype="int32") * (own + size))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(sides, ["left", "right"]))


def _witnesses(height: int, arity: int, kind: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Nodes of a block and its root's row become the nodes with subroot, root and whole witness."""

    def work(nodes: pa.Table, above: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return kind.empty_table()
        nodes, up = nodes.sort_by("pos"), above.slice(0, 1).to_pylist()[0]
        tree = Appender(_levels(nodes["total"][0].as_py(), height, arity), arity)
        for d in nodes["digest"].to_pylist():
            tree.append(d)
        made = tree.close()
        n = nodes.num_rows
        inner = tree.witnesses(n)
        values = {c: nodes[c] for c in nodes.column_names}
        values |= {"witness": _extended(inner, up["witness"]), "root": pa.array([up["root"]] * n)}
        values["subroot"] = pa.array([up["subroot"] or made] * n)
        return pa.table([values[f.name] for f in kind], names=kind.names).cast(kind)

    return work


def numbered(rows: DataFrame, tree: str, order: list[Column], start: DataFrame | None = None) -> DataFrame:
    """rows with pos, the place in their tree (a string column) by `order`, and total, the tree's rows.

    Sorted stretches of all rows are counted by tree, and the counts of the stretches before are added up. With start (tree, n)
    places go on from n.
    """
    kept = rows.columns
    part, seq = "_part", "_seq"
    sorted_rows = rows.repartitionByRange(F.col(tree), *order).sortWithinPartitions(F.col(tree), *order)
    at = F.monotonically_increasing_id()
    placed = cut(sorted_rows.select(*kept, F.spark_partition_id().alias(part), at.alias(seq)))
    sizes = placed.groupBy(tree, part).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    before = Window.partitionBy(tree).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        tree, part, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy(tree)).alias("total"),
    )
    out = placed.join(offsets, [tree, part])
    if start is not None:
        out = out.join(start.select(tree, F.col("n").alias("_start")), tree, "left")
    base = F.coalesce(F.col("_start"), F.lit(0)) if start is not None else F.lit(0)
    return out.select(*kept, (F.col(seq) + F.col("shift") + base).cast("long").alias("pos"), (F.col("total") + base).cast("long").alias("total"))


class Manifest:
    """Leaves (tree, pos, total, digest and what they carry) and the roots of their blocks."""

    def __init__(self, leaves: DataFrame, blocks: DataFrame, height: int = HEIGHT, arity: int = ARITY):
        self.leaves, self.blocks, self.height, self.arity = leaves, blocks, height, arity

    def _block(self, pos: str = "pos") -> Column:
        return F.floor(F.col(pos) / self.arity**self.height).cast("long")

    def _close(self, nodes: DataFrame) -> DataFrame:
        """(tree, pos, total, digest, full): the roots of the blocks of nodes."""
        slim = nodes.select("tree", "pos", "total", "digest", self._block().alias("block"))
        return slim.groupBy("tree", "block").applyInArrow(
            _roots(self.height, self.arity), "tree string, pos long, total long, digest string, full boolean"
        )

    def _open(self, nodes: DataFrame, above: DataFrame) -> DataFrame:
        """nodes with subroot, root and witness; above has these of their blocks' roots."""
        given = nodes.columns
        kind = StructType.fromDDL(f"subroot string, root string, witness {WITNESS}")
        whole = StructType([*nodes.schema.fields, *kind.fields])
        inside = nodes.withColumn("_block", self._block()).groupBy("tree", "_block")
        known = above.select("tree", F.col("pos").alias("_block"), "subroot", "root", "witness").groupBy("tree", "_block")
        done = inside.cogroup(known).applyInArrow(_witnesses(self.height, self.arity, to_arrow_schema(whole)), whole)
        return done.select(*given, "subroot", "root", "witness")

    def _climb(self, nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
        """The blocks' roots above nodes, level by level, and the last, which has one node a tree."""
        steps, size = [nodes], self.arity**self.height
        most = nodes.agg(F.max("total")).first()[0] or 0
        while most > 1:
            steps.append(cut(self._close(steps[-1])))
            most = -(-most // size)
        return steps[:-1], steps[-1]

    def witnesses(self) -> DataFrame:
        """The leaves with subroot (their tree's root), root (of all trees, in the order of their names) and witness.

        The witness of a lone leaf of a lone tree is an empty list.
        """
        steps, tops = self._climb(self.blocks.select("tree", "pos", "total", "digest"))
        names = numbered(tops.select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest"), "all", [F.col("name")])
        names = cut(names.select(F.col("all").alias("tree"), "pos", "total", "digest", "name"))
        above, last = self._climb(names)
        known = last.select("tree", "pos", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.array().cast(WITNESS).alias("witness"))
        for nodes in reversed(above):
            known = self._open(nodes, known)
        if not above:  # one tree, or none
            known = names.select("name", "digest", F.col("digest").alias("root"), F.array().cast(WITNESS).alias("witness"))
        known = known.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "root", "witness")
        for nodes in reversed(steps):
            known = self._open(nodes, known)
        return self._open(self.leaves, known)

    def append(self, leaves: DataFrame, order: list[Column]) -> Manifest:
        """This manifest with leaves (tree, digest and what the others carry) after those that are there, in their order."""
        counts = self.leaves.groupBy("tree").agg(F.count("*").alias("n"))
        new = cut(numbered(leaves, "tree", order, counts))
        totals = new.groupBy("tree").agg(F.max("total").alias("more"))
        old = self.leaves.join(totals, "tree", "left").withColumn("total", F.coalesce("more", "total")).drop("more")
        whole = old.unionByName(new)
        # full blocks stand; the others are made of their old leaves and the new ones
        stand = self.blocks.filter("full").join(totals, "tree", "left")
        size = self.arity**self.height
        stand = stand.withColumn("total", F.when(F.col("more").isNull(), F.col("total")).otherwise(F.ceil(F.col("more") / size))).drop("more")
        shut = self.blocks.filter("full").select("tree", F.col("pos").alias("_block"))
        again = whole.withColumn("_block", self._block()).join(shut, ["tree", "_block"], "left_anti").drop("_block")
        return Manifest(cut(whole), cut(stand.unionByName(self._close(again))), self.height, self.arity)

    def write(self, path: str) -> None:
        """Leaves and blocks as tables under a folder."""
        self.leaves.write.parquet(f"{path}/leaves")
        self.blocks.write.parquet(f"{path}/blocks")

    @classmethod
    def read(cls, spark: SparkSession, path: str, height: int = HEIGHT, arity: int = ARITY) -> Manifest:
        return cls(spark.read.parquet(f"{path}/leaves"), spark.read.parquet(f"{path}/blocks"), height, arity)


def manifest(leaves: DataFrame, order: list[Column], height: int = HEIGHT, arity: int = ARITY) -> Manifest:
    """The manifest of leaves: tree (string), digest (hexadecimal), and columns that they carry along.

    In a tree leaves are in `order`; ties are told apart by their digest, so rows that are equal in both are alike. An empty
    table gives an empty manifest. The names pos, total, subroot, root, witness and those with a leading _ are taken.
    """
    rows = cut(leaves)  # else texts would be hashed for the sample of the order, too
    placed = cut(numbered(rows, "tree", [*order, F.col("digest")]))
    made = Manifest(placed, placed, height, arity)
    made.blocks = cut(made._close(placed))
    return made


def tree_of(lang: Column) -> Column:
    """A string for each value, null too, in the order of bytes with null first."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit("-"))


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and a witness give."""
    return F.aggregate(witness, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def proof_digest(witness: Column) -> Column:
    """SHA-256 of all siblings of a witness, from the leaf up, left to right."""
    return F.sha2(F.concat_ws("", F.transform(witness, lambda level: F.concat(level["left"], level["right"]))), 256)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame) -> DataFrame:
    """(tree, digest, doc_id, tampered): a leaf for each row, and the leaf after tampering, null where that changes nothing.

    Tampering lower-cases A-Z of the text where 3 divides crc32 of the decimal doc_id. Null values are `-`; a null id is not
    tampered with. Other columns play no part.
    """
    columns = {c: F.col(c) for c in FIELDS}
    low = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & (low != F.col("text"))
    return docs.select(
        tree_of(F.col("lang")).alias("tree"),
        digest(*columns.values()).alias("digest"),
        F.col("doc_id"),
        F.when(hit, digest(*(columns | {"text": low}).values())).alias("tampered"),
    )


def verified_documents(docs: DataFrame, height: int = HEIGHT, arity: int = ARITY) -> DataFrame:
    """(doc_id, leaf, subroot, root, witness, proof_sha256, folded_root, verified), one row per row of docs.

    Trees by lang (null first, then by bytes), leaves by doc_id (null first; rows that repeat an id by digest). Empty
    texts are `0:`; an empty table gives an empty result.
    """
    made = manifest(document_leaves(docs), [F.col("doc_id").asc_nulls_first()], height, arity).witnesses()
    back = folded(F.coalesce("tampered", "digest"), F.col("witness"))
    return made.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", "witness", proof_digest(F.col("witness")).alias("proof_sha256"),
        back.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
