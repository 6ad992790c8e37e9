"""Connected components by large-star and small-star steps, with a local contraction after each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from groundphrase.operators.lineage import cut

#: Edges that a worker contracts at once; rows of a table of minima that is broadcast at most; parts of a hot node beyond that.
CHUNK, BROADCAST, SALTS = 1 << 20, 200_000, 16


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of these edges as (node, least node), for every node that is not the least itself."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y, label[x], label[y]):
            np.minimum.at(new, end, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    leaf = label != np.arange(len(nodes))
    return nodes[leaf], nodes[label[leaf]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a partition, some at a time, become stars with the same components."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        node, least = stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(least, pa.int64())], ["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(a) for a, _ in held) >= CHUNK:
            node, least = stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held = [(node, least)]
            if len(node) >= CHUNK // 2:  # little to gain: start anew
                yield out()
                held = []
    if held:
        yield out()


def components_within(edges: DataFrame, key: str, a: str = "a", b: str = "b", carry: tuple[str, ...] = ()) -> DataFrame:
    """(carry, node, component, size) for every node on an edge, where no edge leaves its group (key) and no node is in two
    groups; carry are columns that are the same on all edges of a component, size the nodes of the component.

    One shuffle by the key; a task solves whole groups, some at a time. Edges are contracted to stars as they arrive, so a
    group may have any number of edges, but its nodes must fit into memory.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def solved(e: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            return stars(e["a"].to_numpy(), e["b"].to_numpy())

        def out(e: pa.Table) -> pa.RecordBatch:
            node, least = solved(e)
            centre, first, size = np.unique(least, return_index=True, return_counts=True)
            nodes, root = np.concatenate([node, centre]), np.concatenate([np.searchsorted(centre, least), np.arange(len(centre))])
            ends, at = np.unique(np.concatenate([e["a"].to_numpy(), e["b"].to_numpy()]), return_index=True)
            row = pa.array(at[np.searchsorted(ends, nodes)] % e.num_rows)
            told = [e[c].take(row).combine_chunks() for c in carry]
            return pa.RecordBatch.from_arrays([*told, pa.array(nodes), pa.array(centre[root]), pa.array(size[root] + 1)], [*carry, "node", "component", "size"])

        for batch in batches:
            # without the batch's own schema: columns that are never null there may be so in what is held, and don't go together
            held.append(pa.Table.from_arrays(batch.columns, batch.schema.names))
            rows += batch.num_rows
            if rows >= CHUNK // 4:
                e = pa.concat_tables(held)
                k = e["k"].to_numpy()
                whole = int(np.searchsorted(k, k[-1]))  # the last group may go on in the next batch
                if whole:
                    yield out(e.slice(0, whole))
                e = e.slice(whole)
                node, least = solved(e)
                ends, at = np.unique(e["a"].to_numpy(), return_index=True)
                more, other = np.unique(e["b"].to_numpy(), return_index=True)
                row = np.where(np.isin(node, ends), at[np.minimum(np.searchsorted(ends, node), len(at) - 1)], other[np.minimum(np.searchsorted(more, node), len(other) - 1)])
                stand = {c: e[c].take(pa.array(row)) for c in ("k", *carry)}
                e = pa.table(stand | {"a": pa.array(node), "b": pa.array(least)}).select(e.column_names)
                held, rows = [e], e.num_rows
                if rows >= CHUNK // 8:  # little to gain: wait for as much again
                    rows = 0
        if held and sum(t.num_rows for t in held):
            yield out(pa.concat_tables(held))

    ends = edges.select(F.xxhash64(key).alias("k"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), *carry).filter("a <> b")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in edges.select(*carry).schema) if carry else ""
    return ends.repartition("k").sortWithinPartitions("k").mapInArrow(work, f"{kinds}node long, component long, size long")


def _minima(edges: DataFrame) -> tuple[DataFrame, int, int]:
    """(node, m, several, between) of the nodes whose edges are not those of a star, m their least neighbour, and how many
    have several smaller neighbours, and both smaller and larger ones."""
    arc = lambda x, y: F.struct(F.col(x).alias("node"), F.col(y).alias("next"))
    arcs = edges.select(F.explode(F.array(arc("a", "b"), arc("b", "a"))).alias("e")).select("e.*")
    below = F.when(F.col("next") < F.col("node"), F.col("next"))
    found = arcs.groupBy("node").agg(F.min(below).alias("m"), F.max(below).alias("top"), F.max("next").alias("hi"))
    several, between = F.col("m") < F.col("top"), F.col("hi") > F.col("node")
    found = found.filter(F.col("m").isNotNull() & (several | between)).select("node", "m", several.alias("several"), between.alias("between"))
    seen = Observation()
    found = cut(found.observe(seen, F.count_if("several").alias("s"), F.count_if("between").alias("b")))
    return found, seen.get["s"], seen.get["b"]


def _joined(edges: DataFrame, end: str, minima: DataFrame, rows: int) -> DataFrame:
    """edges with m of the node at this end, null where there is none. A long table of minima is joined by a shuffle in
    which each node is spread over parts, since one node may be on a third of all edges."""
    if rows <= BROADCAST:
        return edges.join(F.broadcast(minima.select(F.col("node").alias(end), "m")), end, "left")
    other = "b" if end == "a" else "a"
    salted = edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    spread = minima.select(F.col("node").alias(end), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return salted.join(spread, [end, "salt"], "left")


def _contracted(edges: DataFrame) -> tuple[DataFrame, int]:
    """Stars of each partition's edges, written to the checkpoint folder, and their number."""
    seen = Observation()
    out = cut(edges.mapInArrow(_contract, "a long, b long").observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node it reaches.

    Ends are longs. Null ends and loops are ignored, direction and repetition of an edge do not matter. The edges of a
    partition are contracted to stars before anything is shuffled; partitions are then put together until they hold
    about CHUNK edges, and contracted again, so a graph of CHUNK edges or less is done. Else each round finds the nodes
    that are not part of a star (one partial aggregate), and hands their least neighbour to their smaller neighbours
    (small star) or to their larger ones (large star) by a join with these nodes only, so the leaves of a large star are
    not moved. Edges and minima of a round are written to the checkpoint folder; it ends when all that is left are stars.
    """
    e, n = _contracted(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b"))
    small, parts = True, None
    for _ in range(max_rounds):
        if parts is None or 2 * n <= parts * CHUNK:
            parts = max(1, -(-n // CHUNK))
            e, n = _contracted(e.coalesce(parts))
            if parts == 1:
                break
        minima, several, between = _minima(e)
        if not several and not between:
            break
        small = bool(several) and (small or not between)
        if small:
            pairs = [(F.col("a"), F.coalesce("m", "b")), (F.col("b"), F.coalesce("m", "b"))]
            hit = _joined(e, "a", minima.filter("several"), several)
        else:
            pairs = [(F.col("a"), F.coalesce("m", "b"))]
            hit = _joined(e, "b", minima.filter("between"), between)
        moved = hit.select(F.explode(F.array(*[F.struct(x.alias("a"), y.alias("b")) for x, y in pairs])).alias("e")).select("e.*")
        e, n = _contracted(moved.filter("a <> b"))
        small = not small
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    node = F.explode(F.array("a", "b"))  # a star's centre comes once for each leaf
    return e.select("b", node.alias("node")).groupBy("node").agg(F.min("b").alias("component"))
