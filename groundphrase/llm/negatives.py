"""Hard-negative mining with bounds along a spanning tree of anchors.

Anchors are dealt into blocks, each with a minimum spanning tree of its vectors. A block of candidates meets a
block of anchors in one task. The tree's root is scored against all candidates; a child's score of a candidate differs
from its parent's by at most the length of the edge times the candidate's norm, which gives an interval. Only candidates
whose interval overlaps the window that the child asks for are scored, and their intervals shrink to points before they
are handed on to the next children.

Windows. Positives are the k best rows of the anchor's own label: their window begins at the k-th largest lower end of the
intervals. A positive of score p asks for negatives from low * p to high * p: its window lies between these, and begins at
the k-th largest lower end of the intervals that lie in it, if there are as many. Both begin with what is proven, so no
row is lost.

For positives rows are dealt by label, so only blocks of one label meet; for negatives by number, whatever their labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundphrase.llm.topk import EXACT
from groundphrase.operators.lineage import cut

#: Rows of a block of candidates and of anchors.
BLOCK, ANCHORS = 8192, 1024
TOP = (1 << 63) - 1


def _narrow(v: np.ndarray) -> bytes:
    """Integers as bytes of the narrowest kind, told by the first byte."""
    for kind in ("int16", "int32"):
        if not v.size or np.abs(v.astype("float64")).max() <= np.iinfo(kind).max:
            return kind[3:4].encode() + v.astype(kind).tobytes()
    return b"8" + v.tobytes()


def _wide(data: bytes, dim: int) -> np.ndarray:
    kind = {b"1": "int16", b"3": "int32", b"8": "int64"}[data[:1]]
    return np.frombuffer(data[1:], kind).astype("int64").reshape(-1, dim)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree from point 0: points in an order in which a parent comes before its
    children, each point's parent (-1 for the root) and its distance to it. One row of distances at a time."""
    n = len(points)
    near, parent = np.full(n, np.inf), np.zeros(n, "int64")
    order, edge, left = np.zeros(n, "int64"), np.zeros(n), np.ones(n, bool)
    parent[:1] = -1
    now = 0
    for i in range(n):
        order[i], left[now] = now, False
        away = np.sqrt(((points - points[now]) ** 2).sum(axis=1))
        closer = left & (away < near)
        near[closer], parent[closer] = away[closer], now
        now = int(np.where(left, near, np.inf).argmin())
        if i + 1 < n:
            edge[now] = near[now]
    return order, parent, edge


def _children(order: np.ndarray, parent: np.ndarray) -> list[list[int]]:
    """Children of each point, those with the largest subtrees last."""
    size = np.ones(len(order), "int64")
    for x in order[:0:-1]:
        size[parent[x]] += size[x]
    out: list[list[int]] = [[] for _ in order]
    for x in sorted(order[1:].tolist(), key=lambda x: size[x]):
        out[parent[x]].append(x)
    return out


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value; -inf if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


class Scores:
    """Intervals of the inner products of a block of candidates with one anchor after another, along a tree."""

    def __init__(self, v: np.ndarray, anchors: np.ndarray):
        big = max(np.abs(v.astype("float64")).max(initial=0), np.abs(anchors.astype("float64")).max(initial=0))
        self.kind = np.float64 if big < EXACT else object
        self.v, self.anchors = v.astype(self.kind), anchors.astype(self.kind)
        self.norm = np.sqrt((v.astype("float64") ** 2).sum(axis=1))
        self.rescored = 0

    def exact(self, anchor: int, at: np.ndarray | slice) -> np.ndarray:
        """Scores of some candidates; those beyond a long are the nearest long."""
        self.rescored += len(self.norm[at])
        out = self.v[at] @ self.anchors[anchor]
        return np.clip(out, -TOP - 1, TOP) if self.kind is object else out

    def walk(self, order: np.ndarray, parent: np.ndarray, edge: np.ndarray, overlapping) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, candidates, scores) of those candidates for whom overlapping(anchor, lo, hi) holds.

        Intervals of a point go when its last child, that with the largest subtree, has taken them: at most log2 of the
        anchors are held at a time.
        """
        below, none = _children(order, parent), np.zeros(0)
        stack = [(int(order[0]), none, none)] if len(order) else []
        while stack:
            x, lo, hi = stack.pop()
            if parent[x] < 0:
                at = np.arange(len(self.norm))
                score = self.exact(x, at)
                lo, hi = score.astype("float64"), score.astype("float64")
                wanted = np.flatnonzero(overlapping(x, lo, hi))
                yield x, wanted, score[wanted]
            else:
                wide = edge[x] * self.norm
                wide = wide + 1 + 1e-9 * (wide + np.abs(lo) + np.abs(hi))  # rounding
                lo, hi = lo - wide, hi + wide
                at = np.flatnonzero(overlapping(x, lo, hi))
                score = self.exact(x, at)
                lo[at] = hi[at] = score.astype("float64")
                yield x, at, score
            # the child with the largest subtree lies lowest: it is taken when all the others are done
            stack += [(c, lo, hi) for c in reversed(below[x])]


def _own(anchor_ids: np.ndarray, ids: np.ndarray) -> dict[int, np.ndarray]:
    """Candidates of the same id as an anchor, where there are any."""
    order = np.argsort(ids, kind="stable")
    lo, hi = (np.searchsorted(ids[order], anchor_ids, s) for s in ("left", "right"))
    return {i: order[a:b] for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)) if a < b}


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id), ties to the smaller id."""
    order = np.lexsort((ids, -score)) if score.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i])), "int64")
    return [(int(score[i]), int(ids[i])) for i in order[:k]]


def positives_of(candidates: tuple, anchors: tuple, k: int) -> list[tuple[int, int, int]]:
    """(anchor_id, vec_id, score): the k best candidates of each anchor in this block, rows of its own id aside."""
    (ids, _, v), (anchor_ids, _, a, *tree) = candidates, anchors
    own, out = _own(anchor_ids, ids), []

    def overlapping(x: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        free = np.ones(len(lo), bool)
        free[own.get(x, [])] = False
        return free & (hi >= _kth(lo[free], k))

    for x, at, score in Scores(v, a).walk(*tree, overlapping):
        out += [(int(anchor_ids[x]), n, s) for s, n in _best(ids[at], score, k)]
    return out


def negatives_of(candidates: tuple, anchors: tuple, asked: dict[int, list], k: int, low: int, high: int) -> list[tuple]:
    """(anchor_id, positive_id, nth, vec_id, positive_score, score): for each of an anchor's positives (asked: anchor id to
    rows of nth, positive_id, score) the k best candidates of this block of another label in its window, in hundredths of
    its score."""
    (ids, labels, v), (anchor_ids, anchor_labels, a, *tree) = candidates, anchors
    codes = pd.factorize(np.concatenate([labels, anchor_labels]))[0]
    codes, anchor_codes = codes[: len(ids)], codes[len(ids) :]
    own, out = _own(anchor_ids, ids), []

    def overlapping(x: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        hit, free = np.zeros(len(lo), bool), codes != anchor_codes[x]
        free[own.get(x, [])] = False
        for _, _, p in asked.get(int(anchor_ids[x]), ()):
            slack = 1 + abs(p) * 1e-12
            begin, end = low * p / 100 - slack, high * p / 100 + slack
            inside = free & (lo >= begin + 3 * slack) & (hi <= end - 3 * slack)
            hit |= (hi >= max(begin, _kth(lo[inside], k))) & (lo <= end)
        return hit & free

    for x, at, score in Scores(v, a).walk(*tree, overlapping):
        near = ids[at]
        for nth, positive, p in asked.get(int(anchor_ids[x]), ()):
            # whole numbers: low * p <= 100 * score <= high * p without rounding
            fit = np.flatnonzero((score >= -(-low * p // 100)) & (score <= high * p // 100))
            out += [(int(anchor_ids[x]), positive, nth, n, p, s) for s, n in _best(near[fit], score[fit], k)]
    return out


def _pack(dim: int, tree: bool):
    """Rows (kind, part, vec_id, label, v) sorted by kind and part become a row for each part; for anchors with their spanning
    tree."""

    def row(key: tuple, ids: list, labels: list, v: list) -> pa.RecordBatch:
        matrix = np.zeros((len(v), dim), "int64")
        for i, x in enumerate(v):
            matrix[i, : len(x)] = x
        columns = [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([np.array(ids, "int64").tobytes()], pa.binary()),
                   pa.array([labels], pa.list_(pa.string())), pa.array([_narrow(matrix)], pa.binary())]
        if tree:
            columns += [pa.array([x.tobytes()], pa.binary()) for x in spanning_tree(matrix.astype("float64"))]
        return pa.RecordBatch.from_arrays(columns, ["kind", "part", *(SENT if tree else SENT[:3])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for kind, part, *rest in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if (kind, part) != now and held:
                    yield row(now, *map(list, zip(*held, strict=True)))
                    held = []
                now = (kind, part)
                held.append(rest)
        if held:
            yield row(now, *map(list, zip(*held, strict=True)))

    return work


#: Columns of a block; a block of candidates has the first three.
SENT = ("ids", "labels", "v", "points", "parent", "edge")


def _block(data: list, dim: int) -> tuple:
    """Ids, labels and vectors of a block, and its spanning tree if it has one."""
    ids, labels, v, *tree = data
    kinds = ("int64", "int64", "float64")[: len(tree)]
    return np.frombuffer(ids, "int64"), np.array(labels, object), _wide(v, dim), *map(np.frombuffer, tree, kinds)


def _meet(dim: int, names: list[str], solve):
    """Rows of a block of candidates, a block of anchors and what else there is become solve(candidates, anchors, else)'s rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = [batch.column(c)[i].as_py() for c in range(batch.num_columns)]
                found = solve(_block(data[:3], dim), _block(data[3:9], dim), *data[9:])
                columns = list(zip(*found, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return work


def _blocks(rows: DataFrame, size: int, dim: int, tree: bool, by_label: bool) -> DataFrame:
    """Blocks of about `size` rows, of one label each (kind) or of any: (kind, part, ids, labels, v), with points, parent and
    edge for anchors. Rows are dealt by a hash over as many parts as their count asks for, so a label may hold any share.
    """
    number = F.xxhash64("vec_id", F.lit(13))
    if by_label:
        counts = rows.groupBy("label").agg(F.ceil(F.count("*") / size).cast("long").alias("parts"))
        dealt = rows.join(counts, "label").select(F.col("label").alias("kind"), F.pmod(number, F.col("parts")).alias("part"), "vec_id", "label", "v")
    else:
        parts = max(1, -(-rows.count() // size))
        dealt = rows.select(F.lit("").alias("kind"), F.pmod(number, F.lit(parts)).alias("part"), "vec_id", "label", "v")
    out = "kind string, part long, ids binary, labels array<string>, v binary" + ", points binary, parent binary, edge binary" * tree
    ordered = dealt.repartition("kind", "part").sortWithinPartitions("kind", "part", "vec_id")
    return cut(ordered.mapInArrow(_pack(dim, tree), out))


def labelled(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v): floor(256 * x) of each component as long, the label as a string."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(False))
    return vectors.filter(whole).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.transform(x, lambda c: F.floor(c * 256)).alias("v")
    )


def hard_negatives(
    vectors: DataFrame,
    is_anchor: str,
    k: int = 5,
    low: int = 80,
    high: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block: int = BLOCK,
    anchors: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its k best
    rows of the same label, the k best rows of other labels whose score is low to high hundredths of the positive's.

    is_anchor is a SQL condition on vec_id. Scores are inner products of floor(256 * x); ties go to the smaller id. Rows
    with a null id, label or vector, or a null or non-finite component, take no part; shorter vectors are filled up with
    0. A row's own id is neither its positive nor its negative; rows that repeat an id count each; an anchor whose id
    repeats is asked once, by its least label and vector. Scores beyond a long are the nearest long. Positives below 0
    have an empty window if low is less than high. Empty tables give an empty result; other columns play no part.
    """
    rows = cut(labelled(vectors, id_col, vector_col, label_col))
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return vectors.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    asked = rows.filter(F.expr(is_anchor)).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    sent = lambda df, *more: df.select(*more, *[F.col(c).alias(f"a_{c}") for c in SENT])

    own, its = _blocks(rows, block, dim, False, True), _blocks(asked, anchors, dim, True, True)
    same = own.select("kind", *SENT[:3]).join(sent(its, "kind"), "kind").drop("kind")
    names = ["anchor_id", "vec_id", "score"]
    near = same.mapInArrow(_meet(dim, names, lambda c, a: positives_of(c, a, k)), ", ".join(f"{n} long" for n in names))
    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    best = near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)

    every, all_anchors = _blocks(rows, block, dim, False, False), _blocks(asked, anchors, dim, True, False)
    member = all_anchors.select("part", "ids").mapInArrow(_members, "anchor_id long, a long")
    # what a block of anchors asks for: k rows an anchor at most
    lists = best.join(member, "anchor_id").groupBy("a").agg(F.collect_list(F.struct("anchor_id", "nth", "vec_id", "score")).alias("asked"))
    known = sent(all_anchors, F.col("part").alias("a")).join(lists, "a")
    parts = all_anchors.agg(F.max("part")).first()[0]
    # pairs of blocks by their numbers; vectors are sent after that
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts or 0).cast("long"))).alias("a")
    meet = every.select("part", *SENT[:3]).join(every.select("part", numbers).join(known, "a"), "part").drop("part", "a")

    def solve(c: tuple, a: tuple, wanted: list) -> list[tuple]:
        by: dict[int, list] = {}
        for r in wanted:
            by.setdefault(r["anchor_id"], []).append((r["nth"], r["vec_id"], r["score"]))
        return negatives_of(c, a, by, k, low, high)

    names = ["anchor_id", "positive_id", "nth", "negative_id", "positive_score", "negative_score"]
    found = meet.mapInArrow(_meet(dim, names, solve), ", ".join(f"{n} long" for n in names))
    order = Window.partitionBy("anchor_id", "nth").orderBy(F.col("negative_score").desc(), "negative_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(ids, "int64")
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), block, "int64"))], ["anchor_id", "a"])
