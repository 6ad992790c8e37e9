"""Exact top-k inner products by pivot-table elimination.

With one more component, sqrt(M - |x|^2) for a candidate and 0 for a query, all candidates have the same length, and
the larger the inner product, the smaller the Euclidean distance: |q' - x'|^2 = |q|^2 + M - 2 q.x. A table of distances
from every candidate to many pivots is computed once, with the blocks of candidates. For a query the largest
|d(q', p) - d(x', p)| over the pivots p bounds its distance to x from below, so the inner product from above;
candidates are evaluated in the order of this bound until the k-th best score exceeds all bounds that are left.

Candidates and queries are dealt into blocks by their nearest pivot. A block of candidates has its least and greatest
distance to every pivot, a block of queries those of its queries and the least of their first thresholds. Pairs of blocks whose
bound cannot reach the threshold are dropped on these summaries, before any vector moves; the queries of the pairs that
are left are then sent to the candidates, which are shuffled once. A task holds one of each at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundphrase.llm.batches import slices
from groundphrase.operators.lineage import cut

#: Rows of a block of candidates and of queries; pivots; rows from which pivots and first thresholds are taken.
BLOCK, QUERY_BLOCK, PIVOTS, SAMPLE = 8192, 1024, 24, 1024
#: Components up to this size give inner products that doubles hold exactly; beyond it Python integers do.
EXACT = 1 << 22


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(256 * x) of each component as long. Rows with a null id, a null vector or a null or
    non-finite component are left out."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(False)))
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 256)).alias("v"))
    )


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """n points, each as far as can be from those before."""
    if not len(points):
        return points
    chosen = [0]
    near = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(points)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """Candidates with the component that makes them equally long."""
    return np.hstack([v, np.sqrt(np.maximum(longest - (v**2).sum(axis=1), 0))[:, None]])


def _matrix(rows: list, dim: int) -> np.ndarray:
    """Integer vectors as rows; shorter ones are filled up with 0."""
    out = np.zeros((len(rows), dim), "int64")
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _cells(dim: int, longest: float, pivots: np.ndarray):
    """Rows (vec_id, v) with the number of the nearest pivot, as (cell, vec_id, v)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            v = _matrix(batch.column(1).to_pylist(), dim).astype("float64")
            cell = distances(lifted(v, longest), pivots).argmin(axis=1) if len(pivots) else np.zeros(len(v), "int64")
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *batch.columns], ["cell", "vec_id", "v"])

    return work


def _blocks(dim: int, make):
    """Rows (block, vec_id, v) sorted by block become make(block, ids, matrix), a row for each block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows = None, [], []
        for batch in batches:
            for b, i, v in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if b != now and ids:
                    yield make(now, np.array(ids, "int64"), _matrix(rows, dim))
                    ids, rows = [], []
                now = b
                ids.append(i)
                rows.append(v)
        if ids:
            yield make(now, np.array(ids, "int64"), _matrix(rows, dim))

    return work


def _row(numbers: list, cells: list[np.ndarray], lists: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    columns = [*(pa.array([x]) for x in numbers), *(pa.array([c.tobytes()], pa.binary()) for c in cells)]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in lists)], names)


def _candidate_block(longest: float, pivots: np.ndarray):
    def make(block: int, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        table = distances(lifted(v.astype("float64"), longest), pivots)
        return _row([block], [ids, v, table], [table.min(axis=0), table.max(axis=0)], ["block", "ids", "vectors", "table", "lo", "hi"])

    return make


def _kind(*vectors: np.ndarray) -> type:
    return object if max(np.abs(v).max(initial=0) for v in vectors) >= EXACT else np.float64


def _query_block(longest: float, pivots: np.ndarray, seeds: np.ndarray, seed_ids: np.ndarray, k: int):
    """With first thresholds: a query's k-th best score among the seeds, a little less for rounding."""

    def make(block: int, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        q, kind = v.astype("float64"), _kind(v, seeds)
        table, square = distances(np.hstack([q, np.zeros((len(q), 1))]), pivots), (q**2).sum(axis=1)
        floors = np.full(len(ids), -math.inf)
        for i, own in enumerate(ids):
            best = np.sort(seeds[seed_ids != own].astype(kind) @ v[i].astype(kind))[::-1] if len(seeds) else []
            if len(best) >= k:
                floors[i] = float(best[k - 1]) - _slack(square[i], longest)
        numbers = [block, float(square.max(initial=0)), float(floors.min(initial=math.inf))]
        return _row(numbers, [ids, v, table, floors], [table.min(axis=0), table.max(axis=0)],
                    ["q", "square", "floor", "q_ids", "q_v", "q_table", "q_floors", "q_lo", "q_hi"])

    return make


def _slack(square: float, longest: float) -> float:
    return 1 + 1e-9 * (square + longest)


def best_of_block(
    q: np.ndarray, own: int, bound: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, floor: float, step: int = 256
) -> list[tuple[int, int]]:
    """The k best (score, id) of a block for one query, ties to the smaller id; fewer if the rest can't reach `floor`.

    Candidates are taken in the order of their bounds until the k-th best score, or floor, exceeds the next bound.
    """
    live = np.flatnonzero((bound >= floor) & (ids != own))
    live = live[np.argsort(-bound[live], kind="stable")]
    score, best_ids = np.zeros(0, q.dtype), np.zeros(0, "int64")
    for at in range(0, len(live), step):
        kth = max(floor, float(score[k - 1])) if len(score) >= k else floor
        if bound[live[at]] < kth:
            break
        part = live[at : at + step]
        score = np.concatenate([score, v[part] @ q])
        best_ids = np.concatenate([best_ids, ids[part]])
        order = np.lexsort((best_ids, -score))[:k]
        score, best_ids = score[order], best_ids[order]
    top = (1 << 63) - 1
    return [(max(-top - 1, min(top, int(s))), int(i)) for s, i in zip(score, best_ids, strict=True)]


def _search(dim: int, longest: float, n_pivots: int, k: int):
    """Rows of a candidate block and a query block become each query's best candidates of the block."""
    kinds = ("int64", "int64", "float64", "int64", "int64", "float64", "float64")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, v, table, q_ids, q_v, q_table, floors = (np.frombuffer(batch.column(c)[row].as_py(), t) for c, t in enumerate(kinds))
                v, q_v = v.reshape(len(ids), dim), q_v.reshape(len(q_ids), dim)
                table, q_table = table.reshape(len(ids), n_pivots), q_table.reshape(len(q_ids), n_pivots)
                kind = _kind(v, q_v)
                exact_v, exact_q = v.astype(kind), q_v.astype(kind)
                square = (q_v.astype("float64") ** 2).sum(axis=1)
                out: list[tuple[int, int, int]] = []
                for i, own in enumerate(q_ids):
                    apart = np.abs(table - q_table[i]).max(axis=1) if n_pivots else np.zeros(len(ids))
                    bound = (square[i] + longest - apart**2) / 2 + _slack(square[i], longest)
                    out += [(int(own), n, s) for s, n in best_of_block(exact_q[i], own, bound, exact_v, ids, k, float(floors[i]))]
                columns = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return work


def near_blocks(candidates: DataFrame, queries: DataFrame, n_queries: int, longest: float) -> DataFrame:
    """(block, q): the pairs of blocks in which a candidate may reach a query's threshold, from the blocks' summaries.

    Each summary of a candidate block meets each of a query block; there are rows / block of the one kind."""
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long")))
    pairs = candidates.select("block", "lo", "hi", numbers.alias("q")).join(queries.select("q", "q_lo", "q_hi", "square", "floor"), "q")
    less = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: x - y))
    apart = F.greatest(F.lit(0.0), less("lo", "q_hi"), less("q_lo", "hi"))
    bound = (F.col("square") + longest - apart * apart) / 2 + 1 + (F.col("square") + longest) * 1e-9
    return pairs.filter(bound >= F.col("floor")).select("block", "q")


def top_k(
    vectors: DataFrame,
    is_query: str,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products among all rows of another id.

    is_query is a SQL condition on vec_id. Ties go to the smaller vec_id, and a row that is there twice counts twice.
    Vectors that are null, or hold a null or non-finite component, take no part, nor do null ids; a query whose id
    repeats is asked once, with its least vector; shorter vectors are filled up with 0. Scores beyond a long are the
    nearest long. Empty tables give an empty result; other columns play no part.
    """
    rows = cut(quantised(vectors, id_col, vector_col))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    dim, longest = rows.agg(F.max(F.size("v")), F.max(square)).first()
    dim, longest = dim or 0, longest or 0.0
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()  # bounded: pivots and thresholds
    seeds, seed_ids = _matrix([r.v for r in sample], dim), np.array([r.vec_id for r in sample], "int64")
    pivots = farthest_first(lifted(seeds.astype("float64"), longest), PIVOTS)

    def blocks(df: DataFrame, size: int, make, kind: str) -> tuple[DataFrame, int]:
        """Blocks of about `size` rows, none across cells, and how many there are."""
        placed = cut(df.mapInArrow(_cells(dim, longest, pivots), "cell long, vec_id long, v array<long>"))
        counts = {r["cell"]: -(-r["count"] // size) for r in placed.groupBy("cell").count().collect()}  # a row a pivot
        first = {c: sum(counts[x] for x in counts if x < c) for c in counts}
        here = spark.createDataFrame([(c, first[c], counts[c]) for c in counts], "cell long, first long, parts long")
        number = F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("parts"))
        dealt = placed.join(F.broadcast(here), "cell").select(number.alias("block"), "vec_id", "v")
        dealt = dealt.repartition("block").sortWithinPartitions("block", "vec_id")
        return cut(dealt.mapInArrow(_blocks(dim, make), kind)), sum(counts.values())

    spark = vectors.sparkSession
    ends = "lo array<double>, hi array<double>"
    c, _ = blocks(rows, block, _candidate_block(longest, pivots), f"block long, ids binary, vectors binary, table binary, {ends}")
    queries = rows.filter(F.expr(is_query)).groupBy("vec_id").agg(F.min("v").alias("v"))
    q, n_queries = blocks(queries, query_block, _query_block(longest, pivots, seeds, seed_ids, k),
                          "q long, square double, floor double, q_ids binary, q_v binary, q_table binary, q_floors binary, q_lo array<double>, q_hi array<double>")
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pairs = near_blocks(c, q, n_queries, longest)
    asked = pairs.join(q.select("q", "q_ids", "q_v", "q_table", "q_floors"), "q")
    found = c.select("block", "ids", "vectors", "table").join(asked, "block").select(
        "ids", "vectors", "table", "q_ids", "q_v", "q_table", "q_floors"
    ).mapInArrow(_search(dim, longest, len(pivots), k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
