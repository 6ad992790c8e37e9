"""Near-duplicate classes by circulant MinHash, banding and exact Jaccard verification.

Signature. A hash of the shingle (the first permutation) gives its place on a ring of 2^32 places; coordinate k is the
least value that the second permutation has on these places after a circular shift by k steps. Two permutations
make all coordinates.

Banding. Rows per band are fixed; the number of bands follows from the threshold, so that a pair at the threshold
shares no band with probability `miss` at most. In each bucket every class is tied to the bucket's smallest class, a
partial aggregate and a join, so the number of ties is linear and a bucket may hold any share of all rows.

Verification. Classes that ties connect form a cluster; each true link lies inside one. Full shingle sets are taken
once more from the whole texts, only for documents in clusters, and dealt by cluster. A cluster that fits the bound is
solved by one index of its shingles: exact overlaps of a set with all others, for every set outside the largest
component. A cluster beyond the bound (buckets that chain unlike texts make such) is first split without loss: two sets that
link share one of their rarest shingles, if each takes as many as the threshold leaves room for (prefix filter), so sets that
share none of these fall apart. What is too large even then, true groups of very many near copies, is dealt as
pairs of blocks, and the components of the pieces are joined afterwards: no pair is lost, none is emitted unless it links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from groundphrase.llm.batches import slices
from groundphrase.llm.shingles import shingle_set
from groundphrase.operators.graph import components
from groundphrase.operators.lineage import cut

#: Rows of a band; chance to miss a pair at the threshold; shingles of the sets that one piece of a cluster holds.
BAND_ROWS, MISS, PIECE = 5, 1e-8, 4_000_000

_STEP, _C1, _C2 = np.uint32(0x9E3779B9), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def bands_for(threshold: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - threshold**rows))) if threshold < 1 else 1


def signature(shingles: np.ndarray, size: int, chunk: int = 256) -> np.ndarray:
    """Least values of the second permutation under `size` circular shifts; blocks that stay in the CPU's cache."""
    shift = (np.arange(size, dtype="uint32") * _STEP)[:, None]
    place = (shingles >> np.uint64(32)).astype("uint32")
    out = np.full(size, 0xFFFFFFFF, "uint32")
    for lo in range(0, len(place), chunk):
        x = place[None, lo : lo + chunk] + shift
        x ^= x >> np.uint32(16)
        x *= _C1
        x ^= x >> np.uint32(15)
        x *= _C2
        np.minimum(out, x.min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, words: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, sig): a narrow map over whole texts. set_key is equal for equal sets (128 bits)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, key, sig = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(signature(s, size).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "sig"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(work, "doc_id long, n_shingles long, set_key binary, sig binary")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(cluster, blocks, doc_id, set) of docs (cluster, blocks, doc_id, text): the set's sorted 64-bit hashes as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, words).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sets, pa.binary())], ["cluster", "blocks", "doc_id", "set"]
            )

    return docs.select("cluster", "blocks", "doc_id", "text").mapInArrow(
        work, "cluster long, blocks int, doc_id long, set binary"
    )


class Parts:
    """Components of sets: a label each, members relabelled with the smaller side of a union, and the largest so far."""

    def __init__(self, n: int):
        self.label, self.count, self.top = np.arange(n), np.ones(n, "int64"), 0
        self.members: dict[int, list[np.ndarray]] = {}

    def unite(self, a: int, b: int) -> None:
        a, b = (a, b) if self.count[a] >= self.count[b] else (b, a)
        moved = self.members.pop(b, [np.array([b])])
        for x in moved:
            self.label[x] = a
        self.members.setdefault(a, [np.array([a])]).append(np.concatenate(moved))
        self.count[a] += self.count[b]
        if self.count[a] > self.count[self.top] or self.top == b:
            self.top = a


def linked_parts(sets: list[np.ndarray], share: int) -> np.ndarray:
    """Component number of each set; two sets are linked if 100 * intersection >= share * union. Exact.

    Two sets that link share one of their rarest elements, if each takes as many as the share leaves room for; only
    these are indexed. A set meets those of other components in its elements' lists, and its overlaps with them are
    counted on the whole sets. A list whose sets are all in one component is closed. Sets are taken until all that are
    left are in the largest component: a link between components has an end outside it, and that end has been compared with all.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], "int64")
    owner = np.repeat(np.arange(n, dtype="int32"), sizes)
    number, freq = np.unique(np.concatenate([*sets, np.zeros(0, "uint64")]), return_inverse=True, return_counts=True)[1:]
    number = number[np.lexsort((number, freq[number], owner))]  # rarest first
    begin = np.concatenate([[0], np.cumsum(sizes)])
    room = np.where(sizes, sizes + (-share * sizes // 100) + 1, 0)
    rare = np.arange(len(number)) - begin[owner] < room[owner]
    order = np.argsort(number[rare], kind="stable")
    lists = owner[rare][order]  # sets by element
    starts, ends = (np.searchsorted(number[rare][order], np.arange(len(freq)), s) for s in ("left", "right"))
    closed, mark = np.zeros(len(freq), bool), np.zeros(len(freq), bool)
    parts = Parts(n)
    label = parts.label

    def spread(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)

    def compare(x: int) -> None:
        mine = number[begin[x] : begin[x] + room[x]]
        mine = mine[~closed[mine]]
        if not len(mine):
            return
        size = ends[mine] - starts[mine]
        found = lists[spread(starts[mine], size)]
        other = label[found] != label[x]
        closed[mine[np.add.reduceat(other, np.cumsum(size) - size, dtype="int64") == 0]] = True
        near = np.unique(found[other])
        near = near[100 * np.minimum(sizes[near], sizes[x]) >= share * np.maximum(sizes[near], sizes[x])]
        if not len(near):
            return
        own = number[begin[x] : begin[x + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[number[spread(begin[near], sizes[near])]], np.cumsum(sizes[near]) - sizes[near], dtype="int64")
        mark[own] = False
        for y in near[100 * both >= share * (sizes[near] + sizes[x] - both)].tolist():
            if label[y] != label[x]:
                parts.unite(int(label[x]), int(label[y]))

    central = np.bincount(owner, freq[number], n) if len(number) else np.zeros(n)
    turns, done = np.argsort(-central, kind="stable"), np.zeros(n, bool)
    while len(turns):
        for x in turns.tolist():
            if parts.count[label[x]] > 1 and label[x] == parts.top:
                continue
            done[x] = True
            compare(x)
        turns = turns[~done[turns] & (label[turns] != parts.top)]  # another component may be the largest now
    return label


def _solve(share: int):
    """For mapInArrow: rows (piece, doc_id, set) sorted by piece become ties (a, b) inside each piece."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ties(ids: list, sets: list) -> pa.RecordBatch:
            label, ids = linked_parts([np.frombuffer(s, "uint64") for s in sets], share), np.array(ids, "int64")
            order = np.lexsort((ids, label))
            first = np.concatenate([[True], label[order][1:] != label[order][:-1]])
            root = ids[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            keep = ids[order] != root
            return pa.RecordBatch.from_arrays([pa.array(ids[order][keep]), pa.array(root[keep])], ["a", "b"])

        piece, ids, sets = None, [], []
        for batch in batches:
            for p, d, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p != piece and ids:
                    yield ties(ids, sets)
                    ids, sets = [], []
                piece = p
                ids.append(d)
                sets.append(s)
        if ids:
            yield ties(ids, sets)

    return work


def with_blocks(clusters: DataFrame, sizes: DataFrame, piece: int = PIECE) -> DataFrame:
    """(doc_id, cluster, blocks): into how many blocks the sets of a cluster are dealt, from the sizes (rep, n_shingles)."""
    sized = clusters.join(sizes.select(F.col("rep").alias("doc_id"), "n_shingles"), "doc_id")
    total = sized.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / F.lit(piece // 2)).cast("int").alias("blocks"))
    return clusters.join(total, "cluster")


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, doc_id, set) with the set as a list of its hashes."""
    for batch in slices(batches):
        sets = [np.frombuffer(s, "int64") for s in batch.column(2).to_pylist()]
        ends = pa.array(np.cumsum([0, *map(len, sets)], dtype="int32"))
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sets, np.zeros(0, "int64")])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["cluster", "doc_id", "elements"])


def split_clusters(sets: DataFrame, share: int) -> DataFrame:
    """(doc_id, cluster): clusters of rows (cluster, doc_id, set) split by the prefix filter; sets that can link with none
    are left out.

    Of n shingles, rarest in the cluster first, a set takes n - ceil(n * share / 100) + 1. Sets that share one of those
    are tied to the smallest of them."""
    listed = sets.select("cluster", "doc_id", "set").mapInArrow(_elements, "cluster long, doc_id long, elements array<long>")
    rows = cut(listed.select("cluster", "doc_id", F.explode("elements").alias("e")))
    counts = cut(rows.groupBy("cluster", "e").agg(F.count("*").alias("n")))
    by_set = rows.join(counts, ["cluster", "e"]).groupBy("cluster", "doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("x"))
    room = (F.size("x") - F.floor((F.size("x") * share + 99) / 100) + 1).cast("int")
    rarest = cut(by_set.select("cluster", "doc_id", F.explode(F.slice("x", F.lit(1), room)).alias("x")).filter("x.n > 1").select("cluster", "doc_id", "x.e"))
    heads = rarest.groupBy("cluster", "e").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).filter("head < last")
    ties = rarest.join(cut(heads.drop("last")), ["cluster", "e"]).select("doc_id", "head")
    return components(ties, "doc_id", "head").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))


def verified_ties(sets: DataFrame, share: int) -> DataFrame:
    """(a, b): ties whose components are those of the links inside each cluster.

    Clusters of more than two blocks are dealt as pairs of blocks, each a piece.
    """
    placed = sets.withColumn(
        "block", F.when(F.col("blocks") <= 2, 0).otherwise(F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    )
    other = F.when(F.col("blocks") <= 2, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.withColumn("other", F.explode(other)).select(
        F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other")).alias("piece"), "doc_id", "set"
    )
    return dealt.repartition("piece").sortWithinPartitions("piece", "doc_id").mapInArrow(_solve(share), "a long, b long")


def _placed(clusters: DataFrame, sizes: DataFrame, piece: int) -> tuple[DataFrame, int]:
    """with_blocks(), written, and how many of its documents are in clusters of more than two blocks."""
    seen = Observation()
    out = cut(with_blocks(cut(clusters), sizes, piece).observe(seen, F.count_if(F.col("blocks") > 2).alias("n")))
    return out, seen.get["n"]


def near_classes(
    docs: DataFrame,
    words: int = 5,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = BAND_ROWS,
    miss: float = MISS,
    piece: int = PIECE,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs.

    Words are those of shingle_set(); linked documents share at least `threshold` of their union (hundredths).
    component_id is the smallest id reachable over links, the own id included. Null, empty and wordless texts have no
    shingles and link with nothing. A null id stays alone, with a null component, and is kept; rows that repeat an id
    are one document for the links, the row is returned as often as it came. Other columns play no part.
    """
    share, n_bands = round(threshold * 100), bands_for(threshold, rows, miss)
    sig = cut(signatures(docs, words, rows * n_bands, id_col, text_col))
    with_set = sig.filter("n_shingles > 0 and doc_id is not null")
    least = {c: F.min_by(c, "doc_id").alias(c) for c in ("n_shingles", "sig")}  # equal in all rows of a set_key
    classes = cut(with_set.groupBy("set_key").agg(F.min("doc_id").alias("rep"), *least.values()))
    width = 4 * rows
    band = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.lit(n_bands - 1)),
            lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width))),
        )
    )
    buckets = classes.select("rep", band.alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("rep").alias("head"), F.max("rep").alias("last"))
    heads = heads.filter("head < last").drop("last")
    tied = buckets.join(heads, "bucket").select("rep", "head")
    clusters = components(tied, "rep", "head").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    placed, large = _placed(clusters, classes, piece)
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets_of = lambda p: shingle_sets(whole.join(p, "doc_id").dropDuplicates(["doc_id", "text"]), words)
    if large:
        split = split_clusters(sets_of(placed.filter("blocks > 2")), share)
        placed = placed.filter("blocks <= 2").unionByName(_placed(split, classes, piece)[0])
    sets = sets_of(placed)
    member = with_set.select("doc_id", "set_key").join(classes.select("set_key", "rep"), "set_key").select("doc_id", "rep")
    # an id with several texts ties their classes together
    several = member.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).filter("b < last")
    same_id = member.join(several.select("doc_id", "b"), "doc_id").select(F.col("rep").alias("a"), "b")
    # written first: a second Python step in the same stage would hold a second worker for each core
    links = components(cut(verified_ties(sets, share)).unionByName(same_id)).select(
        F.col("node").alias("rep"), F.col("component").alias("root")
    )
    found = (
        member.join(links, "rep", "left")
        .select("doc_id", F.coalesce("root", "rep").alias("component_id"))
        .groupBy("doc_id")
        .agg(F.min("component_id").alias("component_id"))
    )
    return (
        sig.select("doc_id", "n_shingles")
        .join(found, "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
        )
    )


def drop_near_copies(
    docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with one document of each near-duplicate component, that of the smallest id; all columns as they are."""
    dropped = near_classes(docs, words, threshold, id_col, text_col).filter("not kept").select(
        F.col("doc_id").alias("_dropped_id")
    )
    dropped = dropped.distinct()
    return docs.join(dropped, docs[f"`{id_col}`"].cast("long") == dropped["_dropped_id"], "left_anti")
