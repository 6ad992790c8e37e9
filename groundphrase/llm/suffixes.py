"""Removal of long repeated byte strings by column-wise suffix sorting of many texts.

Which texts. Every window of `window` bytes has an anchor: of its runs of `anchor` bytes that of the least hash, the leftmost of
ties; equal windows have equal anchors at equal places. The windows that share one occurrence of an anchor make a segment,
and a window can only be repeated in segments of the same anchor. Anchors that occur once in all documents are left out;
of equal segments one is taken, with their number as its weight.

Columns. The segments of an anchor lie one below the other with their anchors in line. Suffixes are sorted from the last
column to the first: a round inserts one symbol of each segment before the suffix that the round before has ranked. The symbols
in the order of these suffixes are the round's block of the Burrows-Wheeler transform; sorting them stably by symbol
gives the new order, and the common prefix of new neighbours is one more than the least of those between their old places.
A round reads the block of the round before and writes its own, one after the other, so a group needs what two
columns hold, and the work is linear in its bytes. Neighbours with `window` or more bytes in common start equal windows;
where their segments weigh two or more together, the window is a repeat.

Groups. All segments of an anchor are sorted in one task, up to `group` bytes of different segments. An anchor that has more
(a very common run in very many surroundings) is dealt by its whole windows, named by 128 bits and counted in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundphrase.llm.shingles import mix64, rolling
from groundphrase.operators.lineage import cut

#: Bytes of a window and of an anchor; bytes of different segments of one anchor that a task sorts; bytes hashed at once.
WINDOW, ANCHOR, GROUP, AT_ONCE = 400, 128, 32 << 20, 1 << 18
#: Codes of bytes for hashes, and the base of their polynomial.
CODES, BASE = mix64(np.arange(1, 257, dtype="uint64")), 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 20) - 1)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` consecutive bytes, by doubling."""
    if len(data) < size:
        return np.zeros(0, "uint64")
    out, done, power, bit = None, 0, CODES[data], 1
    while True:
        if size & bit:
            out = power if out is None else out[: len(data) - done - bit + 1] * np.uint64(pow(BASE, bit, 1 << 64)) + power[done:]
            done += bit
        if done == size:
            return mix64(out[: len(data) - size + 1])
        power = power[: len(power) - bit] * np.uint64(pow(BASE, bit, 1 << 64)) + power[bit:]
        bit *= 2


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every `size` consecutive values."""
    bit = 1
    while 2 * bit <= size:
        values = np.minimum(values[:-bit], values[bit:])
        bit *= 2
    return np.minimum(values[: len(values) - (size - bit)], values[size - bit :])


def segments(data: np.ndarray, begin: np.ndarray, size: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, key, first, last, place) of the segments of texts that lie in data: hash of the anchor, first and last window,
    place of the anchor; places in data. For up to 2 ** 20 bytes."""
    count = np.maximum(size - window + 1, 0)
    if not count.sum():
        return (np.zeros(0, "int64"),) * 5
    hashes = gram_hashes(data, anchor)
    packed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype="uint64")
    text = np.repeat(np.arange(len(size)), count)
    start = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
    place = (_least(packed, window - anchor + 1)[start] & _PLACE).astype("int64")
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
    last = np.append(first[1:], len(place)) - 1
    return text[first], hashes[place[first]].view("int64"), start[first], start[last], place[first]


def _piles(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows of up to `most` bytes; a longer row is alone."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _occurrences(window: int, anchor: int, most: int):
    """Rows (d, t, text) become (d, t, key, d1, d2, size, at, starts): each different segment once a document, by its digest."""

    def found(text: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """Segments of a pile, or of stretches of one long text: (row, key, first, last, place), and the bytes they lie in."""
        whole = b"".join(text)
        size = np.array([len(x) for x in text], "int64")
        if len(whole) <= _PLACE:
            yield *segments(np.frombuffer(whole, "uint8"), np.cumsum(size) - size, size, window, anchor), np.cumsum(size) - size, whole
            return
        # windows of the largest places of one stretch start in the next: cut between two anchors, so no segment is cut
        lo = 0
        while lo + window <= len(whole):
            part = np.frombuffer(whole, "uint8", min(most, len(whole) - lo), lo)
            row, key, first, last, place = segments(part, np.zeros(1, "int64"), np.array([len(part)]), window, anchor)
            n = len(row) if lo + len(part) == len(whole) else np.searchsorted(first, first[-1])
            n = max(int(n), 1)
            yield row[:n], key[:n], first[:n] + lo, last[:n] + lo, place[:n] + lo, np.zeros(1, "int64"), whole
            lo += int(last[n - 1]) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(2).cast(pa.binary())]
            for lo, hi in _piles(sizes, AT_ONCE):
                part = batch.slice(lo, hi - lo)
                text = [(x or "").encode() for x in part.column(2).to_pylist()]
                for row, key, first, last, place, begin, whole in found(text):
                    if not len(row):
                        continue
                    digest = b"".join([hashlib.blake2b(whole[a : b + window], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)])
                    d1, d2 = np.frombuffer(digest, "int64").reshape(-1, 2).T
                    order = np.lexsort((first, d2, d1, key, row))
                    cells = np.stack([row, key, d1, d2])[:, order]
                    new = np.flatnonzero(np.append(True, (cells[:, 1:] != cells[:, :-1]).any(axis=0)))
                    at = order[new]
                    ends = pa.array(np.append(new, len(order)).astype("int32"))
                    starts = pa.ListArray.from_arrays(ends, pa.array((first - begin[row])[order].astype("int32")))
                    given = [part.column(c).take(pa.array(row[at])) for c in (0, 1)]
                    more = [pa.array(x) for x in (key[at], d1[at], d2[at], (last - first)[at].astype("int32") + window, (place - first)[at].astype("int32"))]
                    yield pa.RecordBatch.from_arrays([*given, *more, starts], ["d", "t", "key", "d1", "d2", "size", "at", "starts"])

    return work


class Columns:
    """Segments sorted column by column, from the last to the first, inside their groups.

    A round gives (x, order, symbols, common): the column (0 is where the anchors begin); the segments that reach it, sorted by
    group and by their suffixes from it; what stands there, in the order of the suffixes one column later, the
    transform's block; and the bytes that each suffix has in common with the one before it, counted up to `most`.
    """

    def __init__(self, texts: list[bytes], at: np.ndarray, group: np.ndarray, most: int):
        self.size = np.array([len(t) for t in texts], "int64")
        self.data = np.frombuffer(b"".join(texts), "uint8")
        self.origin = np.cumsum(self.size) - self.size + at  # of column 0
        self.at, self.group, self.most = at, group.astype("int64"), most

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        if not len(self.size):
            return
        end = self.size - self.at
        coming = np.argsort(-end, kind="stable")
        come = np.searchsorted(-end[coming], -np.arange(end.max() + 1), "right")  # how many reach a column's end
        leave = np.sort(self.at)
        order, common, n = np.zeros(0, "int64"), np.zeros(0, "int16"), 0
        for x in range(int(end.max()) - 1, -int(self.at.max()) - 1, -1):
            if x < 0 and leave[0] < -x and len(order):
                stay = np.flatnonzero(self.at[order] >= -x)
                if len(stay) < len(order):
                    common = np.minimum.reduceat(common[: stay[-1] + 1], np.append(0, stay[:-1] + 1)) if len(stay) else common[:0]
                    order = order[stay]
            more = int(come[x + 1]) if x >= -1 else len(coming)
            new = 0
            if more > n:  # their suffixes are empty by now: the first of their groups, with nothing in common
                new = more - n
                order = np.concatenate([coming[n:more], order])
                common = np.concatenate([np.zeros(new, "int16"), common])
                n = more
            symbols = self.data[self.origin[order] + x]
            cell = self.group[order] * 256 + symbols
            to = np.argsort(cell, kind="stable")
            cell = cell[to]
            same = np.append(False, cell[1:] == cell[:-1])
            least = np.append(common, np.int16(0))[to]  # neighbours that were neighbours
            gap = np.flatnonzero(same & (np.append(0, to[:-1]) + 1 != to))
            if len(gap):
                ends = np.stack([to[gap - 1] + 1, to[gap] + 1], axis=1).ravel()
                known = np.minimum.reduceat(np.append(common, np.int16(0)), ends)[::2]
                least[gap] = np.where(to[gap - 1] < new, 0, known)
            common = np.where(same, np.minimum(least + 1, self.most), 0).astype("int16")
            order = order[to]
            yield x, order, symbols, common


def repeated_starts(texts: list[bytes], at: np.ndarray, group: np.ndarray, weight: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the texts start in others of their group, too (or in this one, if it weighs more than one), as one
    array of booleans, and where each text's windows begin in it."""
    columns = Columns(texts, at, group, window)
    count = np.maximum(columns.size - window + 1, 0)
    base = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), bool)
    for x, order, _, common in columns:
        apart = np.flatnonzero(common < window)
        total = np.add.reduceat(weight[order], apart) if len(apart) else weight[:0]
        hit = order[np.repeat(total >= 2, np.diff(np.append(apart, len(order))))]
        hit = hit[x + at[hit] < count[hit]]
        out[base[hit] + x + at[hit]] = True
    return out, base


def _runs(flags: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last) of the runs of marked windows, inside each text."""
    place = np.flatnonzero(flags)
    text = np.searchsorted(base, place, "right") - 1
    new = np.flatnonzero(np.append(True, (np.diff(place) > 1) | (np.diff(text) > 0))[: len(place)])
    last = np.append(new[1:], len(place))[: len(new)] - 1
    return text[new], place[new] - base[text[new]], place[last] - base[text[new]]


def _sorted_groups(window: int, at_once: int):
    """Rows (key, d1, d2, weight, at, text) sorted by key become (key, d1, d2, first, last); whole groups at a time."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        key, d1, d2, weight, at, texts = (list(c) for c in zip(*rows, strict=True))
        group = np.cumsum(np.append(0, np.diff(np.array(key, "int64")) != 0))
        # two copies are as good as many
        weights = np.minimum(np.array(weight, "int64"), 2)
        text, first, last = _runs(*repeated_starts(texts, np.array(at, "int64"), group, weights, window))
        ids = [np.array(c, "int64")[text] for c in (key, d1, d2)]
        return pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(first), pa.array(last)], ["key", "d1", "d2", "first", "last"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= at_once and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield solve(held)

    return work


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted) become (key, d1, d2, weight, at, text, large): the bytes of the wanted segments."""
    names = ("key", "d1", "d2", "weight", "at", "text", "large")
    for batch in batches:
        for i in range(batch.num_rows):
            wanted = batch.column(1)[i].as_py()
            if not wanted:
                continue
            whole = batch.column(0)[i].as_py().encode()
            rows = [(w["key"], w["d1"], w["d2"], w["weight"], w["at"], whole[w["start"] : w["start"] + w["size"]], w["large"]) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)


def _named_windows(window: int):
    """Rows (key, d1, d2, weight, at, text) become (n1, n2, key, d1, d2, weight, offset), a row for each window."""
    second = mix64(CODES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, d1, d2, weight, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(text, "uint8")
                names = [rolling(codes[data], window).view("int64") for codes in (CODES, second)]
                n = len(names[0])
                same = [pa.array(np.full(n, v, "int64")) for v in (key, d1, d2, weight)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, names), *same, pa.array(np.arange(n))], ["n1", "n2", "key", "d1", "d2", "weight", "offset"])

    return work


def repeated_windows(slim: DataFrame, window: int, anchor: int, group: int) -> DataFrame:
    """(d, t, runs array<struct<first, last>>) of rows (d, t, text): runs of window starts whose windows also start elsewhere,
    once a document for each anchor that it has."""
    kind = "d long, t long, key long, d1 long, d2 long, size int, at int, starts array<int>"
    every = cut(slim.select("d", "t", "text").mapInArrow(_occurrences(window, anchor, 1 << 19), kind))
    shared = cut(every.groupBy("key").agg(F.sum(F.size("starts")).alias("n")).filter("n > 1").select("key"))
    some = cut(every.join(shared, "key"))  # written tables on both sides: adaptive execution can split a hot anchor
    start = F.struct("d", "t", F.element_at("starts", 1).alias("start"))
    segment = ["key", "d1", "d2"]
    classes = cut(some.groupBy(*segment).agg(F.sum(F.size("starts")).alias("weight"), F.min(start).alias("x"), F.min("size").alias("size"), F.min("at").alias("at")))
    large = cut(classes.groupBy("key").agg(F.sum("size").alias("n")).filter(F.col("n") > group).select("key", F.lit(True).alias("large")))
    any_large = not large.isEmpty()
    told = classes.join(large, "key", "left") if any_large else classes.withColumn("large", F.lit(False))
    row = F.struct(*segment, "weight", "at", F.col("x.start").alias("start"), "size", F.coalesce("large", F.lit(False)).alias("large"))
    wanted = told.groupBy("x.d", "x.t").agg(F.collect_list(row).alias("wanted"))
    # left, so that this exchange of the texts is the one that the last join uses, too
    known = slim.join(wanted, ["d", "t"], "left").select("text", "wanted")
    texts = known.mapInArrow(_texts_of, "key long, d1 long, d2 long, weight long, at long, text binary, large boolean")
    texts = cut(texts) if any_large else texts
    fields = [*segment, "weight", "at", "text"]
    small = texts.filter("not large") if any_large else texts
    dealt = small.select(*fields).repartition("key").sortWithinPartitions("key")
    marked = dealt.mapInArrow(_sorted_groups(window, 4 << 20), "key long, d1 long, d2 long, first long, last long")
    run = F.struct("first", "last")
    if any_large:
        named = cut(texts.filter("large").select(*fields).mapInArrow(_named_windows(window), "n1 long, n2 long, key long, d1 long, d2 long, weight long, offset long"))
        twice = cut(named.groupBy("n1", "n2").agg(F.sum("weight").alias("n")).filter("n > 1").select("n1", "n2"))
        whole = named.join(twice, ["n1", "n2"]).select(*segment, F.col("offset").alias("first"), F.col("offset").alias("last"))
        marked = marked.unionByName(whole)
    marks = marked.groupBy(*segment).agg(F.collect_list(run).alias("marks"))
    shifted = F.transform("starts", lambda s: F.transform("marks", lambda m: F.struct((m["first"] + s).alias("first"), (m["last"] + s).alias("last"))))
    return some.join(cut(marks), segment).select("d", "t", F.flatten(shifted).alias("runs"))


def _apply(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, runs in zip(*(batch.column(c) for c in range(3)), strict=True):
                data = (text.as_py() or "").encode()
                size, gone, spans = len(data), 0, 0
                if runs.is_valid:
                    ends = runs.values.flatten()
                    edge = np.zeros(size + 1, "int64")
                    np.add.at(edge, ends[0].to_numpy(), 1)
                    np.add.at(edge, ends[1].to_numpy() + window, -1)
                    out = np.cumsum(edge)[:-1] > 0
                    gone = int(out.sum())
                    spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
                    data = np.frombuffer(data, "uint8")[~out].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()], pa.int64()), *(pa.array([n], pa.int64()) for n in (size, gone, spans)), pa.array([data], pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return work


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the bytes that no repeated window covers, one row per row of docs.

    A window is `window` bytes of one text in UTF-8; it is repeated if the same bytes start anywhere else, in the same text or
    another; windows are those of the input. n_spans counts maximal removed runs. kept is binary: a cut may fall inside a
    character. Null texts are empty; texts shorter than a window stay. Rows that repeat an id are texts of their own, and
    equal ones repeat each other; a null id is as good as any. Other columns play no part. An empty table gives an
    empty result.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d")
    text = F.col(text_col).alias("text")
    slim = docs.select(key, F.xxhash64(F.col(text_col), F.col(id_col).isNull()).alias("t"), F.col(id_col).cast("long").alias("doc_id"), text)
    marks = repeated_windows(slim, window, anchor, group).groupBy("d", "t").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    whole = slim.join(marks, ["d", "t"], "left").select("doc_id", "text", "runs")
    return whole.mapInArrow(_apply(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
