"""Substring deduplication with prefix-partitioned suffix trees.

Which suffixes. A window of `window` words holds window - anchor + 1 runs of `anchor` words; the one of the least hash
is its anchor (leftmost of ties), and equal windows have equal anchors. Anchors are about one word in twenty, so
counting them in all documents is cheap; a window whose anchor stands in one document only repeats nowhere else, and
its suffix is a lone leaf that no tree needs.

Partition by prefixes. The suffixes of the windows around an anchor share the anchor's words. Where at most `group`
places share them, they are one group. Where more do, the common words grow: windows that start up to half way before
the anchor share the words after it, the others those before it, about `window - (window - anchor) / 2` words. Where still more
than `group` places share these, they grow to the whole window: then the group is one leaf class of which only the
smallest document matters, which a partial aggregate finds. So the length of the prefix varies with what fits into
memory; counts are of places, in however few documents.

Trees. The words of a group are numbered (exactly, by their bytes), all suffixes of its texts are ranked by depth
doubling, the suffixes that start windows are sorted by rank, and the common prefix of neighbours is measured on the words'
numbers. Runs of neighbours with at least `window` words in common are the leaves under one deep node; the node's
smallest document is its owner, and the windows of other documents under it are marked. Hashes choose the group only;
they decide nothing in it. Classes of whole windows have 128-bit names. Every word that a marked window covers goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundphrase.llm.batches import slices
from groundphrase.llm.shingles import mix64, rolling, word_hashes
from groundphrase.operators.lineage import cut

#: Words of an anchor; places that a group may hold before its prefix grows.
ANCHOR, GROUP = 8, 4096
#: Key of the second of two hashes that name a whole window.
SECOND = "fedcba9876543210"


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+, unchanged."""
    return (text or "").encode("utf-8").split()


def _longer(grams: np.ndarray, at: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """Hashes of the `length` words at some places, from those of the runs of `anchor` words that cover them."""
    out = grams[at]
    for step in [*range(anchor, length - anchor, anchor), length - anchor]:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + grams[at + step])
    return out.view("int64")


class Anchors:
    """Runs of a document's windows that share an anchor, by first window: key (hash of the anchor's words), place of the
    anchor, first and last window, and the hashes of the longer prefixes of the windows that start up to `half` words
    before the anchor (`near`) and of those that start earlier (`far`); 0 where there are no such windows."""

    def __init__(self, words: list[bytes], window: int, anchor: int = ANCHOR):
        self.window, self.half = window, (window - anchor) // 2
        none = np.zeros(0, "int64")
        self.key = self.near = self.far = self.place = self.first = self.last = none
        if len(words) < window:
            return
        hashes = word_hashes(words)
        grams = rolling(hashes, anchor)
        order = mix64(grams)  # hashes of neighbouring runs are independent; one more mix keeps common words out of the order
        view = np.lib.stride_tricks.sliding_window_view(order, window - anchor + 1)
        place = np.empty(len(view), "int64")
        for lo in range(0, len(view), 4096):
            place[lo : lo + 4096] = view[lo : lo + 4096].argmin(axis=1)
        place += np.arange(len(view))
        self.first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        self.last = np.append(self.first[1:], len(view)) - 1
        self.place = place[self.first]
        self.key = grams[self.place].view("int64")
        has_near, has_far = self.last >= self.place - self.half, self.first < self.place - self.half
        self.near, self.far = np.zeros(len(self.key), "int64"), np.zeros(len(self.key), "int64")
        self.near[has_near] = _longer(grams, self.place[has_near], window - self.half, anchor)
        self.far[has_far] = _longer(grams, self.place[has_far] - self.half - 1, self.half + 1 + anchor, anchor)

    def runs(self, known: list[int], longer: bool) -> Iterator[tuple[int, int, int]]:
        """(key, first, last window) of the runs with these keys: of anchors, or of their longer prefixes."""
        wanted = np.array(known, "int64")
        if not longer:
            for i in np.flatnonzero(np.isin(self.key, wanted)):
                yield int(self.key[i]), int(self.first[i]), int(self.last[i])
            return
        for i in np.flatnonzero(np.isin(self.near, wanted) & (self.near != 0)):
            yield int(self.near[i]), int(max(self.first[i], self.place[i] - self.half)), int(self.last[i])
        for i in np.flatnonzero(np.isin(self.far, wanted) & (self.far != 0)):
            yield int(self.far[i]), int(self.first[i]), int(min(self.last[i], self.place[i] - self.half - 1))


def _anchor_rows(window: int, anchor: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = Anchors(words_of(text) if doc is not None else [], window, anchor)
                order = np.lexsort((x.far, x.near, x.key))
                rows = np.stack([x.key, x.near, x.far])[:, order]
                new = np.flatnonzero(np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0))[: len(order)])
                found.append((*rows[:, new], np.diff(np.append(new, len(order)))))
            ends = pa.array(np.cumsum([0, *(len(f[0]) for f in found)], dtype="int32"))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c))) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "anchor", "near", "far", "places"])

    return work


def _texts_at(window: int, anchor: int):
    """Rows (doc_id, text, anchors, longer) become (key, doc_id, start, words): the text of each run of windows at these
    anchors or longer prefixes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            docs, short, longer = (batch.column(c).to_pylist() for c in (0, 2, 3))
            for row, doc in enumerate(docs):
                if not short[row] and not longer[row]:
                    continue
                words = words_of(batch.column(1)[row].as_py())
                x = Anchors(words, window, anchor)
                for known, grown in ((short[row], False), (longer[row], True)):
                    for key, lo, hi in x.runs(known or [], grown):
                        out.append((key, doc, lo, b" ".join(words[lo : hi + window])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "doc_id", "start", "words"])

    return work


def _whole_windows(window: int, anchor: int):
    """Rows (doc_id, text, keys) become (name, check, doc_id, places): each different window at these longer prefixes once
    a document, with all its places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for row, keys in enumerate(batch.column(2).to_pylist()):
                if not keys:
                    continue
                words = words_of(batch.column(1)[row].as_py())
                runs = list(Anchors(words, window, anchor).runs(keys, True))
                place = np.unique(np.concatenate([np.arange(lo, hi + 1) for _, lo, hi in runs] + [np.zeros(0, "int64")]))
                name, check = (rolling(h, window).view("int64")[place] for h in (word_hashes(words), word_hashes(words, SECOND)))
                order = np.lexsort((place, check, name))
                name, check, place = name[order], check[order], place[order]
                new = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (check[1:] != check[:-1]))[: len(name)])
                ends = pa.array(np.append(new, len(name)).astype("int32"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[new]), pa.array(check[new]), pa.array(np.full(len(new), batch.column(0)[row].as_py(), "int64")),
                     pa.ListArray.from_arrays(ends, pa.array(place))],
                    ["name", "check", "doc_id", "places"],
                )

    return work


class SuffixForest:
    """Suffixes of texts (lists of words), ranked by depth doubling: level k names the first 2**k words of each suffix, or
    all its words where the text ends before. Equal numbers are equal words: nothing is hashed."""

    def __init__(self, texts: list[list[bytes]]):
        self.size = np.array([len(t) for t in texts], "int64")
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype("int64")
        cells = np.empty(int(self.size.sum()), object)
        cells[:] = [w for t in texts for w in t]
        self.left = np.repeat(self.begin + self.size, self.size) - np.arange(len(cells))  # words up to the text's end
        self.levels = [pd.factorize(cells)[0].astype("int64") + 1]
        while 1 << len(self.levels) < 2 * self.size.max(initial=0):
            step, rank = 1 << (len(self.levels) - 1), self.levels[-1]
            after = np.zeros(len(rank), "int64")
            more = np.flatnonzero(self.left > step)
            after[more] = rank[more + step]
            self.levels.append(np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1] + 1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b have in common at their start."""
        out, a, b = np.zeros(len(a), "int64"), a.copy(), b.copy()
        left = np.minimum(self.left[a], self.left[b])
        for k in range(len(self.levels) - 1, -1, -1):
            on = np.flatnonzero(out + (1 << k) <= left)
            on = on[self.levels[k][a[on] + out[on]] == self.levels[k][b[on] + out[on]]]
            out[on] += 1 << k
        return out


def deep_nodes(forest: SuffixForest, group: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a group (a number for each suffix in starts) in the order of their words, and for each of them the
    deep node that it is a leaf of: neighbours with `window` or more words in common have the same."""
    order = np.lexsort((forest.levels[-1][starts], group))
    g, s = group[order], starts[order]
    apart = np.ones(len(order), bool)
    apart[1:] = (g[1:] != g[:-1]) | (forest.common(s[:-1], s[1:]) < window)
    return order, np.cumsum(apart) - 1


def marked_windows(key: np.ndarray, doc: np.ndarray, texts: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset in it) of the windows whose words also start a window of a smaller document in a text of the same key."""
    forest = SuffixForest(texts)
    count = np.maximum(forest.size - window + 1, 0)
    text = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    order, node = deep_nodes(forest, key[text], forest.begin[text] + offset, window)
    owner = np.full(node[-1] + 1 if len(node) else 0, np.iinfo("int64").max)
    np.minimum.at(owner, node, doc[text[order]])
    hit = order[owner[node] < doc[text[order]]]
    return text[hit], offset[hit]


def _runs(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive window starts of a document as (doc, first, last)."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    cuts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)))[: len(doc)]
    last = np.append(cuts[1:], len(doc))[: len(cuts)] - 1
    return doc[cuts], place[cuts], place[last]


def _trees(window: int, rows_at_once: int = 4096):
    """Rows (key, doc_id, start, words) sorted by key become marked runs; whole groups at a time."""

    def solve(frame: pd.DataFrame) -> pa.RecordBatch:
        doc, start = frame["doc_id"].to_numpy("int64"), frame["start"].to_numpy("int64")
        text, offset = marked_windows(frame["key"].to_numpy("int64"), doc, [w.split(b" ") for w in frame["words"]], window)
        runs = _runs(doc[text], start[text] + offset)
        return pa.RecordBatch.from_arrays([pa.array(r) for r in runs], ["doc_id", "first", "last"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once).to_pandas()
                held.append(part)
                rows += len(part)
                if rows >= rows_at_once:
                    frame = pd.concat(held, ignore_index=True)
                    open_group = frame["key"] == frame["key"].iloc[-1]  # may go on in the next batch
                    if not open_group.all():
                        yield solve(frame[~open_group])
                    held = [frame[open_group]]
                    rows = len(held[0])
        if rows:
            yield solve(pd.concat(held, ignore_index=True))

    return work


def shared_keys(places: DataFrame, group: int = GROUP) -> DataFrame:
    """(key, hot) of rows (doc_id, key, places): keys of two documents or more; hot with more than `group` places in all."""
    return (
        places.groupBy("key")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("places").alias("n"))
        .filter("lo < hi")
        .select("key", (F.col("n") > group).alias("hot"))
    )


def keys_of_documents(slim: DataFrame, window: int = 50, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """(doc_id, key, level): the prefixes by which a document's windows are dealt; level 0 anchors, 1 longer prefixes,
    2 longer prefixes whose windows are dealt whole."""
    kind = "doc_id long, anchor array<long>, near array<long>, far array<long>, places array<long>"
    found = cut(slim.mapInArrow(_anchor_rows(window, anchor), kind))
    rows = found.select("doc_id", F.explode(F.arrays_zip("anchor", "near", "far", "places")).alias("x"))
    rows = rows.select("doc_id", F.col("x.anchor").alias("key"), "x.near", "x.far", "x.places")
    # written tables on both sides of the joins: adaptive execution can split a hot key
    dealt = cut(rows.join(cut(shared_keys(rows, group)), "key"))
    longer = dealt.filter("hot").select("doc_id", F.explode(F.array("near", "far")).alias("key"), "places").filter("key <> 0")
    grown = longer.join(cut(shared_keys(longer, group)), "key")
    return dealt.filter("not hot").select("doc_id", "key", F.lit(0).alias("level")).unionByName(
        grown.select("doc_id", "key", F.when(F.col("hot"), 2).otherwise(1).alias("level"))
    )


def repeated_windows(
    docs: DataFrame,
    window: int = 50,
    anchor: int = ANCHOR,
    group: int = GROUP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, runs array<struct<first, last>>): runs of window starts (in words) whose windows also start in a document
    of smaller id; a document may have several rows.

    Runs of a document may touch or overlap. Null texts have no words, a null id takes no part.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = keys_of_documents(slim, window, anchor, group)
    by_doc = keys.groupBy("doc_id").agg(*[F.collect_set(F.when(F.col("level") == i, F.col("key"))).alias(f"keys{i}") for i in range(3)])
    # left, so that this exchange of the texts is the one that the last join uses, too
    known = slim.join(by_doc, "doc_id", "left")
    texts = known.select("doc_id", "text", "keys0", "keys1").mapInArrow(
        _texts_at(window, anchor), "key long, doc_id long, start long, words binary"
    )
    trees = texts.repartition("key").sortWithinPartitions("key")
    cold = trees.mapInArrow(_trees(window), "doc_id long, first long, last long")
    wide = known.select("doc_id", "text", "keys2").mapInArrow(
        _whole_windows(window, anchor), "name long, check long, doc_id long, places array<long>"
    )
    wide = cut(wide)
    owners = wide.groupBy("name", "check").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    owners = cut(owners.filter("owner < last").drop("last"))
    hot = wide.join(owners, ["name", "check"]).filter("owner < doc_id")
    run = lambda first, last: F.struct(first.alias("first"), last.alias("last"))
    return cold.select("doc_id", F.array(run(F.col("first"), F.col("last"))).alias("runs")).unionByName(
        hot.select("doc_id", F.transform("places", lambda p: run(p, p)).alias("runs"))
    )


def removed_words(n_words: int, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Which words the marked windows cover."""
    edge = np.zeros(n_words + 1, "int64")
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(last + window, n_words), -1)
    return np.cumsum(edge)[:-1] > 0


def _apply(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, gone, kept = [], [], []
            for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words = words_of(text)
                out = np.zeros(len(words), bool)
                if runs:
                    pairs = np.array([(r["first"], r["last"]) for r in runs], "int64")
                    out = removed_words(len(words), pairs[:, 0], pairs[:, 1], window)
                n.append(len(words))
                gone.append(int(out.sum()))
                kept.append(b" ".join([w for w, o in zip(words, out.tolist(), strict=True) if not o]).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return work


def remove_repeats(
    docs: DataFrame,
    window: int = 50,
    anchor: int = ANCHOR,
    group: int = GROUP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): the words that no repeated window covers, joined by one space.

    One row per row of docs. A window of `window` words is repeated if the same words start in a document of smaller
    id; windows are those of the input. Null texts have no words; texts shorter than a window stay; a null id stays
    whole and owns nothing. Rows that repeat an id are one document: what is marked in one is removed in all at the
    same places.
    """
    runs = repeated_windows(docs, window, anchor, group, id_col, text_col)
    marks = runs.groupBy("doc_id").agg(F.flatten(F.collect_set("runs")).alias("runs"))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.join(marks, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(
        _apply(window), "doc_id long, n_words long, n_removed long, kept_text string"
    )
