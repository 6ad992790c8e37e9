"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics are shares and spreads of bytes, words and lines of the whole text; nothing else of a row is an input.
The model is fitted on a bounded sample of labelled rows: each partition sums its part of the normal equations, the
sums are added in a tree and solved, and pool-adjacent-violators on rows that the fit has not seen makes the scores
probabilities. Scoring is one narrow pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from groundphrase.llm.batches import slices
from groundphrase.operators.lineage import cut

#: Labelled rows that a fit takes at most (expected); Fourier features; partitions of the fit; sums that reach the driver; seed.
FIT_ROWS, FEATURES, FIT_PARTS, SUM_GROUPS, SEED = 30_000, 256, 8, 8, 20_240_601
#: Classes of bytes whose shares are statistics.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:'\"-()", b"!?",
           b"|\t", b"#$%&*+/<=>@[\\]^_`{}~"]
_CLASS = np.zeros((256, len(CLASSES) + 1))
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c), _i] = 1
_CLASS[128:, -1] = 1


def statistics(text: str | None) -> list[float]:
    """The statistics of one text; all are finite, for empty texts too."""
    raw = (text or "").encode("utf-8")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, "uint8"), minlength=256)
    share = counts[counts > 0] / n
    words = raw.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), "float64", len(words)) if words else np.zeros(1)
    seen = Counter(words)
    lines = raw.split(b"\n")
    return [
        *(counts @ _CLASS / n),
        np.log1p(len(raw)),
        float(-(share * np.log(share)).sum()),
        float(np.log1p(sizes.mean())),
        float(np.log1p(sizes.std())),
        float(np.log1p(sizes.max())),
        len(seen) / m * np.log1p(m),
        max(seen.values(), default=0) / m,
        sum(map(eq, words, words[1:])) / m,
        len(set(lines)) / len(lines),
        float(np.log1p(len(raw) / len(lines))),
    ]


WIDTH = len(statistics(""))


@dataclass
class Model:
    """Standardisation, Fourier frequencies and phases, ridge weights, and the calibration's knots."""

    mean: np.ndarray
    std: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        half = np.cos(z @ self.frequency + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([half, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (mean x of each pool, ascending) and levels (mean y, non-decreasing)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 2] / p[:, 1], p[:, 0] / p[:, 1]


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _stats_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = [statistics(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"]
        )


def _summed(rows: DataFrame, make) -> list[np.ndarray]:
    """Sums of make(x, y) over all rows: added up in each partition, then in SUM_GROUPS groups of partitions, and these few
    on the driver, in the order of partitions, so the last digits don't depend on which task ends first."""

    def added(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        total = parts[0]
        for part in parts[1:]:
            total = [a + b for a, b in zip(total, part, strict=True)]
        return total

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for batch in batches:
            if batch.num_rows:
                x, y = np.array(batch.column(2).to_pylist()), np.array(batch.column(1).to_pylist(), "float64")
                part = make(x, y)
                total = part if total is None else added([total, part])
        if total is not None:
            cells = [pa.array([t.tobytes()], pa.binary()) for t in total]
            number = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.RecordBatch.from_arrays([number, *cells], ["part", *(f"s{i}" for i in range(len(cells)))])

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("part")
        total = added([[np.frombuffer(c) for c in cells] for cells in ordered[names].itertuples(index=False)])
        return pd.DataFrame([[int(ordered["part"].iloc[0]), *(t.tobytes() for t in total)]], columns=["part", *names])

    n = len(make(np.zeros((1, WIDTH)), np.zeros(1)))
    names = [f"s{i}" for i in range(n)]
    kind = ", ".join(["part long", *(f"{c} binary" for c in names)])
    sums = rows.mapInArrow(work, kind).groupBy(F.col("part") % SUM_GROUPS).applyInPandas(group, kind).collect()
    return added([[np.frombuffer(r[c]) for c in names] for r in sorted(sums, key=lambda r: r["part"])]) if sums else []


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    fit_rows: int = FIT_ROWS,
    features: int = FEATURES,
    ridge: float = 1e-3,
) -> Model:
    """A model of labels (doc_id, label 0/1), learned only from rows that are not held out.

    The sample is the labelled rows whose hashed id is below a bound that leaves fit_rows of them on average, a
    quarter of it for calibration. Null labels and ids play no part; of an id's labels the largest counts. Without
    labels every score is 0.5; with one class, or too few rows, its share.
    """
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).filter(
        F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    bound = int(min(1, fit_rows / max(1, known.count())) * (1 << 30))
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")
    rows = cut(rows.mapInArrow(_stats_rows, "doc_id long, y int, x array<double>").repartition(FIT_PARTS, "doc_id"))
    rng = np.random.default_rng(SEED)
    sums = _summed(rows, lambda x, y: [x.sum(axis=0), (x**2).sum(axis=0), np.array([len(y), y.sum()], "float64")])
    n, positive = sums[2] if sums else (0, 0)
    flat = Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(2), np.zeros(1),
                 np.array([positive / n if n else 0.5]))
    if n < 50 or positive in (0, n):
        return flat
    mean = sums[0] / n
    std = np.sqrt(np.maximum(sums[1] / n - mean**2, 0))
    model = Model(
        mean, np.where(std > 1e-9, std, 1), rng.normal(size=(WIDTH, features)) / np.sqrt(WIDTH),
        rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.zeros(1),
    )
    fold = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(4)) == 0

    def equations(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z = model.fourier(x)
        return [(z.T @ z).ravel(), z.T @ y]

    gram, moment = _summed(rows.filter(~fold), equations) or (np.zeros((features + 1) ** 2), np.zeros(features + 1))
    penalty = ridge * n / features * np.eye(features + 1)
    model.weight = np.linalg.solve(gram.reshape(features + 1, -1) + penalty, moment)
    seen = rows.filter(fold).select("y", "x").toPandas()  # a quarter of the bounded sample
    if len(seen) < 10 or seen["y"].nunique() < 2:
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        model.knots, model.levels = isotonic(model.raw(np.array(seen["x"].tolist())), seen["y"].to_numpy("float64"))
    return model


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score of 0 to 1 from the whole text alone; null counts as empty. A narrow map.

    A score column that the input has already is refused before anything runs.
    """
    if score_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the input has a column {score_col} already; name another for the result")
    at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, score_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = np.array([statistics(t) for t in part.column(at).to_pylist()]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(x))], names)

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """docs whose score reaches `least`; columns as they are."""
    name = "score"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return with_score(docs, fit(docs, labels), score_col=name).filter(F.col(name) >= least).drop(name)
