"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are numbered and cut into blocks. A source of weight w releases its block j (from 0) at slot
floor(j / w), with the deadline ceil((j + 1) / w). Earliest deadline first, one block a slot, keeps every source within
one block of its share at every slot. Weights are exact rationals; all blocks are scheduled once, on the driver, whose
work grows with blocks and not with rows or slots.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundphrase.operators.lineage import cut, ensure_checkpoint_dir

#: Documents of a block; blocks of a stretch, which the driver holds and a schedule to broadcast may have; rows of a numbered part of a source.
BLOCK, STRETCH, PART = 64, 500_000, 2_000
NO_SOURCE = "\u0000"


def schedule(weights: dict[str, float | Fraction], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """The given number of blocks of each source, earliest deadline first: (source, nth block, release, deadline, slot).

    Releases and deadlines are those of the exact weights, so nothing is rounded. Slots in which no block is released
    are skipped, so the steps are the blocks, however small a weight is.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    total = sum(map(Fraction, weights.values()))
    every = {s: (total / Fraction(w)).as_integer_ratio() for s, w in weights.items()}  # slots a block
    release = lambda s, j: j * every[s][0] // every[s][1]
    due = lambda s, j: -(-(j + 1) * every[s][0] // every[s][1])
    waiting = [(0, s, 0) for s, n in blocks.items() if n]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, j), s, j))
        deadline, s, j = heapq.heappop(ready)
        yield s, j, release(s, j), deadline, slot
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (release(s, j + 1), s, j + 1))
        slot += 1


def planned(spark: SparkSession, weights: dict[str, float | Fraction], blocks: dict[str, int]) -> tuple[DataFrame, int, int]:
    """The schedule as a table (s, b, release, deadline, slot), the first slot that a source can't fill, and the slot after the last.

    A schedule of one stretch is a local table, to be broadcast; of a longer one each stretch is written and forgotten."""
    names, folder, horizon, end = ["s", "b", "release", "deadline", "slot"], "", None, 0
    stretch: list[list] = [[] for _ in names]

    def made() -> DataFrame:
        return spark.createDataFrame(pa.table({n: pa.array(c, pa.string() if n == "s" else pa.int64()) for n, c in zip(names, stretch, strict=True)}))

    for step in schedule(weights, {s: n + 1 for s, n in blocks.items()}):  # the block after a source's last stays empty
        if step[1] >= blocks[step[0]]:
            horizon = step[4] if horizon is None else horizon
            continue
        if len(stretch[0]) == STRETCH:
            if not folder:
                ensure_checkpoint_dir(spark)
                folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/schedule-{uuid.uuid4().hex}"
            made().write.mode("append").parquet(folder)
            stretch = [[] for _ in names]
        for column, value in zip(stretch, step, strict=True):
            column.append(value)
        end = step[4] + 1
    if not folder:
        return F.broadcast(made()), horizon, end
    made().write.mode("append").parquet(folder)
    return spark.read.parquet(folder), horizon, end


def _source(source_col: str) -> Column:
    return F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    temper: float = 0.5,
    block: int = BLOCK,
    source_col: str = "source",
    id_col: str = "doc_id",
    mix_col: str = "mix",
    part: int = PART,
) -> DataFrame:
    """docs with mix: struct<block, release, deadline, slot, place, on_target>.

    Without weights they are the sources' counts to the power `temper`; a source without a weight gets the mean of the
    others. Null is a source of its own. place orders all documents: block by block in the order of slots, inside a
    block in hashed order of ids (null first; rows that repeat an id are neighbours, in hashed order of all their columns). No row is dropped: when a source
    ends, its slots stay empty and the others go on; on_target is true up to the first slot that its source could not
    fill. An empty table gives an empty result. A column named as mix_col is refused.

    A source's documents are numbered in hashed parts of about `part` rows whose counts are summed up, so the largest
    source is spread over as many tasks as its share of the rows.
    """
    return _mixed_rows(docs, weights, temper, block, source_col, id_col, mix_col, part)[0]


def _mixed_rows(
    docs: DataFrame, weights: dict | None, temper: float, block: int, source_col: str, id_col: str, mix_col: str, part: int
) -> tuple[DataFrame, int, int]:
    """The rows of mix(), their number, and the end of the range of places."""
    if mix_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the input has a column {mix_col} already; name another for the result")
    spark, inner = docs.sparkSession, [F.col(f"d.`{c}`") for c in docs.columns]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), _source(source_col).alias("s"), F.col(id_col).alias("i"))
    counted = {r["s"]: r["count"] for r in row.groupBy("s").count().collect()}  # no more than the blocks of the schedule
    if not counted:
        kind = "struct<block:bigint,release:bigint,deadline:bigint,slot:bigint,place:bigint,on_target:boolean>"
        return docs.withColumn(mix_col, F.lit(None).cast(kind)), 0, 0
    given = {NO_SOURCE if s is None else s: w for s, w in (weights or {}).items()}
    mean = sum(given.values()) / len(given) if given else 1
    shared = {s: given.get(s, mean) if given else n**temper for s, n in sorted(counted.items())}
    blocks = {s: -(-n // block) for s, n in counted.items()}
    table, horizon, end = planned(spark, shared, blocks)
    parts = spark.createDataFrame([(s, -(-n // part)) for s, n in counted.items()], "s string, parts long")
    salted = row.join(F.broadcast(parts), "s").withColumn("p", F.pmod(F.xxhash64("i", F.lit(11)), F.col("parts")))
    sizes = cut(salted.groupBy("s", "p").count())
    before = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("s", "p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    told = [F.col(f"d.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    order = Window.partitionBy("s", "p").orderBy(F.xxhash64("i"), "i", F.xxhash64(*told))
    numbered = (
        salted.drop("parts")
        .join(offsets, ["s", "p"])
        .withColumn("n", F.row_number().over(order) - 1 + F.col("before"))
        .withColumn("b", F.floor(F.col("n") / block))
    )
    out = numbered.join(table, ["s", "b"]).select(
        *inner,
        F.struct(
            F.col("b").alias("block"),
            "release",
            "deadline",
            "slot",
            (F.col("slot") * block + F.col("n") % block).alias("place"),
            (F.col("slot") < horizon).alias("on_target"),
        ).alias(mix_col),
    )
    return out, sum(counted.values()), end * block


def mixed(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    temper: float = 0.5,
    block: int = BLOCK,
    source_col: str = "source",
    id_col: str = "doc_id",
    rows_per_file: int = 8_000,
) -> DataFrame:
    """docs in the order of the mixture, all of them, columns as they are.

    Partition k holds the k-th stretch of places, so written files follow each other in that order. The range of places
    is known from the counts, so the stretches need no sampling pass.
    """
    name = "mix"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    rows, n, places = _mixed_rows(docs, weights, temper, block, source_col, id_col, name, PART)
    if not n:
        return docs
    files = -(-n // rows_per_file)
    stretch = F.floor(F.col(f"{name}.place") * files / places).cast("int")
    ordered = rows.repartitionById(files, stretch).sortWithinPartitions(f"{name}.place")
    return ordered.select(*[F.col(f"`{c}`") for c in docs.columns])
