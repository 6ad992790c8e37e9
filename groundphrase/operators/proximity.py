"""Joins of what is near, on cells of a grid instead of all pairs of a patch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def side(df: DataFrame, prefix: str, key: list[str]) -> DataFrame:
    """df with a prefix before all columns but the key."""
    return df.select(*key, *[F.col(c).alias(prefix + c) for c in df.columns if c not in key])


def cell_join(a: DataFrame, b: DataFrame, key: list[str], reach: Column, size: float, on: Column, prefixes: tuple[str, str] = ("a_", "b_")) -> DataFrame:
    """Pairs (a_*, b_*) of rows with equal keys that meet `on`, found by cells; a pair comes once.

    a and b have cx and cy; reach is a column of either: two rows that meet `on` are at most the larger of their reaches apart
    along x and along y. The grid of level l has cells of size * 2^l; a row's own level is the least whose cells are as
    large as its reach. Rows are put on their own level and on those above it which any row has as its own: those of b
    in the cell of their centre, those of a in the up to nine cells around it. A pair is taken on the higher one of its two
    levels only, so it has one cell and nothing has to be made distinct. A patch's cells are keys of their own, so a
    dense patch is spread over tasks. Rows without a centre are near nothing.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2(reach / size) + 1e-9)).cast("int")
    leveled = [d.filter("cx is not null and cy is not null").withColumn("level", level) for d in ((a,) if a is b else (a, b))]
    seen = leveled[0].select("level", "cx", "cy")
    for d in leveled[1:]:
        seen = seen.unionByName(d.select("level", "cx", "cy"))
    ends = {f"{f.__name__}_{c}": f(c) for f in (F.min, F.max) for c in ("cx", "cy")}
    known = seen.agg(F.struct(F.collect_set("level").alias("levels"), *[v.alias(k) for k, v in ends.items()]).alias("x")).scalar()
    at = lambda v: F.floor(v / (size * F.pow(F.lit(2.0), F.col("_l"))))

    def placed(d: DataFrame, prefix: str, wide: bool) -> DataFrame:
        d = d.withColumn("_k", known).withColumn("_l", F.explode(F.filter("_k.levels", lambda n: n >= F.col("level"))))
        for c in ("cx", "cy"):
            own = at(F.col(c))
            if wide:  # cells beyond the outermost rows hold nothing
                own = F.explode(F.sequence(F.greatest(own - 1, at(F.col(f"_k.min_{c}"))), F.least(own + 1, at(F.col(f"_k.max_{c}")))))
            d = d.withColumn(f"_{c}", own)
        return side(d.drop("_k"), prefix, [*key, "_l", "_cx", "_cy"])

    p, q = prefixes
    left, right = placed(leveled[0], p, True), placed(leveled[-1], q, False)
    pairs = left.join(right, [*key, "_l", "_cx", "_cy"]).filter((F.col("_l") == F.greatest(f"{p}level", f"{q}level")) & on)
    return pairs.drop("_l", "_cx", "_cy", f"{p}level", f"{q}level")
