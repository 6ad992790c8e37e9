"""Exact deduplication with a heavy-hitter split.

Groups are found on digests of normalised texts; only drop_exact_copies(), whose result is whole rows, moves rows, once, and
without the copies of frequent texts. A Misra-Gries summary (Spark's freqItems, the
Karp-Shenker-Papadimitriou form of it) finds digests that may be frequent; their exact counts and first rows are
then taken in one aggregate, and these verified winners, at most 1/support of them, are broadcast so that copies of
frequent texts are settled where they are read. All other digests use an ordinary shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundphrase.operators.lineage import cut

WHITE_SPACE = r"[\x20\x09-\x0D]+"
SUPPORT = 1e-3


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def frequent_groups(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, first, n) of digests that are verified to repeat; at most 1/support rows.

    rows has digest, doc_id and, for a tie or a null id, row. Every digest with over support * count rows is among
    the candidates; false ones (n = 1) are filtered after exact counting.
    """
    candidates = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    return (
        rows.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(_first().alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
    )


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and empty texts are copies of each other. The smallest id of a group stays; a null id
    comes last. Of rows that repeat an id with the same text one stays. An empty table gives an empty result; other
    columns of docs play no part.
    """
    rows = cut(
        docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest")).withColumn(
            "row", F.monotonically_increasing_id()
        )
    )
    heavy = cut(frequent_groups(rows, support))
    many = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    few = rest.join(rest.groupBy("digest").agg(_first().alias("first"), F.count("*").alias("n")), "digest")
    return many.unionByName(few).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT
) -> DataFrame:
    """docs without exact copies, all columns as they are; the row with the smallest id of a group stays (null last).

    Copies of frequent texts go before the shuffle; then one window per digest settles the rest. A frequent text
    leaves one row there, unless the very same id repeats too.
    """
    names = docs.columns
    d, k = _free("digest", names), _free("first_id", names)
    marked = docs.withColumn(d, text_digest(F.col(text_col)))
    slim = cut(
        marked.select(F.col(id_col).alias("doc_id"), F.col(d).alias("digest"), F.lit(0).alias("row"))
    )
    heavy = cut(frequent_groups(slim, support)).select(
        F.col("digest").alias(d), F.col("first.doc_id").alias(k), F.lit(True).alias(f"{d}_heavy")
    )
    left = (
        marked.join(F.broadcast(heavy), d, "left")
        .filter(F.col(f"{d}_heavy").isNull() | F.col(id_col).eqNullSafe(F.col(k)))
        .drop(k, f"{d}_heavy")
    )
    order = Window.partitionBy(d).orderBy(F.col(id_col).asc_nulls_last())
    n = _free("nth", names)
    return left.withColumn(n, F.row_number().over(order)).filter(F.col(n) == 1).select(*[F.col(f"`{c}`") for c in names])


def _free(name: str, taken: list[str]) -> str:
    """A column name that the input does not have."""
    low = {c.lower() for c in taken}
    while name.lower() in low or f"{name}_heavy".lower() in low:
        name = f"_{name}"
    return name
