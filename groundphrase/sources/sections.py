"""Arrays of objects inside large JSON documents, read by many tasks.

A file is read as text that ends at every closing brace, which Spark splits at any byte. Where such a piece stands (inside a
string or not, how deep) follows from sums over the pieces before it: first inside a block of the file, then over its blocks, so
that only one row a block is ever put in a file's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from groundphrase.operators.lineage import cut

#: Stands for the section's name in the brackets of a piece.
MARK = "\x01"
BLOCK = ["file", "block"]


def _in_block(last: int) -> WindowSpec:
    """The pieces of a block up to the one `last` places off."""
    return Window.partitionBy(*BLOCK).orderBy("n").rowsBetween(Window.unboundedPreceding, last)


def _blocks_before() -> WindowSpec:
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _count(text: Column, chars: str) -> Column:
    left = text
    for x in chars:
        left = F.replace(left, F.lit(x), F.lit(""))
    return F.length(text) - F.length(left)


def _pieces(spark: SparkSession, path: str | list[str], section: str) -> DataFrame:
    """(file, block, n, value, quotes, s0, s1): text up to a brace, its quotes, and its brackets if it starts outside (s0) or
    inside (s1) of a string. A brace is never escaped, so a piece never starts in the middle of an escape."""
    d = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    plain = F.regexp_replace(F.regexp_replace("value", r"\\.", ""), rf'"{section}"\s*:', f'"{section}"{MARK}')
    string, rest = '"[^"]*(\"|$)', '^[^"]*(\"|$)'
    brackets = lambda t: F.regexp_replace(F.regexp_replace(t, string, ""), rf"[^\[\]{{{MARK}]+", "")
    d = d.withColumn("plain", plain)
    return d.withColumns({"quotes": _count(F.col("plain"), '"'), "s0": brackets(F.col("plain")), "s1": brackets(F.regexp_replace("plain", rest, ""))}).drop("plain")


def _stepped(pieces: DataFrame) -> DataFrame:
    """With d0 and d1, what a piece adds to the depth if its block starts outside or inside of a string."""
    before = F.coalesce(F.sum("quotes").over(_in_block(-1)), F.lit(0)) % 2

    def step(inside: int) -> Column:
        s = F.col(f"s{inside}")
        return _count(s, "[{") - _count(s, "]") - F.when((F.col("quotes") + inside) % 2 == 0, 1).otherwise(0)

    same = before == 0
    return pieces.withColumns({
        "odd": before, "d0": F.when(same, step(0)).otherwise(step(1)), "d1": F.when(same, step(1)).otherwise(step(0))})


def _states(stepped: DataFrame) -> DataFrame:
    """(file, block, inside, depth) at the start of each block: one row a block."""
    sums = stepped.groupBy(*BLOCK).agg(F.sum("quotes").alias("quotes"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    known = sums.withColumn("inside", F.coalesce(F.sum("quotes").over(_blocks_before()), F.lit(0)) % 2)
    step = F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))
    return known.select(*BLOCK, "inside", F.coalesce(F.sum(step).over(_blocks_before()), F.lit(0)).alias("depth"))


def _placed(stepped: DataFrame, states: DataFrame) -> DataFrame:
    """With starts (an object of some section begins here), mark (true: the section begins, false: another one) and deep (the
    piece begins inside an object of a section)."""
    d = stepped.join(states, BLOCK)
    step = F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))
    d = d.withColumn("depth", F.col("depth") + F.coalesce(F.sum(step).over(_in_block(-1)), F.lit(0)))
    d = d.withColumn("s", F.when((F.col("odd") + F.col("inside")) % 2 == 0, F.col("s0")).otherwise(F.col("s1"))).drop("s0", "s1", "d0", "d1", "odd", "inside")
    root = (F.col("depth") == 0) & F.startswith("s", F.lit("{"))
    d = d.withColumns({"s": F.when(root, F.expr("substring(s, 2)")).otherwise(F.col("s")), "level": F.col("depth") + root.cast("int")})
    head = F.substring_index("s", "{", 1)
    d = d.withColumn("head", head).withColumn("at", F.col("level") + _count(F.col("head"), "[") - _count(F.col("head"), "]"))
    bare = F.col("head")  # without arrays that are closed again
    for _ in range(3):
        bare = F.regexp_replace(bare, rf"\[{MARK}?\]", "")
    named = F.endswith("head", F.lit(f"{MARK}[")) & (F.col("at") == 2)
    mark = F.when(named, True).when(F.col("level") - _count(bare, "]") < 2, False)
    opens = F.contains("s", F.lit("{")) & (F.col("at") == 2)
    return d.select(*BLOCK, "n", "value", opens.alias("starts"), mark.alias("mark"), (F.col("depth") > 2).alias("deep"))


def block_states(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Where each block of the files starts, inside a string or not and how deep, for several calls of read_section()."""
    return cut(_states(_stepped(_pieces(spark, path, "_"))))


def read_section(spark: SparkSession, path: str | list[str], section: str, states: DataFrame | None = None) -> DataFrame:
    """(file, number, value): the objects of a document's array `section` as JSON texts, numbered within their file.

    {"a": ..., "<section>": [{...}, {...}]}, one document after another in a file. Files are split at any byte by
    spark.sql.files.maxPartitionBytes (compressed ones are not). The section's elements are objects; null elements are
    passed over. Other sections may hold anything, arrays of numbers nested up to three deep. An array of the same name at a
    greater depth is part of its object. The name must be written without escapes. Empty files and documents without the
    section give nothing.
    Text moves twice: by block, and by object; brackets of pieces move once more for each of the two rows a block."""
    if not section.replace("_", "").isalnum():
        raise ValueError(f"not a plain name: {section}")
    stepped = _stepped(_pieces(spark, path, section))
    placed = _placed(stepped, block_states(spark, path) if states is None else states)
    ends = placed.groupBy(*BLOCK).agg(F.count_if("starts").alias("found"), F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("n"))).alias("last"))
    carried = cut(ends.select(
        *BLOCK, F.coalesce(F.sum("found").over(_blocks_before()), F.lit(0)).alias("first"), F.last("last", ignorenulls=True).over(_blocks_before()).alias("open")))
    so_far = _in_block(0)
    d = placed.join(carried, BLOCK).withColumns({
        "number": F.col("first") + F.sum(F.col("starts").cast("int")).over(so_far),
        "ours": F.coalesce(F.last("mark", ignorenulls=True).over(so_far), F.col("open"), F.lit(False))})
    d = d.filter(F.col("ours") & (F.col("starts") | F.col("deep")))
    # what stands before an object: the section's name, or a comma
    begin = F.when(F.col("mark"), F.regexp_replace("value", rf'(?s)^.*?"{section}"\s*:\s*\[[^{{]*(?=\{{)', "")).otherwise(F.regexp_replace("value", r"^[^{]*", ""))
    text = F.when(F.col("starts"), begin).otherwise(F.col("value"))
    parts = F.sort_array(F.collect_list(F.struct("block", "n", text.alias("t"))))
    return d.groupBy("file", "number").agg(F.concat(F.array_join(parts["t"], "}"), F.lit("}")).alias("value"))
