"""Language-model requests and replies as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REPLY = "enhanced_expressions array<struct<original_expression:string,variation:string>>, unique_description string, unique_expressions array<string>"
#: What may stand around an object in a reply.
FENCES = [r"(?s)```json\s*(.*?)\s*```", r"(?s)```\s*(.*?)\s*```", r"(?s)`(.*?)`"]
INSTRUCTION = "Rewrite each phrase once, then write two new phrases that point to the marked target only."


def _known(got: Column, schema: str) -> Column:
    """Whether an object has a field of the schema that is not null."""
    out = F.lit(False)
    for f in _fields(schema):
        out = out | got[f.strip().split(" ")[0]].isNotNull()
    return out


def _parsed(texts: Column, schema: str) -> Column:
    """The first value of an array of texts, or null where none is an object with a known field. Each text is parsed once."""
    got = F.transform(texts, lambda t: F.from_json(F.trim(t), schema))
    return F.get(F.filter(got, lambda g: _known(g, schema)), F.lit(0))


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(schema + ","):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return out


def recover_json(text: Column, schema: str = REPLY) -> Column:
    """The object in a reply: the whole text, a fenced block marked json, any fenced block, text in backticks, or what
    lies between the first and last brace; null if nothing parses."""
    tries = [_parsed(F.array(text), schema)]
    for pattern in FENCES:
        tries.append(_parsed(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), schema))
    tries.append(_parsed(F.array(F.regexp_extract(text, r"(?s)\{.*\}", 0)), schema))
    return F.coalesce(*tries)


def split_replies(replies: DataFrame, text_col: str, schema: str = REPLY) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejects): rows with a reply, and all others as they are; none is lost."""
    d = replies.withColumn("reply", recover_json(F.col(text_col), schema))
    return d.filter("reply is not null"), d.filter("reply is null").drop("reply")


def explode_response(parsed: DataFrame, id_col: str) -> DataFrame:
    """(id, expr_type, variant, original, text): enhanced and unique phrases that are not blank; variant is "{id}_var_{j}"."""
    old = parsed.select(id_col, F.posexplode("reply.enhanced_expressions").alias("j", "e"))
    old = old.select(id_col, F.lit("enhanced").alias("expr_type"), "j", F.col("e.original_expression").alias("original"), F.col("e.variation").alias("text"))
    new = parsed.select(id_col, F.posexplode("reply.unique_expressions").alias("j", "text"))
    new = new.select(id_col, F.lit("unique").alias("expr_type"), "j", F.lit(None).cast("string").alias("original"), "text")
    both = old.unionByName(new).filter(F.trim("text") != "")
    return both.select(id_col, "expr_type", F.concat(F.col(id_col), F.lit("_var_"), F.col("j")).alias("variant"), "original", "text")


def build_request(targets: DataFrame, uri: Column, instruction: str = INSTRUCTION) -> DataFrame:
    """(split, value): a JSON line for each target (phrases array, split): instruction and phrases, and the picture's place."""
    prompt = F.concat_ws("\n", F.lit(instruction), F.transform("phrases", lambda p: F.concat(F.lit("- "), p)))
    part = F.array(F.struct(prompt.alias("text"), F.lit(None).cast("string").alias("fileUri")), F.struct(F.lit(None).cast("string").alias("text"), uri.alias("fileUri")))
    request = F.struct(F.array(F.struct(F.lit("user").alias("role"), part.alias("parts"))).alias("contents"))
    return targets.select("split", F.to_json(F.struct(request.alias("request"))).alias("value"))


def attach_llm_results(exprs: DataFrame, results: DataFrame) -> DataFrame:
    """(key, result_pos, pos): each rewritten phrase's original among a target's phrases: equal text, else the nearest
    length, else the earlier one. Both have key; exprs pos, text; results result_pos, original, text."""
    d = results.join(exprs.select("key", "pos", F.col("text").alias("said")), "key")
    w = Window.partitionBy("key", "result_pos").orderBy(
        (F.col("said") == F.col("original")).desc_nulls_last(), F.abs(F.length("said") - F.length("original")).asc_nulls_last(), "pos"
    )
    return d.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("key", "result_pos", "pos")


def unpivot_translations(df: DataFrame, id_col: str, languages: list[str]) -> DataFrame:
    """(id, language, text): language columns as rows; missing translations are left out."""
    return df.unpivot([id_col], languages, "language", "text").filter("text is not null")
