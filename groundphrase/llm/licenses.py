"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Units. What is compared are single lines, header blocks and whole licence files. A block is a run of lines that each
hold a key word, with blank lines (or bare comment marks) between them or not, so a notice that is wrapped over lines or has
several paragraphs is one vector, in a comment or not. A file with a licence file's name is a vector as a whole.

Key words. The rarest words of a template that together hold more than 1 - least ** 2 of its squared weight: a text
without any of them cannot reach the cosine `least` (the words that are left bound it), so nothing that could match is
passed over. They follow from the table's own document frequencies; words that are common in it are not among them.
Units whose other words alone make them too long for the bound are not weighed either (may_reach()).

Weights. Term frequency times inverse document frequency over all files of the table, for all words, those that no
template has included. A tag SPDX-License-Identifier names its licence with score 1. A file without a licence of its
own takes that of the licence file in the nearest directory above it, by an equi-join of its ancestor paths with the
directories of licence files. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundphrase.llm.license_texts import TEMPLATES
from groundphrase.operators.lineage import cut

LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"
#: A tag's whole expression: names, AND, OR, WITH, and brackets.
SPDX = r"SPDX-License-Identifier:[ \t]*([(]*[A-Za-z0-9.+-]+[)]*(?:[ \t]+(?:AND|OR|WITH)[ \t]+[(]*[A-Za-z0-9.+-]+[)]*)*)"
#: Least cosine of a unit, and of a licence file's title.
LEAST, TITLE = 0.6, 0.8


def words(text: Column) -> Column:
    """Lower-case words; hyphens and points join, so BY-NC and 2.0 are words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]++(?:[-.][a-z0-9]++)*+"), F.lit(0))


def template_weights(
    files: DataFrame, df: DataFrame, n: int, templates: list[tuple[str, str]]
) -> list[tuple[str, int, str, float, float]]:
    """(word, template, license, idf, share) of the templates' words; the squared shares of a template add up to 1."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    t = files.sparkSession.createDataFrame(rows, "template int, license string, text string")
    tf = t.select("template", "license", F.explode(words(F.col("text"))).alias("word")).groupBy("template", "license", "word").count()
    known = tf.join(df, "word", "left").collect()  # as many rows as the templates have words
    idf = {r.word: math.log((1 + n) / (1 + (r.df or 0))) + 1 for r in known}
    length: dict[int, float] = {}
    for r in known:
        length[r.template] = length.get(r.template, 0.0) + (r["count"] * idf[r.word]) ** 2
    return [(r.word, r.template, r.license, idf[r.word], r["count"] * idf[r.word] / math.sqrt(length[r.template])) for r in known]


def key_words(weights: list[tuple[str, int, str, float, float]], least: float) -> list[str]:
    """For each template its rarest words, until the squared shares of the others are below least ** 2."""
    out: set[str] = set()
    for template in {w[1] for w in weights}:
        left = 1.0
        for _, share, word in sorted((-w[3], w[4], w[0]) for w in weights if w[1] == template):
            if left < least**2 - 1e-9:
                break
            out.add(word)
            left -= share**2
    return sorted(out)


def units(files: DataFrame, keys: list[str]) -> DataFrame:
    """(path, said, title): the texts to compare: lines with a key word, runs of such lines (blank lines end a run, or do not),
    and a licence file as a whole. Each different one of a file once. title marks the first two lines with a letter or
    digit of a licence file, which are a unit of their own."""
    has_key = lambda line: F.arrays_overlap(words(line), F.array(*map(F.lit, keys)))
    blank = lambda line: ~line.rlike(r"[\p{L}\p{N}]")
    lines = F.split("text", r"\r\n|[\n\r]")
    told = files.select("path", "text", F.transform(lines, lambda x: F.struct(x.alias("x"), has_key(x).alias("key"), blank(x).alias("blank"))).alias("_l"))
    # other lines become empty: two line feeds end a run; a blank line that does not end one becomes a space
    broken = F.array_join(F.transform("_l", lambda x: F.when(x["key"], x["x"]).otherwise("")), "\n")
    joined = F.array_join(F.transform("_l", lambda x: F.when(x["key"], x["x"]).when(x["blank"], " ").otherwise("")), "\n")
    head = F.array_join(F.transform(F.slice(F.filter("_l", lambda x: ~x["blank"]), 1, 2), lambda x: x["x"]), " ")
    own, none = F.col("path").rlike(LICENCE_FILE), F.array().cast("array<string>")
    told = told.select("path", "text", broken.alias("broken"), joined.alias("joined"), F.when(own, F.array(head)).otherwise(none).alias("head"))
    runs = F.concat(F.split("broken", "\n"), F.split("broken", "\n\n+"), F.split("joined", "\n\n+"), F.when(own, F.array("text")).otherwise(none))
    row = lambda title: lambda x: F.struct(x.alias("said"), F.lit(title).alias("title"))
    every = F.concat(F.transform(F.array_distinct(F.transform(runs, F.trim)), row(False)), F.transform("head", row(True)))
    return told.select("path", F.explode(every).alias("u")).select("path", "u.said", "u.title")


def may_reach(w: Column, weights: list[tuple[str, int, str, float, float]], least: float) -> Column:
    """Whether a unit of these words can reach `least` with any template. Its product with a template is at most that with
    the greatest share that each word has in any; its length is that of the templates' words at least, and an idf of 1 or
    more for each other word."""
    of = {x[0]: F.struct(F.lit(x[3]).alias("idf"), F.lit(max(y[4] for y in weights if y[0] == x[0])).alias("share")) for x in weights}
    shared = F.array_intersect(w, F.array(*map(F.lit, sorted(of))))
    known = F.create_map(*[x for word in sorted(of) for x in (F.lit(word), of[word])])
    weighed = F.transform(shared, lambda s: F.struct(
        (F.size(F.filter(w, lambda x: x == s)) * F.element_at(known, s)["idf"]).alias("w"), F.element_at(known, s)["share"].alias("share")))
    sums = F.aggregate(weighed, F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("square")), lambda total, x: F.struct(
        (total["dot"] + x["w"] * x["share"]).alias("dot"), (total["square"] + x["w"] * x["w"]).alias("square")))
    others = F.size(F.array_distinct(w)) - F.size(shared)
    return (F.size(w) > 0) & (sums["dot"] * (1 + 1e-9) >= least * F.sqrt(sums["square"] + others))


def expression(tag: Column) -> Column:
    """An SPDX expression without brackets around the whole of it, or such as belong to what stands around the tag."""
    bare = F.regexp_replace(tag, r"^[(]([^()]*)[)]$", "$1")
    return F.when(F.contains(bare, F.lit("(")), bare).otherwise(F.replace(bare, F.lit(")"), F.lit("")))


def own_licenses(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(path, license, score) of each file that states a licence; score is a cosine of `least` or more.

    Of several statements the SPDX tag counts, with its whole expression; else the title of a licence file (cosine TITLE or
    more); else the one that has most in common with its template (the cosine times
    the length of the unit's vector), so a line inside a longer notice does not stand for it; ties go to the greater
    score, then to the greater name.
    """
    f = files.select("path", "text").filter("text is not null")
    n = f.count()
    df = cut(f.select(F.explode(F.array_distinct(words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("df")))
    weights = template_weights(files, df, n, templates)
    keys = key_words(weights, least)
    near = f.filter(F.arrays_overlap(words(F.col("text")), F.array(*map(F.lit, keys))))
    unit = units(near, keys).select("path", F.struct("title", F.xxhash64("said").alias("hash")).alias("unit"), words(F.col("said")).alias("w"))
    unit = unit.filter(may_reach(F.col("w"), weights, least))
    tf = unit.select("path", "unit", F.explode("w").alias("word")).groupBy("path", "unit", "word").agg(F.count("*").alias("tf"))
    idf = F.log((1.0 + n) / (1 + F.col("df"))) + 1
    weighed = cut(cut(tf).join(df, "word").select("path", "unit", "word", (F.col("tf") * idf).alias("w")))
    length = weighed.groupBy("path", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    shares = files.sparkSession.createDataFrame(
        [(w, t, name, share) for w, t, name, _, share in weights], "word string, template int, license string, share double"
    )
    dot = weighed.join(F.broadcast(shares), "word").groupBy("path", "unit", "template", "license").agg(
        F.sum(F.col("w") * F.col("share")).alias("dot")
    )
    dot = dot.filter(F.col("dot") > 0)
    title = F.col("unit.title")
    scored = dot.join(length, ["path", "unit"]).select(
        "path", title.cast("int").alias("tag"), F.when(title, 0.0).otherwise(F.round("dot", 3)).alias("common"),
        F.round(F.col("dot") / F.col("length"), 6).alias("score"), "license",
    )
    tags = F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("license")
    tagged = f.select("path", F.lit(2).alias("tag"), F.lit(0.0).alias("common"), F.lit(1.0).alias("score"), tags).withColumn("license", expression(F.col("license")))
    rank = F.struct("tag", "common", "score", "license")
    best = scored.filter(F.col("score") >= F.when(F.col("tag") == 1, max(least, TITLE)).otherwise(least)).unionByName(tagged).groupBy("path").agg(F.max(rank).alias("b"))
    return best.select("path", "b.license", "b.score")


def ancestors(path: Column) -> Column:
    """Directories above a path, the root "" first."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )


def scan_licenses(
    files: DataFrame,
    path_col: str = "path",
    text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    least: float = LEAST,
) -> DataFrame:
    """(path, license, how, score, origin), one row per path of files.

    how is "own", "inherited" (origin: the licence file) or "none". Of several licence files in a directory that of the
    least path counts. A path that repeats is one file with the statements of all its rows; null and empty texts state
    nothing; rows with a null path give one row with null path and "none". Other columns play no part.
    """
    f = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    own = cut(own_licenses(f.filter("path is not null"), templates, least))
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    holders = (
        own.filter(F.col("path").rlike(LICENCE_FILE))
        .groupBy(parent.alias("dir"))
        .agg(F.min(F.struct("path", "license", "score")).alias("h"))
    )
    paths = f.select("path").distinct()
    bare = paths.join(own, "path", "left_anti").filter("path is not null")
    above = bare.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "dir"))
    nearest = above.join(holders, "dir").groupBy("path").agg(F.max_by("h", "depth").alias("h"))
    return (
        paths.join(own.select("path", F.col("license").alias("own"), F.col("score").alias("own_score")), "path", "left")
        .join(nearest, "path", "left")
        .select(
            "path",
            F.coalesce("own", "h.license").alias("license"),
            F.when(F.col("own").isNotNull(), "own").when(F.col("h").isNotNull(), "inherited").otherwise("none").alias("how"),
            F.coalesce("own_score", "h.score").alias("score"),
            F.when(F.col("own").isNull(), F.col("h.path")).alias("origin"),
        )
    )
