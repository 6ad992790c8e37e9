"""Adapters: how the given tables become patches, objects, pixels, phrases, replies and masks.

Each adapter is a list of SQL column expressions that Spark and DuckDB both read, so one text serves both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundphrase.sources import table

#: Sides of a patch in pixels.
SIZE = 480

_BODY = (
    """'{"enhanced_expressions":[{"original_expression":"the ship","variation":"boat ' || CAST(turn AS STRING) || """
    """'"}],"unique_expressions":["a' || CAST(conv_id AS STRING) || '"," "]}'"""
)
_SIDE = "o_orderkey * o_orderkey"

ADAPTERS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "objects": (
        "orders",
        [
            ("o_orderkey", "object_id"),
            ("CAST(floor(o_orderkey / 20.0) AS BIGINT)", "patch_id"),
            ("CAST(o_orderkey % 20 AS INT)", "pos"),
            ("CASE o_custkey % 5 WHEN 0 THEN 'Small_Vehicle' WHEN 1 THEN 'Large_Vehicle' WHEN 2 THEN 'ship' "
             "WHEN 3 THEN 'plane' ELSE 'building' END", "category"),
            (f"CAST(({_SIDE} * 31 + o_orderkey * 7919) % 431 AS INT)", "xmin"),
            (f"CAST(({_SIDE} * 17 + o_custkey * 104729) % 421 AS INT)", "ymin"),
            (f"CAST(({_SIDE} * 31 + o_orderkey * 7919) % 431 + 8 + (o_orderkey * 31) % 41 AS INT)", "xmax"),
            (f"CAST(({_SIDE} * 17 + o_custkey * 104729) % 421 + 8 + (o_custkey * 17) % 49 AS INT)", "ymax"),
            ("(o_orderkey % 13 = 0)", "is_cutoff"),
        ],
    ),
    "files": (
        "orders",
        [
            ("o_orderkey", "file_id"),
            ("CASE o_orderkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'L' ELSE 'D' END || "
             "CAST(CAST(floor(o_orderkey / 20.0) AS BIGINT) AS STRING) || '_patch_' || CAST(o_orderkey % 20 AS STRING) || "
             "CASE WHEN o_orderkey % 7 = 0 THEN '_toP' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN '.png' ELSE '.xml' END", "name"),
            ("CASE WHEN o_orderkey % 5 = 0 THEN 'val' ELSE 'train' END", "split"),
        ],
    ),
    "pixels": (
        "events",
        [
            ("CAST(floor(event_id / 400.0) AS BIGINT)", "image_id"),
            ("CAST(event_id % 20 AS INT)", "x"),
            ("CAST(floor((event_id % 400) / 20.0) AS INT)", "y"),
            ("CAST((user_id * 53 + event_id * 7) % 256 AS INT)", "b"),
            ("CAST((user_id * 97 + event_id * 13) % 256 AS INT)", "g"),
            ("CAST((user_id * 31 + event_id * 29) % 256 AS INT)", "r"),
            ("CAST((floor((event_id % 20) / 5.0) + floor((event_id % 400) / 100.0) + floor(event_id / 400.0)) % 8 AS INT)", "class_id"),
        ],
    ),
    "responses": (
        "conversations",
        [
            ("conv_id", "conv_id"),
            ("turn", "turn"),
            ("role", "role"),
            (f"CASE conv_id % 5 WHEN 0 THEN 'broken {{\"enhanced_expressions\": [' WHEN 1 THEN '```json ' || {_BODY} || ' ```' "
             f"WHEN 2 THEN 'Here it is: ' || {_BODY} ELSE {_BODY} END", "raw"),
            ("CAST(length(text) AS BIGINT)", "n_chars"),
        ],
    ),
    "pairs": (
        "orders",
        [
            ("o_orderkey", "sample_id"),
            ("CAST(10 + o_custkey % 30 AS BIGINT)", "side"),
            ("CAST(o_orderkey % 12 AS BIGINT)", "dx"),
            ("CAST(o_custkey % 7 AS BIGINT)", "dy"),
        ],
    ),
}

_EXPRS = [
    ("CAST(floor(o_orderkey / 20.0) AS BIGINT)", "patch_id"),
    ("CASE WHEN o_orderkey % 20 >= 15 THEN 'group' ELSE 'individual' END", "target_kind"),
    ("CASE WHEN o_orderkey % 20 >= 18 THEN 1000000 + o_orderkey ELSE o_orderkey END", "target_id"),
    ("k", "pos"),
    ("CASE WHEN k < 2 THEN 'original' WHEN k = 2 THEN 'enhanced' ELSE 'unique' END", "expr_type"),
    ("CASE k WHEN 0 THEN 'the Large_Vehicle in the top left' "
     "WHEN 1 THEN 'the dark topmost ship in the center that is above a plane' "
     "WHEN 2 THEN 'the vehicle number ' || CAST(o_custkey % 9 AS STRING) "
     "ELSE 'group of ' || CAST(1 + o_custkey % 4 AS STRING) || ' plane near ' || CAST(o_orderkey % 6 AS STRING) END", "text"),
    ("CASE WHEN o_orderkey % 5 = 0 THEN 'val' ELSE 'train' END", "split"),
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter's rows, or a given table under its own name."""
    if name == "exprs":
        four = table(spark, sf_dir, "orders").selectExpr("*", "explode(array(0, 1, 2, 3)) AS k")
        return four.selectExpr(*[f"{e} AS {a}" for e, a in _EXPRS])
    if name not in ADAPTERS:
        return table(spark, sf_dir, name)
    source, columns = ADAPTERS[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {a}" for e, a in columns])


def _select(columns: list[tuple[str, str]], source: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {a}' for e, a in columns)} FROM {source}"


#: The adapters as DuckDB texts.
DUCK = {name: _select(columns, source) for name, (source, columns) in ADAPTERS.items()} | {
    "exprs": _select(_EXPRS, "orders CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) ks")
}
