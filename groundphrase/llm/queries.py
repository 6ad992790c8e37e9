"""The queries of this subpackage and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundphrase.llm import bpe, chat, exact_dedup, licenses, merkle, minhash, mixing, negatives, quality, sharding, substring, suffixes, topk
from groundphrase.operators.lineage import ensure_checkpoint_dir
from groundphrase.sources import table

RANKS = "byte_bpe_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations")).unionByName(chat.canonical_turns(said))
    out = chat.format_chats(turns).select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", line)), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "mix.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.with_score(docs.select("doc_id", "text"), quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), window=50).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def file_path() -> Column:
    """A path for each document: id div 4096/id div 64/id div 8/id.txt. Each 64th is the LICENSE of the second folder,
    each 8th of the others that of the third."""
    i = F.col("doc_id")
    folder = lambda *n: F.concat_ws("/", *[F.floor(i / k).cast("string") for k in n])
    return (
        F.when(i % 64 == 0, F.concat(folder(4096, 64), F.lit("/LICENSE")))
        .when(i % 8 == 0, F.concat(folder(4096, 64, 8), F.lit("/LICENSE")))
        .otherwise(F.concat(folder(4096, 64, 8), F.lit("/"), i.cast("string"), F.lit(".txt")))
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select(file_path().alias("path"), "text"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in 16 lots by hashed id; the committed shards after compaction, read back row by row."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/shards-{uuid.uuid4().hex}"
    store = sharding.ShardStore(spark, root, target=32 << 20)
    docs = table(spark, sf_dir, "documents")
    lot = "arrival"
    while lot in {c.lower() for c in docs.columns}:
        lot = f"_{lot}"
    store.append(docs.withColumn(lot, F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")), lot)
    store.compact(vacuum=True)
    store.vacuum()
    rows = [(s.name, s.size, s.rows, s.tier(store.smallest, store.fan_in)) for s in store.manifest()]
    shards = spark.createDataFrame(rows, "shard string, shard_bytes long, shard_rows long, tier int")
    shard = F.regexp_extract(F.col("_metadata.file_path"), rf"(shards/[^/]+(?:/{lot}=[^/]+)?)/[^/]+$", 1)
    return (
        store.read()
        .select(shard.alias("shard"), "doc_id", "n_chars", F.sha2("text", 256).alias("text_sha256"))
        .join(shards, "shard", "left")
    )


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(table(spark, sf_dir, "documents"), words=3, threshold=0.85)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_documents(table(spark, sf_dir, "documents")).drop("witness")


def op12_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), window=400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", noisy), "vec_id % 100 = 0")


QUERIES = [op1_bpe, op2_chat, op3_mixing, op4_quality, op5_substring, op6_exact_dedup, op7_licenses, op8_sharding, op9_minhash, op10_topk,
           op11_merkle, op12_suffix_array, op13_negatives]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(url_encode(role)) + length(text) + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]'))
      + CASE WHEN role = 'assistant' THEN 11 ELSE 17 END) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""

OP5 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50
), h AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s
), m AS (
  SELECT h, min(doc_id) AS d FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 50)) AS p FROM h JOIN m USING (h) WHERE m.d < h.doc_id
), r AS (
  SELECT doc_id, list(p) AS p FROM c GROUP BY doc_id
)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(len(r.p), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN r.p IS NULL THEN w.w ELSE
    list_select(w.w, list_filter(range(1, len(w.w) + 1), lambda j: NOT list_contains(r.p, j))) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""


OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a
), c AS (
  SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x
)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)
"""


OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) r WHERE rank <= 5
"""


OP11 = r"""
WITH RECURSIVE d AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents
), f AS (
  SELECT doc_id, lang, text, low,
    coalesce(octet_length(encode(id)) || ':' || id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
      || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
    xor(list_reduce(list_transform(range(1, len(id) + 1), lambda k: CAST(ascii(id[k]) AS BIGINT)), lambda c, x:
      list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a // 2, (a % 2) * 3988292384)), 4294967295), 4294967295) % 3 = 0 AS hit
  FROM d
), l AS (
  SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(text)) || ':' || CASE WHEN hit THEN low ELSE text END, '-')) AS now FROM f
), o AS (
  SELECT doc_id, lang, leaf, now, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n FROM l
), t AS (
  SELECT lang, 0 AS lev, i, leaf AS h, n FROM o
  UNION ALL SELECT lang, lev + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY lang, lev, i // 8, n
), s AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1
), r AS (
  SELECT 0 AS lev, i, subroot AS h, n FROM s
  UNION ALL SELECT lev + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM r WHERE n > 1 GROUP BY lev, i // 8, n
), p AS (
  SELECT lang, i AS leaf_i, 0 AS lev, i, now AS h, '' AS proof, n FROM o
  UNION ALL
  SELECT p.lang, p.leaf_i, p.lev + 1, p.i // 8, sha256(string_agg(CASE WHEN t.i = p.i THEN p.h ELSE t.h END, '' ORDER BY t.i)),
    p.proof || coalesce(string_agg(CASE WHEN t.i <> p.i THEN t.h END, '' ORDER BY t.i), ''), (p.n + 7) // 8
  FROM p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang AND p.lev = t.lev AND p.i // 8 = t.i // 8
  WHERE p.n > 1 GROUP BY p.lang, p.leaf_i, p.lev, p.i, p.h, p.proof, p.n
), q AS (
  SELECT p.lang, p.leaf_i, 0 AS lev, s.i, p.h, p.proof, s.n FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang WHERE p.n = 1
  UNION ALL
  SELECT q.lang, q.leaf_i, q.lev + 1, q.i // 8, sha256(string_agg(CASE WHEN r.i = q.i THEN q.h ELSE r.h END, '' ORDER BY r.i)),
    q.proof || coalesce(string_agg(CASE WHEN r.i <> q.i THEN r.h END, '' ORDER BY r.i), ''), (q.n + 7) // 8
  FROM q JOIN r ON q.lev = r.lev AND q.i // 8 = r.i // 8
  WHERE q.n > 1 GROUP BY q.lang, q.leaf_i, q.lev, q.i, q.h, q.proof, q.n
)
SELECT o.doc_id, o.leaf, s.subroot, x.root, sha256(q.proof) AS proof_sha256, q.h AS folded_root, q.h = x.root AS verified
FROM o JOIN s ON o.lang IS NOT DISTINCT FROM s.lang
JOIN q ON q.n = 1 AND o.lang IS NOT DISTINCT FROM q.lang AND o.i = q.leaf_i
CROSS JOIN (SELECT h AS root FROM r WHERE n = 1) x
"""


OP12 = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents
), s AS (
  SELECT r, x, unnest(range(1, CAST(len(x) AS BIGINT) // 2 - 398)) AS i FROM d WHERE len(x) >= 800
), h AS (
  SELECT r, i, md5_number(substr(x, 2 * i - 1, 800)) AS h FROM s
), m AS (
  SELECT h FROM h GROUP BY h HAVING count(*) > 1
), c AS (
  SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 400, true) AS fresh FROM h JOIN m USING (h)
), n AS (
  SELECT r, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS g FROM c
), g AS (
  SELECT r, min(i) AS lo, max(i) + 400 AS hi FROM n GROUP BY r, g
), k AS (
  SELECT r, list(lo ORDER BY lo) AS lo, list(hi ORDER BY lo) AS hi FROM g GROUP BY r
)
SELECT d.doc_id, CAST(len(x) AS BIGINT) // 2 AS n_bytes, CAST(coalesce(list_sum(hi) - list_sum(lo), 0) AS BIGINT) AS n_removed,
  CAST(coalesce(len(lo), 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN lo IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(lo) + 1), lambda j:
    substr(x, CASE WHEN j = 0 THEN 1 ELSE 2 * hi[j] - 1 END,
      CASE WHEN j = len(lo) THEN CAST(len(x) AS BIGINT) ELSE 2 * lo[j + 1] - 2 END - CASE WHEN j = 0 THEN 0 ELSE 2 * hi[j] - 2 END)), '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_suffix_array": OP12, "op13_negatives": OP13, "op11_merkle": OP11, "op2_chat": OP2, "op10_topk": OP10, "op5_substring": OP5, "op6_exact_dedup": OP6, "op9_minhash": OP9}
