import itertools
import random

import __spark_entry__ as entry
import numpy as np
from groundphrase.llm import minhash as m
from groundphrase.llm.shingles import rolling, shingle_set, word_hashes
from oracle import same
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def brute(texts, words, share):
    sets = {}
    for d, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() if t else []
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in texts}
    for _ in texts:
        for a, b in itertools.combinations(texts, 2):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= share * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return {d: (len(sets[d]), root[d]) for d in texts}


def test_oracle(spark):
    same(entry.queries()["op9_minhash"](spark, SF), entry.oracle_sql()["op9_minhash"], SF)


def group_texts():
    random.seed(5)
    base = [f"w{random.randint(0, 3000)}" for _ in range(120)]
    texts = {}
    for i in range(70):
        w = list(base)
        for _ in range(random.choice([0, 1, 2, 4, 7])):
            w[random.randrange(len(w))] = f"x{random.randint(0, 9999)}"
        texts[i * 3] = " ".join(w)
    for i in range(40):
        texts[1000 + i] = " ".join(f"y{random.randint(0, 500)}" for _ in range(30))
    return texts | {2000: None, 2001: "", 2002: " \n ", 2003: "One two", 2004: "one  TWO", 2005: "a b c d " * 20_000}


def test_brute_force_with_and_without_blocks(spark):
    texts = group_texts()
    docs = spark.createDataFrame([(*x, "c", 1) for x in texts.items()], "doc_id long, text string, cluster string, size int")
    for words, share, piece in ((3, 85, m.PIECE), (5, 80, m.PIECE), (3, 85, 900)):
        want = brute(texts, words, share)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.near_classes(docs, words, share / 100, piece=piece).collect()}
        assert got == want
    kept = m.drop_near_copies(docs, 3, 0.85)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in brute(texts, 3, 85).items() if c == d)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A b\tc d")], "doc_id long, text string")
    rows = sorted(m.near_classes(docs, 3, 0.85).collect(), key=repr)
    assert [(r.doc_id, r.component_id, r.kept) for r in rows] == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]
    pair = [(1, "a b c d e"), (2, "f g h i j"), (3, "a b c d e"), (3, "f g h i j"), (4, "f g h i j")]
    pair = m.near_classes(spark.createDataFrame(pair, "doc_id long, text string"), 3, 0.85).collect()
    assert {(r.doc_id, r.component_id) for r in pair} == {(1, 1), (2, 1), (3, 1), (4, 1)} and len(pair) == 5
    assert m.near_classes(docs.limit(0)).count() == 0 and m.drop_near_copies(docs.limit(0)).count() == 0


def test_signature_estimates_and_rolling():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype("uint64") * np.uint64(2) + np.uint64(1)
    errors = []
    for k in range(60):
        a, b = pool[: 1000 + 10 * k], pool[500 : 1500 + 10 * k]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((m.signature(a, 512) == m.signature(b, 512)).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04
    w = word_hashes([b"a", b"b", b"a", b"b", b"a", b"b", b"c"])
    for size in range(1, 8):
        h = rolling(w, size)
        words = ["a", "b", "a", "b", "a", "b", "c"]
        grams = [tuple(words[i : i + size]) for i in range(8 - size)]
        assert len(h) == len(grams)
        assert all((h[i] == h[j]) == (grams[i] == grams[j]) for i in range(len(h)) for j in range(len(h)))
    assert len(shingle_set("a b", 3)) == 1


def test_large_clusters_are_split_without_loss(spark):
    """Texts that share a long common part are one cluster, but no two of different groups share a rare shingle."""
    random.seed(11)
    common = [f"c{i}" for i in range(60)]
    texts = {}
    for group in range(12):
        own = [f"g{group}_{i}" for i in range(70)]
        for k in range(5):
            w = list(own)
            w[random.randrange(len(w))] = f"z{group}_{k}"
            texts[group * 10 + k] = " ".join(common + w)
    docs = spark.createDataFrame([(0, d, t) for d, t in texts.items()], "cluster long, doc_id long, text string")
    sets = m.shingle_sets(docs.withColumn("blocks", F.lit(9)), 3)
    parts = {}
    for r in m.split_clusters(sets, 85).collect():
        parts.setdefault(r.cluster, set()).add(r.doc_id)
    assert sorted(map(sorted, parts.values())) == [[g * 10 + k for k in range(5)] for g in range(12)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.near_classes(docs.drop("cluster"), 3, 0.85, rows=1, piece=2000).collect()}
    assert got == brute(texts, 3, 85)
