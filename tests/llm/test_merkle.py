import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from groundphrase.llm import merkle
from oracle import same

SF = "/root/testdata/sf0.01"
KIND = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, low=False):
    text = row[4]
    if low and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    parts = [*row[:4], text]
    return sha("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def proofs(leaves, arity):
    """(root, siblings of every leaf, by level as (left, right)) of a tree made level by level."""
    level, at, found = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, a in enumerate(at):
            run = a // arity * arity
            found[i].append((level[run:a], level[a + 1 : run + arity]))
        level = [sha("".join(level[k : k + arity])) for k in range(0, len(level), arity)]
        at = [a // arity for a in at]
    return level[0], found


def brute(rows, arity=8):
    """All columns of the query, from the definition."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for rs in by.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {x: proofs([leaf(r) for r in by[x]], arity) for x in names}
    root, tops = proofs([trees[x][0] for x in names], arity) if names else (None, [])
    out = []
    for x, top in zip(names, tops):
        for r, low in zip(by[x], trees[x][1]):
            path = low + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf(r, hit)
            for left, right in path:
                now = sha("".join([*left, now, *right]))
            proof = sha("".join(h for left, right in path for h in [*left, *right]))
            out.append((r[0], leaf(r), trees[x][0], root, proof, now, now == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_oracle(spark):
    same(entry.queries()["op11_merkle"](spark, SF), entry.oracle_sql()["op11_merkle"], SF)


@pytest.mark.parametrize("height, arity", [(1, 2), (2, 3), (1, 8), (4, 8)])
def test_brute_force_with_blocks_of_any_size(spark, height, arity):
    random.seed(height * 10 + arity)
    names = [None, "", "de", "en", "zz", "é", "\U0001f600", *"abcdefgh"]
    rows = [(random.choice([None, *range(150)]), random.choice(["w", None]), random.choices(names, [30, 1, 9, 60] + [1] * 11)[0], 3, random.choice(["Ab", "ab", None, "", "ÄB"])) for _ in range(400)]
    df = spark.createDataFrame(rows, KIND).withColumn("pos", F.lit("x"))  # a clashing name
    got = merkle.verified_documents(df, height, arity).select(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, arity)


def test_lone_and_empty(spark):
    one = [(1, "s", "en", 2, "Hi")]
    got = merkle.verified_documents(spark.createDataFrame(one, KIND)).collect()
    assert [(r.leaf, r.subroot, r.root, r.witness, r.proof_sha256) for r in got] == [(leaf(one[0]),) * 3 + ([], sha(""))]
    assert merkle.verified_documents(spark.createDataFrame([], KIND)).count() == 0


def test_equal_rows_take_places_of_their_own(spark):
    rows = [(5, "s", "en", 2, "Hi")] * 20
    got = merkle.verified_documents(spark.createDataFrame(rows, KIND)).select(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_long_text(spark):
    rows = [(i, "s", "en", 1, "Wörd " * 400_000) for i in range(3)]
    got = merkle.verified_documents(spark.createDataFrame(rows, KIND)).select(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_witnesses_grow_while_leaves_arrive():
    """After any number of leaves, what is known of each witness is the start of the final one."""
    leaves = [sha(str(i)) for i in range(60)]
    root, paths = proofs(leaves, 3)
    final = [[("".join(a), "".join(b)) for a, b in p] for p in paths]
    tree = merkle.Appender(len(final[0]), 3)
    seen = 0
    for n, x in enumerate(leaves, 1):
        tree.append(x)
        for i in range(n):
            known = [(left[i // 3**k], right[i // 3**k]) for k, (left, right) in enumerate(tree.known) if i // 3**k < len(left)]
            assert known == final[i][: len(known)]
            seen += len(known)
    assert seen
    assert tree.close() == root
    assert [[(w["left"], w["right"]) for w in x] for x in tree.witnesses(60).to_pylist()] == final


def test_appends_give_what_one_append_gives(spark, tmp_path):
    rows = [(i, sha(str(i)), "=en" if i % 3 else "=de" if i < 90 else "=it") for i in range(200)]
    df = spark.createDataFrame(rows, "i long, digest string, tree string")
    whole = merkle.manifest(df, [F.col("i")], 2, 3)
    grown = merkle.manifest(df.filter("i < 40"), [F.col("i")], 2, 3)
    for lo, hi in ((40, 41), (41, 150), (150, 200)):
        grown.write(str(tmp_path / f"m{lo}"))
        grown = merkle.Manifest.read(spark, str(tmp_path / f"m{lo}"), 2, 3)
        before = {tuple(r) for r in grown.blocks.filter("full").select("tree", "pos", "digest").collect()}
        grown = grown.append(df.filter((F.col("i") >= lo) & (F.col("i") < hi)), [F.col("i")])
        assert before <= {tuple(r) for r in grown.blocks.select("tree", "pos", "digest").collect()}
    columns = ["i", "tree", "pos", "digest", "subroot", "root", "witness"]
    a, b = (sorted(m.witnesses().select(columns).collect()) for m in (whole, grown))
    assert a == b and len(a) == 200
