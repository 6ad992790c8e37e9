"""Replies merged into the table of phrases, against a plain version, and as versions of a stored table."""

import random

import pytest
from groundphrase.operators import merging as mg
from groundphrase.sources.phrase_table import PhraseTable

EXPRS = "patch_id long, target_kind string, target_id long, pos int, expr_type string, text string, split string"
REPLIES = "patch_id long, target_kind string, target_id long, round int, reply struct<enhanced_expressions:array<struct<original_expression:string,variation:string>>,unique_description:string,unique_expressions:array<string>>"


def plain(exprs, replies):
    out, targets = [], {}
    for r in exprs:
        targets.setdefault(r[:3], []).append(r)
    for key, rows in targets.items():
        mine = [r for r in replies if r[:3] == key and r[4] is not None]
        enhanced, told, unique = max(mine, key=lambda r: r[3])[4] if mine else ([], None, [])
        enhanced = [(i, o or "", v) for i, (o, v) in enumerate(enhanced or []) if v and v.strip()]
        unique = [(i, u) for i, u in enumerate(unique or []) if u and u.strip()]
        new, originals, counts = [], sorted((r[3], r[5]) for r in rows if r[4] == "original" and r[5] is not None), {}
        for i, o, v in enhanced:
            base = next((str(p) for p, t in originals if t == o), None)
            if base is None:
                base = str(min(originals, key=lambda x: (abs(len(x[1]) - len(o)), x[0]))[0]) if originals else str(i)
            new.append(("enhanced", v, f"{base}_var_{counts.get(base, 0)}", base))
            counts[base] = counts.get(base, 0) + 1
        if unique and told and told.strip():
            new.append(("unique_description", told, "unique_description", None))
        new += [("unique", u, f"unique_{i}", None) for i, u in unique]
        kept = [r for r in rows if not new or r[4] not in mg.FROM_MODEL]
        out += [(*r[:6], r[6], str(r[3]), None) for r in kept]
        last = max((r[3] for r in kept if r[4] not in mg.FROM_MODEL), default=-1)
        split = min(rows, key=lambda r: r[3])[6]
        out += [(*key, last + 1 + n, kind, text, split, own, base) for n, (kind, text, own, base) in enumerate(new)]
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some(seed, patches=12):
    rng, exprs, replies = random.Random(seed), [], []
    word = lambda: "x" * rng.randrange(1, 9) + rng.choice("abc")
    for p in range(patches):
        for t in range(3):
            key = (p, "individual", p * 10 + t)
            n = rng.randrange(0, 5)
            texts = [word() for _ in range(n)]
            kinds = ["original"] * n + ["enhanced", "unique"][: rng.randrange(3)]
            exprs += [(*key, i, kind, texts[i] if i < n and rng.random() < 0.95 else (None if i < n else word()), f"s{i % 2}") for i, kind in enumerate(kinds)]
            for r in range(rng.randrange(3)):
                items = [(rng.choice([*texts, word(), None]), rng.choice([word(), word(), " ", None])) for _ in range(rng.randrange(5))]
                replies.append((*key, r, None if rng.random() < 0.1 else (items, rng.choice([None, "d"]), [rng.choice([word(), ""]) for _ in range(rng.randrange(3))])))
    replies.append((999, "individual", 1, 0, ([("a", "b")], None, ["c"])))
    return exprs, replies


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_version(spark, seed):
    exprs, replies = some(seed)
    e, r = spark.createDataFrame(exprs, EXPRS), spark.createDataFrame(replies, REPLIES)
    merged = mg.merge_replies(e, r, order="round")
    assert merged.columns == [*e.columns, "expr_id", "base_id"] and told(merged) == plain(exprs, replies)
    assert told(mg.merge_replies(merged, r, order="round")) == told(merged)
    known = {x[:3] for x in exprs}
    assert sorted(tuple(x)[:4] for x in mg.unmatched_replies(e, r).collect()) == sorted(x[:4] for x in replies if x[:3] not in known)


def test_empty_tables(spark):
    exprs, replies = some(3)
    e, r = spark.createDataFrame(exprs, EXPRS), spark.createDataFrame(replies, REPLIES)
    assert told(mg.merge_replies(e, r.limit(0), order="round")) == plain(exprs, [])
    assert mg.merge_replies(e.limit(0), r).count() == 0


def test_versions_of_a_stored_table(spark, tmp_path):
    exprs, replies = some(4)
    e = spark.createDataFrame(exprs, EXPRS)
    table = PhraseTable(spark, f"{tmp_path}/phrases")
    assert table.version() == -1 and table.create(e, buckets=5) == 0
    with pytest.raises(FileExistsError):
        PhraseTable(spark, f"{tmp_path}/phrases").create(e)
    few = [r for r in replies if r[0] == 3]
    assert table.merge(spark.createDataFrame(few, REPLIES), "round") == 1
    assert told(table.read()) == plain(exprs, few) and told(table.read(0)) == plain(exprs, [])
    old, new = table._manifest(0)["folders"], table._manifest(1)["folders"]
    assert sum(old[k] != new[k] for k in old) == 1
    assert table.merge(spark.createDataFrame([], REPLIES)) == 1


def test_two_merges_side_by_side(spark, tmp_path, monkeypatch):
    """Another merge commits between this one's writing and its commit: of other buckets (work is kept) and of the same (done anew)."""
    exprs, replies = some(6)
    table, other = (PhraseTable(spark, f"{tmp_path}/phrases") for _ in range(2))
    table.create(spark.createDataFrame(exprs, EXPRS), buckets=64)
    first, second = [r for r in replies if r[0] in (1, 2)], [r for r in replies if r[0] in (2, 7)]
    writes, write, commit = [], table._write, table._commit
    monkeypatch.setattr(table, "_write", lambda *a: writes.append(1) or write(*a))

    def late(version, manifest):
        if version == 1:
            other.merge(spark.createDataFrame(second, REPLIES), "round")
        return commit(version, manifest)

    monkeypatch.setattr(table, "_commit", late)
    assert table.merge(spark.createDataFrame(first, REPLIES), "round") == 2 and len(writes) == 2
    assert told(table.read()) == plain(exprs, first + second)
    monkeypatch.setattr(table, "_commit", lambda v, m: (other.merge(spark.createDataFrame([r for r in replies if r[0] == 9], REPLIES), "round") if v == 3 else None, commit(v, m))[1])
    assert table.merge(spark.createDataFrame([r for r in replies if r[0] == 5], REPLIES), "round") == 4 and len(writes) == 3
    assert told(table.read()) == plain(exprs, [r for r in replies if r[0] in (1, 2, 5, 7, 9)])
