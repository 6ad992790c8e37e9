import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from groundphrase.llm import suffixes
from oracle import same

SF = "/root/testdata/sf0.01"
KIND = "doc_id long, text string"


def brute(rows, window):
    """From the definition."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + window] for _, b in data for k in range(len(b) - window + 1))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in df.collect()), key=repr)


def test_oracle(spark):
    same(entry.queries()["op12_suffix_array"](spark, SF), entry.oracle_sql()["op12_suffix_array"], SF)


def planted(seed):
    """Texts over few letters with shared passages, copies, repeats inside a text, runs of one letter, and edges."""
    rng = random.Random(seed)
    word = lambda n, letters="abcé ": "".join(rng.choice(letters) for _ in range(n))
    passages = [word(rng.randint(20, 90)) for _ in range(6)]
    texts = ["".join(word(rng.randint(0, 60)) + rng.choice([*passages, ""]) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    texts += [texts[3]] * 20 + [passages[0] * 7, "a" * 300, "ab" * 150, "x" + "a" * 120, None, "", "z" * 29, word(200)]
    near = list(texts[5])
    for _ in range(25):
        other = near.copy()
        if other:
            other[rng.randrange(len(other))] = "Q"
        texts.append("".join(other))
    rows = list(enumerate(texts))
    return rows + [(7, passages[1] + "tail"), (7, texts[7]), (None, passages[2] + "end"), (None, None)]


@pytest.mark.parametrize("seed, group", [(1, 1 << 25), (2, 1 << 25), (3, 400), (4, 0)])
def test_brute_force(spark, seed, group):
    """Groups that fit, and (with a small bound) anchors that are dealt by whole windows."""
    rows = planted(seed)
    got = suffixes.remove_repeats(spark.createDataFrame([(*r, 1) for r in rows], KIND + ", key int"), 30, 8, group)
    want = brute(rows, 30)
    assert sum(w[2] for w in want) > 2000
    assert rows_of(got) == want


def test_empty_and_long(spark, monkeypatch):
    assert suffixes.remove_repeats(spark.createDataFrame([], KIND)).count() == 0
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range(2_500_000))
    rows = [(1, long), (2, "q" * 10 + long[1_200_000:1_200_900] + "r"), (3, long[-500:]), (4, "s" * 399)]
    got = {r[0]: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, KIND)).collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 4)] == [1400, 900, 500, 0]
    assert [got[i].n_spans for i in (1, 2, 3, 4)] == [2, 1, 1, 0]
    assert bytes(got[1].kept).decode() == long[:1_200_000] + long[1_200_900:-500] and bytes(got[2].kept) == b"q" * 10 + b"r"


def test_columns_are_sorted_suffixes():
    """Each round has the suffixes of one column in order, what stands before them, and what neighbours share."""
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(40)] + [b"abba"] * 3
    at = np.array([rng.randrange(len(t)) for t in texts])
    group = np.sort(np.array([rng.randrange(5) for _ in texts]))
    before = None
    for x, order, symbols, common in suffixes.Columns(texts, at, group, 12):
        there = [i for i, t in enumerate(texts) if 0 <= x + at[i] < len(t)]
        suffix = lambda i: (group[i], texts[i][x + at[i] :])  # noqa: B023, E731
        assert sorted(order.tolist()) == there
        listed = [suffix(i) for i in order.tolist()]
        assert listed == sorted(listed)
        for (g, a), (h, b), n in zip(listed, listed[1:], common[1:].tolist()):
            shared = next((k for k, (c, d) in enumerate(zip(a, b)) if c != d), min(len(a), len(b)))
            assert n == (min(shared, 12) if g == h else 0)
        if before is not None:
            assert Counter(symbols.tolist()) == Counter(texts[i][x + at[i]] for i in there)
        before = order
