import random

import __spark_entry__ as entry
import numpy as np
from groundphrase.llm import substring as s
from oracle import same

SF = "/root/testdata/sf0.01"


def brute(texts, window):
    words = {d: (t or "").encode().split() for d, t in texts.items()}
    least = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            least.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def test_oracle(spark):
    same(entry.queries()["op5_substring"](spark, SF), entry.oracle_sql()["op5_substring"], SF)


def texts():
    random.seed(9)
    new = lambda n, k=400: [f"w{random.randint(0, k)}" for _ in range(n)]
    passages = [new(30), new(14), new(60, 3), ["x"] * 40]
    out = {}
    for i in range(60):
        parts = []
        for _ in range(random.randint(0, 6)):
            p = random.choice(passages)
            lo = random.randint(0, 5)
            parts += random.choice([new(random.randint(0, 20)), p, p[lo:], p[: len(p) - lo]])
        out[i * 2 + 1] = random.choice([" ", "\n", "\t "]).join(parts)
    return out | {500: None, 501: "", 502: out[1], 503: "é " * 30_000}


def test_brute_force_with_small_and_hot_groups(spark):
    t = texts()
    docs = spark.createDataFrame([(*x, 7, "n") for x in t.items()], "doc_id long, text string, anchor int, words string")
    want = {w: brute(t, w) for w in (12, 20)}
    for window, anchor, group in ((12, 4, 500), (12, 4, 2), (20, 8, 5)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in s.remove_repeats(docs, window, anchor, group).collect()}
        assert got == want[window]
    assert any(v[1] for v in want[12].values())


def test_edges(spark):
    a = " ".join(f"q{i}" for i in range(60))
    docs = spark.createDataFrame([(2, a), (None, a), (1, a + " end"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in s.remove_repeats(docs).collect()}
    assert got == {1: (61, 0), 2: (60, 60), None: (60, 0), 3: (0, 0)}
    assert s.remove_repeats(docs.limit(0)).count() == 0


def test_few_documents_that_repeat_a_line_are_hot(spark):
    line = " ".join(f"l{i}" for i in range(7)) + "\n"
    t = {i: f"start {i}\n" + line * 2000 for i in range(3)} | {3: "one " * 5000, 4: "one " * 5000, 5: line * 3}
    docs = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    assert {r.level for r in s.keys_of_documents(docs, 12, 4, 500).collect()} >= {2}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in s.remove_repeats(docs, 12, 4, 500).collect()}
    assert got == brute(t, 12)


def test_prefixes_grow_until_a_group_fits(spark):
    """Each place is in one group of its level, and no group of a tree has more than `group` places."""
    docs = spark.createDataFrame(list(texts().items()), "doc_id long, text string")
    window, anchor, group = 20, 8, 12
    levels = {}
    for r in s.keys_of_documents(docs, window, anchor, group).collect():
        levels.setdefault(r.level, set()).add(r.key)
    assert set(levels) == {0, 1, 2}
    held = {}
    for text in texts().values():
        x = s.Anchors(s.words_of(text), window, anchor)
        for level, longer in ((0, False), (1, True)):
            for key, lo, hi in x.runs(list(levels[level]), longer):
                assert lo <= hi
                held[key] = held.get(key, 0) + 1
    assert held and max(held.values()) <= group


def test_many_documents_that_repeat_a_line(spark):
    """A line that stands 2,000 times in each of 60 documents: places are counted, so no group holds them."""
    line = " ".join(f"r{i}" for i in range(9)) + "\n"
    t = {i: f"head {i}\n" + line * 2000 + f"tail {i}" for i in range(60)}
    docs = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in s.remove_repeats(docs).collect()}
    assert got == {i: (18_004, 18_001 if i else 0) for i in t}  # "tail" ends a repeated window


def test_suffixes_are_sorted_and_common_prefixes_exact():
    random.seed(2)
    texts = [[random.choice([b"a", b"b"]) for _ in range(random.randint(0, 40))] for _ in range(12)]
    f = s.SuffixForest(texts)
    at = [(t, i) for t, x in enumerate(texts) for i in range(len(x))]
    order, node = s.deep_nodes(f, np.zeros(len(at), "int64"), np.array([f.begin[t] + i for t, i in at]), 5)
    suffix = lambda k: texts[at[k][0]][at[k][1] :]
    number = {w: f.levels[0][f.begin[t] + i] for t, x in enumerate(texts) for i, w in enumerate(x)}
    ranks = [[number[w] for w in suffix(k)] for k in order]
    assert ranks == sorted(ranks)
    for i in range(1, len(order)):
        a, b = suffix(order[i - 1]), suffix(order[i])
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        starts = [np.array([f.begin[at[order[j]][0]] + at[order[j]][1]]) for j in (i - 1, i)]
        assert f.common(*starts)[0] == n and (node[i] == node[i - 1]) == (n >= 5)
