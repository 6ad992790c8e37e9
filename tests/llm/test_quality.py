import zlib

import numpy as np
from groundphrase.llm import quality as q
from groundphrase.llm.queries import op4_quality
from groundphrase.sources import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    for v in np.unique(score):
        rank[score == v] = 0
    s, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    mid = np.cumsum(counts) - (counts - 1) / 2
    rank = mid[inverse]
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    rows = op4_quality(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id] for r in held])
    a, acc = auc(np.array([r.score for r in held]), y), np.mean([r.predicted == labels[r.doc_id] for r in held])
    print("AUC", a, "accuracy", acc, "of", len(held))
    assert a > 0.9 and acc > 0.9


def test_normal_equations_and_isotonic():
    x, y = np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 1, 1.0])
    knots, levels = q.isotonic(x, y)
    assert np.allclose(levels, [0, 0.5, 1]) and np.allclose(knots, [0.1, 0.25, 0.45])
    assert np.isfinite(q.statistics(None)).all() and q.statistics("") == q.statistics(None)


def test_summed_equations_against_a_direct_solution(spark):
    """The weights from partition sums are those of least squares on all rows at once, with the penalty as further rows."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = q.fit(docs, labels, features=24)
    known = labels.filter(~q.held_out(F.col("doc_id"))).join(docs, "doc_id")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(q.SEED + 1)), F.lit(4)) == 0
    rows = known.select("quality", "text", fold.alias("fold")).collect()
    x, y = np.array([q.statistics(r.text) for r in rows]), np.array([r.quality for r in rows], "float64")
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.std, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1), atol=1e-6)
    learn = np.array([not r.fold for r in rows])
    z = model.fourier(x[learn])
    penalty = np.sqrt(1e-3 * len(rows) / 24) * np.eye(25)
    direct = np.linalg.lstsq(np.vstack([z, penalty]), np.concatenate([y[learn], np.zeros(25)]), rcond=None)[0]
    assert np.allclose(z @ direct, z @ model.weight, atol=1e-6)
    knots, levels = q.isotonic(model.raw(x[~learn]), y[~learn])
    assert np.allclose(knots, model.knots) and np.allclose(levels, model.levels)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (None, "a b", 0.3), (3, "x " * 200_000, 0.4)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    for labels in (none, none.limit(0), spark.createDataFrame([(1, 1), (3, 1), (1, 0)], "doc_id long, quality int")):
        model = q.fit(docs, labels)
        got = q.with_score(docs, model, score_col="s").collect()
        assert len(got) == 4 and all(0 <= r.s <= 1 for r in got)
    assert q.keep_good(docs, none).count() == 0 and q.keep_good(docs, none, 0.5).columns == docs.columns
    assert q.with_score(docs.limit(0), model, score_col="s").count() == 0
    assert q.keep_good(docs.limit(0), none.limit(0)).count() == 0
