from collections import Counter
from fractions import Fraction

import pytest
from groundphrase.llm import mixing as m
from groundphrase.llm.queries import op3_mixing
from groundphrase.sources import table

SF = "/root/testdata/sf0.01"


def check(rows, weights, block):
    """Every row once; windows hold; before the first gap each source is within one block of its share of these weights."""
    total = sum(map(Fraction, weights.values()))
    by_slot = {}
    for r in rows:
        assert r.release <= r.slot < r.deadline
        by_slot.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(v) == 1 for v in by_slot.values())
    assert len({r.place for r in rows}) == len(rows)
    done = Counter()
    horizon = 0
    while horizon in by_slot:
        ((s, _),) = by_slot[horizon]
        done[s] += 1
        horizon += 1
        for k, w in weights.items():
            assert abs(done[k] - horizon * Fraction(w) / total) < 1
    assert {r.slot < horizon for r in rows if r.on_target} <= {True}
    return horizon


def test_query(spark):
    rows = op3_mixing(spark, SF).collect()
    counts = Counter(r.source for r in table(spark, SF, "documents").collect())
    assert Counter(r.source for r in rows) == counts
    check(rows, {s: n**0.5 for s, n in counts.items()}, m.BLOCK)


def test_schedule_over_many_slots():
    """The deviation from the weights given stays under one block over 200,000 slots, also for a weight far below 1/2000."""
    weights = {"a": 7, "b": 2.5, "c": 0.003, "d": Fraction(1, 3)}
    total, n = sum(map(Fraction, weights.values())), 200_000
    blocks = {s: int(n * Fraction(w) / total) + 2 for s, w in weights.items()}
    done, at = Counter(), 0
    every = {s: Fraction(w) / total for s, w in weights.items()}
    for s, j, release, deadline, slot in m.schedule(weights, blocks):
        assert release <= slot < deadline and j == done[s]
        if slot != at or slot >= n:
            break
        done[s], at = done[s] + 1, at + 1
        if at % 7 == 0 or s == "c":
            assert all(abs(done[k] - at * e) < 1 for k, e in every.items())
    assert at == n and done["c"] >= 60
    for uneven in ({"a": 1, "b": 1}, {"a": 0.5, **{f"s{i}": 0.01 for i in range(50)}}):
        plan = list(m.schedule(uneven, dict.fromkeys(uneven, 5)))
        assert all(release <= slot < deadline for _, _, release, deadline, slot in plan) and len({p[4] for p in plan}) == len(plan)


def test_rows_that_repeat_an_id_have_one_order(spark):
    rows = [(7, "s", f"t{i}") for i in range(40)] + [(i, "s", "x") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one, two = ({(r.doc_id, r.text): r.mix.place for r in m.mix(d, block=8, part=30).collect()} for d in (docs, docs.repartition(5, "text")))
    assert one == two


def test_hot_source_weights_and_edges(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", f"t{i}", 1) for i in range(2000)]
    rows += [(None, None, "x", 1), (5, None, "x", 1), (5, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, p int")
    out = m.mix(docs, {"hot": 3.0, None: 1.0}, block=8, part=100)
    got = out.selectExpr("source", "mix.*").collect()
    assert len(got) == len(rows)
    assert check(got, {s: {"hot": 3.0, None: 1.0}.get(s, 2.0) for s in {r[1] for r in rows}}, 8) > 0
    ordered = m.mixed(docs, block=8, rows_per_file=300)
    assert ordered.columns == docs.columns
    assert sorted(map(repr, ordered.collect())) == sorted(map(repr, docs.collect()))
    place = {}
    for r in m.mix(docs, block=8).collect():
        place.setdefault((r.doc_id, r.source), []).append(r.mix.place)
    seen = [place[r.doc_id, r.source][0] for r in ordered.collect() if len(place[r.doc_id, r.source]) == 1]
    assert seen == sorted(seen)
    assert m.mix(docs.limit(0)).count() == 0 and m.mixed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        m.mix(docs, mix_col="P")


def test_deviation_from_the_weights_given(spark):
    sizes, weights = {"a": 3, "b": 5000, "c": 2500}, {"a": 0.0001, "b": 0.66661, "c": 0.33329}
    docs = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    at = {r.slot: r for r in m.mix(docs, weights, block=1).selectExpr("source", "mix.*").collect()}
    assert len(at) == 7503 and all(r.release <= slot < r.deadline for slot, r in at.items())
    total, done, slot = sum(map(Fraction, weights.values())), Counter(), 0
    while slot in at:
        done[at[slot].source] += 1
        slot += 1
        assert all(abs(done[s] - slot * Fraction(w) / total) < 1 for s, w in weights.items())
    assert slot > 7000 and all(r.on_target == (k < slot) for k, r in at.items())


def test_many_sources(spark):
    docs = spark.range(120_000).selectExpr("id doc_id", "concat('s', id % 110000) source")
    assert m.mix(docs, block=2).agg({"mix.slot": "max", "*": "count"}).collect()[0][1] == 120_000


def test_stretches_of_a_schedule(spark, monkeypatch):
    """A schedule written in stretches is the same, row for row, as one that is held whole."""
    docs = spark.range(3000).selectExpr("id doc_id", "concat('s', CASE WHEN id % 3 = 0 THEN 0 ELSE id % 11 END) source")
    told = lambda: sorted(map(tuple, m.mix(docs, block=8, part=100).selectExpr("doc_id", "source", "mix.*").collect()))
    whole = told()
    for n in (50, len({r[4:6] for r in whole}), 1000):
        monkeypatch.setattr(m, "STRETCH", n)
        assert told() == whole


def test_a_driver_holds_one_stretch(spark, monkeypatch):
    """400,000 blocks: what Python holds at the peak does not grow with the schedule."""
    import tracemalloc

    monkeypatch.setattr(m, "STRETCH", 50_000)
    peaks = []
    for n in (100_000, 400_000):
        tracemalloc.start()
        table, horizon, end = m.planned(spark, {"a": 3, "b": 1}, {"a": n * 3 // 4, "b": n // 4})
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert (horizon, end, table.count(), table.agg({"slot": "max"}).first()[0]) == (n, n, n, n - 1)
    assert peaks[1] < 1.3 * peaks[0]
