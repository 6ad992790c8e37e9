import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from groundphrase.llm.queries import op8_sharding
from groundphrase.llm.sharding import Shard, ShardStore
from groundphrase.sources import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_query_has_every_document_once(spark):
    docs = table(spark, SF, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("text_sha256"))
    got = op8_sharding(spark, SF)
    assert got.filter("shard_bytes is null").count() == 0
    assert sorted(map(tuple, got.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert all(r.n == r.shard_rows for r in got.groupBy("shard", "shard_rows").agg(F.count("*").alias("n")).collect())


def test_versions_merges_and_conflicts(spark, tmp_path):
    s = ShardStore(spark, f"file://{tmp_path}/store", target=1 << 20, fan_in=3, smallest=1 << 30)
    assert s.version() == 0 and s.read() is None and s.compact() == 0
    frames = [spark.range(100 * i, 100 * i + 100).selectExpr("id", "if(id % 9 = 0, null, repeat('x', 50)) text") for i in range(7)]
    for f in frames:
        assert len(s.append(f)) == 1
    old = s.version()
    assert old == 7 and s.compact() == 3 and s.version() == 10
    want = sorted(r.id for f in frames for r in f.collect())
    assert sorted(r.id for r in s.read().collect()) == want == sorted(r.id for r in s.read(old).collect())
    assert sum(x.rows for x in s.manifest()) == 700 and len(s.manifest()) == 1
    with pytest.raises(FileExistsError):
        s.commit(old, [])
    assert s.version() == 10
    s.vacuum()
    assert sorted(r.id for r in s.read().collect()) == want


def test_arrivals_and_tiers(spark, tmp_path):
    s = ShardStore(spark, f"file://{tmp_path}/store", fan_in=4)
    docs = spark.range(90).selectExpr("id", "if(id % 3 = 2, null, cast(id % 3 as int)) lot")
    assert len(s.append(docs, "lot")) == 3 and sorted(x.rows for x in s.manifest()) == [30, 30, 30]
    assert s.append(docs.limit(0), "lot") == [] and s.version() == 3
    assert len(s.append(docs.selectExpr("id", "if(id < 10, 'a b/c', 'd') k"), "k")) == 2
    assert sorted(x.rows for x in s.manifest()) == [10, 30, 30, 30, 80]
    assert len(s.append(docs)) == 1 and s.manifest()[-1].rows == 90
    assert s.read(shards=s.manifest()[-1:]).columns == ["id", "lot"]
    assert [Shard("", 0, n).tier(10, 4) for n in (0, 10, 39, 40, 159, 160)] == [0, 0, 0, 1, 1, 2]


def test_shards_of_many_small_files_are_rewritten_at_any_size(spark, tmp_path):
    s = ShardStore(spark, f"file://{tmp_path}/store", target=64 << 10, fan_in=4)
    docs = spark.range(0, 8000, 1, 40).selectExpr("id", "sha2(cast(id as string), 256) text")
    s.append(docs)
    (before,) = s.manifest()
    assert before.size > 4 * s.target and len(before.sizes) == 40 and max(before.sizes) < s.target / 2
    assert s.compact(vacuum=True) == 1
    (after,) = s.manifest()
    assert after.rows == 8000 and sum(after.sizes) == after.size
    assert max(after.sizes) <= s.target * 1.1 and sum(2 * n < s.target for n in after.sizes) <= 1
    assert sorted(r.id for r in s.read().collect()) == list(range(8000))
    assert s.compact() == 0 and spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_two_writers(spark, tmp_path):
    """Appends and merges of two stores on one folder: all commits succeed, no row is lost or doubled."""
    root = f"file://{tmp_path}/store"
    a, b = (ShardStore(spark, root, target=1 << 20, fan_in=3, smallest=1 << 30) for _ in range(2))
    with ThreadPoolExecutor(2) as pool:
        for done in [pool.submit(s.append, spark.range(100 * i, 100 * i + 100, 1, 1)) for i, s in enumerate([a, b] * 4)]:
            assert len(done.result()) == 1
        merges = [pool.submit(s.compact) for s in (a, b)]
        assert sum(m.result() for m in merges) >= 2
    assert a.version() == b.version() and sorted(r.id for r in a.read().collect()) == list(range(800))
    a.vacuum()
    assert sorted(r.id for r in b.read().collect()) == list(range(800))


def test_vacuum_spares_what_is_being_written(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    a, b = ShardStore(spark, root), ShardStore(spark, root)
    a.append(spark.range(10))
    commit = ShardStore.commit

    def slow(self, base, shards):
        if self is a:
            b.vacuum()  # between the writing of the shard and its commit
        return commit(self, base, shards)

    monkeypatch.setattr(ShardStore, "commit", slow)
    a.append(spark.range(10, 20))
    assert sorted(r.id for r in b.read().collect()) == list(range(20))
    monkeypatch.undo()
    with pytest.raises(ValueError), a._intent("shards/lost"):
        spark.range(3).write.parquet(f"{root}/shards/lost")
        b.vacuum()
        assert (tmp_path / "store/shards/lost").exists()
        raise ValueError
    b.vacuum()
    assert not (tmp_path / "store/shards/lost").exists() and b.read().count() == 20
    a.fs.create(a._path(f"{root}/intents/gone"), True).close()
    b.vacuum(abandoned=0)
    assert not (tmp_path / "store/intents/gone").exists()


def test_merges_side_by_side(spark, tmp_path):
    s = ShardStore(spark, f"file://{tmp_path}/store", target=1 << 20, fan_in=2, smallest=1 << 30)
    for i in range(6):
        s.append(spark.range(i, i + 1))
    assert [len(r) for r in s.runs(s.manifest(), set())] == [2, 2, 2]
    assert s.compact(vacuum=True, at_once=3) == 5 and len(s.manifest()) == 1 and s.read().count() == 6


GAPS = ["start", "folders", "notes", "manifest", "end"]


@pytest.mark.parametrize("begin, commit", [(i, j) for i in range(5) for j in range(i, 5)])
def test_vacuum_spares_writers_that_start_between_its_listings(spark, tmp_path, monkeypatch, begin, commit):
    """A writer that begins in one gap of vacuum() and commits in the same or a later one keeps all its rows."""
    store = ShardStore(spark, str(tmp_path / "s"))
    store.append(spark.range(10).coalesce(1))
    name = "shards/a-late"
    note = store._intent(name)

    def reach(gap):
        if GAPS[begin] == gap:
            note.__enter__()
            spark.range(10, 15).coalesce(1).write.parquet(f"{store.root}/{name}")
        if GAPS[commit] == gap:
            store.change(lambda shards: [*shards, store._shard(name, 5)])
            note.__exit__(None, None, None)

    busy = []

    def after(method, gap):
        whole = getattr(store, method)

        def run(*args):
            out = whole(*args)
            if not busy:
                busy.append(gap)
                reach(gap)
                busy.clear()
            return out

        monkeypatch.setattr(store, method, run)

    for method, gap in (("_folders", "folders"), ("_notes", "notes"), ("latest", "manifest")):
        after(method, gap)
    busy.append("start")
    reach("start")
    busy.clear()
    store.vacuum()
    busy.append("end")
    reach("end")
    assert sorted(r.id for r in store.read().collect()) == list(range(15))
    store.vacuum()
    assert sorted(r.id for r in store.read().collect()) == list(range(15))


def test_two_compactions_that_vacuum_side_by_side(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), target=1 << 20, fan_in=2, smallest=1)
    for i in range(12):
        store.append(spark.range(i * 100, i * 100 + 100).coalesce(1))
    others = [ShardStore(spark, store.root, target=1 << 20, fan_in=2, smallest=1) for _ in range(3)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda s: (s.compact(vacuum=True), s.vacuum()), others))
    assert sorted(r.id for r in store.read().collect()) == list(range(1200))
    assert len(store.manifest()) < 12


def test_a_merge_whose_shards_are_gone_gives_up(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), fan_in=2, smallest=1)
    for i in range(2):
        store.append(spark.range(i, i + 1).coalesce(1))
    run = store.manifest()
    assert store.compact(vacuum=True) == 1
    assert store._merge(run, True) is None
    assert sorted(r.id for r in store.read().collect()) == [0, 1]


def test_one_of_many_writers_of_a_version_wins(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"))

    def tried(i):
        try:
            return store.commit(version, [Shard(f"shards/{i}", 0, 0)]) and i
        except FileExistsError:
            return None

    for version in range(25):
        with ThreadPoolExecutor(8) as pool:
            won = [i for i in pool.map(tried, range(8)) if i is not None]
        assert len(won) == 1 and store.manifest(version + 1)[0].name == f"shards/{won[0]}"
    assert not [n for n in os.listdir(tmp_path / "s/manifests") if "tmp" in n]


def test_a_slow_writer_does_not_take_a_version_that_was_vacuumed(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"))
    store.append(spark.range(3).coalesce(1))
    base, before = store.latest()
    for i in range(3):
        store.append(spark.range(10 * i, 10 * i + 3).coalesce(1))
    store.vacuum()
    with pytest.raises(FileExistsError):
        store.commit(base, before)
    assert store.read().count() == 12
