"""One file a patch: written, sampled before parsing, left whole by failures."""

import os

import pytest
from groundphrase.sources import patch_files as pf
from groundphrase.sources import readers as rd
from groundphrase.sources import sinks as si
from pyspark.sql import functions as F

BOX = "patch_id long, object_id long, pos int, category string, xmin int, ymin int, xmax int, ymax int, is_cutoff boolean"


def documents(spark, n):
    o = spark.createDataFrame([(p, 10 * p + k, k, "ship & <co>", k, 2, 3, 4, k == 0) for p in range(n) for k in range(p % 3)], BOX)
    patches = spark.createDataFrame([(p, f"P{p} é=%_patch_{p}.png", 480, 480) for p in range(n)], "patch_id long, filename string, width int, height int")
    return si.annotation_documents(patches, o).drop("patch_id").repartition(4)


def test_a_file_a_patch(spark, tmp_path):
    root = f"{tmp_path}/out"
    assert pf.write_patch_files(documents(spark, 20), root) == 20
    names = {f for f in os.listdir(root) if not f.startswith(".")}
    assert names == {f"P{p} é=%_patch_{p}.xml" for p in range(20)} | {"_SUCCESS"} and not [f for f in os.listdir(root) if f.startswith(".staged")]
    back = rd.read_annotations(spark, root)
    assert back["patches"].count() == 20 and back["objects"].filter("category = 'ship & <co>'").count() == sum(p % 3 for p in range(20))
    # again, with fewer objects: the files are replaced
    assert pf.write_patch_files(documents(spark, 20).withColumn("object", F.slice("object", 1, 1)), root) == 20
    assert rd.read_annotations(spark, root)["objects"].count() == sum(p % 3 > 0 for p in range(20))


def test_bad_rows_leave_nothing(spark, tmp_path):
    root = f"{tmp_path}/out"
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z")], "n string, t string").repartition(3)
    with pytest.raises(ValueError, match="names repeat, a among them"):
        pf.write_patch_files(rows, root, F.col("n"), F.col("t"))
    for n, t in (("a/b", "x"), ("", "x"), (None, "x"), ("a", None)):
        with pytest.raises(Exception, match="no file can be written"):
            pf.write_patch_files(spark.createDataFrame([(n, t)], "n string, t string"), root, F.col("n"), F.col("t"))
    assert os.listdir(root) == []
    assert pf.write_patch_files(rows.limit(0), root, F.col("n"), F.col("t")) == 0


def test_a_failed_driver_is_made_good(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/out"
    decoded, seen = pf._decoded, []

    def fails(folder):
        seen.append(folder)
        if len(seen) > 5:
            raise RuntimeError("lost")
        return decoded(folder)

    monkeypatch.setattr(pf, "_decoded", fails)
    with pytest.raises(RuntimeError):
        pf.write_patch_files(documents(spark, 9), root, threads=1)
    assert "_SUCCESS" not in os.listdir(root)
    os.makedirs(f"{root}/.staged-half/_temporary")
    monkeypatch.setattr(pf, "_decoded", decoded)
    pf.finish_patch_files(spark, root)
    assert len([f for f in os.listdir(root) if f.endswith(".xml") and not f.startswith(".")]) == 9
    assert not [f for f in os.listdir(root) if f.startswith(".staged")] and "_SUCCESS" in os.listdir(root)


def test_only_chosen_files_are_opened(spark, tmp_path):
    root = f"{tmp_path}/out"
    pf.write_patch_files(documents(spark, 12), root)
    listing = pf.list_files(spark, root).checkpoint()
    chosen = pf.sample_files(listing, 4, seed=3).checkpoint()
    kept = {r.name for r in chosen.collect()}
    assert kept == {r.name for r in pf.sample_files(listing.repartition(5), 4, seed=3).collect()} and len(kept) == 4
    for f in os.listdir(root):
        if f.endswith(".xml") and not f.startswith(".") and f not in kept:
            os.remove(f"{root}/{f}")
    d = pf.read_chosen(spark, chosen)
    assert {r.filename.replace(".png", ".xml") for r in d.collect()} == kept
    assert rd.explode_documents(d)["patches"].count() == 4
    assert pf.read_chosen(spark, listing.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pf.read_chosen(spark, chosen, most=3)
