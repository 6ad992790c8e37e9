"""One file a patch. Tasks write under a hidden folder by Spark's commit protocol, so retried or lost tasks leave nothing; the
finished files are then renamed into place, and a marker says that all of them are there. In folders of "file:", which all
machines see, tasks write files themselves, each attempt in a folder of its own, and those of lost attempts are removed."""

from __future__ import annotations

import fnmatch
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundphrase.sources.readers import FULL

#: Files that are renamed at a time; the driver holds no more names than these.
BATCH = 10_000


def write_patch_files(documents: DataFrame, path: str, name: Column | None = None, text: Column | None = None, threads: int = 16) -> int:
    """A file for each row, `path/<name>`; the number of files is returned.

    By default name is the patch's file name with .xml for its ending, and text the <annotation> of the row. Names must differ
    (ignoring none of their letters) and hold no "/" (up to 120 bytes); null or repeated names, and null texts, are an error before any file is in
    place. A file of the same name is replaced. If the driver fails between renames, finish_patch_files() renames the rest.
    Names are counted and checked in Spark; each rename is one call of the driver to the file system, as in Spark's own commits."""
    spark = documents.sparkSession
    name = F.concat(F.regexp_replace("filename", r"\.[^.]*$", ""), F.lit(".xml")) if name is None else name
    text = F.to_xml(F.struct(*documents.columns), {"rowTag": "annotation"}) if text is None else text
    staged = f"{path}/.staged-{uuid.uuid4().hex}"
    rows = documents.select(name.alias("name"), text.alias("value"))
    bad = F.col("name").isNull() | F.col("value").isNull() | (F.length("name") == 0) | F.contains("name", F.lit("/"))
    checked = rows.withColumn("value", F.when(bad, F.raise_error(F.concat(F.lit("no file can be written for "), F.coalesce("name", F.lit("null"))))).otherwise(F.col("value")))
    # names are encoded, since a folder's name is escaped by other rules than these
    key = F.hex(F.encode("name", "UTF-8"))
    fs, at = _store(spark, path)
    if local := _local(fs, at, staged):
        return _write_here(spark, path, checked.select(key.alias("name"), "value"), local)
    try:
        # a row a file: a name that repeats shows as a second file of its folder, also if it came from another task
        checked.select(key.alias("_name"), "value").write.option("maxRecordsPerFile", 1).option("lineSep", "\n").partitionBy("_name").text(staged)
    except BaseException:
        fs.delete(at(staged), True)
        raise
    twice = [d for d in _folders(fs, at(staged)) if len(fs.listStatus(d)) > 1]
    if twice:
        fs.delete(at(staged), True)
        raise ValueError(f"{len(twice)} names repeat, {_decoded(twice[0])} among them")
    return _rename(spark, path, staged, threads)


def _store(spark: SparkSession, path: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _local(fs, at, path: str) -> str | None:
    """The path in the file system of the machine, if it is one."""
    place = fs.makeQualified(at(path)).toUri()
    return place.getPath() if place.getScheme() == "file" else None


#: Parts of a staged folder by a hash of names; repeated names are sought in one of them at a time.
BUCKETS = 256


def _write_here(spark: SparkSession, path: str, rows: DataFrame, staged: str) -> int:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = uuid.uuid4().hex
        known: set[str] = set()
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = f"{staged}/{attempt}/{zlib.crc32(name.encode()) % BUCKETS}"
                if folder not in known:
                    os.makedirs(folder, exist_ok=True)
                    known.add(folder)
                place = f"{folder}/_name={name}"
                # a name that repeats in a task shows as a second file, too
                with open(f"{place}." if os.path.exists(place) else place, "wb") as f:
                    f.write(value.encode() + b"\n")
        yield pa.RecordBatch.from_arrays([pa.array([attempt])], ["attempt"])

    os.makedirs(staged, exist_ok=True)
    try:
        done = {r.attempt for r in rows.mapInArrow(work, "attempt string").collect()}
        for attempt in os.listdir(staged):
            if attempt not in done:
                shutil.rmtree(f"{staged}/{attempt}", ignore_errors=True)
        twice: set[str] = set()
        for bucket in range(BUCKETS):
            seen: set[str] = set()
            for entry in _staged_here(staged, done, bucket):
                name = entry.name.rstrip(".")
                (twice if name in seen else seen).add(name)
        if twice:
            raise ValueError(f"{len(twice)} names repeat, {_decoded(min(twice))} among them")
    except BaseException:
        shutil.rmtree(staged, ignore_errors=True)
        raise
    with open(f"{staged}/_SUCCESS.part", "w") as f:  # names the attempts that count, also if another one still writes
        f.write("\n".join(done))
    os.replace(f"{staged}/_SUCCESS.part", f"{staged}/_SUCCESS")
    return _rename_here(spark, path, staged)


def _staged_here(staged: str, attempts: set[str], bucket: int) -> Iterator[os.DirEntry]:
    for attempt in attempts:
        folder = f"{staged}/{attempt}/{bucket}"
        if os.path.isdir(folder):
            with os.scandir(folder) as found:
                yield from found


def _rename_here(spark: SparkSession, path: str, staged: str) -> int:
    fs, at = _store(spark, path)
    root, done = os.path.dirname(staged), 0
    with open(f"{staged}/_SUCCESS") as f:
        attempts = set(f.read().split())
    for bucket in range(BUCKETS):
        for entry in _staged_here(staged, attempts, bucket):
            name = _decoded(entry.name)
            os.replace(entry.path, f"{root}/{name}")
            if os.path.exists(f"{root}/.{name}.crc"):  # of a file that stood there
                os.remove(f"{root}/.{name}.crc")
            done += 1
    fs.create(at(path, "_SUCCESS"), True).close()
    shutil.rmtree(staged, ignore_errors=True)
    return done


def _folders(fs, staged):
    """The folders of names, one at a time."""
    found = fs.listStatusIterator(staged)
    while found.hasNext():
        place = found.next().getPath()
        if place.getName().startswith("_name="):
            yield place


def _decoded(folder) -> str:
    return bytes.fromhex((folder if isinstance(folder, str) else folder.getName()).removeprefix("_name=")).decode()


def _rename(spark: SparkSession, path: str, staged: str, threads: int) -> int:
    fs, at = _store(spark, path)

    def place(folder) -> None:
        # None of the folder's files are left if an earlier try came as far as this one
        for file in fs.listStatus(folder):
            goal = at(path, _decoded(folder))
            if not fs.rename(file.getPath(), goal):
                fs.delete(goal, False)
                if not fs.rename(file.getPath(), goal):
                    raise OSError(f"could not rename to {goal}")

    done, batch = 0, []
    with ThreadPoolExecutor(threads) as pool:
        for folder in _folders(fs, at(staged)):
            batch.append(folder)
            if len(batch) == BATCH:
                done += len(list(pool.map(place, batch)))
                batch = []
        done += len(list(pool.map(place, batch)))
    fs.create(at(path, "_SUCCESS"), True).close()
    fs.delete(at(staged), True)
    return done


def finish_patch_files(spark: SparkSession, path: str, threads: int = 16) -> int:
    """Renames what a failed driver has left: files of complete writes are put in place, incomplete writes are removed."""
    fs, at = _store(spark, path)
    done = 0
    for status in fs.listStatus(at(path)) if fs.exists(at(path)) else []:
        folder = status.getPath()
        if folder.getName().startswith(".staged-"):
            if fs.exists(at(folder, "_SUCCESS")):
                local = _local(fs, at, folder.toString())
                # a marker without attempts is that of Spark's own commit
                here = local and os.path.getsize(f"{local}/_SUCCESS") > 0
                done += _rename_here(spark, path, local) if here else _rename(spark, path, folder.toString(), threads)
            else:
                fs.delete(folder, True)
    return done


def list_files(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """(path, name, length): the files of a folder as a table; none is opened for reading.

    A folder of "file:" is listed by one task, as it goes: a scan of files plans a task for every few of them."""
    fs, at = _store(spark, path)
    if (local := _local(fs, at, path)) and os.path.isdir(local) and not set(pattern) & set("{}^\\"):

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                rows: list[tuple[str, str, int]] = []
                folders = [local]
                while folders:
                    with os.scandir(folders.pop()) as found:
                        for entry in found:
                            if entry.name[0] == "." or (entry.name[0] == "_" and "=" not in entry.name):
                                continue
                            if entry.is_dir():
                                folders.append(entry.path)
                            elif fnmatch.fnmatchcase(entry.name, pattern):
                                rows.append((f"file:{entry.path}", entry.name, entry.stat().st_size))
                            if len(rows) == BATCH:
                                yield listed(rows)
                                rows = []
                yield listed(rows)

        def listed(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["path", "name", "length"])

        return spark.range(0, 1, 1, 1).mapInArrow(work, "path string, name string, length long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


def read_chosen(spark: SparkSession, files: DataFrame, most: int = 100_000) -> DataFrame:
    """The annotation documents (schema FULL) of the chosen files of a listing, with their path: choose first, parse after.

    Only these files are opened. Their paths go to the driver, as those of every scan do; more than `most` of them are an error."""
    paths = [r[0] for r in files.select("path").limit(most + 1).collect()]
    if len(paths) > most:
        raise ValueError(f"more than {most} files: choose fewer, or read the folder")
    if not paths:
        return spark.createDataFrame([], f"path string, {FULL}")
    d = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_xml("value", FULL, {"rowTag": "annotation"}).alias("d"))
    return d.select("path", "d.*")


def sample_files(files: DataFrame, n: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """n files of a listing in the order of a hash of their names (or of `order`), ties by name and path: the same ones however
    the listing is ordered."""
    return files.orderBy(F.xxhash64(F.lit(seed), "name") if order is None else order, "name", "path").limit(n)
