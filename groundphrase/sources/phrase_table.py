"""A stored table of phrases in buckets of patches. A merge of replies rewrites the buckets that they touch, and a manifest of the
new version makes them valid all at once: readers see the table before or after, and a merge that fails leaves nothing."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from groundphrase.operators.merging import KEY, merge_replies, named


class PhraseTable:
    """`path/data/<id>/_bucket=<k>` has the rows of a bucket, `path/versions/<n>.json` says which folder holds each bucket.

    A version is committed by a rename that fails if it is there already, which must be atomic (HDFS; on one machine, where it
    is not, a hard link stands for it). Of two merges side by side the later one keeps its work if the other touched none of its
    buckets, else it merges anew."""

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = KEY) -> None:
        self.spark, self.path, self.key = spark, path, key
        self.hadoop = spark._jvm.org.apache.hadoop
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, place: str):
        return self.hadoop.fs.Path(f"{self.path}/{place}".rstrip("/"))

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key[0]), F.lit(buckets)).cast("int")

    def _names(self, place: str) -> list[str]:
        at = self._at(place)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def version(self) -> int:
        """The newest version, -1 if there is none."""
        return max((int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def _manifest(self, version: int) -> dict:
        stream = self.fs.open(self._at(f"versions/{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> bool:
        """Whether this manifest became the version; False if another writer was first."""
        aside, place = self._at(f"versions/.{uuid.uuid4().hex}"), self._at(f"versions/{version}.json")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        gateway, jvm = self.spark._sc._gateway, self.spark._jvm
        try:
            if self.fs.getScheme() == "file":
                paths = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), gateway.new_array(jvm.java.lang.String, 0)) for p in (place, aside)]
                jvm.java.nio.file.Files.createLink(*paths)
            else:
                self.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(
                    aside, place, gateway.new_array(self.hadoop.fs.Options.Rename, 0))
        except Exception:
            if self.fs.exists(place):
                return False
            raise
        finally:
            self.fs.delete(aside, False)
        return True

    def _write(self, rows: DataFrame, buckets: int, files: int) -> tuple[str, list[int]]:
        """The folder of rows, and the buckets that have any. A bucket is dealt to `files` tasks by patch."""
        folder = f"data/{uuid.uuid4().hex}"
        split = F.pmod(F.xxhash64(F.lit(1), self.key[0]), F.lit(files))
        dealt = rows.withColumn("_bucket", self._bucket(buckets)).repartition(buckets * files, "_bucket", split)
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return folder, [int(n.split("=")[1]) for n in self._names(folder) if n.startswith("_bucket=")]

    def create(self, exprs: DataFrame, buckets: int = 64, files: int = 1) -> int:
        """Version 0, with the columns expr_id and base_id of merging.named(). There must be no table yet."""
        exprs = named(exprs)
        folder, found = self._write(exprs, buckets, files)
        if not self._commit(0, {"buckets": buckets, "files": files, "schema": exprs.schema.json(), "folders": {str(k): folder for k in found}}):
            raise FileExistsError(self.path)
        return 0

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        mine = {int(k): f for k, f in manifest["folders"].items() if buckets is None or int(k) in buckets}
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        if not mine:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}/_bucket={k}" for k, f in sorted(mine.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        return self._rows(self._manifest(self.version() if version is None else version))

    def merge(self, replies: DataFrame, order: str | None = None, tries: int = 5) -> int:
        """merge_replies() as a new version, whose number is returned. Buckets without replies are neither read nor written.

        Only numbers of buckets reach the driver. Without replies the version stays."""
        version, done = self.version(), None
        for _ in range(tries):
            manifest = self._manifest(version)
            touched = sorted(r[0] for r in replies.select(self._bucket(manifest["buckets"])).distinct().collect())
            if not touched:
                return version
            before = {str(k): manifest["folders"].get(str(k)) for k in touched}
            if done is None or done[0] != before or done[4] != manifest["schema"]:
                merged = merge_replies(self._rows(manifest, touched), replies, self.key, order)
                done = (before, *self._write(merged, manifest["buckets"], manifest["files"]), merged.schema.json(), manifest["schema"])
            kept = {k: f for k, f in manifest["folders"].items() if k not in before}
            if self._commit(version + 1, manifest | {"schema": done[3], "folders": kept | {str(k): done[1] for k in done[2]}}):
                return version + 1
            version = self.version()
        raise PySparkException(f"other writers were first {tries} times: {self.path}")
