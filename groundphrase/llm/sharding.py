"""Size-tiered shards with versioned manifests.

Arrivals become small immutable shards, a folder of Parquet files each. A manifest names the shards of one version; it is
written aside and renamed to its place, which fails if that version exists, so a commit is all or nothing and two
writers can't both win: who comes second takes its change to the newer version and tries again. Compaction takes runs
of similar size (tiers are powers of the fan-in over the smallest size), rewrites `fan_in` of them as files of the
target size, and commits a version that names the result instead. A shard of any size that holds `fan_in` files below
half the target is rewritten in the same way, alone. Merges that share no shard run side by side. Readers hold to a
manifest, so they never see a half-done merge. A writer leaves a note (intents/) before it writes and takes it away
after its commit; vacuum spares what a note names. All files go through Hadoop's file system; the rename must be atomic
and refuse to overwrite, as that of HDFS is. On local and mounted file systems (file:) a hard link stands for it. Plain object
stores have neither.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a target file, shards that are merged at once, least size of a tier.
TARGET, FAN_IN, SMALLEST = 128 << 20, 4, 1 << 20
#: Merges that run at a time; times that a commit is tried; seconds after which a writer that left a note is given up.
AT_ONCE, TRIES, ABANDONED = 4, 50, 7 * 24 * 3600


@dataclass(frozen=True)
class Shard:
    name: str
    rows: int
    size: int
    sizes: tuple[int, ...] = ()  # of its files

    def tier(self, smallest: int, fan_in: int) -> int:
        return max(0, math.floor(math.log(max(1, self.size) / smallest, fan_in))) if self.size > smallest else 0


class ShardStore:
    """A folder of shards and manifests on a store that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fan_in: int = FAN_IN, smallest: int = SMALLEST):
        self.spark, self.root, self.target, self.fan_in, self.smallest = spark, root, target, fan_in, smallest
        self.java = spark._jvm.org.apache.hadoop
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)
        for folder in ("manifests", "intents", "shards"):
            self.fs.mkdirs(self._path(f"{root}/{folder}"))

    def _path(self, name: str):
        return self.java.fs.Path(name)

    def version(self) -> int:
        """The latest committed version; 0 without any."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max([0, *(int(n[:-5]) for n in names if n[:-5].isdigit() and n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, the latest if none is named. Its length grows with files, not with rows."""
        return self.latest()[1] if version is None else self._named(version)

    def _named(self, version: int) -> list[Shard]:
        if not version:
            return []
        stream = self.fs.open(self._path(f"{self.root}/manifests/{version:09d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**{**s, "sizes": tuple(s.get("sizes", ()))}) for s in json.loads(text)["shards"]]

    def latest(self) -> tuple[int, list[Shard]]:
        """The latest version and its shards. Another one's vacuum may take a manifest away as soon as there is a newer one:
        then that one is read."""
        for _ in range(TRIES):
            version = self.version()
            try:
                return version, self._named(version)
            except Exception:
                if self.version() == version:
                    raise
        raise RuntimeError(f"no manifest stood still in {TRIES} tries")

    def _rename_new(self, aside, place) -> None:
        """Renames a file to a place that nothing may have; of several at a time one wins. A local rename looks and moves in
        two steps, so there a hard link is made instead, which fails if the place is taken."""
        gateway, jvm = self.spark._sc._gateway, self.spark._jvm
        if self.fs.getUri().getScheme() == "file":
            more = gateway.new_array(jvm.java.lang.String, 0)
            ends = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), more) for p in (place, aside)]
            jvm.java.nio.file.Files.createLink(*ends)
            self.fs.delete(aside, False)
            return
        none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.java.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self.fs.getUri(), self.conf).rename(aside, place, none)

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Version base + 1 with these shards; FileExistsError if another writer has made it first."""
        aside = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps({"version": base + 1, "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            out.close()
        place = self._path(f"{self.root}/manifests/{base + 1:09d}.json")
        try:
            self._rename_new(aside, place)
        except Exception as error:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(error):
                raise FileExistsError(f"version {base + 1} is committed already") from error
            raise
        return base + 1

    def change(self, edit: Callable[[list[Shard]], list[Shard] | None]) -> int | None:
        """Commits edit(shards) on top of the latest version, and again on the next one where another writer was first.
        None, and no commit, if edit gives None."""
        for _ in range(TRIES):
            base, before = self.latest()
            shards = edit(before)
            if shards is None:
                return None
            try:
                return self.commit(base, shards)
            except FileExistsError:
                continue
        raise RuntimeError(f"no commit in {TRIES} tries")

    @contextmanager
    def _intent(self, folder: str) -> Iterator[None]:
        """A note that this folder is being written; it goes when the folder is committed or given up."""
        note = self._path(f"{self.root}/intents/{folder.rpartition('/')[2]}")
        self.fs.create(note, True).close()
        try:
            yield
        finally:
            self.fs.delete(note, False)

    def _shard(self, name: str, rows: int) -> Shard:
        files = [s for s in self.fs.listStatus(self._path(f"{self.root}/{name}")) if s.isFile()]
        sizes = tuple(sorted(s.getLen() for s in files if s.getPath().getName()[0] not in "._"))
        return Shard(name, rows, sum(sizes), sizes)

    def append(self, df: DataFrame, arrival_col: str | None = None) -> list[str]:
        """Adds df as one shard, or one for each value of arrival_col (then left out); one pass, no shuffle.

        Arrivals are committed one version each, in order of their values. An empty df adds nothing.
        """
        batch = f"shards/a-{uuid.uuid4().hex}"
        col = arrival_col or "lot"
        while not arrival_col and col.lower() in {c.lower() for c in df.columns}:
            col = f"_{col}"
        df = df if arrival_col else df.withColumn(col, F.lit(0))
        added: list[str] = []
        with self._intent(batch):
            df.write.partitionBy(col).parquet(f"{self.root}/{batch}")
            folders = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/{batch}")) if s.isDirectory()]
            if not folders:
                return added
            place = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), "([^/]+)/[^/]+$", 1)
            files = self.spark.read.option("basePath", f"{self.root}/{batch}").parquet(*[f"{self.root}/{batch}/{f}" for f in folders])
            counts = {r[0]: r[1] for r in files.groupBy(place).count().collect()}  # a row per arrival
            for folder in sorted(folders):
                shard = self._shard(f"{batch}/{folder}", counts.get(folder, 0))
                self.change(lambda shards, shard=shard: [*shards, shard])
                added.append(shard.name)
        return added

    def read(self, version: int | None = None, shards: list[Shard] | None = None) -> DataFrame | None:
        """All rows of a version (or of some shards); None without any."""
        shards = self.manifest(version) if shards is None else shards
        return self.spark.read.parquet(*[f"{self.root}/{s.name}" for s in shards]) if shards else None

    @contextmanager
    def _packed(self):
        """Scans planned inside put whole files together up to the target size, one task for each pile."""
        wanted = {"maxPartitionBytes": self.target, "openCostInBytes": 0, "minPartitionNum": 1}
        before = {k: self.spark.conf.get(f"spark.sql.files.{k}", None) for k in wanted}
        try:
            for k, v in wanted.items():
                self.spark.conf.set(f"spark.sql.files.{k}", str(v))
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(f"spark.sql.files.{k}") if v is None else self.spark.conf.set(f"spark.sql.files.{k}", v)

    def scattered(self, shard: Shard) -> bool:
        """Whether fan_in or more of the shard's files are below half the target size."""
        return sum(2 * n < self.target for n in shard.sizes) >= self.fan_in

    def runs(self, shards: list[Shard], fresh: set[str]) -> list[list[Shard]]:
        """Merges that can be done at once: full runs of every tier; if there are none, scattered shards, each alone."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(shards, key=lambda s: (s.size, s.name)):
            if s.size < self.target:
                tiers.setdefault(s.tier(self.smallest, self.fan_in), []).append(s)
        found = [t[i : i + self.fan_in] for _, t in sorted(tiers.items()) for i in range(0, len(t) - self.fan_in + 1, self.fan_in)]
        return found or [[s] for s in shards if s.name not in fresh and self.scattered(s)]

    def _merge(self, run: list[Shard], vacuum: bool) -> str | None:
        """Rewrites a run as one shard and commits it; None if another writer has merged one of its shards first, and
        perhaps deleted it already."""
        name, gone = f"shards/m-{uuid.uuid4().hex}", {s.name for s in run}
        with self._intent(name):
            try:
                self.read(shards=run).write.parquet(f"{self.root}/{name}")
            except Exception:
                if gone <= {s.name for s in self.manifest()}:
                    raise
                self.fs.delete(self._path(f"{self.root}/{name}"), True)
                return None
            made = self._shard(name, sum(s.rows for s in run))

            def edit(shards: list[Shard]) -> list[Shard] | None:
                return [*(s for s in shards if s.name not in gone), made] if gone <= {s.name for s in shards} else None

            done = self.change(edit)
        for x in (gone if vacuum else set()) if done else {name}:
            self.fs.delete(self._path(f"{self.root}/{x}"), True)
        return name if done else None

    def compact(self, vacuum: bool = False, at_once: int = AT_ONCE) -> int:
        """Merges until no tier below the target size holds fan_in shards and none is scattered; the number of merges.

        A merge reads whole shards and writes their files in piles of at most the target size, a file each, so no row is
        shuffled; all piles but the last are above half of it. Up to `at_once` merges run side by side. A shard that a
        merge wrote is not rewritten alone in the same call, even if its files came out smaller. With vacuum the merged
        shards are deleted after their commit, for which no reader may hold an older version.
        """
        merges, fresh = 0, set()
        with self._packed(), ThreadPoolExecutor(at_once) as pool:
            while runs := self.runs(self.manifest(), fresh):
                made = [name for name in pool.map(lambda run: self._merge(run, vacuum), runs) if name]
                fresh.update(made)
                merges += len(made)
        return merges

    def _folders(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/shards"))]

    def _notes(self, abandoned: float) -> set[str]:
        """Folders that a note names; notes older than `abandoned` seconds go."""
        notes = set()
        for note in self.fs.listStatus(self._path(f"{self.root}/intents")):
            if time.time() - note.getModificationTime() / 1000 < abandoned:
                notes.add(note.getPath().getName())
            else:
                self.fs.delete(note.getPath(), False)
        return notes

    def vacuum(self, abandoned: float = ABANDONED) -> None:
        """Deletes the shards that the latest version does not name, but for folders that a writer's note names, and manifests of
        earlier versions; notes and manifests go when they are older than `abandoned` seconds, those of lost writers. A
        younger manifest stays, since it keeps a slow writer from taking its version again.

        Folders are listed first, then notes, then the manifest is read. A writer makes its note before its folder and takes
        it away after its commit: a folder without a note when the notes are listed is in the manifest that is read after
        that, or no longer wanted. What is made after the first listing isn't looked at.
        """
        folders = self._folders()
        notes = self._notes(abandoned)
        last, shards = self.latest()
        live = {s.name for s in shards}
        for folder in folders:
            if folder in notes:
                continue
            name = f"shards/{folder}"
            here = self._path(f"{self.root}/{name}")
            if not self.fs.exists(here):  # another vacuum was here
                continue
            inner = [f"{name}/{s.getPath().getName()}" for s in self.fs.listStatus(here) if s.isDirectory()]
            for x in inner or [name]:
                if x not in live:
                    self.fs.delete(self._path(f"{self.root}/{x}"), True)
        for m in self.fs.listStatus(self._path(f"{self.root}/manifests")):
            if m.getPath().getName() < f"{last:09d}.json" and time.time() - m.getModificationTime() / 1000 >= abandoned:
                self.fs.delete(m.getPath(), False)
