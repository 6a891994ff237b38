"""Size-tiered shards under a versioned manifest.

Arrivals are appended as small immutable Parquet files.  Compaction sorts the live files into tiers by size; a tier with
enough runs is merged into files of about the target size, and the rest wait.  Every change is one new manifest
``v<N>.json``, put in place whole and only if that version doesn't exist: readers see the old version or the new, and of two
writers one tries again on top of the other's version.  That takes a step that is exclusive: a hard link in a local folder,
a rename without overwriting on HDFS.  Object stores whose rename copies lack one, so there only one writer may work at
a time.  Files are deleted only once no kept version names them and they are older than any write in progress.

A merge reads files of like size packed into input splits of the target size and writes one file per split, so no row
is shuffled.  The driver handles files, never rows.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Shard:
    path: str  # below the table's folder
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


class VersionTaken(Exception):
    """Another writer has committed this version."""


class ShardedTable:
    """A folder of shards with manifests; ``target`` is the size of a full shard."""

    def __init__(self, spark: SparkSession, root: str, target: int = 256 << 20, fan_in: int = 4, ratio: float = 4.0):
        self.spark, self.root, self.target, self.fan_in, self.ratio = spark, root.rstrip("/"), target, fan_in, ratio
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    # ------------------------------------------------------------ files

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _names(self, folder: str) -> list[tuple[str, int]]:
        return [(name, size) for name, size, _ in self._listed(folder)]

    def _listed(self, folder: str) -> list[tuple[str, int, float]]:
        """Name, bytes and age in seconds of what is in a folder."""
        path = self._path(folder)
        if not self._fs().exists(path):
            return []
        now = time.time()
        return [(s.getPath().getName(), s.getLen(), now - s.getModificationTime() / 1000) for s in self._fs().listStatus(path)]

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n, _ in self._names("manifest") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """A version, the last by default; None if nothing was committed."""
        if version is None:
            found = self.versions()
            if not found:
                return None
            version = found[-1]
        stream = self._fs().open(self._path(f"manifest/v{version:08d}.json"))
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        d = json.loads(raw)
        return Manifest(d["version"], d["schema"], tuple(Shard(**s) for s in d["shards"]))

    def _commit(self, manifest: Manifest) -> Manifest:
        temporary, final = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/v{manifest.version:08d}.json")
        out = self._fs().create(temporary, True)
        out.write(bytearray(json.dumps(asdict(manifest), separators=(",", ":")).encode()))
        out.close()
        try:
            self._put(temporary, final)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise VersionTaken(manifest.version) from e
            raise
        finally:
            self._fs().delete(temporary, False)
        return manifest

    def _put(self, temporary, final) -> None:
        """Give a file its name unless there is one of that name; exclusive."""
        jvm = self.spark._jvm
        if self._fs().getScheme() == "file":
            source, target = (jvm.java.io.File(self._fs().makeQualified(p).toUri().getPath()).toPath() for p in (temporary, final))
            jvm.java.nio.file.Files.createLink(target, source)
            return
        context = self._hadoop.FileContext.getFileContext(self._path("").toUri(), self._conf)
        flags = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        flags[0] = getattr(self._hadoop, "Options$Rename").NONE
        context.rename(temporary, final, flags)

    def _publish(self, change: Callable[[Manifest | None], Manifest | None], tries: int = 20) -> Manifest | None:
        """Commit what ``change`` makes of the last version, again if another writer was faster; None if it makes nothing."""
        for i in range(tries):
            after = change(self.manifest())
            if after is None:
                return None
            try:
                return self._commit(after)
            except VersionTaken:
                if i + 1 == tries:
                    raise
                time.sleep(0.05 * (i + 1))
        return None

    def _discard(self, shards: list[Shard]) -> None:
        for folder in {s.path.rsplit("/", 1)[0] for s in shards}:
            self._fs().delete(self._path(folder), True)

    def _write(self, df: DataFrame, **options) -> list[Shard]:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.options(compression="zstd", **options).parquet(f"{self.root}/{folder}")
        return [Shard(f"{folder}/{n}", size) for n, size in sorted(self._names(folder)) if n.endswith(".parquet")]

    # ------------------------------------------------------------ operations

    def append(self, df: DataFrame, rows_per_shard: int = 0) -> Manifest:
        """Add ``df`` as new small shards, one or more a partition; an empty ``df`` adds none but is a version."""
        schema = df.schema.json()
        new = self._write(df, **({"maxRecordsPerFile": rows_per_shard} if rows_per_shard else {}))

        def with_new(now: Manifest | None) -> Manifest:
            if now and _names_and_types(now.schema) != _names_and_types(schema):
                raise ValueError("the rows have other columns than the table")
            return Manifest(now.version + 1 if now else 1, schema, (now.shards if now else ()) + tuple(new))

        try:
            return self._publish(with_new)
        except Exception:
            self._discard(new)
            raise

    def tier(self, size: int) -> int:
        """Tier of a shard: 0 for full ones, and one more for each ``ratio`` that it is smaller."""
        return max(0, math.ceil(math.log(self.target * 0.75 / max(1, size), self.ratio)))

    def due(self, manifest: Manifest) -> list[list[Shard]]:
        """Runs to merge, a list for each tier that has enough of them."""
        tiers: dict[int, list[Shard]] = {}
        for s in manifest.shards:
            tiers.setdefault(self.tier(s.bytes), []).append(s)
        return [tiers[t] for t in sorted(tiers, reverse=True) if t > 0 and len(tiers[t]) >= self.fan_in]

    def compact(self) -> Manifest:
        """Merge what is due and commit; the current version if nothing is, or if another writer has merged some of it meanwhile."""
        now = self.manifest()
        runs = self.due(now) if now else []
        if not runs:
            return now
        merged, gone = [], set()
        for run in runs:
            merged += self._merge(now, run)
            gone |= {s.path for s in run}

        def with_merged(last: Manifest) -> Manifest | None:
            if not gone <= {s.path for s in last.shards}:
                return None
            return Manifest(last.version + 1, last.schema, tuple(s for s in last.shards if s.path not in gone) + tuple(merged))

        done = None
        try:
            done = self._publish(with_merged)
        finally:
            if done is None:
                self._discard(merged)
        return done or self.manifest()

    def _merge(self, manifest: Manifest, run: list[Shard]) -> list[Shard]:
        """One file for each input split of the target size; the split's size is set in a session of its own."""
        own = self.spark.newSession()
        for k, v in {"maxPartitionBytes": str(self.target), "openCostInBytes": "0", "minPartitionNum": "1"}.items():
            own.conf.set(f"spark.sql.files.{k}", v)
        return self._write(self._read(manifest, run, own))

    def _read(self, manifest: Manifest, shards: list[Shard] | tuple[Shard, ...], session: SparkSession | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        session = session or self.spark
        if not shards:
            return session.createDataFrame([], schema)
        return session.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        manifest = self.manifest(version)
        return self._read(manifest, manifest.shards)

    def vacuum(self, keep: int = 1, age_s: float = 24 * 3600) -> int:
        """Delete the older versions than the last ``keep``, then the files that none names and that are older than ``age_s``
        seconds.  Returns how many files went.

        Younger files may belong to a writer that has yet to commit, so no write may take longer than ``age_s``; 0 is for a
        table without other writers.
        """
        versions = self.versions()
        named = {s.path for v in versions[-keep:] for s in self.manifest(v).shards}
        for v in versions[:-keep]:
            self._fs().delete(self._path(f"manifest/v{v:08d}.json"), False)
        gone = 0
        for folder, _ in self._names("data"):
            files = self._listed(f"data/{folder}")
            dead = [n for n, _, age in files if n.endswith(".parquet") and age >= age_s and f"data/{folder}/{n}" not in named]
            gone += len(dead)
            if dead and len(dead) == sum(n.endswith(".parquet") for n, _, _ in files):
                self._fs().delete(self._path(f"data/{folder}"), True)
            else:
                for n in dead:
                    self._fs().delete(self._path(f"data/{folder}/{n}"), False)
        return gone


def _names_and_types(schema: str) -> list[tuple]:
    return [(f["name"], json.dumps(f["type"])) for f in json.loads(schema)["fields"]]


def shard(df: DataFrame, root: str, arrivals: int = 3, rows_per_shard: int = 2000, target: int = 64 << 20, id_: str = "doc_id") -> ShardedTable:
    """Store ``df`` in ``arrivals`` appends, told apart by a hash of ``id_``, then compact and vacuum; ``root`` is a new folder
    of the caller's own.

    Rows keep all their columns and values, nulls and repeated rows too; an empty ``df`` gives an empty table.
    """
    table = ShardedTable(df.sparkSession, root, target)
    for i in range(arrivals):
        table.append(df.where(F.pmod(F.xxhash64(id_), F.lit(arrivals)) == i), rows_per_shard)
    table.compact()
    table.vacuum(age_s=0)
    return table


def digest(df: DataFrame, root: str) -> DataFrame:
    """Every document as it is read back from the compacted table: its columns' sizes and a hash of its text."""
    stored = shard(df, root).read()
    return stored.select(
        "doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    )


ORACLE_SQL = """
SELECT doc_id, lang, source, n_chars, strlen(text)::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""
