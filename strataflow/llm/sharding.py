"""Sharding: size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable shards (Parquet files of one folder each).  A manifest version lists the live shards; it
is written under a temporary name and renamed to the next number, which fails if that number exists, so a
reader sees either the old version or the new one and of two writers one has to try again.  A shard's tier is
the power of `fanout` that its bytes are over the smallest size; where a tier below the target holds `fanout`
shards or more, its oldest ones are merged into files of the target size and the version is committed.
Shards that only older versions than the last `keep` list can be removed by vacuum(), and so can folders that no version lists, once they
are older than a grace period: until then another writer may be about to commit them.

The rename is one step that never overwrites on HDFS and other file systems with an atomic rename; on object stores and local
disks, where it is a check and then a move, writers must not commit at the same moment.

Every row keeps all columns.  Null texts, repeated rows and any number of rows are stored as they are; an
empty arrival commits no shard.  An empty store can't be read, as it has no columns.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FANOUT = 4
SMALLEST = 1 << 20
TARGET = 128 << 20


@dataclass(frozen=True)
class Shard:
    name: str
    bytes: int
    files: int
    arrival: int


class Conflict(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, smallest: int = SMALLEST, target: int = TARGET):
        self.spark, self.root, self.fanout, self.smallest, self.target = spark, root, fanout, smallest, target
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifest
    def version(self) -> int:
        at = self._path(f"{self.root}/manifest")
        if not self._fs.exists(at):
            return 0
        return max([0, *(int(x.getPath().getName()[1:-5]) for x in self._fs.listStatus(at) if x.getPath().getName().startswith("v"))])

    def shards(self, version: int | None = None) -> list[Shard]:
        """The live shards: one entry per file folder, as in any table format's manifest."""
        v = self.version() if version is None else version
        if not v:
            return []
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{v:08d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(text)["shards"]]

    def commit(self, shards: list[Shard], base: int) -> int:
        """The version after `base`; Conflict if another writer has made it."""
        new = base + 1
        temp, final = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest/v{new:08d}.json")
        out = self._fs.create(temp, False)
        out.write(json.dumps({"version": new, "shards": [asdict(s) for s in shards]}).encode())
        out.close()
        try:
            if self._fs.exists(final):
                raise Conflict(f"version {new} exists")
            # rename without overwriting: the check and the move are one step
            options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(temp, final, options)
        except Py4JJavaError as e:
            raise Conflict(str(e.java_exception)) from e
        finally:
            if self._fs.exists(temp):
                self._fs.delete(temp, False)
        return new

    # -- data
    def _write(self, df: DataFrame, arrival: int) -> Shard | None:
        name = f"{arrival:06d}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(f"{self.root}/data/{name}")
        at = self._path(f"{self.root}/data/{name}")
        if not self.spark.read.schema(df.schema).parquet(f"{self.root}/data/{name}").head(1):
            self._fs.delete(at, True)
            return None
        files = [x for x in self._fs.listStatus(at) if x.getPath().getName().startswith("part-")]
        return Shard(name, sum(x.getLen() for x in files), len(files), arrival)

    def append(self, df: DataFrame, tries: int = 10) -> int:
        """The version that lists df's rows.  The shard is written once and committed to the version that is the last by then."""
        new = self._write(df, max([0, *(s.arrival for s in self.shards())]) + 1)
        for left in range(tries - 1, -1, -1):
            base = self.version()
            if not new:
                return base
            try:
                return self.commit([*self.shards(base), new], base)
            except Conflict:
                if not left:
                    self._fs.delete(self._path(f"{self.root}/data/{new.name}"), True)
                    raise
        return self.version()

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(1, size / self.smallest), self.fanout)))

    def compact(self, once: bool = False) -> int:
        """Merges until no tier holds `fanout` shards; the version then."""
        while True:
            base = self.version()
            live = self.shards(base)
            tiers: dict[int, list[Shard]] = {}
            for s in live:
                if s.bytes // s.files < self.target // 2 or s.files > max(1, -(-2 * s.bytes // self.target)):
                    tiers.setdefault(self.tier(s.bytes), []).append(s)
            full = min((t for t, own in tiers.items() if len(own) >= self.fanout), default=None)
            if full is None:
                return base
            run = sorted(tiers[full], key=lambda s: (s.arrival, s.name))[: max(self.fanout, 8)]
            size = sum(s.bytes for s in run)
            df = self.spark.read.parquet(*[f"{self.root}/data/{s.name}" for s in run])
            # files of the target size, from whole scan tasks: no row is shuffled
            merged = self._write(df.coalesce(max(1, -(-size // self.target))), max(s.arrival for s in run))
            gone = {s.name for s in run}
            version = self.commit([*(s for s in live if s.name not in gone), *([merged] if merged else [])], base)
            if once:
                return version

    def vacuum(self, keep: int = 1, grace: float = 7 * 86_400) -> int:
        """Removes shards that only versions before the last `keep` list, folders of over `grace` seconds that none lists, and the older
        versions; the number of folders removed."""
        now = self.version()
        held = {s.name for v in range(max(1, now - keep + 1), now + 1) for s in self.shards(v)}
        root, old = self._path(f"{self.root}/manifest"), range(1, now - keep + 1)
        there = {x.getPath().getName() for x in self._fs.listStatus(root)} if self._fs.exists(root) else set()
        listed = {s.name for v in old if f"v{v:08d}.json" in there for s in self.shards(v)}
        n, data = 0, self._path(f"{self.root}/data")
        for x in self._fs.listStatus(data) if self._fs.exists(data) else ():
            name = x.getPath().getName()
            if name not in held and (name in listed or x.getModificationTime() / 1000 < time.time() - grace):
                n += self._fs.delete(x.getPath(), True)
        for v in old:
            if f"v{v:08d}.json" in there:
                self._fs.delete(self._path(f"{self.root}/manifest/v{v:08d}.json"), False)
        return n

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """Rows of a version; shard: the name of a further column with each row's shard."""
        live = self.shards(version)
        if not live:
            raise ValueError("the version has no shard")
        rows = self.spark.read.parquet(*[f"{self.root}/data/{s.name}" for s in live])
        if shard is None:
            return rows
        if shard in rows.columns:
            raise ValueError(f"the rows have a column {shard} of their own")
        return rows.withColumn(shard, F.regexp_extract(F.input_file_name(), r"/data/([^/]+)/", 1))


def op7_sharding(spark: SparkSession, sf_dir: str, arrivals: int = 5) -> DataFrame:
    """documents in `arrivals` arrivals, compacted; each row of the last version with the place that holds it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = Store(spark, C.scratch(spark, "shards"))
    dealt = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(arrivals))
    for k in range(arrivals):
        store.append(docs.where(dealt == k))
    store.compact()
    store.vacuum()
    live, version = store.shards(), store.version()
    if not live:
        empty = docs.limit(0).select("doc_id")
        return empty.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("shard_arrival", "int"), ("n_bytes", "long"), ("text_crc32", "long"), ("live_shards", "int"), ("version", "int"))])
    rows = store.read(version, shard="_shard_name")
    return rows.select(
        "doc_id",
        F.substring("_shard_name", 1, 6).cast("int").alias("shard_arrival"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(len(live)).alias("live_shards"),
        F.lit(version).alias("version"),
    )
