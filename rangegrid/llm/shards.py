"""Sharding: small immutable shards, size-tiered compaction, and manifests that are committed atomically.

A store is a folder. Arrivals are Parquet files that never change; ``manifest-<version>.json`` lists the files that make
up a version. Files of similar size make a tier; as many as the fan-in of a tier are merged into one, until files reach
the target size. Superseded files stay, so that every version can be read and readers lose nothing, until ``expire``
removes the versions before one. Only file names and sizes are seen by the driver; rows move in Spark jobs without
shuffles or Python.

A commit writes a manifest beside its target, under a name of its own, and then publishes it in one step that fails if
the version is there already: a hard link on local file systems, a rename that doesn't replace elsewhere. A store thus
needs a file system with such a rename (HDFS has it); on an object store, where a rename is a copy, two writers that
commit at the same moment aren't kept apart.

Defined results: rows come back as they were appended, nulls, ties, repeated rows, texts of any length and all columns
(whatever their names: none is added) included, in no order; an empty arrival leaves the rows as they were, an empty
store reads as an empty table of the appended schema.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rangegrid.llm.common import hadoop_fs, new_path

TARGET_BYTES, FAN_IN, ROWS_A_SHARD = 128 << 20, 4, 4_000
#: Merged files that one Spark job writes.
GROUPS_A_JOB = 256


class Store:
    """A versioned table of shards below ``root``."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target, fan_in

    # ---- manifests ----

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest-{version:08d}.json"

    def versions(self) -> list[int]:
        """The committed versions that are there, in order."""
        fs, root = hadoop_fs(self.spark, self.root)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def version(self) -> int:
        """The last committed version; 0 for a store without one."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "files": [[path, bytes], ...]} of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "files": []}
        fs, p = hadoop_fs(self.spark, self._manifest(version))
        size = fs.getFileStatus(p).getLen()
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)))
        finally:
            stream.close()

    def _publish(self, temp: str, to: str, link: bool) -> bool:
        """Give a finished file its last name, in one step; false if the name is taken."""
        jvm = self.spark._jvm
        fs, source = hadoop_fs(self.spark, temp)
        _, target = hadoop_fs(self.spark, to)
        try:
            if link:
                nio = jvm.java.nio.file
                local = lambda p: nio.Path.of(jvm.java.net.URI(fs.makeQualified(p).toString()).getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                nio.Files.createLink(local(target), local(source))
                fs.delete(source, False)
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, none)
        except Py4JJavaError as e:
            fs.delete(source, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def commit(self, base: int, schema: str, files: list) -> int:
        """Make version base + 1 of these files; raises if that version is there already."""
        to, temp = self._manifest(base + 1), f"{self.root}/_manifest-{uuid.uuid4().hex}"
        fs, p = hadoop_fs(self.spark, temp)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps({"version": base + 1, "schema": schema, "files": files}).encode()))
        out.close()
        if not self._publish(temp, to, link=fs.getUri().getScheme() == "file"):
            raise RuntimeError(f"version {base + 1} was committed by another writer")
        return base + 1

    def expire(self, before: int) -> int:
        """Remove the versions before one, and the files that only they list; the last version stays. Returns files removed.

        Manifests go first, so that no version is offered that can't be read whole. Readers of older versions must be done.
        """
        versions = self.versions()
        old, kept = [v for v in versions[:-1] if v < before], [v for v in versions if v >= before] or versions[-1:]
        gone = {f[0] for v in old for f in self.manifest(v)["files"]} - {f[0] for v in kept for f in self.manifest(v)["files"]}
        for path in [*map(self._manifest, old), *gone]:
            fs, p = hadoop_fs(self.spark, path)
            fs.delete(p, False)
        return len(gone)

    def _written(self, path: str) -> list:
        fs, p = hadoop_fs(self.spark, path)
        return [[s.getPath().toString(), s.getLen()] for s in fs.listStatus(p) if s.getPath().getName().startswith("part-") and s.getLen()]

    # ---- writing ----

    def append(self, df: DataFrame, rows_a_shard: int = ROWS_A_SHARD) -> int:
        """Write df as small shards, one or more a task, and commit them beside the files there are."""
        path = f"{self.root}/arrival-{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows_a_shard).parquet(path)
        now = self.manifest()
        return self.commit(now["version"], df.schema.json(), now["files"] + self._written(path))

    def _tier(self, size: int) -> int:
        return int(math.log(max(size, 1), self.fan_in))

    def groups(self, files: list) -> list[list]:
        """Files to merge: per tier, runs of fan-in files or more, none beyond the target size, none of one file."""
        tiers: dict[int, list] = {}
        for f in sorted(files, key=lambda f: (f[1], f[0])):
            if f[1] < self.target / 2:
                tiers.setdefault(self._tier(f[1]), []).append(f)
        out = []
        for own in tiers.values():
            if len(own) < self.fan_in:
                continue
            run, total = [], 0
            for f in own:
                if run and total + f[1] > self.target:
                    out.append(run)
                    run, total = [], 0
                run.append(f)
                total += f[1]
            out.append(run)
        return [g for g in out if len(g) > 1]

    def compact(self, threads: int = 4) -> int:
        """Merge tiers until none is full, with one commit a round and one job for GROUPS_A_JOB merged files.

        A merged file is read and written by one task, which its target size bounds; a lost executor costs that task.
        """
        while True:
            now = self.manifest()
            work = self.groups(now["files"])
            if not work:
                return now["version"]
            schema = StructType.fromJson(json.loads(now["schema"]))
            run = f"{self.root}/merge-{now['version'] + 1:08d}-{uuid.uuid4().hex}"

            def merge(k: int, work=work, schema=schema, run=run) -> list:
                path = f"{run}/{k:06d}"
                # a partition a merged file, whatever the session's settings for reading files are
                parts = [self.spark.read.schema(schema).parquet(*[f[0] for f in g]).coalesce(1) for g in work[k : k + GROUPS_A_JOB]]
                while len(parts) > 1:
                    parts = [a.union(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
                parts[0].write.parquet(path)
                return self._written(path)

            with ThreadPoolExecutor(threads) as pool:
                made = [f for files in pool.map(merge, range(0, len(work), GROUPS_A_JOB)) for f in files]
            gone = {f[0] for g in work for f in g}
            self.commit(now["version"], now["schema"], [f for f in now["files"] if f[0] not in gone] + made)

    # ---- reading ----

    def read(self, version: int | None = None) -> DataFrame:
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("nothing was appended to this store")
        schema = StructType.fromJson(json.loads(now["schema"]))
        if not now["files"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f[0] for f in now["files"]])


def query(spark, sf_dir: str) -> DataFrame:
    store = Store(spark, new_path(spark, "store"))
    store.append(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    store.compact()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


SQL = "select doc_id, lang, source, n_chars, sha256(coalesce(text, '')) as text_sha256 from documents"
