"""A keyed table in hash buckets: a batch rewrites the buckets of its own keys and no others.

Below the table's folder, ``rows/version=V/bucket=B`` holds the buckets that version V has written, and
``manifest/version=V`` says, for every bucket, which version's files are its own. A version counts once its manifest is
written; readers take the files of one manifest. Change rows and run counts stand beside, under the same
version. A batch whose id the manifest knows adds nothing. There is one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import run_counts

BUCKETS = 64
KNOWN_BATCHES = 1_000  # ids of batches that a manifest remembers
MANIFEST = "bucket int, version int, batch string"

#: Of stored rows (of the touched buckets), a batch and keys to close: rows with ``change``, ``is_new`` and ``was_seen``.
Step = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType | str | None = None, buckets: int = BUCKETS):
        """``schema`` is that of the rows; a reader can leave it to the files."""
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets

    def _files(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _numbers(self, folder: str, done: bool = False) -> list[int]:
        """Versions below a folder; with ``done`` only those whose writing was completed."""
        store, at = self._files()
        place = at(f"{self.path}/{folder}")
        found = [s.getPath() for s in store.listStatus(place)] if store.exists(place) else []
        return sorted(int(p.getName().split("=")[1]) for p in found if not done or store.exists(at(p, "_SUCCESS")))

    def versions(self) -> list[int]:
        return self._numbers("manifest", done=True)

    def manifest(self, version: int) -> tuple[dict[int, int], list[str]]:
        """Of each bucket the version that wrote it, and the batches known: at most ``buckets`` and KNOWN_BATCHES rows."""
        rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/version={version}").collect()
        return {r["bucket"]: r["version"] for r in rows if r["bucket"] is not None}, [r["batch"] for r in rows if r["batch"] is not None]

    def bucket_of(self, keys: list[str] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(self.buckets)).cast("int")

    def _read(self, owners: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in sorted(owners.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return (self.spark.read.schema(self.schema) if self.schema else self.spark.read).parquet(*paths)

    def current(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        return self._read(self.manifest(known[-1] if version is None else version)[0] if known else {})

    def apply(self, batch: str, incoming: DataFrame, closing: DataFrame, step: Step) -> int:
        """The version after ``batch``: its buckets, change rows and counts written, then its manifest."""
        known = self.versions()
        owners, batches = self.manifest(known[-1]) if known else ({}, [])
        if batch in batches:
            return known[-1]
        version = max([*self._numbers("rows"), *known, -1]) + 1
        named = incoming.select(*self.keys).union(closing.select(*self.keys))
        touched = [r[0] for r in named.select(self.bucket_of()).distinct().collect()]  # at most ``buckets`` numbers
        stored = self._read({b: v for b, v in owners.items() if b in touched})
        rows = step(stored, incoming, closing).withColumn("bucket", self.bucket_of())
        folder = f"{self.path}/rows/version={version}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        written = self.spark.read.schema(rows.schema).parquet(folder)
        written.where("change is not null").select(F.lit(batch).alias("batch"), *self.keys, "change.*").write.parquet(f"{self.path}/changes/version={version}")
        run_counts(written).select(F.lit(batch).alias("batch"), "*").write.parquet(f"{self.path}/runs/version={version}")
        now = [(b, v, None) for b, v in {**owners, **dict.fromkeys(touched, version)}.items()] + [(None, None, b) for b in [*batches, batch][-KNOWN_BATCHES:]]
        self.spark.createDataFrame(now, MANIFEST).coalesce(1).write.json(f"{self.path}/manifest/version={version}")
        return version

    def _beside(self, folder: str, schema: str) -> DataFrame:
        """What stands beside the versions that count."""
        paths = [f"{self.path}/{folder}/version={v}" for v in self.versions()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def changes(self) -> DataFrame:
        keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self._read({}).select(*self.keys).schema)
        return self._beside("changes", f"batch string, {keys}, change_type string, summary string, before string, after string, evidence string")

    def runs(self) -> DataFrame:
        return self._beside("runs", "batch string, records_seen long, records_new long, records_changed long, records_closed long")

    def expire(self, keep: int = 2) -> list[str]:
        """Delete what none of the last ``keep`` manifests reads, and return the folders deleted; change rows and runs stay."""
        store, at = self._files()
        known = self.versions()
        used = {(v, b) for m in known[-keep:] for b, v in self.manifest(m)[0].items()}
        gone = []
        for version in (v for v in self._numbers("rows") if known and v <= known[-1]):
            for s in store.listStatus(at(f"{self.path}/rows/version={version}")):
                name = s.getPath().getName()
                if name.startswith("bucket=") and (version, int(name.split("=")[1])) not in used:
                    store.delete(s.getPath(), True)
                    gone.append(f"version={version}/{name}")
        return gone
