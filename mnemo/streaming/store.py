"""Tables that grow by one folder per micro-batch, and their compaction.

A micro-batch owns its folders, so a replayed one overwrites what it wrote and adds nothing. A
manifest names the segments that older folders were merged into. Segments of one level are merged
again when there are enough of them, so a row is rewritten once per level and the folders that a
reader opens grow with the logarithm of the number of batches.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mnemo.schema import prefix


@dataclass(frozen=True)
class Table:
    schema: StructType
    #: Key column whose hash prefix is a folder level, or a plain column that is one.
    keyed: str | None = None
    split: str | None = None

    @property
    def folders(self) -> list[str]:
        return ["prefix"] if self.keyed else [self.split] if self.split else []

    def laid_out(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prefix", prefix(F.col(self.keyed))) if self.keyed else df

    @property
    def stored(self) -> StructType:
        """The columns with those that folder names give."""
        names = ["prefix", "batch"] if self.keyed else ["batch"]
        return StructType([*self.schema.fields, *[StructField(n, StringType()) for n in names]])


class Files:
    """What the driver does with folders, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self._path(folder)):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(folder))]

    def make(self, folder: str) -> None:
        self.fs.mkdirs(self._path(folder))

    def drop(self, folder: str) -> None:
        self.fs.delete(self._path(folder), True)

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """The file is there as a whole or not at all; it never replaces another."""
        draft = f"{path}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(self._path(draft), self._path(path)):
            self.drop(draft)
            raise FileExistsError(path)


@dataclass
class BatchTables:
    """Tables under ``root``: ``<table>/batch=<n>`` and ``_segments/<table>/batch=<level-first-last>``."""

    spark: SparkSession
    root: str
    tables: dict[str, Table]
    #: Folders of one level that are merged into one of the next.
    fan: int = 10

    def __post_init__(self) -> None:
        self.files = Files(self.spark, self.root)

    # -- manifest -------------------------------------------------------------------------
    def manifest(self) -> dict:
        found = [n for n in self.files.names(f"{self.root}/_manifest") if re.fullmatch(r"\d+\.json", n)]
        if not found:
            return {"version": 0, "segments": [], "old": []}
        return json.loads(self.files.read(f"{self.root}/_manifest/{max(found)}"))

    def _switch(self, manifest: dict) -> None:
        self.files.publish(f"{self.root}/_manifest/{manifest['version']:010d}.json", json.dumps(manifest))

    @staticmethod
    def _covered(manifest: dict) -> int:
        """The last batch that lies in a segment."""
        return max((s["last"] for s in manifest["segments"]), default=-1)

    def _batches(self, name: str) -> list[int]:
        found = (re.fullmatch(r"batch=(\d+)", n) for n in self.files.names(f"{self.root}/{name}"))
        return sorted(int(m[1]) for m in found if m)

    # -- tables ---------------------------------------------------------------------------
    def path(self, name: str, batch_id: int) -> str:
        return f"{self.root}/{name}/batch={batch_id}"

    def folders(self, name: str, manifest: dict | None = None) -> list[str]:
        """What a reader of the table opens now."""
        manifest = manifest or self.manifest()
        merged = [self._segment(name, s["name"]) for s in manifest["segments"] if name in s["tables"]]
        return merged + [self.path(name, b) for b in self._batches(name) if b > self._covered(manifest)]

    def _segment(self, name: str, segment: str) -> str:
        return f"{self.root}/_segments/{name}/batch={segment}"

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        """One scan of the batches' folders, one of the segments'."""
        stored, rows = self.tables[name].stored, None
        for base in (f"{self.root}/{name}", f"{self.root}/_segments/{name}"):
            under = [f for f in folders if f.startswith(f"{base}/")]
            if under:
                part = self.spark.read.schema(stored).option("basePath", base).parquet(*under)
                rows = part if rows is None else rows.unionByName(part)
        return (self.spark.createDataFrame([], stored) if rows is None else rows).drop("batch")

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], self.tables[name].schema)

    def read_batch(self, name: str, batch_id: int) -> DataFrame:
        return self._read(name, [self.path(name, batch_id)])

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """The table as of now, or as batch ``before`` met it, also when that batch is replayed.

        Keyed tables carry ``prefix``; a filter on it prunes folders.
        """
        later = [] if before is None else [self.path(name, b) for b in self._batches(name) if b >= before]
        return self._read(name, [f for f in self.folders(name) if f not in later])

    def write(self, name: str, df: DataFrame, batch_id: int) -> None:
        """Put a batch's rows in place of what that batch wrote before."""
        self._save(name, self.tables[name].laid_out(df), self.path(name, batch_id))

    def _save(self, name: str, df: DataFrame, path: str) -> None:
        # One file a folder and task at most, all rows of a folder from a few tasks.
        writer = df.write.mode("overwrite")
        if self.tables[name].folders:
            writer = writer.partitionBy(*self.tables[name].folders)
        writer.parquet(path)

    def drop_batch(self, name: str, batch_id: int) -> None:
        self.files.drop(self.path(name, batch_id))

    # -- compaction -----------------------------------------------------------------------
    def compact(self, upto: int) -> bool:
        """Merge batches up to ``upto`` where there are ``fan`` of them; true if something was.

        A crash before the switch leaves folders that nobody reads, a crash after it old ones that
        nobody reads. What a switch replaces is dropped by the next one, so readers of the state
        before have that long.
        """
        manifest = self.manifest()
        self._clean(manifest)
        segments, covered = list(manifest["segments"]), self._covered(manifest)
        fresh = sorted({b for t in self.tables for b in self._batches(t) if covered < b <= upto})
        replaced = []
        if len(fresh) < self.fan:
            return False
        held = {
            t: [self.path(t, b) for b in self._batches(t) if covered < b <= upto] for t in self.tables
        }
        segments.append(self._merged(0, covered + 1, fresh[-1], held))
        replaced += [p for paths in held.values() for p in paths]
        level = 0
        while sum(s["level"] == level for s in segments) >= self.fan:
            same = [s for s in segments if s["level"] == level]
            held = {
                t: [self._segment(t, s["name"]) for s in same if t in s["tables"]] for t in self.tables
            }
            segments = [s for s in segments if s["level"] != level]
            segments.append(self._merged(level + 1, same[0]["first"], same[-1]["last"], held))
            replaced += [p for paths in held.values() for p in paths]
            level += 1
        self._switch({"version": manifest["version"] + 1, "segments": segments, "old": replaced})
        return True

    def _merged(self, level: int, first: int, last: int, held: dict[str, list[str]]) -> dict:
        segment = f"{level}-{first}-{last}"
        for name, folders in held.items():
            if folders:
                self._save(name, self._read(name, folders), self._segment(name, segment))
        return {"level": level, "first": first, "last": last, "name": segment, "tables": [n for n, f in held.items() if f]}

    def _clean(self, manifest: dict) -> None:
        """Drop what the switch before replaced, and manifests before it."""
        for folder in manifest["old"]:
            self.files.drop(folder)
        for name in self.files.names(f"{self.root}/_manifest"):
            if name < f"{manifest['version']:010d}.json":
                self.files.drop(f"{self.root}/_manifest/{name}")


def fit(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns of ``schema``, NULL where ``df`` has none."""
    have = set(df.columns)

    def column(f: StructField) -> Column:
        return (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in schema.fields])
