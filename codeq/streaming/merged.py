"""What a stream has gathered, kept as a few parts that are merged by level.

Every micro-batch adds one part. When ``FAN`` parts of a level have come together they are merged to one of
the next level, so after n batches FAN * log(n) parts at most are read. What is there is named by a
manifest, one small file per batch, which appears whole or not at all: a crash before it leaves parts that
nobody reads, and the batch comes again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8
KEPT_MANIFESTS = 3  # older ones go, with the parts that only they name: readers may still be at work
MANIFEST = "version long, level int, number long, path string"
Merge = Callable[[DataFrame], DataFrame]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class MergedParts:
    """Parts below a folder; ``merge`` turns several of them, read as one table, into one.

    ``merge`` must give the same whichever parts were merged before, and in whatever order: sums, minima,
    last versions, first rows.
    """

    def __init__(self, spark: SparkSession, folder: str, merge: Merge):
        self.spark, self.folder, self.merge = spark, folder, merge

    def _manifests(self) -> list:
        """Rows of the manifests that were not cleared away: a few dozen."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def _current(self, rows: list) -> list:
        last = max((r["version"] for r in rows), default=None)
        return [r for r in rows if r["version"] == last]

    def paths(self) -> list[str]:
        return [r["path"] for r in self._current(self._manifests())]

    def read(self) -> DataFrame | None:
        """Everything that was added, merged; None if nothing was yet."""
        paths = self.paths()
        return self.merge(self.spark.read.parquet(*paths)) if paths else None

    def _write(self, df: DataFrame, level: int) -> str:
        path = f"{self.folder}/parts/{level}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch; one that was added before changes nothing."""
        rows = self._manifests()
        current = self._current(rows)
        if current and current[0]["version"] >= batch_id:
            return
        parts = [(r["level"], r["number"], r["path"]) for r in current]
        parts.append((0, batch_id, self._write(self.merge(batch), 0)))
        level = 0
        while len(own := sorted(p for p in parts if p[0] == level)) >= FAN:
            merged = self._write(self.merge(self.spark.read.parquet(*[p[2] for p in own])), level + 1)
            parts = [p for p in parts if p[0] != level] + [(level + 1, batch_id, merged)]
            level += 1
        self.spark.createDataFrame([(batch_id, *p) for p in parts], MANIFEST).coalesce(1).write.mode(
            "append").parquet(f"{self.folder}/manifest")
        self._clear(rows)

    def _clear(self, rows: list) -> None:
        """Drop manifests beyond the last few, and the parts that none of the others names."""
        versions = sorted({r["version"] for r in rows})
        old = set(versions[:-KEPT_MANIFESTS])
        if len(old) < FAN:
            return
        named = {r["path"] for r in rows if r["version"] not in old}
        files = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest").select(
            "version", F.input_file_name().alias("file")).distinct().collect()
        for file in {r["file"] for r in files if r["version"] in old}:
            _delete(self.spark, file)
        for path in {r["path"] for r in rows if r["version"] in old} - named:
            if re.fullmatch(r"\d+-[0-9a-f]{32}", path.rsplit("/", 1)[-1]):
                _delete(self.spark, path)


def last_versions(*keys: str) -> Merge:
    """Of the rows of a key the one of the last batch; rows have a ``batch_id``."""
    def merge(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in (*keys, "batch_id")]
        last = F.max(F.struct("batch_id", *rest)).alias("last")
        return df.groupBy(*keys).agg(last).select(*keys, "last.*")
    return merge


def sums(*keys: str) -> Merge:
    """Sums of all columns but the keys."""
    def merge(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.sum(c).cast(t).alias(c) for c, t in df.dtypes if c not in keys])
    return merge
