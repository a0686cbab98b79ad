"""Named chunk tables: written, upserted by id, opened, listed.

A collection is a folder of parts and a pointer that lists those in force, oldest first. A write adds its part and then
replaces the pointer by one atomic rename, so readers and failed runs see one whole table at any moment. An upsert
writes its own rows alone; readers take the newest row of each id, and every :data:`MAX_PARTS` parts are merged into one.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts of a collection beyond which an upsert merges them.
MAX_PARTS = 8
_POINTER = "_PARTS"


class _Folder:
    """A collection's folder on the file system that its path names."""

    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        self.path = f"{root.rstrip('/')}/{name}"
        self._gateway = spark.sparkContext._gateway
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._text = spark._jvm.org.apache.commons.io.IOUtils
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._at("").getFileSystem(self._conf)

    def _at(self, below: str):
        return self._hadoop.Path(f"{self.path}/{below}".rstrip("/"))

    def parts(self) -> list[str]:
        """The parts in force, oldest first; none where there is no collection."""
        pointer = self._at(_POINTER)
        if not self._files.exists(pointer):
            return []
        stream = self._files.open(pointer)
        try:
            return self._text.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def put_in_force(self, parts: list[str]) -> None:
        """Replaces the pointer. Parts that neither the new nor the last pointer lists are deleted: readers of the last one go on."""
        last = self.parts()
        fresh = self._files.makeQualified(self._at(f"_{uuid.uuid4().hex}"))
        stream = self._files.create(fresh)
        stream.write(bytearray("\n".join(parts).encode()))
        stream.close()
        rename = self._hadoop.Options.Rename
        overwrite = self._gateway.new_array(rename, 1)
        overwrite[0] = rename.OVERWRITE
        context = self._hadoop.FileContext.getFileContext(fresh.toUri(), self._conf)
        context.rename(fresh, self._files.makeQualified(self._at(_POINTER)), overwrite)
        for found in self._files.listStatus(self._at("")):
            if found.isDirectory() and found.getPath().getName() not in {*parts, *last}:
                self._files.delete(found.getPath(), True)


def _rows(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """The rows of some parts, of each id the newest; a single part is read as it is."""
    tables = [spark.read.parquet(f"{path}/{part}") for part in parts]
    if len(tables) == 1:
        return tables[0]
    aged = [t.withColumn("__age", F.lit(len(tables) - i)) for i, t in enumerate(tables)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aged)
    newest = F.row_number().over(Window.partitionBy("chunk_id").orderBy("__age"))
    return every.withColumn("__n", newest).where("__n = 1").drop("__n", "__age")


def write(chunks: DataFrame, root: str, name: str, replace: bool = True) -> None:
    """Stores chunks under a name. ``replace`` drops what was there; otherwise chunks are upserted by chunk_id.

    One writer at a time: two would each put their own list of parts in force.
    """
    spark, folder = chunks.sparkSession, _Folder(chunks.sparkSession, root, name)
    part = f"part-{uuid.uuid4().hex}"
    chunks.write.parquet(f"{folder.path}/{part}")
    parts = [part] if replace else [*folder.parts(), part]
    if len(parts) > MAX_PARTS:
        merged = f"part-{uuid.uuid4().hex}"
        _rows(spark, folder.path, parts).write.parquet(f"{folder.path}/{merged}")
        parts = [merged]
    folder.put_in_force(parts)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored collection; ValueError if it is missing or empty."""
    folder = _Folder(spark, root, name)
    parts = folder.parts()
    if not parts or (rows := _rows(spark, folder.path, parts)).isEmpty():
        raise ValueError(f"collection {name} is missing or empty under {root}")
    return rows


def stats(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length, rounded half to even; null for none."""
    return chunks.agg(F.nullif(F.count(F.lit(1)), F.lit(0)).alias("chunks"), F.bround(F.avg(F.length("text"))).cast("long").alias("mean_chars"))


def inspect(spark: SparkSession, root: str) -> list[dict]:
    """Name, number of chunks and the first chunk's id and opening, for every collection."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for name in sorted(s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()):
        folder = _Folder(spark, root, name)
        if parts := folder.parts():
            rows = _rows(spark, folder.path, parts)
            first = rows.select("chunk_id", "source", F.substring("text", 1, 120).alias("text")).limit(1).collect()
            out.append({"name": name, "count": rows.count(), "first": first[0].asDict() if first else None})
    return out
