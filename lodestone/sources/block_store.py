"""Stored blocks and files: tables with a key, where later puts replace and deletions hide.

A put or a deletion is one folder below root (v=<n>), written beside its place and renamed, so readers see all of it or
nothing, and of two writers of one version one fails. A key's newest version counts. compact() rewrites what is left.
"""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B

# Fixed value: the capacity of a node's store in bytes. Puts don't look at it, placement does.
CAPACITY = 1 << 30


class KeyedTable:
    """Rows by one string key. `columns` is the schema with the key first."""

    def __init__(self, spark: SparkSession, root: str, columns: str):
        self.spark, self.root, self.columns = spark, root.rstrip("/"), columns
        self.key = columns.split()[0]

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, kind: str) -> list[int]:
        path, fs = self._path(kind)
        return sorted(int(x.getPath().getName()[2:]) for x in fs.listStatus(path)) if fs.exists(path) else []

    def _commit(self, kind: str, frame: DataFrame) -> int:
        version = max(self._versions("put") + self._versions("gone"), default=0) + 1
        made = f"made-{uuid.uuid4().hex}"
        (old, fs), (new, _), (parent, _) = self._path(made), self._path(f"{kind}/v={version}"), self._path(kind)
        try:
            frame.write.parquet(f"{self.root}/{made}")
            fs.mkdirs(parent)
            if fs.exists(new) or not fs.rename(old, new):
                raise RuntimeError(f"another writer made version {version} of {self.root}")
        finally:
            fs.delete(old, True)
        return version

    def _read(self, kind: str, schema: str) -> DataFrame:
        if not self._versions(kind):
            return self.spark.createDataFrame([], f"{schema}, v long")
        return self.spark.read.schema(f"{schema}, v long").parquet(f"{self.root}/{kind}")

    def put(self, rows: DataFrame) -> int:
        """Store rows by key; the version they are. A null or empty key is an error, and then nothing is stored."""
        checked = F.when(F.coalesce(F.col(self.key), F.lit("")) == "", F.raise_error(F.lit(f"empty {self.key}"))).otherwise(F.col(self.key))
        return self._commit("put", rows.withColumn(self.key, checked).sortWithinPartitions(self.key))

    def delete(self, keys: DataFrame) -> int:
        """Hide the rows of keys; a missing one is no error."""
        return self._commit("gone", keys.select(self.key).distinct())

    def read(self) -> DataFrame:
        """The visible rows. Keys and versions alone are shuffled to find them where nothing was replaced or deleted."""
        rows = self._read("put", self.columns)
        if len(self._versions("put")) < 2 and not self._versions("gone"):
            return rows.drop("v")
        ids = rows.select(self.key, "v", F.lit(True).alias("there"))
        gone = self._read("gone", f"{self.key} string").withColumn("there", F.lit(False))
        last = ids.unionByName(gone).groupBy(self.key).agg(F.max(F.struct("v", "there")).alias("m"))
        return rows.join(last.where("m.there").select(self.key, F.col("m.v").alias("v")), [self.key, "v"], "left_semi").drop("v")

    def compact(self) -> None:
        """One version with the visible rows; the folders before it are deleted."""
        version = self._commit("put", self.read().sortWithinPartitions(self.key))
        for kind in ("put", "gone"):
            for v in self._versions(kind):
                if v < version:
                    path, fs = self._path(f"{kind}/v={v}")
                    fs.delete(path, True)


class BlockStore(KeyedTable):
    """Blocks(id, data) of a node or of all: put, get, stat, exists, delete."""

    def __init__(self, spark: SparkSession, root: str, capacity: int = CAPACITY):
        super().__init__(spark, root, "id string, data binary, size long, checksum string")
        self.capacity = capacity

    def put(self, rows: DataFrame) -> int:
        """Null data is an error. Of several rows of one id that with the smallest checksum is stored."""
        data = F.coalesce("data", F.raise_error(F.lit("null block data")).cast("binary"))
        # 32 bytes a checksum, in the order of its digits
        once = rows.select("id", F.struct(F.unhex(F.sha2(data, 256)).alias("sum"), data.alias("data")).alias("b")).groupBy("id").agg(F.min("b").alias("b"))
        return super().put(once.select("id", "b.data", F.octet_length("b.data").cast("long").alias("size"), F.lower(F.hex("b.sum")).alias("checksum")))

    def _one(self, block_id: str) -> DataFrame:
        if not block_id:
            raise ValueError("empty block id")
        return self.read().where(F.col("id") == block_id)

    def get(self, block_id: str) -> bytes:
        """A block's bytes; a missing one is an error."""
        if (row := self._one(block_id).select("data").first()) is None:
            raise FileNotFoundError(block_id)
        return bytes(row.data)

    def exists(self, block_id: str) -> bool:
        return bool(block_id) and self._one(block_id).select("id").first() is not None

    def stat(self) -> DataFrame:
        """(id, size, checksum), both from the bytes as they are stored now, hashed where they are read: no bytes are shuffled."""
        now = [F.octet_length("data").cast("long").alias("size"), F.unhex(F.sha2("data", 256)).alias("sum")]
        shown = ["id", "size", F.lower(F.hex("sum")).alias("checksum")]
        rows = self._read("put", self.columns).select("id", "v", F.lit(True).alias("there"), *now)
        if len(self._versions("put")) < 2 and not self._versions("gone"):
            return rows.select(*shown)
        none = [F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("sum")]
        gone = self._read("gone", "id string").select("id", "v", F.lit(False).alias("there"), *none)
        last = rows.unionByName(gone).groupBy("id").agg(F.max(F.struct("v", "there", "size", "sum")).alias("m"))
        return last.where("m.there").select("id", "m.size", "m.sum").select(*shown)

    def usage(self) -> DataFrame:
        """One row: capacity, used, blocks."""
        used = F.coalesce(F.sum("size"), F.lit(0).cast("long"))
        return self.read().agg(F.lit(self.capacity).cast("long").alias("capacity"), used.alias("used"), F.count("*").alias("blocks"))


class FileStore:
    """Files over blocks: put, get, stat and delete. A replica is a node in a block's list; bytes are stored once, and
    copies of them are left to the file system below."""

    def __init__(self, spark: SparkSession, root: str):
        self.blocks = BlockStore(spark, f"{root.rstrip('/')}/blocks")
        self.files = KeyedTable(spark, f"{root.rstrip('/')}/files", B.METADATA)

    def put(self, files: DataFrame, nodes: DataFrame, replicas: int = 1, block_size: int = B.BLOCK_SIZE) -> DataFrame:
        """Split, place, write, then commit the metadata: (path, status) of all files, of which the ok ones are stored.

        A path that is there already is replaced and its old blocks stay. Of several rows of a path one must be left.
        """
        placed = B.allocate_files(files, nodes, replicas, block_size)
        blocks = B.placed_blocks(placed, block_size)
        self.blocks.put(blocks.select("id", "data"))
        self.files.put(B.placed_metadata(placed, blocks.drop("data")))
        return placed.select("path", "status")

    def stat(self) -> DataFrame:
        """(path, size, blocks) of the files."""
        return self.files.read()

    def _listed(self, path: str | None = None) -> DataFrame:
        listed = self.stat() if path is None else self.stat().where(F.col("path") == path)
        return listed.select("path", F.explode("blocks").alias("b")).select("path", "b.idx", "b.id")

    def get(self, path: str, to: BinaryIO) -> int:
        """Write a file's bytes block by block; how many. A missing path or block is an error."""
        if self.stat().where(F.col("path") == path).select("path").first() is None:
            raise FileNotFoundError(path)
        found, total = self._listed(path).join(self.blocks.read().select("id", "data"), "id", "left"), 0
        for row in found.orderBy("idx").toLocalIterator():
            if row.data is None:
                raise FileNotFoundError(row.id)
            total += to.write(row.data)
        return total

    def read(self) -> DataFrame:
        """(path, content) of all files with blocks."""
        return B.reassemble(self._listed().join(self.blocks.read().select("id", "data"), "id"))

    def delete(self, paths: DataFrame) -> None:
        """Delete the metadata; blocks stay, see orphans()."""
        self.files.delete(paths)

    def orphans(self) -> DataFrame:
        """(id, size) of blocks that no file lists."""
        return B.orphan_blocks(self.blocks.read().select("id", "size"), self._listed())
