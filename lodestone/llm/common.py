"""Shared by the operators: scratch tables, folds, file access and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests.
FALLBACK_DIR = "file:///tmp/lodestone-checkpoints"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors, through Spark, unless it was sent in this application."""
    root, app = Path(__file__).resolve().parent.parent, spark.sparkContext.applicationId
    if app not in _shipped:
        folder = tempfile.mkdtemp()  # the driver's own: Spark serves the file from there until the driver ends
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, f"{root.name}-source.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or FALLBACK_DIR).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended; its folder stays for the cluster's own clean-up
        pass


def written(df: DataFrame, name: str, rows: int | None = None, per_part: int = 200_000) -> DataFrame:
    """df as a table in the shared folder: computed once, and any lost executor's part can be read again.

    With a bound of its rows it gets no more files than they need.
    """
    path = new_folder(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(tasks(rows, per_part))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(rows: int, each: int) -> int:
    """Tasks for so many rows of which one task takes `each`: as many as the data need, whatever shuffles are dealt into."""
    return max(8, -(-rows // each))


def in_training_fold(doc_id: str = "doc_id"):
    """Rows whose crc32(doc_id as text) mod 5 is not 0; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def hash_below(fraction: float, *columns):
    """A fixed pseudo-random sample: whether the hash of the columns is in the lowest fraction."""
    bound = int(min(max(fraction, 0.0), 1.0) * (1 << 53))
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)) < F.lit(bound)


def quoted(names: Iterable[str]) -> list[str]:
    """Column names as Spark reads them, dots and backticks included."""
    return [f"`{n.replace('`', '``')}`" for n in names]


def unused(names: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores after those that columns have already in any case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow() for columns of any names: Spark's own doesn't take those with dots."""
    names = df.columns

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(pa.RecordBatch.from_arrays(b.columns, names) for b in batches)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, schema)


#: Clear what an operator keeps in a Python worker between tasks; another operator's tasks in the worker call them.
caches: list = []
_frozen = False


def forget(kept=None) -> None:
    """Clear the caches of other operators: Spark deals the workers of one stage out to any other."""
    for clear in caches:
        if clear != kept:  # equal, not the same: each look-up makes a new bound method
            clear()


def release() -> None:
    """Give a Python worker's free memory back: workers live on, and the next stage's come on top of it.

    What the imports made stays; after the first time it isn't gone through again (70 ms, and a copy of the pages that workers share).
    """
    global _frozen
    gc.collect()
    if not _frozen:
        gc.freeze()
        _frozen = True
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], name: str, most: int = 8 << 20, kept=None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of a string or list column, so that memory follows a text's size.

    kept: the one of caches that this operator uses.
    """
    forget(kept)
    release()
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(name))
        if col.nbytes <= most or batch.num_rows <= 1:
            yield batch
            continue
        sizes = pc.multiply(pc.list_value_length(col), 4) if pa.types.is_list(col.type) else pc.binary_length(col)
        sizes = np.array(pc.fill_null(sizes, 0), dtype=np.int64)
        piece = np.cumsum(sizes) // most
        starts = np.flatnonzero(np.diff(piece, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))
    batch = col = None
    release()


@contextlib.contextmanager
def small_transfers(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Within it Spark sends Python batches of about `most` bytes, however long its rows: each is in the executor's JVM and in the worker at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by a key: a group never ends within a table's end.

    Several groups come in one table. Memory follows a batch and the largest group.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key))
        last = keys[-1]
        if rest and rest[-1].column(rest[-1].schema.get_field_index(key))[-1] == last:
            rest.append(batch)
            continue
        same = pc.equal(keys, last)
        cut = int(pc.index(same, True).as_py())  # the last group begins here
        rest.append(batch.slice(0, cut))
        yield pa.Table.from_batches(rest)
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest)
    rest = batch = None
    release()


#: Edges that one task joins by union and find: 16 MB of ids.
LOCAL_EDGES = 1_000_000


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of edges(a, b) reaches.

    Up to local_edges edges are joined in a single task on an executor. More take alternating large-star and
    small-star steps, each written to the shared folder. A node's neighbours are never gathered there: a step needs
    only their minimum, which is written and joined back, and such joins split hot nodes. There are never more edges
    than at the beginning.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = written(pairs, "edges")
    n = now.count()
    if n <= local_edges:
        return now.coalesce(1).mapInArrow(_union_find, "node long, component long")
    seen = None
    for _ in range(rounds):
        # large star: each neighbour larger than u links to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low", n)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large", n)
        # small star: smaller neighbours and u itself link to the smallest of them
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low", n)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges", n)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = find(u), find(v)
            if u != v:
                up[max(u, v)] = min(u, v)
    nodes = list(up)
    arrays = [pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())]
    yield pa.RecordBatch.from_arrays(arrays, ["node", "component"])


#: Bits of an id filter that is broadcast, and of one of its blocks.
FILTER_BITS, FILTER_BLOCK = 1 << 26, 1 << 16


def id_filter(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap (one hashed bit an id) of ids(id long), bits / 8 bytes whatever their number; fuller ones pass more."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(filter_places(np.asarray(batch.column(0)), bits))
            blocks = np.unique(at // FILTER_BLOCK)
            edge = np.searchsorted(at, np.append(blocks, blocks[-1:] + 1) * FILTER_BLOCK)
            inner = (at % FILTER_BLOCK).astype(np.uint16)
            parts = [inner[a:b].tobytes() for a, b in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array(parts, pa.binary())], ["block", "at"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}  # the blocks of this partition: a fixed share of the bits
        for batch in batches:
            for block, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept.setdefault(block, np.zeros(FILTER_BLOCK, bool))[np.frombuffer(at, np.uint16)] = True
        rows = [pa.array(list(kept), pa.int32()), pa.array([np.packbits(b, bitorder="little").tobytes() for b in kept.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(rows, ["block", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    n = max(16, bits >> 22)
    parts = ids.mapInArrow(split, "block int, at binary").repartition(n, "block").coalesce(n)
    for row in parts.mapInArrow(merge, "block int, bits binary").toLocalIterator():
        out[row.block * FILTER_BLOCK // 8 : (row.block + 1) * FILTER_BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def filter_places(ids: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)


def passes(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = filter_places(ids, len(bitmap) * 8)
    return (bitmap[at >> 3] >> (at & 7)) & 1 == 1


def seen_parts(keys: np.ndarray, counts: np.ndarray, places, bits: int, block_bits: int) -> pa.RecordBatch:
    """One task's two Bloom filters as (block, once, twice): places within a block as 16-bit numbers."""
    found = [np.unique(places(keys[m], bits)) for m in (counts == 1, counts > 1)]
    blocks = np.unique(np.concatenate(found) // block_bits)
    arrays = [pa.array(blocks.astype(np.int32))]
    for at in found:
        edge = np.searchsorted(at, np.append(blocks, blocks[-1:] + 1) * block_bits)
        inner = (at % block_bits).astype(np.uint16)
        arrays.append(pa.array([inner[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["block", "once", "twice"])


def twice_seen(parts: DataFrame, bits: int, block_bits: int) -> np.ndarray:
    """The merged twice-seen filter of parts(block, once, twice): bits / 8 bytes."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            kept = np.packbits(twice, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([kept], pa.binary())], ["block", "bits"])

        for batch in batches:
            for at, o, t in zip(*(c.to_pylist() for c in batch.columns)):
                if at != block:
                    if block is not None and twice.any():
                        yield done()
                    block, once, twice = at, np.zeros(block_bits, bool), np.zeros(block_bits, bool)
                o, t = np.frombuffer(o, np.uint16), np.frombuffer(t, np.uint16)
                twice[o[once[o]]] = True  # once here and once before
                twice[t] = True
                once[o] = True
                once[t] = True
        if block is not None and twice.any():
            yield done()

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = parts.repartition(n, "block").sortWithinPartitions("block").coalesce(max(8, bits >> 22)).mapInArrow(merge, "block int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():  # bits / 8 bytes at most
        at = row.block * block_bits // 8
        out[at : at + block_bits // 8] = np.frombuffer(row.bits, np.uint8)
    return out
