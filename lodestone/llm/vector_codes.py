"""Product codes of vectors: eight small codebooks, learned and applied with segment-mean lower bounds.

A vector's components become integers floor(scale * x) and are cut into equal consecutive parts. Each part position has a
codebook of a few entries, which starts as that part of the rows with the smallest ids. A round assigns every part to
its nearest entry (squared Euclidean distance, ties to the lower index) and replaces each entry by the componentwise
floor(sum / count) of its parts; entries without parts stay.

The nearest entry is found coarse to fine. A part is cut into blocks (one, then two, then four); with m the mean of a block
of n components and r the norm of what remains of the block without its mean,

    |x - c|^2  =  sum over blocks of n (m_x - m_c)^2 + |rest_x - rest_c|^2  >=  sum of n (m_x - m_c)^2 + (r_x - r_c)^2,

and each level's bound is at least as large as the one before. The entry with the smallest first bound gets its exact
distance; entries whose bound is above it (by more than floating point may err) go, level by level; what survives gets exact
integer distances, so results are those of a comparison with all entries.

Rows are written once as integers. A round is one pass over them: tasks see the codebooks, a table of a fixed number of
components whatever the rows, and return sums and counts by entry, that is at most parts * entries * width rows each.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; components saturate at
+-2^26 after scaling (|x| of 16 384 at scale 4096), which keeps distances within a long; vectors shorter than the longest,
and those of a length that parts doesn't divide, count as ending in zeros; empty vectors have code 0 everywhere. Equal ids and equal
vectors are rows of their own; of equal ids those with the smaller vector come first; null ids come last. Fewer rows than entries give
smaller codebooks; no rows give no codebook and no codes. Null labels count as one label. No other column is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, quoted, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bound of a component, blocks of a part at each level, rows compared at a time.
MOST, BLOCKS, CHUNK = 1 << 26, (1, 2, 4), 1 << 13
#: What floating point may err, as a share of |x|^2 + |c|^2: norms of remainders come from differences, to about 1e-8 |x|.
SLACK = 1e-6
#: Labels whose sums are broadcast; more are joined by a shuffle, dealt into SALT parts a label.
BROADCAST_LABELS, SALT = 100_000, 32


def integers(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, v array<int>) of the rows that take part, written once."""
    names = quoted([id_column, label, vector])
    rows = vectors.select(F.col(names[0]).cast("long").alias("id"), F.col(names[1]).alias("label"), F.col(names[2]).cast("array<double>").alias("v"))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(2)))
            if not batch.num_rows:
                continue
            v = batch.column(2)
            x = v.flatten()
            fine = np.asarray(pc.fill_null(pc.is_finite(x), False))
            sizes = np.asarray(pc.list_value_length(v)).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            kept = np.ones(len(sizes), bool)
            kept[row[~fine]] = False
            ints = np.clip(np.floor(np.asarray(x.fill_null(0.0))[kept[row]] * scale), -MOST, MOST).astype(np.int32)
            edge = np.append(0, np.cumsum(sizes[kept])).astype(np.int32)
            mask = pa.array(kept)
            arrays = [batch.column(0).filter(mask), batch.column(1).filter(mask), pa.ListArray.from_arrays(edge, pa.array(ints))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "label", "v"])

    schema = f"id long, label {rows.schema['label'].dataType.simpleString()}, v array<int>"
    return written(rows.mapInArrow(scaled, schema), "vector-integers")


def parts_of(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """(parts, rows, width) of integer lists, shorter ones ending in zeros."""
    sizes = np.asarray(pc.list_value_length(column)).astype(np.int64)
    out = np.zeros((len(sizes), parts * width), np.int64)
    out[np.arange(parts * width) < sizes[:, None]] = np.asarray(column.flatten())
    return np.ascontiguousarray(out.reshape(len(sizes), parts, width).transpose(1, 0, 2))


def _levels(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each level the blocks' scaled means sqrt(n) m, and the norm of what remains."""
    width, out = x.shape[1], []
    square = (x * x).sum(axis=1).astype(np.float64)
    for blocks in BLOCKS:
        if blocks > width:
            break
        cuts = np.arange(blocks) * width // blocks
        n = np.diff(np.append(cuts, width))
        means = np.add.reduceat(x, cuts, axis=1) / np.sqrt(n)
        out.append((means, np.sqrt(np.maximum(square - (means * means).sum(axis=1), 0))))
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the nearest entry of each row of x, and how many exact distances it took."""
    index, error, exact = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    of_entries = _levels(entries)
    for a in range(0, len(x), CHUNK):
        part = x[a : a + CHUNK]
        n = len(part)
        levels = _levels(part)
        if not levels:  # vectors without components
            continue
        (m, r), (cm, cr) = levels[0], of_entries[0]
        bound = ((m[:, None] - cm) ** 2).sum(axis=2) + (r[:, None] - cr) ** 2
        first = bound.argmin(axis=1)
        best = ((part - entries[first]) ** 2).sum(axis=1)
        # a bound may err by a share of the numbers that it comes from
        scale = ((m * m).sum(axis=1) + r * r)[:, None] + ((cm * cm).sum(axis=1) + cr * cr) + 1
        limit = best[:, None] + SLACK * scale
        fine = bound <= limit
        fine[np.arange(n), first] = False  # it is known
        row, entry = np.nonzero(fine)
        for (m, r), (cm, cr) in zip(levels[1:], of_entries[1:]):
            fine = ((m[row] - cm[entry]) ** 2).sum(axis=1) + (r[row] - cr[entry]) ** 2 <= limit[row, entry]
            row, entry = row[fine], entry[fine]
        exact += len(row) + n
        found = np.full((n, len(entries)), np.iinfo(np.int64).max)
        found[np.arange(n), first] = best
        found[row, entry] = ((part[row] - entries[entry]) ** 2).sum(axis=1)
        index[a : a + n] = found.argmin(axis=1)  # the first of equal ones
        error[a : a + n] = found[np.arange(n), index[a : a + n]]
    return index, error, exact


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of integers() rows."""
    spark = rows.sparkSession
    longest = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("n")).first().n
    width = -(-longest // parts)
    firsts = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()  # the first codebook
    start = np.zeros((len(firsts), parts * width), np.int64)
    for i, row in enumerate(firsts):
        start[i, : len(row.v)] = row.v
    books = np.ascontiguousarray(start.reshape(len(firsts), parts, width).transpose(1, 0, 2))
    if not len(firsts) or not width:
        return books
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)  # parts * entries * width numbers

        def gather(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            forget()
            books = shared.value
            p, k, w = books.shape
            sums, counts = np.zeros((p, k, w), np.int64), np.zeros((p, k), np.int64)
            for batch in batches:
                x = parts_of(batch.column(0), p, w)
                for j in range(p):
                    index, _, _ = nearest(x[j], books[j])
                    own = (index == np.arange(k)[:, None]).astype(np.float64)
                    sums[j] += (own @ x[j].astype(np.float64)).astype(np.int64)  # exact: below 2^53 for a batch's rows
                    counts[j] += np.bincount(index, minlength=k)
            cell = np.flatnonzero(np.repeat(counts.ravel() > 0, w))
            arrays = [cell, sums.ravel()[cell], np.repeat(counts.ravel(), w)[cell]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["cell", "s", "n"])

        sums = rows.select("v").mapInArrow(gather, "cell long, s long, n long")
        found = sums.groupBy("cell").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()  # a row a component of a codebook
        cell, s, n = (found.column(c).to_numpy() for c in ("cell", "s", "n"))
        books = books.copy()
        books.ravel()[cell] = s // n
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code array<int>, error) of integers() rows: an index a part and the squared distances' sum."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        p, _, w = shared.value.shape
        for batch in batches:
            x = parts_of(batch.column(2), p, w)
            code, error = np.zeros((batch.num_rows, p), np.int32), np.zeros(batch.num_rows, np.int64)
            for j in range(p):
                index, far, _ = nearest(x[j], shared.value[j])
                code[:, j] = index
                error += far
            edge = np.arange(batch.num_rows + 1, dtype=np.int32) * p
            lists = pa.ListArray.from_arrays(edge, pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(error)], ["id", "label", "code", "error"])

    schema = f"id long, label {rows.schema['label'].dataType.simpleString()}, code array<int>, error long"
    return (rows if parts else rows.limit(0)).mapInArrow(run, schema)


def with_label_error(coded: DataFrame, most: int = BROADCAST_LABELS) -> DataFrame:
    """coded with label_error, the errors' sum over equal labels. coded is read twice, so write it before."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = written(sums, "label-errors")
    same = coded["label"].eqNullSafe(sums["label"])
    if sums.count() <= most:
        return coded.join(F.broadcast(sums), same).drop(sums["label"])
    # a label may hold a third of the rows: its sum goes to SALT tasks
    salted = sums.select("label_error", F.col("label").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    rows = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code", "error"), F.lit(SALT)).cast("int"))
    return rows.join(salted, rows["label"].eqNullSafe(salted["own"]) & (rows["salt"] == salted["salt"])).select(*coded.columns, "label_error")


def compress(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error, label_error), codebooks): learned from all rows and applied to all."""
    rows = integers(vectors, id_column, vector, label, scale)
    books = fit(rows, parts, entries, rounds)
    return with_label_error(written(encode(rows, books), "vector-codes")), books


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
