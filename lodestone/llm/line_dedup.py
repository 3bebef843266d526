"""Removal of lines that many documents share, with two Bloom filters.

1. Each task adds its documents' distinct line keys to two Bloom filters, once-seen and twice-seen, as bit positions;
   positions meet by block of the filter. A key's bits are in the merged twice-seen filter if a task saw it twice or
   two tasks saw it once each: that is at least all keys of two documents, and few others.
2. Only keys that the twice-seen filter suspects are shuffled, as SHA-256 digests once per document, counted before
   the shuffle, and confirmed exactly.
3. Confirmed keys lose their lines: in every document, or (keep_first) in all but the first that has it.

The filters have 8 bits a line, at most MAX_BITS; beyond that they get fuller, more keys are suspected and counted,
and the result stays exact. Confirmed digests are broadcast up to a checked number; beyond it they are joined.

Defined cases: null or empty text is one empty line; rows of one id are one document that is counted once; rows without
an id lose common lines like any other, but are counted as no document; each row keeps its own text; an empty table
gives no rows; other columns of the input are passed through as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, quoted, seen_parts, small_batches, twice_seen, unused, written

BLANKS = b" \t\n\x0b\x0c\r"
MIN_DOCUMENTS, MIN_CHARS = 10, 1
MIN_BITS, MAX_BITS, BLOCK_BITS = 1 << 16, 1 << 29, 1 << 16
#: Confirmed digests that are broadcast: 32 bytes each.
BROADCAST_KEYS = 200_000


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII blanks, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def _keys(text: str | None, min_chars: int) -> list[bytes]:
    keys = map(line_key, (text or "").encode().split(b"\n"))
    if min_chars <= 1:
        return [k for k in keys if len(k) >= min_chars]
    return [k for k in keys if len(k) >= min_chars and len(k.decode()) >= min_chars]


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64)


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bits of the filter for each hash of a key."""
    low, mask = hashes & np.uint64(0xFFFFFFFF), np.uint64(bits - 1)
    return np.stack([low & mask, (hashes >> np.uint64(32)) & mask]).astype(np.int64)


def _filter_parts(docs: DataFrame, bits: int, min_chars: int) -> DataFrame:
    """(block, once, twice): the tasks' two filters."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def parts() -> pa.RecordBatch:
            return seen_parts(*np.unique(np.concatenate(held), return_counts=True), lambda h, n: _positions(h, n).ravel(), bits, BLOCK_BITS)

        for batch in small_batches(batches, "text"):
            for text in batch.column(0).to_pylist():
                held.append(_hashes(set(_keys(text, min_chars))))
                size += len(held[-1])
            if size > 1 << 19:
                yield parts()
                held, size = [], 0
        if size:
            yield parts()

    return docs.select("text").mapInArrow(add, "block int, once binary, twice binary")


def common_keys(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(key) digests of keys in at least min_documents documents, and the filter's suspects (id, row, key)."""
    spark = docs.sparkSession
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 1
    bits = min(MAX_BITS, max(MIN_BITS, 1 << int(8 * int(lines)).bit_length()))
    shared = spark.sparkContext.broadcast(twice_seen(_filter_parts(docs, bits, min_chars), bits, BLOCK_BITS))  # at most MAX_BITS / 8 bytes

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in small_batches(batches, "text"):
            at, found = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                keys = list(set(_keys(text, min_chars)))
                if not keys:
                    continue
                a, b = _positions(_hashes(keys), bits)
                there = (bitmap[a >> 3] >> (a & 7)) & (bitmap[b >> 3] >> (b & 7)) & 1
                for j in np.flatnonzero(there):
                    at.append(i)
                    found.append(hashlib.sha256(keys[j]).digest())
            own = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(found, pa.binary())], ["id", "row", "key"])

    suspects = docs.select(F.col("doc_id").cast("string").alias("id"), _row().alias("row"), "text").mapInArrow(suspect, "id string, row binary, key binary")
    # a document counts once, however many rows it has
    counted = suspects.where("id IS NOT NULL").select("key", "id").distinct().groupBy("key").agg(F.count("*").alias("n"))
    return written(counted.where(F.col("n") >= min_documents), "lines"), suspects


def _row():
    """A digest of a row's id and text."""
    return F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))))


def drop_common_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, broadcast_keys: int = BROADCAST_KEYS, keep_first: bool = False, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with the text left after common lines are dropped, and the numbers of lines before and dropped as counts.

    Columns doc_id and text are read; the others stay, but for those that have the names of counts. keep_first keeps
    such a line in the document with the smallest id that has it (its first occurrence there).
    """
    spark = docs.sparkSession
    keys, suspects = common_keys(docs, min_documents, min_chars)
    fields = [f for f in docs.schema if f.name not in counts]
    names = [f.name for f in fields]
    lines, lists = unused(names, "row", "keys")
    out = T.StructType([*fields, *[T.StructField(n, T.LongType()) for n in counts]])
    own_columns = docs.select(*quoted(names))
    small = keys.count() <= broadcast_keys and not keep_first
    shared = spark.sparkContext.broadcast(frozenset(bytes(r.key) for r in keys.select("key").collect())) if small else None

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            at = batch.schema.get_field_index("text")
            own = None if small else batch.column(batch.schema.get_field_index(lists)).to_pylist()
            kept, total, gone = [], [], []
            for i, text in enumerate(batch.column(at).to_pylist()):
                lines = (text or "").encode().split(b"\n")
                bad = shared.value if small else frozenset(own[i] or ())
                stay = []
                for line in lines if bad else ():
                    key = line_key(line)
                    if not (key and hashlib.sha256(key).digest() in bad):
                        stay.append(line)
                total.append(len(lines))
                gone.append(len(lines) - len(stay) if bad else 0)
                kept.append(b"\n".join(stay).decode() if bad and gone[-1] else text if text is not None else "")
            arrays = [pa.array(kept, pa.string()) if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*names, *counts])

    if small:
        return map_batches(own_columns, strip, out)
    rows = own_columns.withColumn(lines, _row())
    hits = suspects.join(keys.select("key"), "key")
    if keep_first:
        ids = docs.select(_row().alias("row"), F.struct("doc_id", _row().alias("row")).alias("o"))
        placed = hits.join(ids.distinct(), "row")
        first = placed.groupBy("key").agg(F.min("o").alias("f"))
        hits = placed.join(first, "key").where("o <> f")
    own = hits.groupBy(F.col("row").alias(lines)).agg(F.collect_set("key").alias(lists))  # the lines of one text
    return map_batches(rows.join(own, lines, "left").drop(lines), strip, out)
