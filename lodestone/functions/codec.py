"""Gap and variable-length integer codecs over sorted id and position lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A varint holds 7 bits a byte.
VARINT_STEPS = tuple(1 << (7 * i) for i in range(1, 9))


def gap_encode(ids: Column) -> Column:
    """First differences of an ascending array<bigint>, the first against 0."""
    return F.transform(ids, lambda x, i: x - F.when(i > 0, F.get(ids, i - 1)).otherwise(F.lit(0).cast("long")))


def gap_decode(gaps: Column) -> Column:
    """Running sums, the inverse of gap_encode(). For long lists use index.gap_rows() and index.ungap_rows(), a row an id."""
    return F.transform(gaps, lambda x, i: F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y))


def size_mb(size: Column) -> Column:
    """Bytes as millions with two decimals."""
    return F.round(size / 1e6, 2)


def varint_length(value: Column) -> Column:
    """Bytes of the little-endian base-128 form of a value that is not negative."""
    return sum(((value >= step).cast("long") for step in VARINT_STEPS), F.lit(1).cast("long"))


def encode_varints(values: list[int]) -> bytes:
    """The bytes themselves, for one list on the driver or in a Python worker."""
    out = bytearray()
    for value in values:
        if value < 0:
            raise ValueError("varints are not negative")
        while value >= 0x80:
            out.append(value & 0x7F | 0x80)
            value >>= 7
        out.append(value)
    return bytes(out)


def decode_varints(data: bytes) -> list[int] | None:
    """The values; None if the bytes end within a value or one needs over 64 bits."""
    values, value, shift, open_ = [], 0, 0, False
    for byte in data:
        if shift >= 64:
            return None
        value |= (byte & 0x7F) << shift
        shift += 7
        open_ = bool(byte & 0x80)
        if not open_:
            values.append(value)
            value = shift = 0
    return None if open_ else values


def encode_postings(postings: dict[int, list[int]]) -> bytes:
    """A posting list: the number of documents, then id gap, count and position gaps of each."""
    flat, last = [len(postings)], 0
    for doc_id in sorted(postings):
        positions = postings[doc_id]
        flat += [doc_id - last, len(positions)]
        flat += [b - a for a, b in zip([0, *positions], positions)]
        last = doc_id
    return encode_varints(flat)


def decode_postings(data: bytes) -> dict[int, list[int]] | None:
    """The inverse of encode_postings(); None for broken bytes or bytes left over."""
    values = decode_varints(data)
    if not values:
        return {} if values == [] else None
    rest, out, doc_id = iter(values), {}, 0
    try:
        for _ in range(next(rest)):
            doc_id += next(rest)
            positions, at = [], 0
            for _ in range(next(rest)):
                at += next(rest)
                positions.append(at)
            out[doc_id] = positions
    except StopIteration:
        return None
    return None if next(rest, None) is not None else out
