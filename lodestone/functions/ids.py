"""Identifiers derived from content and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_id(index: Column, data: Column) -> Column:
    """block-<index>-<16 hex digits of the SHA-256>: addressed by content at an index."""
    return F.format_string("block-%06d-%s", index, F.substring(F.sha2(data, 256), 1, 16))


def block_path(block: Column) -> Column:
    """Two levels of two characters; ids of under four characters stay flat."""
    nested = F.concat_ws("/", F.substring(block, 1, 2), F.substring(block, 3, 2), block)
    return F.when(F.length(block) < 4, block).otherwise(nested)


def cas_path(key: Column) -> Column:
    """Eight folders of five hex digits of the SHA-1 of a key."""
    digest = F.sha1(key.cast("binary"))
    return F.concat_ws("/", *[F.substring(digest, i * 5 + 1, 5) for i in range(8)])


def segment_number(segment_id: Column) -> Column:
    """The number in seg_<digits>, null for other names."""
    return F.regexp_extract(segment_id, r"^seg_(\d+)$", 1).try_cast("long")


def segment_name(number: Column) -> Column:
    return F.format_string("seg_%06d", number)


def path_from_url(url_path: Column) -> Column:
    """/files/<x> is the file /<x>; other paths get a slash in front; null if no name is left."""
    path = F.concat(F.lit("/"), F.regexp_replace(url_path, "^/files/", ""))
    return F.when(path != "/", path)


def url_from_path(path: Column) -> Column:
    """The inverse of path_from_url()."""
    return F.concat(F.lit("/files/"), F.regexp_replace(path, "^/", ""))
