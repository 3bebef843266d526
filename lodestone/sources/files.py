"""Text files as a document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import INDEXED_EXTENSIONS, gutenberg_clean, indexable

#: Names that end in an indexed extension and have something before it; what it lets through is tested exactly.
INDEXED_NAMES = f"?*.{{{','.join(INDEXED_EXTENSIONS)}}}"


def crawl(spark: SparkSession, root: str) -> DataFrame:
    """(path, content binary) of the indexable files below root, or of root itself if it is a file.

    The listing leaves other files out before tasks are planned, so they are never opened; tasks take files of bounded bytes together.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", INDEXED_NAMES).load(root)
    return files.where(indexable(F.col("path"))).select("path", "content")


def read_documents(spark: SparkSession, root: str, on_invalid: str = "skip", clean: bool = True) -> DataFrame:
    """(path, text) of UTF-8 files. Bytes that are not UTF-8: "skip" leaves the file out, "error" fails."""
    return as_documents(crawl(spark, root), on_invalid, clean)


def stream_documents(spark: SparkSession, root: str, on_invalid: str = "skip", clean: bool = True, files_a_batch: int = 10_000) -> DataFrame:
    """read_documents() as a stream: each indexable file once, when it first appears in the folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", INDEXED_NAMES).option("recursiveFileLookup", True)
    files = reader.option("maxFilesPerTrigger", files_a_batch).load(root)
    return as_documents(files.where(indexable(F.col("path"))).select("path", "content"), on_invalid, clean)


def as_documents(files: DataFrame, on_invalid: str, clean: bool) -> DataFrame:
    if on_invalid == "skip":
        text = F.col("content").cast("string")
        files = files.where(F.is_valid_utf8(text))
    elif on_invalid == "error":
        text = F.validate_utf8(F.col("content").cast("string"))
    else:
        raise ValueError(f"on_invalid is skip or error, not {on_invalid}")
    return files.select("path", (gutenberg_clean(text) if clean else text).alias("text"))
