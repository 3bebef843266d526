"""Tokens, terms, file cleaning and the query syntax.

Nulls: a null text has no tokens and stays null when cleaned.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BLANK_FREE = r"[^\p{IsWhite_Space}]+"
NOT_IN_TERM = r"[^\p{IsAlphabetic}\p{N}]"

# The markers around a Project Gutenberg book.
START_MARKERS = (
    "*** START OF THE PROJECT GUTENBERG EBOOK",
    "*** START OF THIS PROJECT GUTENBERG EBOOK",
    "***START OF THE PROJECT GUTENBERG EBOOK",
    "START OF THE PROJECT GUTENBERG",
)
END_MARKERS = (
    "*** END OF THE PROJECT GUTENBERG EBOOK",
    "*** END OF THIS PROJECT GUTENBERG EBOOK",
    "***END OF THE PROJECT GUTENBERG EBOOK",
    "END OF THE PROJECT GUTENBERG",
)
# The file extensions that are indexed, in this case only.
INDEXED_EXTENSIONS = ("txt", "html", "htm", "rs", "c", "cc", "cpp", "h", "hpp", "md")

MODES = {"and": "and", "all": "and", "or": "or", "any": "or", "phrase": "phrase"}


def raw_tokens(text: Column) -> Column:
    """Maximal runs without Unicode white space, in order."""
    return F.regexp_extract_all(text, F.lit(BLANK_FREE), F.lit(0))


def normalize(raw: Column) -> Column:
    """Letters and digits only, lower case; a capital sigma never becomes a final one."""
    return F.lower(F.translate(F.regexp_replace(raw, NOT_IN_TERM, ""), "Σ", "σ"))


#: What stands for characters that are in no term; itself one of them.
NO_TERM = "\u0001"


def marked(text: Column) -> Column:
    """A text in lower case with a mark for each character that is in no term nor white space: normalize() of all its tokens at once, up to the marks."""
    kept = F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}]", NO_TERM)
    return F.lower(F.translate(kept, "Σ", "σ"))


def unmarked(token: Column) -> Column:
    """The term of a token of a marked() text."""
    return F.replace(token, F.lit(NO_TERM), F.lit(""))


def indexable(path: Column) -> Column:
    """Whether the last extension is one of the indexed ones; a dot file has none."""
    extension = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    return F.coalesce(extension.isin(*INDEXED_EXTENSIONS), F.lit(False))


def gutenberg_clean(text: Column) -> Column:
    """From the first start marker (or the beginning) to the first end marker (or the end).

    All of the text if they are not in this order. What follows a start marker in its line stays.
    """

    def first(markers: tuple[str, ...], after: bool) -> Column:
        found = [
            F.when(F.instr(text, m) > 0, F.instr(text, m) + (len(m) if after else 0)) for m in markers
        ]
        return F.least(*found)

    start = F.coalesce(first(START_MARKERS, True), F.lit(1))
    end = F.coalesce(first(END_MARKERS, False), F.length(text) + 1)
    body = F.substring(text, start, end - start)
    return F.when(start < end, body).otherwise(text)


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The terms of a query, repeats included, by the very expressions that terms of an index come from."""
    words = F.transform(raw_tokens(F.col("q")), normalize)
    row = spark.createDataFrame([(query,)], "q string").select(F.filter(words, lambda t: t != "").alias("t")).first()
    return list(row.t)


def parse_mode(name: str) -> str:
    """and, or or phrase from a name or its alias in any ASCII case."""
    try:
        return MODES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown query mode: {name}") from None


def parse_query(query: str, default: str = "and") -> tuple[str, str]:
    """(text, mode); a query in double quotes is a phrase without them."""
    if query.startswith('"') and query.endswith('"'):
        return query.strip('"'), "phrase"
    return query, parse_mode(default)
