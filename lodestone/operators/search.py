"""AND, OR and phrase search with TF-IDF or BM25 and an exact top k.

The number of terms of a query is fixed, so a document's statistics are one row: its length and the count of
each query term, summed before any shuffle. Ranking is score descending, then path, segment and id ascending.
Statistics are those of a segment; TF-IDF treats all segments as one snapshot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms

# Fixed values of the ranking functions.
K1, B = 1.2, 0.75
RESULT = "segment_id string, doc_id long, path string, score double"


def term_counts(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """doc_len and tf0, tf1, ... of each document with a token."""
    counts = [F.count_if(F.col("term") == t).alias(f"tf{i}") for i, t in enumerate(terms)]
    return tokens.groupBy("segment_id", "doc_id").agg(F.count("*").alias("doc_len"), *counts)


def statistics(docs: DataFrame, counts: DataFrame, terms: list[str], by: list[str]) -> DataFrame:
    """n (documents, those without tokens too), total length and df0, df1, ... of each group."""
    found = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]
    sums = counts.groupBy(*by).agg(F.sum("doc_len").alias("total"), *found)
    sizes = docs.groupBy(*by).agg(F.count("*").alias("n"))
    return sizes.join(sums, by) if by else sizes.crossJoin(sums)  # one row each


def tf_idf(tf: Column, df: Column, n: Column) -> Column:
    return F.when((df > 0) & (n > 0), tf * F.ln(n / df)).otherwise(F.lit(0.0))


def bm25(tf: Column, df: Column, n: Column, doc_len: Column, avg_len: Column) -> Column:
    idf = F.ln((n - df + 0.5) / (df + 0.5) + 1.0)
    score = idf * tf * (K1 + 1.0) / (tf + F.lit(K1) * (1.0 - B + F.lit(B) * doc_len / avg_len))
    return F.when((n > 0) & (df > 0) & (tf > 0) & (avg_len > 0), score).otherwise(F.lit(0.0))


def search(docs: DataFrame, tokens: DataFrame, query: str, mode: str = "and", scorer: str = "bm25") -> DataFrame:
    """(segment_id, doc_id, path, score) of all matches, unordered. A term scores once per occurrence in the query.

    Without terms nothing matches. A phrase scores the number of its occurrences.
    """
    terms = query_terms(docs.sparkSession, query)
    if not terms:
        return docs.sparkSession.createDataFrame([], RESULT)
    if mode == "phrase":
        scored = phrase(tokens, terms)
    else:
        distinct = list(dict.fromkeys(terms))
        counts = term_counts(tokens, distinct)
        by = ["segment_id"] if scorer == "bm25" else []
        stats = statistics(docs, counts, distinct, by)
        scored = _scored(counts.where(_match(mode, len(distinct))), stats, by, terms, scorer).select("segment_id", "doc_id", "score")
    return docs.select("segment_id", "doc_id", "path").join(scored, ["segment_id", "doc_id"])


def _match(mode: str, terms: int) -> Column:
    return reduce(Column.__and__ if mode == "and" else Column.__or__, [F.col(f"tf{i}") > 0 for i in range(terms)])


def _scored(matched: DataFrame, stats: DataFrame, by: list[str], terms: list[str], scorer: str) -> DataFrame:
    """matched(doc_len, tf0, ...) with score; stats has a row a segment, or one."""
    matched = matched.join(F.broadcast(stats), by) if by else matched.crossJoin(F.broadcast(stats))
    distinct, parts = list(dict.fromkeys(terms)), []
    for t in terms:
        i = distinct.index(t)
        tf, df, n = F.col(f"tf{i}"), F.col(f"df{i}"), F.col("n")
        parts.append(tf_idf(tf, df, n) if scorer == "tfidf" else bm25(tf, df, n, F.col("doc_len"), F.col("total") / n))
    return matched.withColumn("score", reduce(Column.__add__, parts))


@dataclass(frozen=True)
class TermStats:
    """A term in a segment: documents, the most occurrences in one, and the length of the shortest."""

    doc_freq: int
    max_tf: int
    min_len: int


#: Ranges that a list of documents is told in, and bits of a filter of more.
RANGES, FILTER_BITS = 64, 1 << 24


def rarest(words: list[str], found: dict[str, TermStats]) -> str:
    """The term with the fewest documents, of equal ones the first."""
    return min(dict.fromkeys(words), key=lambda t: found[t].doc_freq)


def listed(ids: list[int]) -> Column:
    """A test for a list of doc_id: the list prunes buckets, its ranges prune pages of sorted files."""
    ids = sorted(ids)
    gaps = sorted(range(1, len(ids)), key=lambda i: ids[i - 1] - ids[i])[: RANGES - 1]
    cuts = [0, *sorted(gaps), len(ids)]
    near = " OR ".join(f"doc_id BETWEEN {ids[a]} AND {ids[b - 1]}" for a, b in zip(cuts, cuts[1:]))
    return F.expr(f"doc_id IN ({', '.join(map(str, ids))}) AND ({near})")


def bloom(postings: DataFrame, term: str, doc_freq: int) -> Column:
    """A test that every doc_id with the term passes, and few others: a Bloom filter of two hashes.

    Of about 16 bits a document up to FILTER_BITS; a subquery of the search itself builds it.
    """
    words_of = min(FILTER_BITS, 1 << (16 * doc_freq - 1).bit_length()) // 64
    places = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(words_of * 64)) for i in (1, 2)]
    bits = postings.where(F.col("term") == term).select(F.explode(F.array(*places)).alias("at"))
    bits = bits.select((F.col("at") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("bit"))
    zeros = postings.sparkSession.range(words_of).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bit"))
    by_word = bits.groupBy("word").agg(F.bit_or("bit").alias("bit")).unionByName(zeros).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    one = by_word.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bit"))), lambda x: x["bit"]).alias("bits"))
    filled = one.scalar()  # one row of words_of numbers
    return reduce(Column.__and__, [F.getbit(F.get(filled, (at / 64).cast("int")), (at % 64).cast("int")) == 1 for at in places])


def score_of(words: list[str], scorer: str, found: dict[str, TermStats], n: int, total: int, whole: tuple[int, dict[str, int]]) -> Column:
    """A document's score from its tf0, tf1, ... and doc_len. whole: documents and frequencies over all segments, for TF-IDF."""
    distinct, parts = list(dict.fromkeys(words)), []
    for t in words:
        tf = F.col(f"tf{distinct.index(t)}")
        if scorer == "tfidf":
            parts.append(tf_idf(tf, F.lit(whole[1][t]), F.lit(whole[0])))
        else:
            df = found[t].doc_freq if t in found else 0
            parts.append(bm25(tf, F.lit(df), F.lit(n), F.col("doc_len"), F.lit(total / n if n else 0.0)))
    return reduce(Column.__add__, parts)


def bounded(words: list[str], mode: str, scorer: str, found: dict[str, TermStats], n: int, total: int, whole: tuple[int, dict[str, int]]) -> float:
    """No document of the segment scores more: both rankings grow with tf, and BM25 falls with a document's length."""
    own = [found[t] for t in words if t in found]
    if mode == "phrase":
        return float(min(s.max_tf for s in own))
    out = 0.0
    for t in words:
        if t in found and scorer == "tfidf":
            out += found[t].max_tf * math.log(whole[0] / whole[1][t])
        elif t in found and total:
            s = found[t]
            idf = math.log((n - s.doc_freq + 0.5) / (s.doc_freq + 0.5) + 1.0)
            out += idf * s.max_tf * (K1 + 1.0) / (s.max_tf + K1 * (1.0 - B + B * s.min_len / (total / n)))
    return out


def _moved(positions: Column, offset: int) -> Column:
    return F.transform(positions, lambda x: x - offset)


def search_segment(docs: DataFrame, postings: DataFrame, words: list[str], mode: str, score: Column, found: dict[str, TermStats], keep: Column | None = None) -> DataFrame:
    """(doc_id, path, score) of a segment's matches, from docs(doc_id, path) and postings(term, doc_id, tf, doc_len, positions).

    Both bucketed by doc_id, nothing is shuffled: a document's postings and its path are in the same bucket. A phrase is found by
    intersecting the terms' positions, each moved to the phrase's beginning.
    """
    distinct = list(dict.fromkeys(words))
    own = term_lookup(postings, [t for t in distinct if t in found])
    if keep is not None:
        own, docs = own.where(keep), docs.where(keep)

    def of(t: str, value: str) -> Column:
        return F.max(F.when(F.col("term") == t, F.col(value)))

    if mode == "phrase":
        places = own.groupBy("doc_id").agg(*[of(t, "positions").alias(f"p{i}") for i, t in enumerate(distinct)])
        places = places.where(reduce(Column.__and__, [F.col(f"p{i}").isNotNull() for i in range(len(distinct))]))
        starts = [_moved(F.col(f"p{distinct.index(t)}"), o) for o, t in enumerate(words)]
        matched = places.select("doc_id", F.size(reduce(F.array_intersect, starts)).cast("double").alias("score")).where("score > 0")
    else:
        tf = [F.coalesce(of(t, "tf"), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(distinct)]
        counts = own.groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"), *tf).where(_match(mode, len(distinct)))
        matched = counts.select("doc_id", score.alias("score"))
    return docs.select("doc_id", "path").join(matched.hint("merge"), "doc_id")


def phrase(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """(segment_id, doc_id, score) with score occurrences of the terms at neighbouring positions.

    A token may stand at several offsets of the phrase; each start that all offsets agree on is one occurrence.
    One shuffle for any length.
    """
    offsets: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        offsets.setdefault(t, []).append(i)
    at = F.coalesce(*[F.when(F.col("term") == t, F.array(*map(F.lit, o))) for t, o in offsets.items()])
    hits = tokens.where(F.col("term").isin(*offsets)).select("segment_id", "doc_id", "pos", F.explode(at).alias("o"))
    starts = hits.groupBy("segment_id", "doc_id", (F.col("pos") - F.col("o")).alias("start")).agg(F.count("*").alias("k"))
    whole = starts.where(F.col("k") == len(terms))
    return whole.groupBy("segment_id", "doc_id").agg(F.count("*").cast("double").alias("score"))


def ranked(results: DataFrame) -> list[Column]:
    return [F.desc("score"), F.asc("path"), F.asc("segment_id"), F.asc("doc_id")]


def top_k(results: DataFrame, k: int) -> DataFrame:
    """The k best results."""
    return results.orderBy(*ranked(results)).limit(k)


def top_k_per_segment(results: DataFrame, k: int) -> DataFrame:
    """The k best results of each segment."""
    rank = F.row_number().over(Window.partitionBy("segment_id").orderBy(*ranked(results)))
    return results.withColumn("rank", rank).where(F.col("rank") <= k)


def term_lookup(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Posting lists of the exact terms; the filter reaches the scan of a stored index."""
    return postings.where(F.col("term").isin(*terms))


def contains_doc(postings: DataFrame, term: str, doc_ids: DataFrame) -> DataFrame:
    """Those of doc_ids(doc_id) that have the term."""
    return doc_ids.join(postings.where(F.col("term") == term), "doc_id", "left_semi")


def plan_terms(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(ord, term, doc_freq) of the query's terms, rarest first, absent ones last, ties in query order."""
    spark = postings.sparkSession
    wanted = spark.createDataFrame(list(enumerate(terms)), "at int, term string")
    found = postings.where(F.col("term").isin(*terms)).groupBy("term").agg(F.count("*").alias("doc_freq"))
    joined = F.broadcast(wanted).join(found, "term", "left")  # the terms of one query
    order = Window.orderBy(F.asc_nulls_last("doc_freq"), "at")
    return joined.select(F.row_number().over(order).cast("long").alias("ord"), "term", "doc_freq")
