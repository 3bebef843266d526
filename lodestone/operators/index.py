"""The inverted index: tokens, postings, statistics and segments.

Frames: docs(segment_id, doc_id, path, text), tokens(segment_id, doc_id, term, pos),
postings(segment_id, term, doc_id, positions array<bigint>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import gap_encode, varint_length
from ..functions.text import marked, normalize, raw_tokens, unmarked

#: Rows of a piece of number_rows(), and the most pieces, whose splits are on the driver.
PIECE_ROWS, MOST_PIECES = 1_000_000, 2_000
#: Numbers of documents that a term's gaps are worked on together.
RANGE_ROWS = 1 << 20
#: Bytes of text whose postings a task sorts by term: some ten times that in its memory.
TERM_BYTES = 16 << 20
#: A term's ids that differ in these low bits only are one list where postings are dealt by term: 1024 ids at most.
LIST_BITS = 10


def deal(docs: DataFrame) -> DataFrame:
    """docs dealt out by (segment_id, doc_id), so that groups of a document or of a posting need no shuffle of tokens.

    One shuffle of the texts instead; it also spreads a source of few splits over all cores.
    """
    return docs.repartition("segment_id", "doc_id")


def spread(docs: DataFrame) -> DataFrame:
    """docs as they are, or dealt out if their source has fewer splits than there are cores."""
    few = docs.rdd.getNumPartitions() < docs.sparkSession.sparkContext.defaultParallelism
    return deal(docs) if few else docs


def tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs but the text, and (term, pos) of each token that has a letter or digit.

    pos counts white-space-separated words from 0, those without a term included.
    """
    rest = [c for c in docs.columns if c not in (text, "term", "pos")]
    words = docs.select(*rest, F.posexplode(raw_tokens(F.col(text))).alias("pos", "raw"))
    return words.select(*rest, normalize(F.col("raw")).alias("term"), F.col("pos").cast("long").alias("pos")).where("term <> ''")


def postings(tokens: DataFrame) -> DataFrame:
    """Ascending positions of each (segment_id, term, doc_id). Tokens of dealt documents aren't shuffled."""
    positions = F.array_sort(F.collect_list("pos")).alias("positions")
    return tokens.groupBy("segment_id", "term", "doc_id").agg(positions)


def text_postings(docs: DataFrame, text: str = "text", buckets: int | None = None, blocks: int | None = None) -> DataFrame:
    """postings() of docs(segment_id, doc_id, text), with tf and doc_len, made within each document: no token is shuffled or sorted with others'.

    Texts are shuffled once, as rows of one (segment_id, doc_id) are one document. A document's tokens sorted by term and position
    are runs of one term; a run is a posting. buckets: deal by doc_id to so many, as a bucketed table of one segment wants it.
    blocks: deal to so many tasks by (segment_id, _block), the high bits of doc_id, and give _block, too.
    """
    key, found = ["segment_id", "doc_id"], docs.select("segment_id", "doc_id", text)
    if blocks:
        key, found = ["segment_id", "_block", "doc_id"], found.withColumn("_block", F.shiftright(F.col("doc_id").cast("long"), LIST_BITS))
        dealt = found.repartition(blocks, "segment_id", "_block")
    else:
        dealt = found.repartition(buckets, "doc_id") if buckets else deal(found)
    one = dealt.groupBy(*key).agg(F.collect_list(text).alias("_texts"))

    def own(t: Column) -> Column:
        found = F.transform(raw_tokens(marked(t)), lambda raw, i: F.struct(unmarked(raw).alias("term"), i.cast("long").alias("pos")))
        return F.filter(found, lambda w: w["term"] != "")

    rows = one.select(*key, F.sort_array(F.flatten(F.transform("_texts", own))).alias("_s"))
    term = lambda i: F.get("_s", i)["term"]
    first = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (term(i) != term(i - 1)))
    rows = rows.select(*key, "_s", F.size("_s").cast("long").alias("doc_len"), F.when(F.size("_s") > 0, first).alias("_first"))

    def run(a: Column, j: Column) -> Column:
        n = F.coalesce(F.get("_first", j + 1), F.size("_s")) - a
        return F.struct(term(a).alias("term"), n.cast("long").alias("tf"), F.transform(F.slice("_s", a + 1, n), lambda w: w["pos"]).alias("positions"))

    # exploded where they are made: of a column, Spark would test the size by making all of it again for each token. The rows don't carry _s
    rows = rows.select(*key, "doc_len", F.explode(F.transform("_first", run)).alias("_p"))
    return rows.select("segment_id", "_p.term", "doc_id", "_p.positions", "_p.tf", "doc_len", *key[1:-1])


def document_frequency(postings: DataFrame) -> DataFrame:
    """doc_freq of each term of each segment."""
    return postings.groupBy("segment_id", "term").agg(F.count("*").alias("doc_freq"))


def doc_lengths(tokens: DataFrame) -> DataFrame:
    """doc_len of each document with a token; others have no row."""
    return tokens.groupBy("segment_id", "doc_id").agg(F.count("*").alias("doc_len"))


def index_stats(postings: DataFrame) -> DataFrame:
    """One row: terms, postings and positions over all segments together."""
    by_term = postings.groupBy("term").agg(F.count("*").alias("p"), F.sum(F.size("positions")).alias("n"))
    zero = F.lit(0).cast("long")
    return by_term.agg(
        F.count("*").alias("terms"),
        F.coalesce(F.sum("p"), zero).alias("postings"),
        F.coalesce(F.sum("n"), zero).alias("positions"),
    )


def segment_meta(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """doc_count, term_count, posting_count, position_count and avg_doc_len of each segment.

    Documents without tokens count as documents. One shuffle of the tokens: per posting first. text_meta() has none.
    """
    return _meta(docs, tokens.groupBy("segment_id", "term", "doc_id").agg(F.count("*").alias("n")))


def text_meta(docs: DataFrame, text: str = "text") -> DataFrame:
    """segment_meta() of docs(segment_id, doc_id, text): a segment's terms are shuffled, summed within tasks, and no tokens."""
    return _meta(docs, text_postings(docs, text).select("segment_id", "term", F.col("tf").alias("n")))


def _meta(docs: DataFrame, per_posting: DataFrame) -> DataFrame:
    per_term = per_posting.groupBy("segment_id", "term").agg(F.count("*").alias("p"), F.sum("n").alias("n"))
    counts = per_term.groupBy("segment_id").agg(
        F.count("*").alias("term_count"), F.sum("p").alias("posting_count"), F.sum("n").alias("position_count")
    )
    sizes = docs.groupBy("segment_id").agg(F.count("*").alias("doc_count"))
    joined = sizes.join(counts, "segment_id", "left").na.fill(0, ["term_count", "posting_count", "position_count"])
    return joined.withColumn("avg_doc_len", F.col("position_count") / F.col("doc_count"))


def inspect_segments(meta: DataFrame) -> DataFrame:
    """The counts of each segment and a total row; a term in two segments counts twice."""
    names = ["doc_count", "term_count", "posting_count", "position_count"]
    rolled = meta.rollup("segment_id").agg(*[F.sum(n).alias(n) for n in names], F.grouping("segment_id").alias("g"))
    total = F.when(F.col("g") == 1, "total").otherwise(F.col("segment_id"))
    return rolled.select(total.alias("segment_id"), *names)


def _ranges(order_by: str, within: int) -> Column:
    """Never null: a join would look for nulls on one side below its shuffle, which then couldn't be used for both sides."""
    return F.coalesce(F.floor(F.col(order_by) / within), F.lit(-1 << 62))


def term_ranges(docs: DataFrame) -> int | None:
    """within for the functions below: none for up to RANGE_ROWS documents, as a term has no more rows than there are documents."""
    return None if docs.count() <= RANGE_ROWS else RANGE_ROWS


def term_tasks(docs: DataFrame, text: str = "text") -> int:
    """As many tasks as the texts need, whatever shuffles are dealt into."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TERM_BYTES))


def by_term(postings: DataFrame, docs: DataFrame, text: str = "text", within: int | None = None) -> DataFrame:
    """postings dealt out by (segment_id, term), within: and _range of doc_id, to term_tasks().

    Windows and groups of a segment's term, or of its ranges, then need no other shuffle.
    """
    if within:
        postings = postings.withColumn("_range", _ranges("doc_id", within))
    return postings.repartition(term_tasks(docs, text), "segment_id", "term", *(["_range"] if within else []))


def ids_by_term(docs: DataFrame, text: str = "text", within: int | None = None) -> DataFrame:
    """by_term() of docs' postings without positions: a list of at most 2^LIST_BITS neighbouring ids is shuffled, not a row an id.

    Texts are dealt by blocks of ids, so a block's lists are made where its postings are. An id in a list is its low bits.
    """
    n, size = term_tasks(docs, text), 1 << LIST_BITS
    posts = text_postings(docs, text, blocks=n)
    low = F.col("doc_id").cast("long").bitwiseAND(F.lit(size - 1)).cast("short")
    lists = posts.groupBy("segment_id", "_block", "term").agg(F.collect_list(low).alias("_ids"))  # a block's ids of a term
    by = ["segment_id", "term"]
    if within:
        by, lists = [*by, "_range"], lists.withColumn("_range", _ranges("_block", max(1, within // size)))
    # a row without an id stays one
    rows = lists.repartition(n, *by).select(*by, "_block", F.explode_outer("_ids").alias("_low"))
    return rows.select(*by, (F.shiftleft("_block", LIST_BITS) + F.col("_low")).alias("doc_id"))


def _before(rows: DataFrame, order_by: str, value: Column, last: bool, within: int | None) -> DataFrame:
    """rows with before: over the rows of a segment's term that come earlier, the last value or the sum of values.

    A term of all documents isn't one task's: rows are worked on in ranges of `within` numbers of order_by, and what a range leaves is
    carried to the next ones over one row a range. order_by is unique within a term. Without ranges a term is a task's: one pass.
    Rows that were dealt by _range have it and keep it; only the rows of ranges are shuffled then.
    """
    key = ["segment_id", "term"]
    if within is None:
        whole = Window.partitionBy(*key).orderBy(order_by)
        found = F.lag(value).over(whole) if last else F.sum(value).over(whole.rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("before", F.coalesce(found, F.lit(0).cast("long")))
    ranged = "_range" in rows.columns
    rows = (rows if ranged else rows.withColumn("_range", _ranges(order_by, within))).withColumn("_value", value)
    inside = Window.partitionBy(*key, "_range").orderBy(order_by)
    total = F.max_by("_value", order_by) if last else F.sum("_value")
    per = rows.groupBy(*key, "_range").agg(total.alias("_total"))
    ahead = Window.partitionBy(*key).orderBy("_range")
    if last:
        own, carried = F.lag("_value").over(inside), F.lag("_total").over(ahead)
    else:
        earlier = (Window.unboundedPreceding, -1)
        own, carried = F.sum("_value").over(inside.rowsBetween(*earlier)), F.sum("_total").over(ahead.rowsBetween(*earlier))
    per = per.select(*key, "_range", carried.alias("_carried"))
    joined = rows.withColumn("_own", own).join(per, [*key, "_range"])
    zero = F.lit(0).cast("long")
    before = F.coalesce("_own", "_carried", zero) if last else F.coalesce("_own", zero) + F.coalesce("_carried", zero)
    return joined.withColumn("before", before).drop("_value", "_own", "_carried", *([] if ranged else ["_range"]))


def _dealt(rows: DataFrame) -> list[str]:
    return [c for c in ("segment_id", "term", "_range") if c in rows.columns]


def own_size(positions: Column) -> Column:
    """Bytes of a posting's count and gaps of positions."""
    gaps = F.aggregate(gap_encode(positions), F.lit(0).cast("long"), lambda a, x: a + varint_length(x))
    return varint_length(F.size(positions).cast("long")) + gaps


def postings_size(postings: DataFrame, within: int | None = RANGE_ROWS) -> DataFrame:
    """Bytes of each term's varint-coded posting list: gaps of ids, counts and gaps of positions.

    postings with positions, or with own in their place, their own_size(): positions needn't be shuffled.
    """
    if "own" not in postings.columns:
        postings = postings.select(*_dealt(postings), "doc_id", own_size(F.col("positions")).alias("own"))
    rows = _before(postings, "doc_id", F.col("doc_id"), True, within)
    size = varint_length(F.col("doc_id") - F.col("before")) + F.col("own")
    sized = rows.select("segment_id", "term", size.alias("bytes")).groupBy("segment_id", "term")
    return sized.agg((F.sum("bytes") + varint_length(F.count("*"))).alias("bytes"))


def number_rows(rows: DataFrame, by: str, name: str = "doc_id", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Number rows from 1 in the order of a string column, without sorting all of them in one task.

    The range is cut at quantiles into as many pieces as the counted rows need; rows are numbered within a piece, after
    the counts of the pieces before. Equal values get any order; nulls come first.
    """
    counted = rows.where(F.col(by).isNotNull()).agg(F.count("*").alias("n")).first().n
    pieces = min(MOST_PIECES, -(-counted // piece_rows))
    cuts: list[str] = []
    if pieces > 1:  # a sample of 16 values a piece, by hash
        share = F.pmod(F.xxhash64(by), F.lit(counted)) < 16 * pieces
        found = sorted({r.v for r in rows.where(share).select(F.col(by).alias("v")).distinct().limit(64 * pieces).collect()})
        cuts = found[:: max(1, len(found) // pieces)][1:]
    rows = rows.withColumn("_piece", F.when(F.col(by).isNull(), -1).otherwise(_piece_of(F.col(by), cuts, 0)))
    before = rows.groupBy("_piece").agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = before.select("_piece", start.alias("_start"))  # a row a piece
    rank = F.row_number().over(Window.partitionBy("_piece").orderBy(by))
    numbered = rows.withColumn("_rank", rank).join(F.broadcast(before), "_piece")
    return numbered.withColumn(name, F.col("_start") + F.col("_rank")).drop("_piece", "_start", "_rank")


def _piece_of(value: Column, cuts: list[str], first: int) -> Column:
    """How many cuts are not above a value, as nested tests."""
    if not cuts:
        return F.lit(first)
    m = len(cuts) // 2
    return F.when(value < cuts[m], _piece_of(value, cuts[:m], first)).otherwise(_piece_of(value, cuts[m + 1 :], first + m + 1))


def gap_rows(postings: DataFrame, within: int | None = RANGE_ROWS) -> DataFrame:
    """(segment_id, term, doc_id, gap): gaps of the ids of a term, a row each, so that no list of a common term is built."""
    rows = _before(postings.select(*_dealt(postings), "doc_id"), "doc_id", F.col("doc_id"), True, within)
    return rows.select(*_dealt(rows), "doc_id", (F.col("doc_id") - F.col("before")).alias("gap"))


def ungap_rows(gaps: DataFrame, order_by: str = "ord", within: int | None = RANGE_ROWS) -> DataFrame:
    """(segment_id, term, doc_id) from gaps(segment_id, term, ord, gap): running sums, the inverse of gap_rows()."""
    rows = _before(gaps.select(*_dealt(gaps), order_by, "gap"), order_by, F.col("gap"), False, within)
    return rows.select("segment_id", "term", (F.col("before") + F.col("gap")).alias("doc_id"))


def incremental_new_docs(docs: DataFrame, indexed: DataFrame) -> DataFrame:
    """Documents whose path is not indexed yet; changes and deletions are not looked for."""
    return docs.join(indexed.select("path"), "path", "left_anti")


def visible(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of the segments that the manifest lists."""
    return rows.join(manifest.select("segment_id"), "segment_id", "left_semi")


def merge_segments(manifest: DataFrame, docs: DataFrame, postings: DataFrame, new_id: str) -> tuple[DataFrame, DataFrame]:
    """One segment from those of manifest(ord, segment_id): a document's id moves by the largest ids before.

    Each document keeps its own path and postings; a path in two segments stays two documents.
    """
    largest = docs.groupBy("segment_id").agg(F.max("doc_id").alias("m"))
    ahead = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    shift = manifest.join(largest, "segment_id", "left").select(
        "segment_id", F.coalesce(F.sum(F.coalesce("m", F.lit(0))).over(ahead), F.lit(0)).alias("shift")
    )

    def moved(rows: DataFrame) -> DataFrame:  # shift: a row a segment of the manifest
        rows = rows.join(F.broadcast(shift), "segment_id").withColumn("doc_id", F.col("doc_id") + F.col("shift"))
        return rows.withColumn("segment_id", F.lit(new_id)).drop("shift")

    return moved(docs), moved(postings)
