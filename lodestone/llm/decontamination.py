"""Documents that hold benchmark items, found by SimHash of item-sized windows. DataFrame functions only.

1. Texts become lower-case words and hashes of WIDTH words (shingles). A window that is as similar to an item as asked
   shares a shingle with it, so windows are laid where a document's shingle is one of an item's: as long as the item,
   with that shingle in the item's place or at the window's start, and moved into the text where they would stick out.
2. Each window's shingles make a 64-bit SimHash. Fingerprints are cut into RADIUS + 1 blocks; two of at most RADIUS
   different bits agree in a block. At this radius blocks are of 2 or 3 bits and sort out little, so the index is by
   item shingle and block: a window that is similar enough lacks at most a known share of an item's shingles, hence has
   one of as many and one more, chosen as those that the fewest items have. An equi-join on (item size, such a shingle,
   block, value) finds all pairs within the radius that can be similar.
3. Candidates within the radius are verified: the weighted Jaccard similarity of shingles, weights being how often a
   shingle stands in the window and in the item.

Items shorter than WIDTH words have one shingle of all their words and are held against windows of as many words.

Item shingles and ids of documents with a hit are broadcast while their counted number is under a bound; else they are
joined by shuffles that split hot keys. No window or pair depends on how many documents share an item.

Defined cases: null or empty texts and items match nothing; null ids take no part and are never dropped; repeated
rows of a document id are one document; an empty benchmark drops nothing; extra columns are passed through by clean().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, written

WIDTH, PERCENT, RADIUS = 5, 80, 23
#: Rows that may be broadcast: item shingles, and ids of documents (8 to 24 bytes a row).
BROADCAST_ROWS = 500_000
_BLANKS = r"[ \t\n\x0B\f\r]+"
#: Sizes in bits of the blocks: 16 of three and 8 of two.
_BLOCKS = [3] * 16 + [2] * 8


def _words(text: str) -> str:
    return f"filter(split(lower({text}), '{_BLANKS}'), w -> w <> '')".replace("\\", "\\\\")


def _shingles(words: str, width: int) -> str:
    """SQL for the array of shingle hashes of a word array; empty for fewer words than the width."""
    return f"CASE WHEN size({words}) >= {width} THEN transform(sequence(1, size({words}) - {width - 1}), i -> xxhash64(slice({words}, i, {width}))) ELSE CAST(array() AS array<bigint>) END"


_SIMHASH = """aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(CAST(2 * aggregate(h, 0L, (s, x) -> s + (shiftright(x, b) & 1L)) > size(h) AS bigint), b))"""


def _fingerprint_blocks() -> list:
    out, at = [], 0
    for i, bits in enumerate(_BLOCKS):
        value = F.shiftright("fp", at).bitwiseAND(F.lit((1 << bits) - 1))
        out.append(F.struct(F.lit(i).alias("block"), value.alias("value")))
        at += bits
    return out


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def items_of(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, width, h): shingles of each item with a word; shorter items have their own width."""
    words = benchmark.where("item_id IS NOT NULL").select("item_id", F.expr(_words("text")).alias("w")).where("size(w) > 0")
    words = words.withColumn("width", F.least(F.size("w"), F.lit(width)))
    hashes = F.expr("transform(sequence(1, size(w) - width + 1), i -> xxhash64(slice(w, i, width)))")
    return words.select("item_id", "width", hashes.alias("h"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, start, similarity): the best window of each document and item, start counted in words."""
    items = written(items_of(benchmark, width), "items", 0)
    widths = [r["width"] for r in items.select("width").distinct().collect()]  # at most `width` of them
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").alias("t"))
    found = [_of_width(texts, items.where(F.col("width") == w), w, percent) for w in sorted(widths)]
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start int, similarity double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _of_width(texts: DataFrame, items: DataFrame, width: int, percent: int) -> DataFrame:
    grams = items.select("item_id", F.size("h").alias("m"), F.posexplode("h").alias("q", "x"))
    n_grams = grams.count()
    hashed = texts.select("doc_id", F.expr(_words("t")).alias("w")).select("doc_id", F.expr(_shingles("w", width)).alias("h"))
    # outer, as Spark pushes the filter of an inner one below the projections and then splits the text per shingle
    exploded = hashed.select("doc_id", F.size("h").alias("n"), F.posexplode_outer("h").alias("p", "x")).where("x IS NOT NULL")
    # a shingle's places in items, each once for the size of the item: windows don't depend on the item
    spots = grams.select("x", "m", "q").distinct()
    # written, as three kinds of windows are laid from it: texts are split once
    hits = written(exploded.join(_maybe_broadcast(spots, n_grams), "x").select("doc_id", "n", "m", "p", "q"), "hits")
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("n") - F.col("m")))
    in_place = hits.select("doc_id", "m", start.alias("start"))
    # a window may be moved right to its first shared shingle, or to the text's end: none is lost, whatever the order of
    # the item's parts; it needs as many hits as the similarity has common shingles
    places = hits.groupBy("doc_id", "n", "m").agg(F.sort_array(F.collect_set("p")).alias("at"))
    need = F.expr(f"CAST(ceil({percent} * (least(n, m) + m) / {100 + percent}) AS int)")
    places = places.withColumn("need", need).where("size(at) >= need").withColumn("end", F.greatest(F.lit(0), F.col("n") - F.col("m")))
    moved = places.select("doc_id", "m", "at", "need", "end", F.posexplode("at").alias("i", "p"))
    moved = moved.where("p < end AND i + need <= size(at)").where("get(at, i + need - 1) < p + m").select("doc_id", "m", F.col("p").alias("start"))
    last = places.where("size(filter(at, x -> x >= end)) >= need").select("doc_id", "m", F.col("end").alias("start"))
    windows = written(in_place.unionByName(moved).unionByName(last).distinct(), "windows")
    ids = windows.select("doc_id").distinct()
    again = texts.join(_maybe_broadcast(ids, ids.count()), "doc_id", "left_semi")
    again = again.select("doc_id", F.expr(_words("t")).alias("w")).select("doc_id", F.expr(_shingles("w", width)).alias("h"))
    laid = again.join(windows, "doc_id").select("doc_id", "m", "start", F.expr("slice(h, start + 1, m)").alias("h"))
    laid = written(laid.withColumn("fp", F.expr(_SIMHASH)), "fingerprints")
    pairs = candidates(laid, items, percent)
    bag = laid.join(pairs, ["doc_id", "m", "start"]).select("doc_id", "item_id", "m", "start", F.size("h").alias("k"), F.explode("h").alias("x"))
    bag = bag.groupBy("doc_id", "item_id", "m", "start", "k", "x").agg(F.count("*").alias("in_window"))
    in_item = grams.groupBy("item_id", "x").agg(F.count("*").alias("in_item"))
    common = bag.join(_maybe_broadcast(in_item, n_grams), ["item_id", "x"])
    common = common.groupBy("doc_id", "item_id", "m", "start", "k").agg(F.sum(F.least("in_window", "in_item")).alias("c"))
    union = F.col("k") + F.col("m") - F.col("c")
    good = common.where(100 * F.col("c") >= percent * union).withColumn("similarity", F.col("c") / union)
    best = F.max_by("start", F.struct("similarity", -F.col("start"))).alias("start")
    return good.groupBy("doc_id", "item_id").agg(best, F.max("similarity").alias("similarity"))


def rare_shingles(items: DataFrame, percent: int) -> DataFrame:
    """(item_id, m, x): shingles of items(item_id, h) of which a window that is similar enough has at least one.

    Of an item's m shingles, repeats included, such a window has percent at least, be it shorter than the item or not.
    """
    grams = items.select("item_id", F.size("h").alias("m"), F.posexplode("h").alias("q", "x"))
    items_with = grams.groupBy("x").agg(F.countDistinct("item_id").alias("items"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("items", "x", "q"))
    ranked = grams.join(items_with, "x").withColumn("rank", rank)
    most = F.floor(F.col("m") * (100 - percent) / 100) + 1
    return ranked.where(F.col("rank") <= most).select("item_id", "m", "x").distinct()


def candidates(laid: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """(doc_id, m, start, item_id): pairs of windows(doc_id, m, start, h, fp) and items that the index doesn't sort out."""
    rare = rare_shingles(items, percent)
    own = items.select("item_id", F.size("h").alias("m"), F.expr(_SIMHASH).alias("fp")).join(rare, ["item_id", "m"])
    blocks, n = F.array(*_fingerprint_blocks()), rare.count()
    marks = _maybe_broadcast(rare.select("m", "x").distinct(), n)
    left = laid.select("doc_id", "m", "start", "fp", F.explode(F.array_distinct("h")).alias("x")).join(marks, ["m", "x"])
    left = left.select("doc_id", "m", "start", "x", "fp", F.inline(blocks))
    right = own.select("item_id", "m", "x", F.col("fp").alias("item_fp"), F.inline(blocks))
    different = F.col("fp").bitwiseXOR(F.col("item_fp"))
    pairs = left.join(_maybe_broadcast(right, n * len(_BLOCKS)), ["m", "x", "block", "value"]).where(F.bit_count(different) <= RADIUS)
    return pairs.select("doc_id", "m", "start", "item_id").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs without those that hold an item; all columns stay."""
    bad = contaminated(docs.select("doc_id", "text"), benchmark, width, percent).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*quoted(docs.columns))
