"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length (norm) into buckets of a fixed ratio, and large buckets into blocks. Queries come in
blocks as well. For a query with a threshold t (a score that k vectors are known to reach), a block whose longest
vector has norm l needs a cosine of at least t / (|q| l):

- above 1: the block is skipped;
- high: coordinate pruning. A unit vector within the cosine of q has each coordinate within known bounds, so the few
  largest coordinates of q sort out most candidates;
- low: length pruning. Vectors shorter than t / |q| are skipped.

All that is left is verified by integer products, so results are exact. First thresholds come from the longest
vectors. Then queries are grouped by the length that a vector needs to reach their threshold, and a group is dealt only
to the blocks that are long enough for it: blocks and groups are numbered so that those are a prefix and a suffix, and
neither queries nor vectors travel to the other pairs. Ties go to the smaller id.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do null ids; shorter
vectors count as ending in zeros; equal vectors are different candidates; an empty table gives no rows. A query's own
rows (the same id) are no candidates. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K, SCALE, EVERY = 5, 256, 50
#: Ratio of the norms within a bucket, rows of a block.
RATIO, BLOCK = 1.1, 4096
#: A vector travels once to each group of queries, so few large groups are best: of so many components (8 MB of
#: integers), and of LEAST queries where vectors are that long.
GROUP_COMPONENTS, LEAST = 1 << 20, 1024
#: Ranges of needed lengths that queries are grouped by.
RANGES = 64
#: From this cosine on coordinates are looked at, and so many of them.
COORDINATE_FROM, COORDINATES = 0.6, 3


def integers(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v array<bigint>, norm) with components floor(scale * x)."""
    x = F.col(vector)
    fine = F.col(id_column).isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    ints = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("bigint"))
    rows = vectors.where(fine).select(F.col(id_column).cast("long").alias("id"), ints.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    return rows.withColumn("norm", norm)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of integer lists as one matrix, shorter ones ending in zeros."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(arr.offsets))
    flat = np.asarray(arr.values)[int(arr.offsets[0].as_py()) if len(arr.offsets) else 0 :]
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat[: int(sizes.sum())]
    return out


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products: in floats while sums stay below 2**53."""
    if not rows.size or not queries.size:
        return np.zeros((len(queries), len(rows)), np.int64)
    width = min(queries.shape[1], rows.shape[1])
    a, b = queries[:, :width], rows[:, :width]
    if float(np.abs(a).max()) * float(np.abs(b).max()) * width < 2**53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def search_block(qid: np.ndarray, q: np.ndarray, limit: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best of a block for each query; those below the query's limit may be left out."""
    out: list[tuple[int, int, int]] = []
    norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((ids, -norms))
    ids, rows, norms = ids[order], rows[order], norms[order]
    lengths = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    longest = float(norms[0]) if len(norms) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(lengths * longest > 0, limit / (lengths * longest), np.where(limit > 0, np.inf, -np.inf)) * (1 - 1e-9)
    width = min(q.shape[1], rows.shape[1])

    def take(i: int, scores: np.ndarray, among: np.ndarray) -> None:
        good = (among != qid[i]) & (scores >= limit[i])
        scores, among = scores[good], among[good]
        if len(scores) > k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            good = scores >= edge
            scores, among = scores[good], among[good]
        best = np.lexsort((among, -scores))[:k]
        out.extend(zip([int(qid[i])] * len(best), among[best].tolist(), scores[best].tolist()))

    by_length = np.flatnonzero(cosine < COORDINATE_FROM)
    for a in range(0, len(by_length), 256):
        part = by_length[a : a + 256]
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(lengths[part] > 0, limit[part] / lengths[part], -np.inf) * (1 - 1e-9)
        ends = np.searchsorted(-norms, -least, side="right")
        scores = _products(q[part], rows[: int(ends.max(initial=0))])
        for j, i in enumerate(part):
            take(int(i), scores[j, : ends[j]], ids[: ends[j]])
    coordinates = np.flatnonzero((cosine >= COORDINATE_FROM) & (cosine <= 1.0))
    unit = rows[:, :width] / np.maximum(norms, 1e-300)[:, None] if len(coordinates) else None
    for i in coordinates:
        c, own = cosine[i], q[i, :width] / lengths[i]
        focus = np.argsort(-np.abs(own))[:COORDINATES]
        spread = np.sqrt(np.maximum(0.0, 1 - own[focus] ** 2) * max(0.0, 1 - c * c)) + 1e-9
        near = np.flatnonzero((np.abs(own[focus]) * c - spread <= np.sign(own[focus]) * unit[:, focus]).all(axis=1))
        take(int(i), _products(q[i : i + 1], rows[near])[0], ids[near])
    return out


def dealt_pairs(blocks: dict[int, tuple[int, int]], longest: dict[int, float], ranges: list[tuple[int, int, float]], lead: set[int]) -> tuple[dict[int, int], dict[int, int], dict[str, int]]:
    """(first group of each bucket, blocks of each range, counts of pairs dealt out and skipped).

    blocks: (first, number) by bucket, in descending order of lengths; ranges: (first group, groups, least needed
    length), in descending order of that.
    """
    groups = sum(n for _, n, _ in ranges)
    first_group, last_block = {}, {}
    for b in blocks:
        first_group[b] = next((g for g, _, need in ranges if need <= longest[b]), groups)
    for i, (_, _, need) in enumerate(ranges):
        last_block[i] = max((f + n for b, (f, n) in blocks.items() if longest[b] >= need), default=0)
    in_lead = {b: sum(f <= x < f + n for x in lead) for b, (f, n) in blocks.items()}
    every = groups * sum(n - in_lead[b] for b, (_, n) in blocks.items())
    dealt = sum((groups - first_group[b]) * (n - in_lead[b]) for b, (_, n) in blocks.items())
    return first_group, last_block, {"dealt": dealt, "skipped": every - dealt}


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE, block: int = BLOCK, query_block: int | None = None, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by `every`.

    query_block: queries of a group, by default as GROUP_COMPONENTS says. report gets the
    numbers of pairs of a group and a block that are dealt out and skipped.
    """
    spark = vectors.sparkSession
    bucket = F.when(F.col("norm") > 0, F.floor(F.log(F.col("norm")) / float(np.log(RATIO)))).otherwise(-1_000_000).cast("long")
    rows = written(integers(vectors, id_column, vector, scale).withColumn("bucket", bucket), "vectors")
    # a row a bucket: norms of doubles give a few thousand at most
    counts = {r["bucket"]: (r["n"], r["m"]) for r in rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("m")).collect()}
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, total = {}, 0
    for b in sorted(counts, reverse=True):
        n = -(-counts[b][0] // block)
        blocks[b] = (total, n)
        total += n
    table = F.broadcast(spark.createDataFrame([(b, s, n) for b, (s, n) in blocks.items()], "bucket long, first long, n long"))
    placed = rows.join(table, "bucket").select("id", "v", "bucket", (F.col("first") + F.pmod(F.xxhash64("id"), "n")).alias("block"))
    is_query = F.pmod("id", F.lit(every)) == 0
    n_queries, widest = rows.agg(F.count_if(is_query), F.max(F.size("v"))).first()
    query_block = query_block or max(LEAST, GROUP_COMPONENTS // max(1, widest or 1))
    groups = max(1, -(-n_queries // query_block))
    queries = rows.where(is_query).select("id", "v", "norm")
    lead, seen = [], 0  # blocks of the longest vectors that give first thresholds
    for b in sorted(counts, reverse=True):
        lead += range(blocks[b][0], blocks[b][0] + min(2, blocks[b][1]))
        seen += counts[b][0]
        if seen >= 16 * k:  # of the buckets before, each has less than this: few rows in all
            break
    found = "query_id long, vec_id long, score long"

    def searched(left: DataFrame, right: DataFrame) -> DataFrame:
        """Queries (group, block, id, v, at_least) and vectors (group, block, id, v) of the same group and block."""
        left = left.select("group", "block", "id", "v", "at_least", F.lit(True).alias("is_query"))
        right = right.select("group", "block", "id", "v", F.lit(None).cast("long").alias("at_least"), F.lit(False).alias("is_query"))

        def run(key: tuple, both: pa.Table) -> pa.Table:
            mask = both.column("is_query")
            own, others = both.filter(mask), both.filter(pc.invert(mask))
            triples: list = []
            if own.num_rows and others.num_rows:
                limit = np.array([-np.inf if x is None else x for x in own.column("at_least").to_pylist()], np.float64)
                triples = search_block(np.asarray(own.column("id")), _matrix(own.column("v")), limit, np.asarray(others.column("id")), _matrix(others.column("v")), k)
            columns = list(zip(*triples)) or [(), (), ()]
            return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

        return left.unionByName(right).groupBy("group", "block").applyInArrow(run, found)

    def best(hits: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)

    def numbers(a: int, b: int) -> Column:
        return F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long"))

    first = queries.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups))).withColumn("block", F.explode(F.array(*[F.lit(b).cast("long") for b in lead])))
    leaders = placed.where(F.col("block").isin(lead)).withColumn("group", F.explode(numbers(0, groups - 1)))
    led = written(best(searched(first.withColumn("at_least", F.lit(None).cast("long")), leaders)), "lead")
    hits = led.select("query_id", "vec_id", "score")
    if total == len(lead):
        return best(hits).select("query_id", "rank", "vec_id", "score")
    limits = led.groupBy("query_id").agg(F.min("score").alias("at_least"), F.count("*").alias("n")).where(F.col("n") == k)
    known = queries.join(limits.select(F.col("query_id").alias("id"), "at_least"), "id", "left")
    # the length that a vector needs; without a threshold above 0 any will do
    need = F.when((F.col("at_least") > 0) & (F.col("norm") > 0), F.col("at_least") / F.col("norm") * (1 - 1e-9)).otherwise(0.0)
    known = known.withColumn("need", need)
    parts = min(groups, RANGES)
    cuts = sorted(set(known.agg(F.percentile_approx("need", [i / parts for i in range(1, parts)] or [0.5], 1000)).first()[0] if parts > 1 else []), reverse=True)
    known = known.withColumn("range", sum((F.lit(c) > F.col("need")).cast("int") for c in cuts) if cuts else F.lit(0))
    per_range = known.groupBy("range").agg(F.count("*").alias("n"), F.min("need").alias("need")).orderBy("range").collect()  # RANGES rows at most
    ranges, names, at = [], [], 0
    for r in per_range:
        n = -(-r["n"] // query_block)
        ranges.append((at, n, r["need"]))
        names.append(r["range"])
        at += n
    first_group, last_block, counted = dealt_pairs(blocks, {b: m for b, (_, m) in counts.items()}, ranges, set(lead))
    if report is not None:
        report.update(counted)
    dealt = [(names[i], f, n, last_block[i]) for i, (f, n, _) in enumerate(ranges) if last_block[i]]
    wanted = [(b, g) for b, g in first_group.items() if g < at]
    if not dealt or not wanted:
        return best(hits).select("query_id", "rank", "vec_id", "score")
    of_range = F.broadcast(spark.createDataFrame(dealt, "range int, f long, n long, last long"))
    of_bucket = F.broadcast(spark.createDataFrame(wanted, "bucket long, g long"))
    left = known.join(of_range, "range").withColumn("group", F.col("f") + F.pmod(F.xxhash64("id"), "n"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - 1))).where(~F.col("block").isin(lead))
    right = placed.where(~F.col("block").isin(lead)).join(of_bucket, "bucket").withColumn("group", F.explode(F.sequence("g", F.lit(at - 1).cast("long"))))
    hits = hits.unionByName(searched(left, right))
    return best(hits).select("query_id", "rank", "vec_id", "score")
