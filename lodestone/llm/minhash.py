"""Near-duplicate documents by a chosen-path set similarity join.

Texts become sets of word shingles; texts of equal sets are one class from then on. A class is embedded as SIZE
minwise tokens. Independent trees branch classes recursively: a node chooses BRANCHES of the tokens' places, and its
classes go to one child for each chosen place and their token there. Similar sets agree at a chosen place as often as
they are similar, so a pair of similarity 0.8 stays together somewhere in a tree with probability over 0.93, whatever
the depth, and in at least one of TREES trees almost surely; common tokens alone keep nothing together for long.

A node of up to LEAF classes is compared exhaustively by its tokens. A larger one is branched again, unless it barely
shrank: then it is a cluster of similar texts, which is dealt out in blocks, each with the same few pivots. Each
comparison yields a spanning forest, never all pairs. What a cluster's forest leaves apart is then compared with every
block of it, so that no link depends on how rows were dealt out.

Linked tokens give coarse groups, and each class's full set goes once to its group. There similarities are exact:
intersections by an inverted index, linking by union and find, blocks and pivots for large groups as before. The
components of the exact links are the result.

Defined cases: a null or word-free text has an empty set and is linked with nothing; one with fewer words than a
shingle has a single shingle of them all; null ids take no part (component null, kept); rows of one id are one node;
ties go to the smaller id; other columns are not read, and keep_one() passes them through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, id_filter, passes, quoted, runs, small_batches, written
from .shingles import batch_sets, mix

WORDS, PERCENT = 5, 80
SIZE, TREES, BRANCHES, DEPTH = 64, 4, 2, 12
LEAF, BLOCK, PIVOTS = 512, 2048, 32
#: Shingles in a block of full sets.
BLOCK_SHINGLES = 4_000_000
#: A child with this share of its node is a cluster.
DENSE = 0.65
#: Equal tokens (of SIZE) for a candidate: pairs of similarity 0.8 miss this with a probability of about 3e-6.
AGREE = 36
SEED = 11


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 1 << 63, SIZE, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, SIZE, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest of SIZE hashes over a set, 32 bits each."""
    a, b = _parameters()
    out = np.full(SIZE, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        x = shingles[at : at + 4096]
        out = np.minimum(out, ((x[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).min(axis=1))
    return out.astype(np.uint32)


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n, key, sig): size, digest and minwise tokens of each text's set; empty key and sig for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sizes, keys, sigs = [], [], []
            for s in batch_sets(batch.column(1).to_pylist(), words):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"")
                sigs.append(signature(s).tobytes() if len(s) else b"")
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "key", "sig"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, key binary, sig binary")


def _bytes_matrix(column, width: int) -> np.ndarray:
    """Binary values of one width as a matrix."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(arr):
        return np.zeros((0, width), np.uint8)
    first = int(np.frombuffer(arr.buffers()[1], np.int32)[arr.offset])
    return np.frombuffer(arr.buffers()[2], np.uint8)[first : first + len(arr) * width].reshape(len(arr), width)


NODE = "g long, id long, parent_n long, token binary"


def first_nodes(classes: DataFrame) -> DataFrame:
    """The children of the roots: TREES x BRANCHES nodes of each class(id, sig), with one byte a token from then on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _bytes_matrix(batch.column(1), 4 * SIZE).view(np.uint32)
            token = pa.array([t.tobytes() for t in sig.astype(np.uint8)], pa.binary())
            none = pa.array(np.zeros(len(sig), np.int64))
            for place in range(TREES * BRANCHES):
                with np.errstate(over="ignore"):
                    g = mix(np.uint64(place + 1) * np.uint64(0x9E3779B97F4A7C15) + mix(sig[:, place].astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), batch.column(0), none, token], ["g", "id", "parent_n", "token"])

    return classes.select("id", "sig").mapInArrow(run, NODE)


def next_nodes(rows: DataFrame) -> DataFrame:
    """Children of branched nodes (g, id, n, token): the places depend on the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = np.asarray(batch.column(0)).view(np.uint64)
            token = _bytes_matrix(batch.column(3), SIZE)
            with np.errstate(over="ignore"):
                seed = mix(g + np.uint64(0xA24BAED4963EE407))
                start, step = seed % np.uint64(SIZE), (seed >> np.uint64(32)) % np.uint64(SIZE - 1) + np.uint64(1)
                for j in range(BRANCHES):
                    place = ((start + np.uint64(j) * step) % np.uint64(SIZE)).astype(np.int64)
                    value = token[np.arange(len(g)), place].astype(np.uint64)
                    child = mix(g * np.uint64(0x2545F4914F6CDD1D) + place.astype(np.uint64) * np.uint64(256) + value + np.uint64(1))
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1), batch.column(2), batch.column(3)], ["g", "id", "parent_n", "token"])

    return rows.select("g", "id", "n", "token").mapInArrow(run, NODE)


# --- comparing within a block --------------------------------------------------------------------------------------


class _Forest:
    """Union and find over places; the smallest place of a set stands for it."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _merge(label: np.ndarray, i: int, hit: np.ndarray) -> list[int]:
    """Join the sets of rows `hit` to row i's; gives one row of each set that was another."""
    labels, first = np.unique(label[hit], return_index=True)
    first = first[labels != label[i]]
    if len(first):
        label[np.isin(label, labels)] = label[i]
    return hit[first].tolist()


def token_links(ids: np.ndarray, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of candidate pairs of each group; groups begin at starts."""
    n = len(ids)
    sizes = np.diff(np.append(starts, n))
    forest, out = _Forest(n), []
    small = np.repeat(sizes <= 32, sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows to the end of the group, itself included
    rows = np.flatnonzero(small & (left > 1))
    k = 1
    while len(rows):
        hit = rows[(tokens[rows] == tokens[rows + k]).sum(axis=1) >= AGREE]
        out += [(i, i + k) for i in hit.tolist() if forest.union(i, i + k)]
        k += 1
        rows = rows[left[rows] > k]
    for s, m in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
        label, own = np.arange(m), tokens[s : s + m]
        for i in range(m - 1):
            rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            hit = rest[(own[rest] == own[i]).sum(axis=1) >= AGREE]
            out += [(s + i, s + j) for j in _merge(label, i, hit)]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return ids[pairs[:, 0]], ids[pairs[:, 1]]


def exact_links(ids: np.ndarray, tokens: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the exact links of one group: rows meet through an inverted index of their shingles."""
    m = len(ids)
    sizes = np.array([len(s) for s in sets])
    label, out = np.arange(m), []
    owner = np.repeat(np.arange(m), sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    begin = np.searchsorted(shingle[order], np.arange(shingle.max() + 2))
    by_shingle, edge = owner[order], np.append(0, np.cumsum(sizes))
    for i in range(m - 1):
        near = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        near = near[(tokens[near] == tokens[i]).sum(axis=1) >= AGREE]
        if not len(near):
            continue
        own = shingle[edge[i] : edge[i + 1]]
        if len(near) <= 4:
            common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in near])
        else:
            counts, first = begin[own + 1] - begin[own], begin[own]
            at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            common = np.bincount(by_shingle[at], minlength=m)[near]
        hit = near[100 * common >= percent * (sizes[i] + sizes[near] - common)]
        out += [(int(ids[i]), int(ids[j])) for j in _merge(label, i, hit)]
    return out


def _edge_batch(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def compare_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, id, token) sorted by k to candidate edges."""
    for table in runs(batches, "k"):
        if not table.num_rows:
            continue
        k = np.asarray(table.column("k").combine_chunks())
        starts = np.flatnonzero(np.diff(k, prepend=k[0] ^ 1))
        yield _edge_batch(*token_links(np.asarray(table.column("id").combine_chunks()), _bytes_matrix(table.column("token"), SIZE), starts))


def compare_sets(percent: int):
    """Rows (k, id, token, set) sorted by k to exact edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "k"):
            if not table.num_rows:
                continue
            k = np.asarray(table.column("k").combine_chunks())
            ids, tokens = np.asarray(table.column("id").combine_chunks()), _bytes_matrix(table.column("token"), SIZE)
            sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
            starts = np.flatnonzero(np.diff(k, prepend=k[0] ^ 1))
            edges: list[tuple[int, int]] = []
            for a, b in zip(starts, [*starts[1:], len(k)]):
                if b - a > 1:
                    edges += exact_links(ids[a:b], tokens[a:b], sets[a:b], percent)
            yield _edge_batch(*(list(zip(*edges)) or [(), ()]))

    return run


# --- dealing groups out ----------------------------------------------------------------------------------------------


def _dealt(rows: DataFrame, keys: list, compare, columns: list[str]) -> DataFrame:
    """Edges of rows compared within equal keys. A key's rows are bounded by the size of a block."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(F.xxhash64(*keys).alias("k"), "id", *columns)
    return keyed.repartition(n, "k").sortWithinPartitions("k").mapInArrow(compare, "a long, b long")


def link(rows: DataFrame, compare, columns: list[str], block: int, block_weight: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(edges, sizes): edges within groups g of rows(g, id, w, *columns); sizes of groups of several blocks, if any."""
    weight = F.ceil(F.sum("w") / block_weight) if block_weight else F.lit(1)
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / block), weight).cast("long").alias("blocks"))
    many = written(sizes.where("blocks > 1"), "groups", 0)
    if not many.limit(1).count():
        return _dealt(rows, ["g"], compare, columns), None
    placed = rows.join(many, "g", "left")
    own = F.array(F.pmod(F.xxhash64("id"), F.col("blocks")))
    pivot = F.pmod(F.xxhash64("id", F.lit(1)), F.col("n")) < PIVOTS
    where = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).when(pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(own)
    return _dealt(placed.withColumn("block", F.explode(where)), ["g", "block"], compare, columns), many


def link_rest(rows: DataFrame, many: DataFrame, found: DataFrame, compare, columns: list[str], block: int) -> DataFrame:
    """Edges between what is apart from the largest component of a large group and all blocks of the group.

    rows and many as in link(), found(node, component) by its edges. What is apart comes in chunks as well.
    """
    placed = rows.join(many, "g").join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    shares = placed.groupBy("g", "component").agg(F.count("*").alias("c"))
    top = written(shares.groupBy("g").agg(F.max_by("component", F.struct("c", "component")).alias("top"), F.sum("c").alias("all"), F.max("c").alias("c")), "top", 0)
    top = top.where("c < all").withColumn("chunks", F.ceil((F.col("all") - F.col("c")) / (block // 2)).cast("long"))
    placed = placed.join(top.select("g", "top", "chunks"), "g")
    zero = F.lit(0).cast("long")
    chunk, own = F.pmod(F.xxhash64("id", F.lit(2)), F.col("chunks")), F.pmod(F.xxhash64("id"), F.col("blocks"))
    apart = placed.where("component <> top").withColumn("chunk", chunk).withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    all_rows = placed.withColumn("block", own).withColumn("chunk", F.explode(F.sequence(zero, F.col("chunks") - 1)))
    return _dealt(apart.unionByName(all_rows), ["g", "block", "chunk"], compare, columns)


def candidates(classes: DataFrame) -> DataFrame:
    """(node, component): coarse groups of classes(id, sig) that the trees' comparisons connect."""
    now, edges, clusters, n = first_nodes(classes), None, [], classes.count()
    for depth in range(1, DEPTH + 1):
        now = written(now, "nodes")
        sizes = now.groupBy("g").agg(F.count("*").alias("n"), F.max("parent_n").alias("p"))
        large = written(sizes.where(F.col("n") > LEAF), "large", n // LEAF)
        if not large.limit(1).count():
            leaf, branched = now, None
        else:
            joined = now.join(large, "g", "left")
            leaf = joined.where("n IS NULL").select("g", "id", "parent_n", "token")
            stop = (F.col("n") >= DENSE * F.col("p")) | F.lit(depth == DEPTH)
            stop = stop & (F.col("p") > 0)
            clusters.append(joined.where(F.col("n").isNotNull() & stop).select("g", "id", "token"))
            branched = joined.where(F.col("n").isNotNull() & ~stop).select("g", "id", "n", "token")
        found = written(_dealt(leaf, ["g"], compare_tokens, ["token"]).distinct(), "candidates", n)
        edges = found if edges is None else edges.unionByName(found)
        if branched is None or not branched.limit(1).count():
            break
        now = next_nodes(branched)
    if clusters:
        rows = clusters[0]
        for more in clusters[1:]:
            rows = rows.unionByName(more)
        rows = written(rows.withColumn("w", F.lit(1)), "clusters")
        inner, many = link(rows, compare_tokens, ["token"], BLOCK)
        edges = edges.unionByName(written(inner.distinct(), "candidates", n))
        if many is not None:
            found = written(components(edges), "coarse")
            rest = written(link_rest(rows, many, found, compare_tokens, ["token"], BLOCK).distinct(), "candidates", n)
            if not rest.limit(1).count():
                return found
            edges = edges.unionByName(rest)
    return written(components(edges), "coarse")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    sketched = written(sketches(docs, words), "sketches")
    with_set = sketched.where("n > 0 AND doc_id IS NOT NULL")
    first = F.min_by(F.struct("n", "sig"), "doc_id").alias("s")
    classes = written(with_set.groupBy("key").agg(F.min("doc_id").alias("id"), first).select("key", "id", "s.n", "s.sig"), "classes", sketched.count(), 50_000)
    n = classes.count()
    groups = candidates(classes)
    members = groups.select(F.col("node").alias("id"), F.col("component").alias("g"))
    bitmap = spark.sparkContext.broadcast(id_filter(members.select("id")))

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            mask = passes(bitmap.value, np.asarray(batch.column(0).fill_null(0))) & np.asarray(batch.column(0).is_valid())
            part = batch.filter(pa.array(mask))
            sets = batch_sets(part.column(1).to_pylist(), words)
            token = [signature(s).astype(np.uint8).tobytes() for s in sets]
            arrays = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(token, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            batch = pa.RecordBatch.from_arrays(arrays, ["id", "w", "token", "set"])
            yield batch.filter(pa.array(np.array([len(s) > 0 for s in sets], bool)))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(full_sets, "id long, w long, token binary, set binary")
    rows = written(rows.join(members, "id"), "sets")
    compare, columns = compare_sets(percent), ["token", "set"]
    edges, many = link(rows, compare, columns, BLOCK, BLOCK_SHINGLES)
    edges = written(edges.distinct(), "links", n)
    found = written(components(edges), "components")
    if many is not None:
        rest = written(link_rest(rows, many, found, compare, columns, BLOCK).distinct(), "links", n)
        if rest.limit(1).count():
            found = written(components(edges.unionByName(rest)), "components")
    own = found.select(F.col("node").alias("id"), "component")
    known = written(classes.select("key", "id").join(own, "id", "left").select("key", F.coalesce("component", "id").alias("component")), "classes", n)
    placed = sketched.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(known, "key", "left")
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the rows whose component has a smaller id; all columns stay."""
    gone = near_duplicates(docs.select("doc_id", "text"), words, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*quoted(docs.columns))
