"""Best-fit packing of token sequences by a linear grouping scheme.

Whole lengths are at most the sequence's capacity, so a histogram by length, of at most `capacity` rows whatever the
corpus, is all that planning needs:

1. lengths over a share of the capacity are cut into groups of equal cardinality and rounded up to their group's
   largest, which leaves a few sizes;
2. the configuration program over these sizes is solved by column generation (a knapsack prices new patterns) and
   rounded down;
3. the real lengths take the places of the rounded ones, longest first, which leaves room;
4. what is left over and all small lengths go, longest first, where they fit best, into that room or new sequences.

Sequences of equal content are kept as runs (first number, count, tokens used), so the plan's size doesn't depend on
the number of documents either. Documents then find their place by their rank among those of the same length; ranks
are counted within salted parts of a length and moved by the sizes of the parts before.

Defined cases: null text is empty text; an empty text is the end id alone; null or repeated doc_ids are packed like
any other rows; an empty table gives no rows. Columns of the input other than the id and the text are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import caches, small_batches, written

CAPACITY, END_ID = 4096, 1
#: Lengths above capacity / LARGE_SHARE are grouped; GROUPS sizes enter the configuration program.
LARGE_SHARE, GROUPS = 4, 160
#: Words kept in a worker's memory with their ids (about 35 bytes each), and the longest of them.
CACHED_WORDS, CACHED_CHARS = 600_000, 48
#: Bytes of text that are tokenized at once.
BATCH_BYTES = 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Bytes with line ends and tabs as blanks, and with A-Z in lower case, too.
_BLANKS = bytes.maketrans(b"\n\t\r", b"   ")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in _BLANKS)


class WordTokenizer:
    """A tokenizer whose words don't depend on each other: ids are remembered by word.

    Holds for tokenizers that drop white space and case, and split letters from punctuation. Only blanks, tabs and
    line ends separate words here; what other white space separates goes to the tokenizer together. New words are
    tokenized many at a time, joined by a mark whose ids end each word. Words and their ids are kept as Arrow arrays, and
    only the different words of a batch are looked up, so neither memory nor time goes to an object for each word.
    """

    MARK = "\x01"
    #: Marks that are a piece of their own at the end of a word, behind letters and digits that stay as they are but for case.
    MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    STEM = "[0-9a-zÀ-ÖØ-öø-ÿ]"
    ENDS = STEM + r"[!-/:-@\[-`{-~]+$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        self.mark = np.array(self.inner.encode(self.MARK, add_special_tokens=False).ids, dtype="<u4")
        self.special = sorted(t.content for t in self.inner.get_added_tokens_decoder().values())

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        cased = [any(s in t for s in self.special) or "<|" in t for t in texts]  # case matters in special tokens
        out: list[bytes] = [b""] * len(texts)
        for kind in (False, True):
            own = [i for i, c in enumerate(cased) if c == kind]
            for i, ids in zip(own, self._encode([texts[i] for i in own], kind)):
                out[i] = ids
        return out

    def _encode(self, texts: list[str], cased: bool) -> list[bytes]:
        raw = [t.encode() for t in texts]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        joined = b"".join(raw).translate(_BLANKS if cased else _LOWER)
        raw = None
        if not joined:
            return [b""] * len(texts)
        # each word with the blank behind it, if there is one
        cut = np.append(True, np.frombuffer(joined, np.uint8) == 32)
        cut[ends] = True
        at = np.flatnonzero(cut)
        cut = None
        kind, width = (pa.string(), np.int32) if len(joined) < 1 << 31 else (pa.large_string(), np.int64)
        coded = pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(width)), pa.py_buffer(joined)]).dictionary_encode()
        sizes, flat = self._ids_of(coded.dictionary.cast(pa.string()), cased)
        first = np.cumsum(sizes) - sizes
        code = np.asarray(coded.indices)
        own = sizes[code]
        after = np.append(0, np.cumsum(own))
        spots = np.repeat((first[code] - after[:-1]).astype(width), own)
        spots += np.arange(after[-1], dtype=width)
        out = flat[spots].tobytes()
        bounds = [0, *(4 * after[np.searchsorted(at, ends)]).tolist()]
        return [out[a:b] for a, b in zip(bounds, bounds[1:])]

    def _ids_of(self, found: pa.Array, cased: bool) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the words has, which may end with a blank, and all their ids."""
        parts = [pc.utf8_rtrim(found, " ")]
        if not cased:  # a word and the marks at its end apart: fewer words to keep
            apart = pc.match_substring_regex(parts[0], self.ENDS)
            stem = pc.if_else(apart, pc.utf8_rtrim(parts[0], self.MARKS), parts[0])
            tails = pc.if_else(apart, pc.replace_substring_regex(parts[0], f"^.*{self.STEM}", ""), "")
            parts = [stem, tails]
        ids = [self._known(p) for p in parts]
        whole = ids[0] if cased else pc.binary_join_element_wise(*ids, pa.scalar(b"", pa.binary()))
        edge = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1] // 4
        return np.diff(edge).astype(np.int64), np.frombuffer(whole.buffers()[2] or b"", "<u4")[edge[0] :]

    def _known(self, found: pa.Array) -> pa.Array:
        """The ids of words, which are learned where they aren't kept."""
        at = pc.index_in(found, value_set=self.words)
        if len(self.words) > CACHED_WORDS:  # those that this batch has, too, are kept
            kept = pc.unique(at.drop_null())
            self.words, self.ids = self.words.take(kept), self.ids.take(kept)
            at = pc.index_in(found, value_set=self.words)
        if not at.null_count:
            return self.ids.take(at)
        words, ids = self._learn(pc.unique(found.filter(pc.is_null(at))))
        at = pc.coalesce(at, pc.add(pc.index_in(found, value_set=words), len(self.words)))
        out = pa.concat_arrays([self.ids, ids]).take(at)
        short = pc.less_equal(pc.utf8_length(words), CACHED_CHARS)
        self.words, self.ids = pa.concat_arrays([self.words, words.filter(short)]), pa.concat_arrays([self.ids, ids.filter(short)])
        return out

    def _learn(self, new: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words, in another order perhaps, and their ids."""
        marked = pc.or_(pc.match_substring(new, self.MARK), pc.match_substring(new, "<|"))
        odd = pc.or_(marked, pc.greater(pc.utf8_length(new), CACHED_CHARS))
        plain, single = new.filter(pc.invert(odd)), new.filter(odd).to_pylist()
        between, words, found = f" {self.MARK} ", [], []
        for at in range(0, len(plain), 8192):
            part = plain.slice(at, 8192)
            own = part.to_pylist()
            lines = [between.join(own[i : i + 64]) + between for i in range(0, len(own), 64)]
            ids = np.concatenate([np.array(x.ids, "<u4") for x in self.inner.encode_batch(lines, add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else np.zeros(0, int)
            if len(ends) != len(part):  # the mark is no id of its own
                single += own
                continue
            edge = np.append(0, 4 * (ends - np.arange(len(ends)))).astype(np.int32)
            raw = pa.py_buffer(ids[ids != self.mark[0]].tobytes())
            words.append(part)
            found.append(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(edge), raw]))
        words.append(pa.array(single, pa.string()))
        found.append(pa.array([np.array(self.inner.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in single], pa.binary()))
        return pa.concat_arrays(words), pa.concat_arrays(found)


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


caches.append(_tokenizer.cache_clear)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Token pieces of (doc_id, text): ids, the end id, cut every `capacity`. keep_ids adds ids array<int>.

    `tokenizer` is a file that every executor has.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = _tokenizer(tokenizer).encode_all
        for batch in small_batches(batches, "text", BATCH_BYTES, _tokenizer.cache_clear):
            rows: list[tuple] = []
            encoded = encode_all([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded):
                ids += end
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    row = (doc_id, k // step, k // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<i4").tolist()) if keep_ids else row)
            columns = list(zip(*rows)) or [()] * (5 + keep_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES + ", ids array<int>" * keep_ids)


# --- the plan, from the histogram alone -------------------------------------------------------------------------


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        gains = best[room - sizes[fits]] + values[fits]
        k = int(gains.argmax())
        if gains[k] > best[room - 1] + 1e-12:
            best[room], last[room] = gains[k], fits[k]
        else:
            best[room], last[room] = best[room - 1], -1
    pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(best[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = 400) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole numbers of sequences, from the linear program rounded down.

    After `steps` new patterns the program is taken as it is: a few more sequences perhaps, but every piece has its place.
    """
    k = len(sizes)
    if not k:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    amounts = inverse @ demand
    for _ in range(steps):
        prices = inverse.sum(axis=0)  # each sequence costs 1
        value, pattern = _best_pattern(sizes, np.maximum(prices, 0.0), capacity)
        if value <= 1.0 + 1e-6:
            break
        change = inverse @ pattern
        up = change > 1e-9
        ratio = np.where(up, amounts / np.where(up, change, 1.0), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        inverse = np.linalg.inv(basis)
        amounts = np.maximum(inverse @ demand, 0.0)
    return [(basis[:, j].astype(np.int64), int(amounts[j] + 1e-9)) for j in range(k) if int(amounts[j] + 1e-9) > 0]


class _Plan:
    """Runs of sequences with equal use, and the places given to lengths."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.room: dict[int, list[tuple[int, int]]] = {}
        self.places: list[tuple[int, int, int, int, int, int]] = []  # length, rank, count, sequence, per sequence, offset
        self.rank: dict[int, int] = {}

    def open(self, count: int) -> int:
        first, self.sequences = self.sequences, self.sequences + count
        return first

    def place(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        rank = self.rank.get(length, 0)
        self.places.append((length, rank, count, sequence, each, offset))
        self.rank[length] = rank + count

    def leave(self, first: int, count: int, used: int) -> None:
        if count and used < self.capacity:
            self.room.setdefault(self.capacity - used, []).append((first, count))

    def best_fit(self, length: int, count: int) -> None:
        """Put `count` pieces where the least room is left; those of a sequence follow each other."""
        rooms = sorted(r for r in self.room if r >= length)
        for room in rooms:
            each = room // length
            while count and self.room.get(room):
                first, n = self.room[room].pop()
                count = self._fill(length, count, first, n, each, room)
            if not self.room.get(room):
                self.room.pop(room, None)
            if not count:
                return
        each = self.capacity // length
        n = -(-count // each)
        self._fill(length, count, self.open(n), n, each, self.capacity)

    def _fill(self, length: int, count: int, first: int, n: int, each: int, room: int) -> int:
        used = self.capacity - room
        full = min(n, count // each)
        if full:
            self.place(length, full * each, first, each, used)
            self.leave(first, full, used + each * length)
            count -= full * each
        if full < n:
            rest = 0
            if count:  # fewer than `each`, for one more sequence
                self.place(length, count, first + full, count, used)
                self.leave(first + full, 1, used + count * length)
                rest, count = 1, 0
            self.leave(first + full + rest, n - full - rest, used)
        return count


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> _Plan:
    """Places for all pieces; histogram: how many there are of each length."""
    out = _Plan(capacity)
    if whole := histogram.get(capacity, 0):
        out.place(capacity, whole, out.open(whole), 1, 0)
    large = sorted((x for x in histogram if capacity // LARGE_SHARE < x < capacity), reverse=True)
    total = sum(histogram[x] for x in large)
    parts: list[list[list[int]]] = []  # of each group: [length, count], longest first
    taken = 0
    for length in large:
        n = histogram[length]
        while n:
            bound = -(-total * (len(parts) if parts else 1) // groups)
            if not parts or taken >= bound:
                parts.append([])
                bound = -(-total * len(parts) // groups)
            step = min(n, max(1, bound - taken))
            parts[-1].append([length, step])
            taken, n = taken + step, n - step
    sizes = np.array([p[0][0] for p in parts], dtype=np.int64)
    # groups that round up to one size are one size of the program
    distinct, which = np.unique(sizes, return_inverse=True) if len(sizes) else (sizes, sizes)
    demand = np.zeros(len(distinct))
    pools: list[list[list[int]]] = [[] for _ in distinct]
    for p, w in zip(parts, which):
        demand[w] += sum(n for _, n in p)
        pools[w] += p
    for pattern, count in configurations(distinct, demand, capacity):
        spans = [(out.open(count), count, 0)]
        for w in np.flatnonzero(pattern)[::-1]:
            for _ in range(pattern[w]):
                spans = _substitute(out, spans, pools[w])
        for first, n, used in spans:
            out.leave(first, n, used)
    left: dict[int, int] = {x: n for x, n in histogram.items() if x <= capacity // LARGE_SHARE}
    for pool in pools:
        for length, n in pool:
            left[length] = left.get(length, 0) + n
    for length in sorted(left, reverse=True):
        if left[length]:
            out.best_fit(length, left[length])
    return out


def _substitute(out: _Plan, spans: list[tuple[int, int, int]], pool: list[list[int]]) -> list[tuple[int, int, int]]:
    """One more real piece into each sequence of the spans, longest first, while the pool lasts."""
    after = []
    for first, n, used in spans:
        while n and pool:
            length, have = pool[0]
            step = min(n, have)
            out.place(length, step, first, 1, used)
            after.append((first, step, used + length))
            first, n = first + step, n - step
            if step == have:
                pool.pop(0)
            else:
                pool[0][1] -= step
        if n:
            after.append((first, n, used))
    return after


# --- the documents' places -----------------------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; keep_ids adds the token ids."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    made = plan(counts, capacity, groups)
    part_rows = min(100_000, max(256, sum(counts.values()) // 2000))
    salts = [(x, -(-n // part_rows)) for x, n in counts.items()]
    table = F.broadcast(spark.createDataFrame(salts, "length long, salts long"))  # at most `capacity` rows
    salted = cut.join(table, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("own", own).join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    places = np.array(sorted(made.places), dtype=np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(places)  # follows `capacity`, not the rows
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = shared.value
        keys = spots[:, 0] * (1 << 44) + spots[:, 1]
        for batch in batches:
            length = np.asarray(batch.column(batch.schema.get_field_index("length")))
            rank = np.asarray(batch.column(batch.schema.get_field_index("rank")))
            _, first, _, sequence, each, offset = spots[np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1].T
            at = rank - first
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            arrays += [pa.array(sequence + at // each), pa.array(offset + at % each * length)]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "sequence_id", "offset"])

    schema = PIECES + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(locate, schema)
