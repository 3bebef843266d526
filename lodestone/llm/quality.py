"""A supervised subword classifier: averaged vectors of hashed words and character n-grams, softmax, trained in numpy.

Words are runs without white space, in their own case. A word's features are itself and its n-grams of 3 to 5 characters, of
which one at either end may be the space beside it; each is hashed to a row of a table of vectors. A document is the
mean of all its features' vectors, and a softmax over two classes reads that mean. Table and output are trained by stochastic
gradient descent in small batches, with a rate that falls to zero; a feature's step is divided by the root of its
mean weight so far, so that rare and frequent features move alike.

Training sees a sample of the labelled rows of the training fold: those with the lowest hash of their id, about SAMPLE_ROWS
rows or SAMPLE_BYTES of text, whichever is less, in one task of an executor. A fifth of it is kept apart and moves the scores so that CUT (0.3) is
the cut with the best mean of both classes' recalls. Scoring covers every whole text: the output is linear in a feature, so a
document's score is the logistic of its features' mean worth, and a word's worth is summed once a batch.

Defined cases: null, empty or blank text has no features, and the score that the output's constants give; without labelled rows of both
labels every score is the share of label 1 (0.5 without rows), so nothing is dropped; null ids and labels other than 0 and 1 are never
trained on; repeated labels of a document, and repeated documents, count as given. Extra columns are passed
through; score and predicted replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, hash_below, in_training_fold, map_batches, small_batches, unused

BUCKETS, DIM, GRAMS = 1 << 17, 8, (3, 4, 5)
EPOCHS, BATCH, RATE, SEED, CUT = 6, 32, 0.5, 11, 0.3
#: The bounds of the labelled sample.
SAMPLE_ROWS, SAMPLE_BYTES = 10_000, 20 << 20
#: Bytes of text in a batch.
BYTES = 2 << 20
_SPACE = 32
#: Stands for a word that is the same as the one before it; no text has it as a word.
REPEAT = "\x1f" * 4


@dataclass
class Model:
    table: np.ndarray  # buckets x DIM
    out: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2
    shift: float  # added to the difference of the logits
    constant: float | None = None

    def worth(self) -> tuple[np.ndarray, float]:
        """What a feature adds to the difference of the two logits, and the constant."""
        return self.table @ (self.out[:, 1] - self.out[:, 0]), float(self.bias[1] - self.bias[0]) + self.shift


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(20)).astype(np.int64) % BUCKETS


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the table, index of the word) of all features of words without white space."""
    text = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    gap = text == _SPACE
    of = np.cumsum(gap) - 1  # the word that begins after this space
    starts = np.flatnonzero(gap)[:-1] + 1
    with np.errstate(over="ignore"):
        sizes = np.diff(np.flatnonzero(gap)) - 1
        power = np.ones(int(sizes.max(initial=0)) + 1, np.uint64)
        np.multiply.accumulate(np.full(len(power) - 1, 0x100000001B3, np.uint64), out=power[1:])
        place = np.arange(len(text)) - starts[np.minimum(of, len(starts) - 1)]
        own = np.where(gap, 0, text * power[np.clip(place, 0, len(power) - 1)])
        rows, owner = [_mixed(np.add.reduceat(own, starts))], [np.arange(len(words))]
        for n in GRAMS:
            m = len(text) - n + 1
            if m <= 0:
                continue
            h, fine = np.full(m, n, np.uint64), np.ones(m, bool)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) ^ text[i : i + m]
                if 0 < i < n - 1:
                    fine &= ~gap[i : i + m]
            at = np.flatnonzero(fine)
            rows.append(_mixed(h[at]))
            owner.append(of[at + 1])
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return rows[order], owner[order]


def _words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of a batch of texts, and for each word of each text its place among them and its text."""
    listed = pc.utf8_split_whitespace(pc.fill_null(column, ""))
    flat, text = listed.flatten(), np.repeat(np.arange(len(listed)), np.asarray(pc.list_value_length(listed)))
    coded = flat.dictionary_encode()
    words = pc.utf8_trim_whitespace(coded.dictionary)
    code = np.asarray(coded.indices).astype(np.int64)
    some = np.asarray(pc.greater(pc.binary_length(words), 0))  # white space at either end gives an empty word
    place = np.cumsum(some) - 1
    keep = some[code]
    return words.filter(pa.array(some)).to_pylist(), place[code[keep]], text[keep]


def _counts(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words and REPEAT, and by text: word, text, count)."""
    words, code, text = _words(column)
    again = np.flatnonzero((code[1:] == code[:-1]) & (text[1:] == text[:-1])) + 1
    code, text = np.append(code, np.full(len(again), len(words))), np.append(text, text[again])
    words = [*words, REPEAT]
    key, n = np.unique(text * len(words) + code, return_counts=True)
    return words, key % len(words), key // len(words), n


def margins(column: pa.Array, worth: np.ndarray, constant: float) -> np.ndarray:
    """The difference of the logits of each text."""
    words, code, text, n = _counts(column)
    rows, owner = features(words)
    value = np.bincount(owner, worth[rows], len(words))
    parts = np.bincount(owner, minlength=len(words))
    total = np.bincount(text, n * value[code], len(column))
    size = np.bincount(text, n * parts[code], len(column))
    return total / np.maximum(size, 1) + constant


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, weights that sum to 1) of each text."""
    out = []
    for i in range(0, len(texts), 200):
        part = pa.array(texts[i : i + 200], pa.string())
        words, code, text, n = _counts(part)
        rows, owner = features(words)
        edge = np.searchsorted(owner, np.arange(len(words) + 1))
        cut = np.searchsorted(text, np.arange(len(part) + 1))
        for a, b in zip(cut, cut[1:]):
            if a == b:
                out.append((rows[:0], np.zeros(0, np.float32)))
                continue
            size = edge[code[a:b] + 1] - edge[code[a:b]]
            at = np.repeat(edge[code[a:b]], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            row, where = np.unique(rows[at], return_inverse=True)
            weight = np.bincount(where, np.repeat(n[a:b], size))
            out.append((row.astype(np.int32), (weight / weight.sum()).astype(np.float32)))
    return out


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Stochastic gradient descent on the softmax's cross entropy; both labels weigh the same."""
    empty = np.zeros((BUCKETS, DIM), np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Model(empty, np.zeros((DIM, 2)), np.zeros(2), 0.0, float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    bags = _bags(texts)
    shuffled = rng.permutation(len(labels))
    apart = np.zeros(len(labels), bool)
    for y in (0, 1):
        own = shuffled[labels[shuffled] == y]
        apart[own[: len(own) // 5]] = True
    learn = np.flatnonzero(~apart)
    weight = np.array([0.5 * len(learn) / max(1, int((labels[learn] == y).sum())) for y in (0, 1)])
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    seen = np.full(BUCKETS, 1e-6, np.float32)
    out, bias = rng.uniform(-1, 1, (DIM, 2)), np.zeros(2)
    steps, done = epochs * -(-len(learn) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(learn)
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            size = np.array([len(bags[i][0]) for i in part])
            row, w = np.concatenate([bags[i][0] for i in part]), np.concatenate([bags[i][1] for i in part])
            doc = np.repeat(np.arange(len(part)), size)
            mean = np.zeros((len(part), DIM))
            full = size > 0
            starts = (np.cumsum(size) - size)[full]
            if len(row):
                mean[full] = np.add.reduceat(table[row] * w[:, None], starts, axis=0)
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            p *= weight[labels[part]][:, None] / len(part)
            back = p @ out.T
            out -= rate * (mean.T @ p)
            bias -= rate * p.sum(axis=0)
            if len(row):
                some, where = np.unique(row, return_inverse=True)
                push = np.stack([np.bincount(where, w * back[doc, j], len(some)) for j in range(DIM)], axis=1)
                seen[some] += np.bincount(where, w * w, len(some)) / len(part)
                table[some] -= (rate * push / np.sqrt(seen[some])[:, None]).astype(np.float32)
    model = Model(table, out, bias, 0.0)
    worth, constant = model.worth()
    z = np.array([float(worth[r] @ w) + constant for r, w in bags])
    own = apart if len(set(labels[apart])) == 2 else np.ones(len(z), bool)
    model.shift = float(np.log(CUT / (1 - CUT))) - _cut(z[own], labels[own])
    return model


def _cut(z: np.ndarray, labels: np.ndarray) -> float:
    """Midway in the gap that gives the best mean of both labels' recalls; of equal ones the widest."""
    values, at = np.unique(z, return_inverse=True)
    good, bad = np.bincount(at, labels == 1), np.bincount(at, labels == 0)
    if len(values) == 1:
        return float(values[0])
    right = np.cumsum(bad)[:-1] / bad.sum() + 1 - np.cumsum(good)[:-1] / good.sum()
    width = np.diff(values)
    k = max(range(len(right)), key=lambda i: (round(right[i], 12), width[i]))
    return float((values[k] + values[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, quality), of a bounded sample of the training fold."""
    known = labels.where(in_training_fold() & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    count = known.count()
    share = sample_rows / max(1, count)
    # at most about sample_rows rows of labels, so their texts are found without a shuffle
    some = known.where(hash_below(share, F.col("doc_id"), F.lit(SEED)))
    found = docs.join(F.broadcast(some), "doc_id")
    size = found.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    if size > sample_bytes:
        found = found.where(hash_below(share * sample_bytes / size, F.col("doc_id"), F.lit(SEED)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows = sorted((i, y, t or "") for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns)))
        model = train([t for _, _, t in rows], np.array([y for _, y, _ in rows], np.int64))
        parts = [model.table.astype(np.float32).tobytes(), np.append(model.out.ravel(), model.bias).tobytes()]
        arrays = [pa.array([x], pa.binary()) for x in parts]
        arrays += [pa.array([model.shift]), pa.array([model.constant], pa.float64())]
        yield pa.RecordBatch.from_arrays(arrays, ["t", "o", "shift", "constant"])

    one = found.select("doc_id", "text", "quality").repartition(1)
    row = one.mapInArrow(learn, "t binary, o binary, shift double, constant double").first()
    if row is None:
        return train([], np.zeros(0, np.int64))
    out = np.frombuffer(row.o)
    return Model(np.frombuffer(row.t, np.float32).reshape(BUCKETS, DIM), out[: 2 * DIM].reshape(DIM, 2), out[2 * DIM :], row.shift, row.constant)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted, from the text alone."""
    fields = [f for f in docs.schema if f.name not in ("score", "predicted")]
    names = [f.name for f in fields]
    (listed,) = unused(names, "words")
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast((*model.worth(), model.constant))  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth, constant, fixed = shared.value
        for batch in small_batches(batches, listed, BYTES):
            z = margins(batch.column(batch.schema.get_field_index(listed)), worth, constant)
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500))) if fixed is None else np.full(batch.num_rows, fixed)
            arrays = [*batch.columns[: len(names)], pa.array(s), pa.array((s >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "score", "predicted"])

    rows = docs.select(*[F.col(f"`{n.replace('`', '``')}`") for n in names], F.col("text").cast("string").alias(listed))
    return map_batches(rows, run, schema)
