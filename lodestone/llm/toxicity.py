"""A convolutional text classifier in numpy, with thresholds calibrated by language.

Words (runs of letters, lower case) and their beginnings of 5 and 4 letters are hashed to rows of an embedding table;
their sum is the word's vector, near zero until training has seen one of them. Filters of widths 1 to 3 run over the
vectors, each filter keeps its maximum over the whole text, and a logistic layer reads the maxima. Training (Adam)
sees all labelled rows of the training fold but a fifth, which is kept apart for calibration. The rows are dealt by the
hash of their id into shards of about SHARD_ROWS rows and SHARD_BYTES of text. Each of several rounds trains every shard from
the common network, on the executors, and adds the mean of the shards' changes to it, of a word's vector that of the shards that
have the word; sums are of whole numbers, so the order of the shards doesn't matter. One shard is trained in a single round.

Calibration: the language of a text is predicted from its words (naive Bayes over the same hashes, learned from lang in
all training rows), never read from a column. Each language with enough rows of both labels gets the threshold with the best
F1 on the calibration rows, shrunk towards the common one; a score is the logistic of the distance to the threshold,
so 0.5 means the same everywhere.

Defined cases: null, empty or word-free text has one padding word, and a score; without labelled rows of both labels
every score is the share of label 1 (0 without rows). Null ids are never trained on; repeated labels of
a document count as given. Extra columns are passed through; score and predicted replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_filter, in_training_fold, map_batches, passes, quoted, runs, small_batches, unused, written

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 12, 12, (1, 2, 3)
#: Hashed forms of a word: itself and its beginnings.
FORMS = (0, 5, 4)
EPOCHS, BATCH, RATE, SEED = 8, 16, 0.01, 7
#: Rows and bytes of text of a shard, and rounds over several shards.
SHARD_ROWS, SHARD_BYTES, ROUNDS = 5000, 8_000_000, 4
#: Parts of a unit that changes are rounded to before they are added up, and logits for calibration.
UNIT, LOGIT_UNIT = 1 << 24, 1 << 10
#: Rows of each label that a language needs for a threshold of its own.
CALIBRATION_ROWS = 12
#: Bytes of text whose words are hashed at once, and words scored at a time.
SCORED_BYTES = 2 << 20
CHUNK = 1 << 13
PADDING = 0
# The primes of xxHash64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def word_ids(text: Column, buckets: int = BUCKETS) -> Column:
    """Hashed forms of the words, 1 to buckets - 1, as array<int>: len(FORMS) numbers a word. coded_words() gives the same for a batch."""

    def hashed(form: Column, n: int) -> Column:
        return (F.pmod(F.xxhash64(form, F.lit(n)), F.lit(buckets - 1)) + 1).cast("int")

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.array(*[hashed(F.left(w, F.lit(n)) if n else w, n) for n in FORMS])))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _four(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _turned(h ^ x * P1, 23) * P2 + P3


def _final(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * P2
    h = (h ^ h >> np.uint64(29)) * P3
    return h ^ h >> np.uint64(32)


def xxhash64(words: pa.Array, seed: int = 42) -> np.ndarray:
    """xxHash64 of each word, those of one length at once; words of 32 bytes or more one by one."""
    out = np.zeros(len(words), np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    size, data = np.diff(offsets), np.frombuffer(words.buffers()[2] or b"", np.uint8)
    with np.errstate(over="ignore"):
        for n in np.unique(size[size < 32]).tolist():
            own = np.flatnonzero(size == n)
            letters = data[offsets[own][:, None] + np.arange(n)]
            h = np.full(len(own), seed + n, np.uint64) + P5
            for i in range(0, n - 7, 8):
                x = _turned(np.ascontiguousarray(letters[:, i : i + 8]).view("<u8")[:, 0] * P2, 31) * P1
                h = _turned(h ^ x, 27) * P1 + P4
            at = n // 8 * 8
            if n - at >= 4:
                h = _four(h, np.ascontiguousarray(letters[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64))
                at += 4
            for i in range(at, n):
                h = _turned(h ^ letters[:, i] * P5, 11) * P1
            out[own] = _final(h)
    for i in np.flatnonzero(size >= 32).tolist():
        out[i] = xxhash.xxh64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes(), seed)
    return out


def _hashed(forms: pa.Array, n: int, buckets: int) -> np.ndarray:
    """The bucket of each form of n letters (0: the whole word): xxhash64(form, n) as Spark computes it."""
    with np.errstate(over="ignore"):
        h = _final(_four(xxhash64(forms) + P5 + np.uint64(4), np.uint64(n)))
    return (h.view(np.int64) % (buckets - 1) + 1).astype(np.int32)


def coded_words(lowered: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words x forms, each word's place among them, words of each text) of lower-case texts; each distinct word is hashed once."""
    listed = pc.split_pattern_regex(lowered, r"[^\pL]+")
    coded = listed.flatten().dictionary_encode()
    some = np.asarray(pc.greater(pc.binary_length(coded.dictionary), 0))  # what isn't a letter at either end gives an empty word
    code = np.asarray(coded.indices).astype(np.int64)
    keep = some[code]
    edge = np.append(0, np.cumsum(keep))[np.append(0, np.cumsum(np.asarray(pc.list_value_length(listed)), dtype=np.int64))]
    words = coded.dictionary.filter(pa.array(some))
    ids = np.empty((len(words), len(FORMS)), np.int32)
    for i, n in enumerate(FORMS):
        forms = (pc.utf8_slice_codeunits(words, 0, n) if n else words).dictionary_encode()
        ids[:, i] = _hashed(forms.dictionary, n, buckets)[np.asarray(forms.indices)]
    return ids, (np.cumsum(some) - 1)[code[keep]], np.diff(edge)


@dataclass
class Model:
    table: np.ndarray  # buckets x DIM
    taps: np.ndarray  # DIM x sum(width * FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    languages: list[str]
    evidence: np.ndarray  # buckets x languages
    thresholds: np.ndarray
    constant: float | None = None


class _Net:
    """Embedding, filters, maxima and logistic output, with gradients for one text at a time."""

    def __init__(self, rng: np.random.Generator):
        self.p = {"e": rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["o"] = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = 0

    def forward(self, ids: np.ndarray):
        e = self.p["e"]
        x = sum((e[form] for form in ids.T[1:]), e[ids[:, 0]])
        maxima, places = [], []
        for w in WIDTHS:
            n = len(ids) - w + 1
            taps = self.p[f"w{w}"].reshape(w, DIM, FILTERS)
            h = x[:n] @ taps[0]
            for j in range(1, w):
                h += x[j : j + n] @ taps[j]
            at = h.argmax(axis=0)
            maxima.append(h[at, np.arange(FILTERS)] + self.p[f"b{w}"])
            places.append(at)
        raw = np.concatenate(maxima)
        return np.maximum(raw, 0), places

    def gradients(self, ids: np.ndarray, label: int, weight: float, keep: np.ndarray, into: dict) -> None:
        hidden, places = self.forward(ids)
        hidden = hidden * keep
        z = float(hidden @ self.p["o"] + self.p["ob"][0])
        d = weight * (1 / (1 + np.exp(-z)) - label)
        into["o"] += d * hidden
        into["ob"] += d
        back = d * self.p["o"] * keep * (hidden > 0)
        for i, w in enumerate(WIDTHS):
            g = back[i * FILTERS : (i + 1) * FILTERS]
            into[f"b{w}"] += g
            spots = places[i][:, None] + np.arange(w)  # filters x width
            x = self.p["e"][ids[spots]].sum(axis=2).reshape(FILTERS, w * DIM)
            into[f"w{w}"] += x.T * g
            one = (self.p[f"w{w}"].T * g[:, None]).reshape(-1, 1, DIM)
            into["e"].append((ids[spots].ravel(), np.broadcast_to(one, (len(one), len(FORMS), DIM)).reshape(-1, DIM)))

    def step(self, grads: dict, n: int) -> None:
        self.steps += 1
        rate = RATE * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        rows = np.concatenate([i for i, _ in grads["e"]])
        order = np.argsort(rows, kind="stable")
        starts = np.flatnonzero(np.diff(rows[order], prepend=-1))
        ge = np.add.reduceat(np.concatenate([g for _, g in grads["e"]])[order], starts, axis=0)
        rows = rows[order[starts]]
        for k in self.p:
            g = (ge if k == "e" else grads[k]) / n
            at = rows if k == "e" else slice(None)
            g = g + (1e-4 * self.p[k][at] if not k.startswith(("b", "ob")) else 0)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            self.p[k][at] -= rate * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-6)

    def flat(self) -> np.ndarray:
        """All numbers as rows of DIM, those of the embedding first."""
        small = np.concatenate([v.ravel() for k, v in self.p.items() if k != "e"])
        return np.concatenate([self.p["e"], np.append(small, np.zeros(-len(small) % DIM, np.float32)).reshape(-1, DIM)])

    def load(self, rows: np.ndarray) -> None:
        self.p["e"][:] = rows[:BUCKETS]
        small, at = rows[BUCKETS:].ravel(), 0
        for k, v in self.p.items():
            if k != "e":
                v[:] = small[at : at + v.size].reshape(v.shape)
                at += v.size

    def epoch(self, rng: np.random.Generator, texts: list[np.ndarray], labels: np.ndarray, learn: np.ndarray, weight: dict) -> None:
        order = rng.permutation(learn)
        for a in range(0, len(order), BATCH):
            grads: dict = {k: np.zeros_like(v) for k, v in self.p.items() if k != "e"} | {"e": []}
            part = order[a : a + BATCH]
            for i in part:
                keep = (rng.random(len(self.p["o"])) < 0.8).astype(np.float32) / 0.8
                self.gradients(texts[i], int(labels[i]), weight[int(labels[i])], keep, grads)
            self.step(grads, len(part))

    def model(self, languages: list[str], evidence: np.ndarray, thresholds: np.ndarray) -> Model:
        taps = np.concatenate([self.p[f"w{w}"].reshape(w, DIM, FILTERS)[j] for w in WIDTHS for j in range(w)], axis=1)
        bias = np.concatenate([self.p[f"b{w}"] for w in WIDTHS])
        return Model(self.p["e"], taps, bias, self.p["o"], float(self.p["ob"][0]), languages, evidence, thresholds)

    def logit(self, ids: np.ndarray) -> float:
        return float(self.forward(ids)[0] @ self.p["o"] + self.p["ob"][0])


def _padded(ids) -> np.ndarray:
    """Words x forms, at least as many words as the widest filter, with padding on both sides."""
    own = np.asarray(ids, np.int64).reshape(-1, len(FORMS))
    edge = np.full((max(WIDTHS) - 1, len(FORMS)), PADDING)
    return np.concatenate([edge, own, edge, edge[:1] if not len(own) else edge[:0]])


def _threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """Midway below the cut with the best F1."""
    order = np.argsort(-logits)
    hit = np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + labels.sum())
    k = int(f1.argmax())
    low = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 1
    return float((logits[order[k]] + low) / 2)


def train(rows: list[tuple[list[int], int, str | None]], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """rows: (word ids, label, language)."""
    labels = np.array([y for _, y, _ in rows])
    if not rows or labels.min() == labels.max():
        empty = np.zeros((BUCKETS, 1), np.float32)
        return Model(empty, empty, empty[0], empty[0], 0.0, [], empty, empty[0], float(labels.mean()) if len(rows) else 0.0)
    rng = np.random.default_rng(seed)
    texts = [_padded(ids) for ids, _, _ in rows]
    shuffled = rng.permutation(len(rows))
    apart = np.zeros(len(rows), bool)
    for y in (0, 1):
        own = shuffled[labels[shuffled] == y]
        apart[own[: len(own) // 5]] = True
    learn = np.flatnonzero(~apart)
    weight = {y: 0.5 * len(learn) / max(1, int((labels[learn] == y).sum())) for y in (0, 1)}
    net = _Net(rng)
    for _ in range(epochs):
        net.epoch(rng, texts, labels, learn, weight)
    languages = sorted({lang for _, _, lang in rows if lang is not None})
    counts = np.full((BUCKETS, max(1, len(languages))), 0.5)
    for ids, _, lang in rows:
        if lang is not None:
            np.add.at(counts, (np.asarray(ids, np.int64)[:: len(FORMS)], languages.index(lang)), 1)
    evidence = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    evidence[PADDING] = 0
    logits = np.array([net.logit(t) for t in texts])
    of = np.array([int(evidence[t[:, 0]].sum(axis=0).argmax()) for t in texts])
    # rows kept apart decide; with few of them the learned rows do too
    common = apart if labels[apart].sum() >= 10 else np.ones(len(rows), bool)
    base = _threshold(logits[common], labels[common])
    thresholds = np.full(max(1, len(languages)), base)
    for j in range(len(languages)):
        own = common & (of == j)
        n = min(int(labels[own].sum()), int((1 - labels[own]).sum())) if own.any() else 0
        if n >= CALIBRATION_ROWS:
            share = n / (n + CALIBRATION_ROWS)
            thresholds[j] = share * _threshold(logits[own], labels[own]) + (1 - share) * base
    return net.model(languages, evidence, thresholds)


def score_texts(model: Model, ids: np.ndarray, sizes: np.ndarray, code: np.ndarray | None = None) -> np.ndarray:
    """Scores of texts whose words (x forms) follow each other. Long texts go through in chunks; maxima and sums are whole.

    code: the words' places in ids, where ids has each distinct word once.
    """
    if model.constant is not None:
        return np.full(len(sizes), model.constant)
    logit, language = logits(model, ids, sizes, code)
    z = logit - model.thresholds[language]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -500, 500)))


def logits(model: Model, ids: np.ndarray, sizes: np.ndarray, code: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The logit and the language's number of each text."""
    n = len(sizes)
    best = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
    proof = np.zeros((n, model.evidence.shape[1]))
    edge = max(WIDTHS) - 1
    ids = np.concatenate([ids, np.full((1, len(FORMS)), PADDING, ids.dtype)])
    vectors = np.empty((len(ids), model.table.shape[1]), np.float32)
    for a in range(0, len(ids), CHUNK):
        vectors[a : a + CHUNK] = sum(model.table[form] for form in ids[a : a + CHUNK].T)
    taps, first = np.ascontiguousarray(model.taps.T), ids[:, 0].copy()
    # each text's words with padding on both sides
    own = sizes + 2 * edge + (sizes == 0)
    starts = np.cumsum(own) - own
    flat = np.full(int(own.sum()), len(ids) - 1, np.int64)
    flat[np.repeat(starts + edge, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.arange(len(ids) - 1) if code is None else code
    for a in range(0, len(flat), CHUNK):
        part = flat[a : a + CHUNK + edge]
        doc = np.searchsorted(starts, np.arange(a, a + len(part)), side="right") - 1
        rows = taps @ vectors.take(part, axis=0).T  # filters x words
        col = 0
        for i, w in enumerate(WIDTHS):
            m = min(CHUNK, len(part)) if len(part) - w + 1 >= CHUNK else len(part) - w + 1
            if m <= 0:
                col += w * FILTERS
                continue
            h = rows[col : col + FILTERS, :m]  # each row is used once
            for j in range(1, w):
                h += rows[col + j * FILTERS : col + (j + 1) * FILTERS, j : j + m]
            col += w * FILTERS
            h[:, np.flatnonzero(doc[:m] != doc[w - 1 : w - 1 + m])] = -np.inf  # a filter stays within its text
            cut = np.flatnonzero(np.diff(doc[:m], prepend=-1))
            docs = doc[cut]
            sl = slice(i * FILTERS, (i + 1) * FILTERS)
            best[docs, sl] = np.maximum(best[docs, sl], np.maximum.reduceat(h, cut, axis=1).T)
        m = min(CHUNK, len(part))
        cut = np.flatnonzero(np.diff(doc[:m], prepend=-1))
        proof[doc[cut]] += np.add.reduceat(model.evidence.take(first.take(part[:m]), axis=0), cut, axis=0)
    return np.maximum(best + model.bias, 0) @ model.out + model.out_bias, proof.argmax(axis=1)


def _words_of(column) -> tuple[np.ndarray, np.ndarray]:
    """All hashed forms in a row, and where each text's begin and end."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(arr.offsets).astype(np.int64)
    return np.asarray(arr.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _lowered(text: str) -> Column:
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def labelled(docs: DataFrame, labels: DataFrame, shard_rows: int, shard_bytes: int) -> tuple[DataFrame, list, int]:
    """((shard, doc_id, toxic, apart, lang, w), counts by label, shards): all labelled rows of the training fold, a shard in one file.

    w are the words' hashed forms. Texts are shuffled once, with the labels of their shard.
    """
    known = labels.where(in_training_fold() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic"))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    sizes = docs.select("doc_id", F.octet_length("text").alias("b")).join(known, "doc_id")
    counts = sizes.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("b").alias("b")).collect()
    shards = max(1, -(-sum(r["n"] for r in counts) // shard_rows), -(-sum(r["b"] or 0 for r in counts) // shard_bytes))
    bitmap = docs.sparkSession.sparkContext.broadcast(id_filter(known.select("doc_id")))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            yield batch.filter(pa.array(passes(bitmap.value, np.asarray(batch.column(0).fill_null(0)))))

    # only texts that have a label, but for a few, are shuffled
    texts = docs.mapInArrow(some, "doc_id long, text string, lang string").where("doc_id IS NOT NULL")
    rows = texts.withColumn("is_text", F.lit(True)).unionByName(known.withColumn("is_text", F.lit(False)), allowMissingColumns=True)
    shard, apart = F.pmod(F.xxhash64("doc_id"), F.lit(shards)), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    rows = rows.withColumn("shard", shard).repartition(shards, "shard")
    given = F.collect_list("toxic").over(Window.partitionBy("shard", "doc_id"))  # labels of one document
    rows = rows.withColumn("given", given).where("is_text").select("shard", "doc_id", F.explode("given").alias("toxic"), apart.alias("apart"), "lang", "text")
    rows = rows.sortWithinPartitions("shard", "doc_id", "toxic", "lang", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", SCORED_BYTES):
            ids, code, sizes = coded_words(batch.column(5))
            edge = np.append(0, np.cumsum(sizes) * len(FORMS)).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(edge), pa.array(ids[code].ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], words], [*batch.schema.names[:5], "w"])

    rows = rows.select("shard", "doc_id", "toxic", "apart", "lang", _lowered("text").alias("text"))
    return written(rows.mapInArrow(hashed, "shard long, doc_id long, toxic int, apart boolean, lang string, w array<int>"), "shards"), counts, shards


def fit(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> Model:
    """A model from docs(doc_id, text, lang) and labels(doc_id, toxic): all labelled rows of the training fold."""
    rows, counts, shards = labelled(docs, labels, shard_rows, shard_bytes)
    total = {r["toxic"]: r["n"] for r in counts}
    if len(total) < 2:
        return train([([], y, None) for y in total])  # a constant
    spark = docs.sparkSession
    languages = sorted(r["lang"] for r in rows.where("lang IS NOT NULL").select("lang").distinct().collect())
    weight = {y: 0.5 * sum(total.values()) / n for y, n in total.items()}
    net = _Net(np.random.default_rng(SEED))
    rounds, epochs = (1, EPOCHS) if shards == 1 else (ROUNDS, 1)
    words = rows.select("shard", "toxic", "apart", "lang", "w")
    count_from = len(net.flat())  # rows from here on count the words of each language
    tally = np.zeros(-(-BUCKETS * max(1, len(languages)) // DIM) * DIM).reshape(-1, DIM)
    columns = [f"d{i}" for i in range(DIM)]
    schema = ", ".join(["row long", *[f"{c} long" for c in columns]])
    for turn in range(rounds):
        common = spark.sparkContext.broadcast(net.flat())  # a fixed number of buckets and filters

        def learn(batches: Iterator[pa.RecordBatch], turn=turn, common=common) -> Iterator[pa.RecordBatch]:
            for table in runs(batches, "shard"):
                shard = np.asarray(table.column("shard").combine_chunks())
                for a in np.flatnonzero(np.diff(shard, prepend=-1)) if len(shard) else []:
                    own = table.slice(int(a), int((shard == shard[a]).sum()))
                    ids, edge = _words_of(own.column("w"))
                    toxic, lang = np.array(own.column("toxic").combine_chunks()), own.column("lang").to_pylist()
                    mine = np.flatnonzero(~own.column("apart").to_numpy())
                    for j, name in enumerate(languages if turn == 0 else []):
                        found = [ids[x:y : len(FORMS)] for x, y, z in zip(edge, edge[1:], lang) if z == name]
                        at, n = np.unique(np.concatenate([ids[:0], *found]), return_counts=True)
                        cell = at.astype(np.int64) + j * BUCKETS
                        row, place = np.unique(cell // DIM, return_inverse=True)
                        counts = np.zeros((len(row), DIM), np.int64)
                        counts[place, cell % DIM] = n
                        yield pa.RecordBatch.from_arrays([pa.array(row + count_from), *[pa.array(counts[:, i]) for i in range(DIM)]], ["row", *columns])
                    texts = [_padded(ids[x:y]).astype(np.int32) for x, y in zip(edge, edge[1:])]
                    ids = own = found = None
                    rng = np.random.default_rng([SEED, turn, int(shard[a])])
                    local = _Net(rng)
                    local.load(common.value)
                    for _ in range(epochs):
                        local.epoch(rng, texts, toxic, mine, weight)
                    texts, new = None, local.flat()
                    local = None
                    at = np.append(np.flatnonzero((new[:BUCKETS] != common.value[:BUCKETS]).any(axis=1)), np.arange(BUCKETS, len(new)))
                    change = np.rint((new[at].astype(np.float64) - common.value[at]) * UNIT).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(change[:, i]) for i in range(DIM)]], ["row", *columns])
                    new = change = None

        changes = words.mapInArrow(learn, schema).groupBy("row").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns])
        found = changes.toArrow()  # at most a row for each bucket and, once, for each DIM buckets of each language
        at, n, sums = found.column("row").to_numpy(), found.column("n").to_numpy(), np.stack([found.column(c).to_numpy() for c in columns], axis=1)
        of_net = at < count_from
        new = net.flat()
        new[at[of_net]] += (sums[of_net] / n[of_net, None] / UNIT).astype(np.float32)
        net.load(new)
        tally[at[~of_net] - count_from] += sums[~of_net]
        found = changes = sums = new = None
    tally = tally.ravel()[: BUCKETS * max(1, len(languages))].reshape(-1, BUCKETS).T + 0.5
    evidence = np.log(tally / tally.sum(axis=0)).astype(np.float32)
    evidence[PADDING] = 0
    model = net.model(languages, evidence, np.zeros(tally.shape[1]))
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "w"):
            if batch.num_rows:
                ids, edge = _words_of(batch.column(3))
                z, language = logits(shared.value, ids.reshape(-1, len(FORMS)), np.diff(edge) // len(FORMS))
                z = np.rint(z.astype(np.float64) * LOGIT_UNIT).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(language.astype(np.int64)), pa.array(z)], ["toxic", "apart", "language", "z"])

    # sizes by rounded logit: their number doesn't follow the rows
    judged = words.select("toxic", "apart", "lang", "w").mapInArrow(judge, "toxic int, apart boolean, language long, z long")
    sizes = judged.groupBy("apart", "language", "z").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).toArrow()
    apart, of, z, bad, n = (sizes.column(c).to_numpy(zero_copy_only=False) for c in ("apart", "language", "z", "bad", "n"))
    own = apart if bad[apart].sum() >= 10 else np.ones(len(z), bool)
    base = _cut(z[own], bad[own], n[own])
    model.thresholds = np.full(tally.shape[1], base)
    for j in range(len(languages)):
        mine = own & (of == j)
        least = min(int(bad[mine].sum()), int((n[mine] - bad[mine]).sum()))
        if least >= CALIBRATION_ROWS:
            share = least / (least + CALIBRATION_ROWS)
            model.thresholds[j] = share * _cut(z[mine], bad[mine], n[mine]) + (1 - share) * base
    return model


def _cut(z: np.ndarray, bad: np.ndarray, n: np.ndarray) -> float:
    """_threshold() of rounded logits, of which each stands for n rows, `bad` of them with label 1."""
    values, at = np.unique(-z, return_inverse=True)
    hit, rows = np.cumsum(np.bincount(at, bad)), np.cumsum(np.bincount(at, n))
    k = int((2 * hit / (rows + bad.sum())).argmax())
    low = -values[k + 1] if k + 1 < len(values) else -values[k] - LOGIT_UNIT
    return float((low - values[k]) / 2 / LOGIT_UNIT)


def score(docs: DataFrame, model: Model, only: tuple[str, ...] | None = None) -> DataFrame:
    """docs with score and predicted, from the text alone; only: the columns to pass through, all if None."""
    fields = [f for f in docs.schema if f.name not in ("score", "predicted") and (only is None or f.name in only)]
    names = [f.name for f in fields]
    (lowered,) = unused(names, "lowered")
    out = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets, filters and languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, lowered, SCORED_BYTES):
            ids, code, sizes = coded_words(batch.column(batch.schema.get_field_index(lowered)))
            z = score_texts(shared.value, ids, sizes, code)
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(z, pa.float64()), pa.array((z >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return map_batches(docs.select(*quoted(names), _lowered("text").alias(lowered)), run, out)
