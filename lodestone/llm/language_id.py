"""Language identification by prediction by partial matching (PPM).

For each language, a tree of byte contexts of order 0 to 3 with symbol counts. A byte costs -log2 of its estimate in
the longest context that was seen in training; a byte new to that context pays the escape probability (method C:
distinct symbols against all) and goes on in the next shorter one, down to one byte in 256. After training the counts
are frozen, so a text's code length is exact and doesn't depend on other texts. The language with the shortest code
wins; the score is its share of the probabilities.

The tree is kept as sorted arrays of (context, byte) numbers with the whole chain of escapes summed in advance.
Training reads a fixed pseudo-random sample of about TRAIN_BYTES of text a language, whole texts only.

Defined cases: null text, or text without a letter: `und`, score 0. Ties go to the alphabetically first language.
Without training rows all is `und`; repeated rows are trained on and scored like any other. Extra columns are passed
through; the two columns that are added replace those of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_below, in_training_fold, map_batches, quoted, small_batches

ORDER, TRAIN_BYTES, PAD = 3, 1_500_000, b"   "
UNKNOWN = "und"
#: Bytes that are scored at a time.
CHUNK = 1 << 18


@dataclass
class Model:
    """keys[k]: seen (context of k bytes, byte); costs[k]: bits by language; contexts[k], escapes[k]: of contexts."""

    languages: list[str]
    keys: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """The byte at each place from ORDER on with the k before it, as numbers."""
    n = len(data) - ORDER
    out = np.zeros(max(0, n), np.uint32)
    for j in range(k, -1, -1):
        out = (out << np.uint32(8)) | data[ORDER - j : ORDER - j + n].astype(np.uint32)
    return out


def padded(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x for t in texts for x in (PAD, t)), np.uint8)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in keys, -1 for those that aren't there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def train(samples: dict[str, list[bytes]]) -> Model:
    """A model from texts by language."""
    languages = sorted(samples)
    counted = {}
    for lang in languages:
        data = np.concatenate([np.frombuffer(PAD, np.uint8), padded(samples[lang])])
        counted[lang] = [np.unique(grams(data, k), return_counts=True) for k in range(ORDER + 1)]
    model = Model(languages, [], [], [], [])
    for k in range(ORDER + 1):
        keys = np.unique(np.concatenate([counted[lang][k][0] for lang in languages]))
        contexts = np.unique(keys >> np.uint32(8))
        costs = np.zeros((len(keys), len(languages)))
        escapes = np.zeros((len(contexts), len(languages)))
        shorter = keys & np.uint32((1 << (8 * k)) - 1)
        fallback = _bits(model, shorter, k - 1) if k else np.full(costs.shape, 8.0)
        for j, lang in enumerate(languages):
            own, n = counted[lang][k]
            context, start = np.unique(own >> np.uint32(8), return_index=True)
            total, distinct = np.add.reduceat(n, start), np.diff(np.append(start, len(own)))
            at = np.searchsorted(contexts, context)
            escapes[at, j] = -np.log2(distinct / (total + distinct))
            costs[:, j] = fallback[:, j] + escapes[np.searchsorted(contexts, keys >> np.uint32(8)), j]
            of = np.searchsorted(context, own >> np.uint32(8))
            costs[np.searchsorted(keys, own), j] = -np.log2(n / (total[of] + distinct[of]))
        model.keys.append(keys)
        model.costs.append(costs.astype(np.float32))
        model.contexts.append(contexts)
        model.escapes.append(escapes.astype(np.float32))
    return model


def _bits(model: Model, wanted: np.ndarray, k: int) -> np.ndarray:
    """Bits of each (context, byte) of order k in each language."""
    at = _find(model.keys[k], wanted)
    bits = model.costs[k][at]
    missed = np.flatnonzero(at < 0)
    if len(missed):
        rest = wanted[missed]
        context = _find(model.contexts[k], rest >> np.uint32(8))
        escape = np.where((context >= 0)[:, None], model.escapes[k][context], 0)
        bits[missed] = escape + (_bits(model, rest & np.uint32((1 << (8 * k)) - 1), k - 1) if k else 8.0)
    return bits


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text in each language. Texts are scored whole, in chunks that overlap by the context."""
    out = np.zeros((len(texts), len(model.languages)))
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        data = padded(texts[at:end])
        own = np.array([len(t) for t in texts[at:end]])
        first = np.cumsum(own + len(PAD)) - own - ORDER  # where each text's own bytes begin among the grams
        for a in range(0, max(0, len(data) - ORDER), CHUNK):
            part = grams(data[a : a + CHUNK + ORDER], ORDER)
            distinct, which = np.unique(part, return_inverse=True)
            bits = _bits(model, distinct, ORDER)
            doc = np.searchsorted(first, np.arange(a, a + len(part)), side="right") - 1
            place = np.arange(a, a + len(part)) - first[doc]
            inside = (doc >= 0) & (place < own[doc])
            for j in range(bits.shape[1]):
                w = np.where(inside, bits[which, j], 0)
                out[at:end, j] += np.bincount(np.maximum(doc, 0), weights=w, minlength=end - at)
        at = end
    return out


def fit(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> Model | None:
    """A model from rows (doc_id, text, lang) of the training fold with a language; None if there are none."""
    rows = docs.where(in_training_fold() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if not sizes:
        return None
    test = F.lit(False)
    for lang, n in sizes.items():
        test = test | ((F.col("lang") == lang) & hash_below(train_bytes / n, "doc_id", "text"))
    samples: dict[str, list[bytes]] = {}
    for r in rows.where(test).toLocalIterator():  # about train_bytes a language
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    if missing := sizes.keys() - samples.keys():  # a language with a few texts, all beyond the sample's bound
        for r in rows.where(F.col("lang").isin(*missing)).groupBy("lang").agg(F.min(F.struct(F.length("text"), "doc_id", "text")).alias("r")).collect():
            samples[r["lang"]] = [r["r"]["text"].encode()]
    return train(samples)


def predict(docs: DataFrame, model: Model | None, added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score under the names `added`, from the text alone."""
    fields = [f for f in docs.schema if f.name not in added]
    names = [f.name for f in fields]
    out = T.StructType([*fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # follows train_bytes, not the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in small_batches(batches, "text"):
            found = batch.column(batch.schema.get_field_index("text")).to_pylist()
            langs, scores = [UNKNOWN] * len(found), [0.0] * len(found)
            at = [i for i, t in enumerate(found) if t and known is not None and any(map(str.isalpha, t))]
            if at:
                bits = code_lengths(known, [found[i].encode() for i in at])
                best = bits.argmin(axis=1)
                share = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0)).sum(axis=1)
                for i, b, s in zip(at, best, share):
                    langs[i], scores[i] = known.languages[b], float(1 / s)
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, *added])

    return map_batches(docs.select(*quoted(names)), run, out)


def identify(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """fit() and predict() on one table."""
    return predict(docs, fit(docs, train_bytes))
