"""The ten operators on small tables: brute force, round trips and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import (
    common, decontamination, language_id, line_dedup, minhash, packing, queries, shingles, substring_dedup, topk,
    toxicity, url_filter, warc,
)

from . import brute

EDGE = [None, "", " \t\n", "one", "One", "two words", "é è ü", "a\n\na\n", "x" * 300_000, "w " * 20_000]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


# --- 1 packing


def places(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by)


def test_pack_is_gapless_and_exact(docs_of):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    rng = random.Random(1)
    texts = EDGE + ["a<|endoftext|>b <|ENDOFTEXT|> \x01 don't I'll, É. ΣΣ \x1c q"] + [words(rng, rng.randrange(1, 900)) for _ in range(150)]
    rows = packing.pack(docs_of(texts), path).collect()
    inner = Tokenizer.from_file(path)
    want = {}
    for i, t in enumerate(texts):
        ids = inner.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    total = sum(r.length for r in rows)
    assert places(rows) <= -(-total // 4096) + 3


def test_pack_nothing_and_keep_ids(docs_of):
    path = queries.tokenizer_path()
    assert packing.pack(docs_of([]), path).collect() == []
    (row,) = packing.pack(docs_of(["hello"]), path, keep_ids=True).collect()
    assert row.ids[-1] == 1 and row.length == len(row.ids)


def test_other_operators_free_the_words_that_packing_keeps():
    import public_tokenizers
    import pyarrow as pa

    path, batch = public_tokenizers.path("word_bpe_49k.json"), pa.RecordBatch.from_arrays([pa.array(["a b"])], ["text"])
    first = packing._tokenizer(path)
    first.encode_all(["some words"])
    list(common.small_batches(iter([batch]), "text", kept=packing._tokenizer.cache_clear))
    assert packing._tokenizer(path) is first and first.ids  # packing's own next task finds them
    list(common.small_batches(iter([batch]), "text"))
    assert packing._tokenizer.cache_info().currsize == 0


def test_words_are_kept_in_little_memory(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(1000)) for _ in range(60)]
    tokenizer = packing.WordTokenizer(queries.tokenizer_path())
    tokenizer.encode_all(["a b"])
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    tokenizer.encode_all(texts)
    taken = pa.total_allocated_bytes() - before + tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(tokenizer.ids) > 59_000 and taken < 80 * 60_000
    # words that are left out later don't matter
    monkeypatch.setattr(packing, "CACHED_WORDS", 500)
    texts = [*texts[:5], "İ, Ça. ça,. É### x'' 12, İ\u0307. \u0958, \u00a0, n\u0303. =\u0338 don't' A<|endoftext|>, ..", "x" * 60 + "! " + "é" * 60, "", *texts[:2]]
    for text in [*texts, *texts]:
        want = tokenizer.inner.encode(text, add_special_tokens=False).ids
        assert tokenizer.encode_all([text, ""]) == [np.array(want, "<u4").tobytes(), b""]
        assert len(tokenizer.ids) < 2600


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_everything_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6, 1.2, 3000).astype(int), 1, 4096)
    histogram = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
    made = packing.plan(histogram, groups=32)
    used = np.zeros(made.sequences, int)
    for length, _, count, first, each, offset in sorted(made.places, key=lambda p: p[5]):
        for i in range(count):
            assert used[first + i // each] == offset + (i % each) * length
            used[first + i // each] += length
    assert made.rank == histogram and used.max() <= 4096
    assert made.sequences <= 1.02 * -(-lengths.sum() // 4096) + 2


# --- 2 WARC


def test_warc_round_trip(spark, tmp_path):
    big, other = "b" * 1200, "é" * 600
    pages = [(1, "http://a/", big), (5, "http://b/", big), (5, "http://b2/", big), (3, None, None), (4, 'q"\\\r\nü', "small"), (6, "u", "small"), (7, "u", other), (None, "n", other)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = warc.archive(df, f"file://{tmp_path}")
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_records(index).collect()]
    want = [(1, "revisit", 5, 1200), (5, "response", None, 1200), (5, "revisit", 5, 1200), (3, "response", None, 0), (4, "response", None, 5), (6, "response", None, 5), (7, "response", None, 1200), (None, "revisit", 7, 1200)]
    assert sorted(got, key=str) == sorted(want, key=str)
    full = {(r.page_id, r.url): bytes(r.payload) for r in warc.read_records(index, payload=True).collect() if r.record_type == "response"}
    assert full[4, 'q"\\\r\nü'] == b"small" and full[7, "u"] == other.encode()
    import gzip
    from pathlib import Path

    for file in {r.file for r in index.collect()}:
        data = Path(file.removeprefix("file://")).read_bytes()
        rows = warc.read_index(f"{file}.idx")
        assert sum(r[1] for r in rows) == len(data) and gzip.decompress(data).startswith(b"WARC/1.1")
        for offset, length, record, *_ in rows:
            assert f"WARC-Record-ID: {record}".encode() in gzip.decompress(data[offset : offset + length])


def test_warc_empty_and_broken(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.archive(df, f"file://{tmp_path}")).collect() == []
    with pytest.raises(ValueError):
        list(warc.iterate_records([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"]))


# --- 3 near duplicates


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(docs_of, k):
    rng = random.Random(k)
    base = [words(rng, rng.randrange(20, 200)) for _ in range(12)]
    texts = EDGE[:8] + [edited(rng, rng.choice(base), rng.choice([0, 0.02, 0.04, 0.06, 0.1])) for _ in range(150)]
    rows = list(enumerate(texts))
    want = brute.near_duplicates(rows, k)
    got = minhash.near_duplicates(docs_of(texts), words=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_clusters_meet_in_blocks(docs_of, monkeypatch):
    for name, value in {"LEAF": 8, "BLOCK": 24, "PIVOTS": 4, "DEPTH": 4}.items():
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(3)
    base = [words(rng, 120) for _ in range(3)]
    texts = [edited(rng, base[0], 0.03) for _ in range(150)] + [edited(rng, base[i % 2 + 1], 0.06) for i in range(60)]
    got = minhash.near_duplicates(docs_of(texts), words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_duplicates(list(enumerate(texts)), 2)


def test_near_duplicates_null_ids_and_empty(docs_of, spark):
    text = "a b c d e f g h"
    rows = [(None, text), (4, text), (4, text), (2, text), (9, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(None, None, True), (4, 2, False), (4, 2, False), (2, 2, True), (9, 9, True)], key=str)
    assert minhash.near_duplicates(docs_of([])).collect() == []
    assert {r.doc_id for r in minhash.keep_one(docs_of([text, text, "z"])).collect()} == {0, 2}


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, local):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), local).collect()}
    up = {}
    for a, b in edges:
        if a != b:
            up.setdefault(a, a), up.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up


def test_word_hashes_depend_on_words_only(monkeypatch):
    texts = [b"a bb ccc", b"bb", b"", b"  ccc\x0b\x0ca ", "é x".encode() * 3]
    one = [shingles.batch_hashes([t])[0].tolist() for t in texts]
    assert [h.tolist() for h in shingles.batch_hashes(texts)] == one
    assert one[0][1] == one[1][0] and one[0][2] == one[3][0] and one[0][0] == one[3][1]
    monkeypatch.setattr(shingles, "PART", 8)
    long = shingles.batch_hashes([b"a bb ccc bb a ccc a"])[0].tolist()
    assert long == [one[0][i] for i in (0, 1, 2, 1, 0, 2, 0)]


# --- 4 repeated passages


def test_repeated_passages(docs_of):
    rng = random.Random(9)
    shared = words(rng, 60, 10**6)
    texts = [words(rng, 100, 10**6) + " " + (shared + " " if i % 3 == 0 else "") + words(rng, 150, 10**6) for i in range(12)] + EDGE[:8]
    rows = substring_dedup.repeated_passages(docs_of(texts)).collect()
    assert {r.doc_id for r in rows} | {r.partner_id for r in rows} == brute.passages(list(enumerate(texts)), 50) == {0, 3, 6, 9}
    assert all(abs(r.start - 100) <= 2 and 58 <= r.n_words <= 62 and r.similarity >= 0.8 for r in rows)
    assert substring_dedup.repeated_passages(docs_of([])).collect() == []


@pytest.mark.parametrize("few", [0, 10**6])
def test_passages_of_exact_copies(spark, monkeypatch, few):
    """A copy's row spans its whole text, whether the copies' ids are broadcast or shuffled."""
    monkeypatch.setattr(substring_dedup, "FEW_COPIES", few)
    rng = random.Random(21)
    text, short = words(rng, 80, 10**6), "too short to count"
    rows = [(1, words(rng, 80, 10**6)), (2, text), (3, text), (3, text), (4, short), (5, short), (6, None), (7, None), (8, ""), (9, ""), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r) for r in substring_dedup.repeated_passages(docs).collect()] == [(3, 0, 80, 2, 0, 1.0)]


def test_exact_part_with_a_shingle_that_the_partner_has_twice():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 1 << 32, 46, dtype=np.uint32)
    other = np.concatenate([passage[20:22], rng.integers(0, 1 << 32, 90, dtype=np.uint32), passage])
    own = np.concatenate([other[30:34], rng.integers(0, 1 << 32, 8, dtype=np.uint32), passage, rng.integers(0, 1 << 32, 5, dtype=np.uint32), other[40:60]])
    found = substring_dedup.verify([(100, own)], other, 46, 80)
    assert found == [(112, 157, 92, 1.0)]


def test_recall_of_near_passages(docs_of):
    """Of 400 passages of 54 words with one changed (similarity 0.82) no more are lost than by five functions with two needed."""
    rng = random.Random(31)
    texts = []
    for _ in range(400):
        passage = words(rng, 54, 10**9).split(" ")
        for middle in (passage[27], "changed"):
            texts.append(" ".join([words(rng, 60, 10**9), *passage[:27], middle, *passage[28:], words(rng, 60, 10**9)]))
    found = {(r.doc_id, r.partner_id) for r in substring_dedup.repeated_passages(docs_of(texts)).collect() if r.start <= 60 and r.start + r.n_words >= 114}
    assert found <= {(2 * i + 1, 2 * i) for i in range(400)} and len(found) >= 394


@pytest.mark.parametrize("copies", [12, 40])
def test_passages_that_no_anchor_has(docs_of, copies):
    """Near copies of a template, edited where two of them have 50 words of their own: under few and many windows a key."""
    rng = random.Random(41)
    template = [f"w{i}x" for i in range(200)]
    texts = []
    for i in range(copies):
        text = list(template)
        for at in range(0, 200, 10):  # no two share 50 words, but for the last two
            if i < copies - 2 or not 70 <= at < 130:
                text[at + rng.randrange(10)] = f"e{i}x{at}"
        texts.append(" ".join(text))
    got = substring_dedup.repeated_passages(docs_of(texts)).collect()
    assert brute.passages(list(enumerate(texts)), 50) == {copies - 2, copies - 1}
    assert any(r.doc_id == copies - 1 and r.partner_id == copies - 2 for r in got)


@pytest.mark.parametrize("many", [0, 10**6])
def test_near_passage_that_no_anchor_has(docs_of, monkeypatch, many):
    """As above, but the last two differ in a word amid their 60, so no 50 words are equal; their key has over FEW windows."""
    monkeypatch.setattr(substring_dedup, "MANY", many, raising=False)
    rng = random.Random(43)
    template, copies = [f"w{i}x" for i in range(200)], 80
    texts = []
    for i in range(copies):
        text = list(template)
        for at in range(0, 200, 10):
            if i < copies - 2 or not 70 <= at < 130:
                text[at + rng.randrange(10)] = f"e{i}x{at}"
        text[100] = text[100] if i < copies - 1 else "changed"
        texts.append(" ".join(text))
    assert brute.passages(list(enumerate(texts)), 50) == set()
    got = substring_dedup.repeated_passages(docs_of(texts)).collect()
    assert any(r.doc_id == copies - 1 and r.partner_id == copies - 2 and r.similarity >= 0.8 for r in got)


def test_covered_stretches_equal_brute_force():
    rng = np.random.default_rng(7)
    for t, needed in ((1, 1), (3, 2), (5, 2), (4, 4)):
        of = np.sort(rng.integers(0, 12, 60))
        k, left = rng.integers(0, 5, 60).astype(np.int8), rng.integers(0, 30, 60).astype(np.int32)
        right = (left + rng.integers(0, 12, 60)).astype(np.int32)
        wanted = []
        for group in range(12):
            places = [len({f for o, f, a, b in zip(of, k, left, right) if o == group and a <= p <= b}) >= needed for p in range(50)]
            first = [p for p in range(50) if places[p] and not (p and places[p - 1])]
            wanted += [(group, a, b - 1) for a in first if (b := places.index(False, a)) - a >= t]
        assert list(zip(*(x.tolist() for x in substring_dedup.covered(of, k, left, right, t, needed)))) == wanted
    none = np.zeros(0, np.int64)
    assert [len(x) for x in substring_dedup.covered(none, none, none, none, 3, 2)] == [0, 0, 0]


def test_only_later_documents_are_compared_with_earlier_ones(spark):
    """Of stretches in two documents the earlier one can be a partner only, the later one, where it has hot windows, a document only."""
    rng = np.random.default_rng(8)
    shared, line = rng.integers(0, 1 << 32, 60, dtype=np.uint32), rng.integers(0, 1 << 32, 20, dtype=np.uint32)
    near = shared.copy()
    near[[10, 40]] += np.uint32(1)
    own = [rng.integers(0, 1 << 32, 60, dtype=np.uint32) for _ in range(4)]
    texts = {1: [line, own[0]], 2: [own[1], shared], 5: [near, line, own[2]], 7: [line, shared], 9: [line, own[3]]}
    good = [(i, 100, 99 + sum(map(len, x)), np.concatenate(x).tobytes()) for i, x in texts.items()]
    good = spark.createDataFrame(good, "doc_id long, first int, last int, s binary")
    windows = [(i, 1, 0, 100, 110, 300) for i in (1, 2, 5, 9)]  # 7 has none that isn't settled
    hot = spark.createDataFrame(windows, "doc_id long, key long, k byte, l int, c int, r int")
    found = {(r.doc_id, r.partner): (r.first, r.last) for r in substring_dedup.earlier(hot, good, 10, 46, 80).collect()}
    assert set(found) == {(5, False), (2, True)}
    for (i, partner), (a, b) in {(5, False): (100, 159), (2, True): (160, 219)}.items():
        assert found[i, partner][0] <= a and found[i, partner][1] >= b


def test_dense_places_hold_all_similar_stretches():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = rng.integers(0, 60, int(rng.integers(1, 40)))
        hit, t = np.isin(x, rng.integers(0, 60, 70)), int(rng.integers(1, 12))
        marked = substring_dedup.dense(hit, substring_dedup._before(x) >= 0, t, 80)
        for a in range(len(x)):
            for b in range(a + t, len(x) + 1):
                there = len(set(x[a:b][hit[a:b]].tolist()))
                assert 100 * there < 80 * len(set(x[a:b].tolist())) or marked[a:b].all()


def best_similarity(own, other):
    """The largest Jaccard similarity of the whole of own with any stretch of 46 shingles or more of the other text."""
    x, best = set(own.tolist()), 0
    for a in range(len(other)):
        y, common = set(), 0
        for k, v in enumerate(other[a : a + 2 * len(own)].tolist()):
            common += v in x and v not in y
            y.add(v)
            if k >= 45:
                best = max(best, common / (len(x) + len(y) - common))
    return best


@pytest.mark.parametrize("seed", range(60))
def test_near_passages_equal_brute_force(seed):
    """Passages of 50 to 100 words with changed, added and left out words are found from 0.8 on, and reported rows are so similar."""
    rng = np.random.default_rng(seed)
    passage = rng.integers(0, 1 << 40, 50 if seed < 10 else int(rng.integers(50, 101)), dtype=np.uint64)
    copy, at = passage.copy(), len(passage) // 2
    if seed < 20:  # one changed word in the middle
        copy[at] += np.uint64(1)
    elif seed < 30:
        copy = np.insert(copy, at, rng.integers(0, 1 << 40, 7, dtype=np.uint64))
    elif seed < 40:
        copy[[at, at + 5]] += np.uint64(1)
    elif seed < 50:
        copy = np.delete(copy, slice(at, at + 4))
    else:
        copy[rng.integers(3, len(copy) - 3, 2)] += np.uint64(1)
    noise = [rng.integers(0, 1 << 40, 60, dtype=np.uint64) for _ in range(4)]
    own = shingles.shingles(np.concatenate([noise[0], passage, noise[1]]), 5)
    other = shingles.shingles(np.concatenate([noise[2], copy, noise[3]]), 5)
    first, last = 60, 60 + len(passage) - 5
    real = best_similarity(own[first : last + 1], other)
    found = substring_dedup.verify([(0, own)], other, 46, 80)
    there = np.flatnonzero(np.isin(own[first : last + 1], other)) + first  # changed ends may be left out
    assert real < 0.8 or all(any(a <= p <= b for a, b, _, _ in found) for p in there)
    for a, b, _, similarity in found:
        assert b - a + 1 >= 46 and similarity >= 0.8 and best_similarity(own[a : b + 1], other) >= similarity - 1e-9


def test_cover_keeps_all_places():
    found = [(0, 60, 0, 1.0), (10, 70, 0, 1.0), (20, 80, 0, 1.0), (90, 140, 0, 1.0)]
    assert substring_dedup._cover(found) == [found[0], found[2], found[3]]


@pytest.mark.parametrize("t", [1, 3, 46, 50])
def test_grams_are_equal_where_the_stretches_are(t):
    x = np.random.default_rng(4).integers(0, 2, 50).astype(np.uint32)
    g = substring_dedup.grams(x, t)
    assert len(g) == 51 - t and len(substring_dedup.grams(x[: t - 1], t)) == 0
    assert all((g[i] == g[j]) == (x[i : i + t] == x[j : j + t]).all() for i in range(len(g)) for j in range(len(g)))


@pytest.mark.parametrize("alphabet", [2, 50, 10**9])
def test_compact_windows_hold_all_stretches(alphabet):
    """Each stretch of t places or more is within exactly one limit pair of windows with its minimum, equal minima included."""
    rng = np.random.default_rng(2)
    sequences = [shingles.mix(rng.integers(0, alphabet, n).astype(np.uint64)) for n in (60, 3, 7, 0, 40)]
    salts = np.array([5, 9], np.uint64)
    found = {}
    for k, which, low, left, c, right in substring_dedup.compact_windows(sequences, 7, salts):
        for w, v, a, m, b in zip(which.tolist(), low.tolist(), left.tolist(), c.tolist(), right.tolist()):
            assert a <= m <= b and b - a >= 6
            found.setdefault((k, w), set()).add((v, a, b))
    assert {w for _, w in found} == {0, 2, 4}
    for k, salt in enumerate(salts):
        for w in (0, 2, 4):
            x = (sequences[w] * salt >> np.uint64(20)).tolist()
            for i in range(len(x)):
                for j in range(i + 6, len(x)):
                    assert len([1 for v, a, b in found[k, w] if a <= i and j <= b and v == min(x[i : j + 1])]) == 1


# --- 5 lines


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_line_dedup(docs_of, broadcast):
    texts = [f"own {i}\n  Common LINE \nshort\n\nend" if i < 12 else f"own {i}\ncommon line" for i in range(14)] + [None, "", "é" * 100_000, "rare\nrare"]
    got = {r.doc_id: r for r in line_dedup.drop_common_lines(docs_of(texts), broadcast_keys=broadcast).collect()}
    assert len(got) == len(texts) and got[0].score == "x"
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if x.strip(" \t\n\x0b\x0c\r").lower() not in ("common line", "short", "end")]
        assert (got[i].text, got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert line_dedup.drop_common_lines(docs_of([])).collect() == []


def test_line_dedup_keeps_the_first(docs_of):
    got = {r.doc_id: r.text for r in line_dedup.drop_common_lines(docs_of(["a\nx", "a\ny", "b\na"]), min_documents=2, keep_first=True).collect()}
    assert got == {0: "a\nx", 1: "y", 2: "b"}


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_line_dedup_counts_documents(spark, broadcast):
    """Repeated rows of an id are one document, rows without an id none; columns of clashing names stay."""
    rows = [(1, "hello\nown")] * 10 + [(2, " HELLO")] + [(None, "hello")] * 3 + [(i, "common\nx") for i in range(3, 13)] + [(None, "common")]
    docs = spark.createDataFrame([(*r, "a", "b", "c", 7) for r in rows], "doc_id long, text string, `a.b` string, `_keys` string, `row` string, KEYS int")
    got = line_dedup.drop_common_lines(docs, broadcast_keys=broadcast).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str) == sorted(
        [(1, "hello\nown", 2, 0)] * 10 + [(2, " HELLO", 1, 0)] + [(None, "hello", 1, 0)] * 3 + [(i, "", 2, 2) for i in range(3, 13)] + [(None, "", 1, 1)], key=str
    )
    assert {(r["a.b"], r["_keys"], r["row"], r["KEYS"]) for r in got} == {("a", "b", "c", 7)}


# --- 6 URL lists


def test_url_filter(spark):
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    events = [("l", "host", "a.com", "add", at(5)), ("l", "host", "a.com", "add", at(6)), ("l", "host", "a.com", "remove", at(10)), ("l", "host", "b.com", "add", at(3)), ("l", "host", "b.com", "remove", at(3)), ("m", "domain", "evil.org", "add", at(1)), ("m", "prefix", "c.com/x", "add", at(1)), ("m", None, "z", "add", at(1)), ("m", "host", "a.com", None, at(1))]
    ev = spark.createDataFrame(events, "list string, kind string, value string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    captures = [(1, "http://A.com/q", at(4)), (2, "http://u@a.com:80/q", at(5)), (3, "http://a.com", at(9)), (4, "http://a.com", at(10)), (5, "http://b.com", at(4)), (6, "https://x.evil.org/", at(2)), (7, "https://notevil.org/", at(2)), (8, "http://c.com/x/y?z", at(2)), (9, "http://c.com/xy", at(2)), (10, None, at(2)), (11, "nonsense", at(2)), (12, "http://a.com", None), (None, "http://a.com", at(7))]
    df = spark.createDataFrame(captures, "page_id long, url string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.page_id: r.blocked for r in url_filter.judge(df, ev).collect()}
    assert {k for k, v in got.items() if v} == {2, 3, 6, 8, None} and len(got) == 13
    assert url_filter.judge(df.limit(0), ev).count() == 0 and url_filter.judge(df, ev.limit(0)).where("blocked").count() == 0


def test_url_filter_takes_very_long_urls_and_odd_columns(spark):
    """Keys follow the lists' longest entries, not the URL's length; repeated captures are one row; other columns aren't read."""
    at = F.lit("2024-01-02 00:00:00").cast("timestamp")
    deep = "http://a.b.c.example.org/" + "/".join(f"s{i}" for i in range(20_000))
    rows = [(1, deep), (2, "http://" + "x." * 5000 + "evil.org/"), (3, "http://c.com/x/y/z"), (3, "http://c.com/x/y/z"), (4, "")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, kind string, `a.b` int").withColumn("at", at).withColumn("value", F.lit(2))
    events = [("m", "prefix", "a.b.c.example.org/s0/s1", "add"), ("m", "domain", "evil.org", "add"), ("m", "prefix", "c.com/x/y", "add"), ("m", "prefix", "c.com/x/y", "add")]
    ev = spark.createDataFrame(events, "list string, kind string, value string, action string").withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = {r.page_id: (r.blocked, r.n_entries) for r in url_filter.judge(df, ev).collect()}
    assert got == {1: (True, 1), 2: (True, 1), 3: (True, 1), 4: (False, 0)}
    assert url_filter.keys(F.col("u"), 0, 0) is not None


# --- 7 benchmark items


def test_decontamination(docs_of, spark):
    rng = random.Random(4)
    items = [(i, words(rng, rng.randrange(14, 50), 10**6)) for i in range(8)] + [(8, "tiny item"), (9, None), (None, "a b c d e f")]
    texts = [words(rng, 60, 10**6) + " " + edited(rng, items[i % 8][1], rng.choice([0, 0, 0.03, 0.1])) + " " + words(rng, 40, 10**6) for i in range(40)]
    texts += EDGE[:8] + ["some TINY\nitem here", items[0][1], " ".join(items[1][1].split()[:10])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs_of(texts), bench).collect()}
    assert got == brute.contaminated(list(enumerate(texts)), [(j, t) for j, t in items if j is not None])
    left = {r.doc_id for r in decontamination.clean(docs_of(texts), bench).collect()}
    assert left == set(range(len(texts))) - {i for i, _ in got}
    assert decontamination.clean(docs_of(texts), bench.limit(0)).count() == len(texts)


def test_decontamination_sorts_out_most_pairs_and_loses_none(docs_of, spark):
    """Items of few sizes and common phrases, edited up to and over the threshold, held against all windows of all texts."""
    rng = random.Random(77)
    common = words(rng, 8, 10**6)
    items = [(i, f"{words(rng, 10 + 4 * (i % 3), 10**6)} {common} {words(rng, 12, 30)}") for i in range(60)]
    texts = []
    for i in range(240):
        inner = items[rng.randrange(60)][1] if i % 4 else common
        if i % 4 == 3:  # parts in another order
            w = inner.split(" ")
            inner = " ".join(w[len(w) // 2 :] + w[: len(w) // 2])
        texts.append(" ".join([words(rng, rng.randrange(40), 30), edited(rng, inner, rng.choice([0, 0.02, 0.05])), words(rng, rng.randrange(40), 30)]).strip())
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(texts)
    want = brute.contaminated(list(enumerate(texts)), items)
    got = [(r.doc_id, r.item_id) for r in decontamination.contaminated(docs.unionByName(docs.limit(30)), bench.withColumn("a.b", F.lit(1))).collect()]
    assert len(want) > 50 and sorted(got) == sorted(want)
    found = decontamination.items_of(bench)
    other = found.select((F.col("item_id") + 1000).alias("doc_id"), F.size("h").alias("m"), F.lit(0).alias("start"), "h", F.expr(decontamination._SIMHASH).alias("fp"))
    pairs = other.alias("a").join(found.alias("b"), F.size("a.h") == F.size("b.h")).count() - 60
    kept = decontamination.candidates(other, found, 80).where("doc_id <> item_id + 1000").count()
    assert kept <= 0.05 * pairs


def test_item_with_swapped_halves_is_found(docs_of, spark):
    rng = random.Random(51)
    item = words(rng, 100, 10**6).split(" ")
    text = " ".join([words(rng, 150, 10**6), *item[50:], *item[:50], words(rng, 150, 10**6)])
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    rows = decontamination.contaminated(docs_of([text]), bench).collect()
    assert [(r.doc_id, r.item_id, r.start) for r in rows] == [(0, 7, 150)] and rows[0].similarity == 92 / 100


# --- 8 top k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = [(rng.normal(size=8) * rng.choice([0.1, 1, 30])).tolist() for _ in range(300)]
    v[7], v[8], v[9], v[10] = None, [float("nan")] * 8, v[11], [0.0] * 8
    v[12] = v[12][:5] + [None] * 3
    v[0], v[50] = [3.0] * 8, [0.0] * 8
    df = spark.createDataFrame([(i, x, "e") for i, x in enumerate(v)], "vec_id long, embedding array<float>, extra string")
    ints = {i: np.floor(256 * np.array(x, np.float32).astype(float)).astype(np.int64) for i, x in enumerate(v) if x and None not in x and np.isfinite(x).all()}
    want = []
    for q in ints:
        if q % 50 == 0:
            best = sorted(((-int(ints[q] @ ints[c]), c) for c in ints if c != q))[:5]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    got = topk.top_k(df, block=40, query_block=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0)).collect() == []
    assert topk.top_k(df.where("vec_id IN (0, 50)")).count() == 2


def test_top_k_deals_fewer_pairs_where_norms_are_spread(spark):
    """Ties, repeated ids, extra columns, and blocks of short vectors that no query group is sent to."""
    rng = np.random.default_rng(8)
    v = [(rng.normal(size=6) * 0.8 ** (i % 12)).tolist() for i in range(600)]
    v[3] = v[4] = v[5]
    rows = [(i, x, 1, 2) for i, x in enumerate(v)] + [(5, v[5], 1, 2), (50, v[50], 1, 2), (None, v[0], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, `group` int, `a.b` int")
    ints = [(r[0], np.floor(256 * np.array(r[1])).astype(np.int64)) for r in rows if r[0] is not None]
    report = {}
    got = topk.top_k(df.where("vec_id <> 50 OR vec_id IS NULL"), block=20, query_block=2, report=report).collect()
    assert report["skipped"] > report["dealt"] / 4 > 0
    ints = [x for x in ints if x[0] != 50]
    want = sorted(w for q, x in ints if q % 50 == 0 for w in sorted((q, -int(x @ y), c) for c, y in ints if c != q)[:5])
    assert sorted((r.query_id, -r.score, r.vec_id) for r in got) == want


def test_top_k_deals_a_block_once_to_many_queries(spark):
    """Vectors of one length, as of a normed model: no block is too short for a query, so groups must be large."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(3000, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(50 * i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    report = {}
    got = topk.top_k(df, block=500, report=report).groupBy("query_id").agg(F.collect_list(F.struct("rank", "vec_id", "score")).alias("r")).collect()
    assert 0 < report["dealt"] + report["skipped"] <= 3000 / 250  # one group; about 6 blocks and some of rounded lengths
    ints = np.floor(256 * v).astype(np.int64)
    scores = ints @ ints.T
    assert len(got) == 3000
    for r in rng.choice(np.array(got, object), 200):
        q = r[0] // 50
        order = [c for c in np.lexsort((np.arange(3000), -scores[q]))[:6] if c != q][:5]
        assert sorted(map(tuple, r[1])) == [(n + 1, 50 * int(c), int(scores[q, c])) for n, c in enumerate(order)]


# --- 9 toxicity


def test_toxicity_learns_and_scores_all_texts(spark, docs_of):
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = words(rng, rng.randrange(20, 120)).split(" ")
        if bad:
            t[rng.randrange(len(t))] = rng.choice(["vilest", "foulmouth", "nasty"])
        texts.append(" ".join(t))
        labels.append((i, int(bad)))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs_of(texts), lab)
    got = {r.doc_id: r for r in toxicity.score(docs_of(texts + EDGE), model).collect()}
    assert len(got) == len(texts) + len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.9
    none = toxicity.score(docs_of(["a"]), toxicity.fit(docs_of(["a"]), lab.limit(0))).collect()
    assert none[0].score == 0


def test_toxicity_learns_from_all_labelled_rows(spark, docs_of):
    """Over shards, each in one file: languages are counted on the words of every row of the fold (w12x is two), in any partitions."""
    rng = random.Random(8)
    texts = [words(rng, 12) + (" nasty" if i % 4 == 0 else "") for i in range(600)]
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    rows, _, shards = toxicity.labelled(docs_of(texts), lab, 100, 10**9)
    fold = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(r.doc_id for r in rows.collect()) == fold and shards == -(-len(fold) // 100)
    files = rows.groupBy(F.input_file_name(), "shard").count().groupBy("shard").count().collect()
    assert all(r["count"] == 1 for r in files)  # no shard in two files
    one, two = (toxicity.fit(docs_of(texts).repartition(n), lab, 100, 10**9) for n in (3, 7))
    assert np.array_equal(one.table, two.table) and np.array_equal(one.thresholds, two.thresholds)
    assert np.isclose(np.exp(one.evidence[1:]).min(), 0.5 / (24 * len(fold) + sum(i % 4 == 0 for i in fold) + toxicity.BUCKETS / 2))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs_of(texts), one).collect()}
    assert np.mean([got[i] == (i % 4 == 0) for i in range(600) if i not in fold]) > 0.9


def plain_score(model, ids):
    """One text through embedding, filters, maxima, output and threshold, word by word."""
    edge, forms = max(toxicity.WIDTHS) - 1, len(toxicity.FORMS)
    words = [list(ids[i : i + forms]) for i in range(0, len(ids), forms)]
    padding = [[toxicity.PADDING] * forms]
    padded = padding * edge + words + padding * (edge + (not words))
    x = [sum(model.table[i].astype(float) for i in w) for w in padded]
    z, column = model.out_bias, 0
    for i, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            values = [sum(float(x[a + j] @ model.taps[:, column + j * toxicity.FILTERS + f]) for j in range(width)) for a in range(len(x) - width + 1)]
            z += model.out[i * toxicity.FILTERS + f] * max(0.0, max(values) + model.bias[i * toxicity.FILTERS + f])
        column += width * toxicity.FILTERS
    language = np.argmax(sum(model.evidence[w[0]].astype(float) for w in padded))
    return 1 / (1 + np.exp(-(z - model.thresholds[language])))


def test_toxicity_shuffles_labelled_texts_once(spark, monkeypatch):
    rows = [(i % 90 if i % 7 else None, f"a b{i} c", "en" if i % 2 else None) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    given = [(i % 70, i % 3) for i in range(0, 140, 2)]
    plans, write = [], toxicity.written

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *args)

    monkeypatch.setattr(toxicity, "written", seen)
    found, counts, shards = toxicity.labelled(docs, spark.createDataFrame(given, "doc_id long, toxic int"), 10, 10**6)
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1 and "Join" not in plans[0]
    want = [(i, y, lang) for i, _, lang in rows if i is not None and zlib.crc32(str(i).encode()) % 5 for j, y in given if j == i and y < 2]
    assert shards > 1 and sorted(((r.doc_id, r.toxic, r.lang) for r in found.collect()), key=str) == sorted(want, key=str)
    assert sum(r["n"] for r in counts) == len(want) and all(len(r.w) == 9 for r in found.collect())


def test_toxicity_scores_without_passing_texts_on(docs_of):
    docs, model = docs_of(["a b", None, ""]), toxicity.train([([], 1, None)])
    found = toxicity.score(docs, model, ("doc_id",))
    assert found.columns == ["doc_id", "score", "predicted"]
    assert found.orderBy("doc_id").collect() == toxicity.score(docs, model).select(found.columns).orderBy("doc_id").collect()


def test_toxicity_equals_a_plain_network(docs_of, spark):
    rng = random.Random(12)
    texts = [words(rng, rng.randrange(5, 30)) + (" nasty" if i % 3 == 0 else "") for i in range(90)] + [None, "", "one", "ties ties ties"]
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(3, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    docs = docs_of(texts).withColumn("words", F.lit(1)).withColumn("a.b", F.lit(2)).unionByName(docs_of(["ties"], [5]).withColumn("words", F.lit(1)).withColumn("a.b", F.lit(2)))
    model = toxicity.fit(docs, lab)
    got = toxicity.score(docs, model).collect()
    ids = {(r.doc_id, r.text): r.w for r in docs.select("doc_id", "text", toxicity.word_ids(F.col("text")).alias("w")).collect()}
    assert len(got) == 95 and all(r["words"] == 1 and r["a.b"] == 2 for r in got)
    assert np.allclose([r.score for r in got], [plain_score(model, ids[r.doc_id, r.text]) for r in got], atol=1e-4)


def test_toxicity_hashes_distinct_words_as_spark_does(docs_of):
    rng = random.Random(21)
    letters = "aB\u00dc\u00df\u0130\u03a3\u03c3\u4e2d\u0301\U00010400z9_ \n\t-'\u00a0\0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["", " ", "\n", "word", " word ", "a" * 40_000, "abcdefgh abcd abcde abcdefgh", "same " * 3000, "-x-"]
    rows = docs_of(texts).select("doc_id", toxicity._lowered("text").alias("low"), toxicity.word_ids(F.col("text")).alias("w")).orderBy("doc_id").collect()
    ids, code, sizes = toxicity.coded_words(pa.array([r.low for r in rows], pa.string()))
    got = np.split(ids[code], np.cumsum(sizes)[:-1])
    assert [g.ravel().tolist() for g in got] == [r.w for r in rows] and len(ids) == len(np.unique(code))
    none = toxicity.coded_words(pa.array([], pa.string()))
    assert [len(x) for x in none] == [0, 0, 0]


def test_toxicity_distinct_words_score_as_all_words():
    rng = np.random.default_rng(4)
    model = toxicity.train([(rng.integers(1, 90, 3 * int(n)).tolist(), int(n % 2), "en") for n in rng.integers(1, 60, 60)], epochs=1)
    ids, sizes = rng.integers(1, 90, (20, 3)), np.array([0, 5, 0, 70, 1])
    code = rng.integers(0, 20, int(sizes.sum()))
    assert np.allclose(toxicity.score_texts(model, ids, sizes, code), toxicity.score_texts(model, ids[code], sizes), atol=1e-6)


def test_toxicity_chunks_don_t_matter(monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(rng.integers(1, 900, 3 * int(n)).tolist(), int(n % 2), "en") for n in rng.integers(1, 60, 60)]
    model = toxicity.train(rows, epochs=1)
    sizes = np.array([len(r[0]) // 3 for r in rows] + [0])
    ids = np.concatenate([np.array(r[0]) for r in rows]).reshape(-1, 3)
    whole = toxicity.score_texts(model, ids, sizes)
    monkeypatch.setattr(toxicity, "CHUNK", 16)
    assert np.allclose(whole, toxicity.score_texts(model, ids, sizes), atol=1e-5)


# --- 10 language


def ppm_bits(sample, text):
    """The definition, byte by byte."""
    counts = {}
    data = b"   " + b"".join(x for t in sample for x in (b"   ", t))
    for i in range(3, len(data)):
        for k in range(4):
            c = counts.setdefault(bytes(data[i - k : i]), {})
            c[data[i]] = c.get(data[i], 0) + 1
    bits = 0.0
    text = b"   " + text
    for i in range(3, len(text)):
        for k in (3, 2, 1, 0):
            c = counts.get(bytes(text[i - k : i]))
            if not c:
                continue
            total, distinct = sum(c.values()), len(c)
            if text[i] in c:
                bits -= np.log2(c[text[i]] / (total + distinct))
                break
            bits -= np.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(monkeypatch):
    a, b = [b"the cat sat on the mat", b"then the dog"], ["le chat était là".encode(), b"la le les"]
    model = language_id.train({"en": a, "fr": b})
    texts = [b"the chat \xff", b"", b"zz", b"le dog et the cat" * 5]
    want = np.array([[ppm_bits(a, t), ppm_bits(b, t)] for t in texts])
    assert np.allclose(language_id.code_lengths(model, texts), want, rtol=1e-3, atol=1e-2)
    monkeypatch.setattr(language_id, "CHUNK", 7)
    assert np.allclose(language_id.code_lengths(model, texts), want, rtol=1e-3, atol=1e-2)


def test_language_id_held_out(spark, tables, docs_of):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    found = language_id.predict(docs, language_id.fit(docs)).where(~common.in_training_fold())
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    got = [(r.lang_pred, 0 <= r.score <= 1) for r in language_id.identify(docs_of([None, "", "123 !?", "hello there"])).collect()]
    assert got[:3] == [("und", True)] * 3
    assert language_id.identify(docs_of([])).collect() == []


# --- queries and pipeline


@pytest.mark.parametrize("name", [n for n in queries.ORACLES if n.startswith("op")])
def test_query_equals_sql(spark, tables, name):
    import duckdb
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(tables).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, tables).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        before, kept = kept, spark.read.parquet(str(tmp_path / name))
        assert kept.columns == docs.columns
        rows = [(r.doc_id, r.text) for r in before.collect()]
        left = {r.doc_id for r in kept.collect()}
        if name == "near_dedup":
            assert left == {i for i, (_, c) in brute.near_duplicates(rows, 5).items() if i == c}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
            assert left == {i for i, _ in rows} - {i for i, _ in brute.contaminated(rows, items)}
        if name == "line_dedup":
            assert left == {i for i, _ in rows}
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept.collect()}
    places(pieces)


def test_pipeline_passes_odd_columns_nulls_and_repeats(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(60)
    odd = {"score": F.lit(1.5), "lang_pred": F.lit("p"), "n_lines": F.lit(3), "n_dropped": F.array(F.lit(1)), "a.b": F.lit("dot"), "KEY": F.lit(9)}
    docs = docs.withColumns(odd)
    none = {"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}
    some = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs.unionByName(docs.where("doc_id % 7 = 0")).unionByName(docs.limit(1).withColumns(none)).unionByName(some)
    for name, frame in (("full", docs), ("empty", docs.limit(0))):
        kept = frame
        for step, stage in corpus_pipeline.STAGES[:-1]:
            path = str(tmp_path / name / step)
            stage(spark, kept, d).write.parquet(path)
            kept = spark.read.parquet(path)
            assert kept.columns == docs.columns
        rows = kept.collect()
        assert (len(rows) > 40) == (name == "full")
        assert {(r["score"], r["lang_pred"], r["n_lines"], tuple(r["n_dropped"]), r["a.b"], r["KEY"]) for r in rows} <= {(1.5, "p", 3, (1,), "dot", 9)}
        assert name == "empty" or None in {r.doc_id for r in rows}
        assert (corpus_pipeline.STAGES[-1][1](spark, kept, d).count() >= len(rows)) if rows else corpus_pipeline.STAGES[-1][1](spark, kept, d).collect() == []
