"""Vector codes, quality and conversation repair against plain versions, held-out rows and edge cases."""

import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import conversations, quality, queries, vector_codes

from . import brute

# --- 11 vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(codes, errors, codebooks) of [(id, vector)], by comparing every part with every entry in whole numbers."""
    width = -(-max((len(v) for _, v in rows), default=0) // parts)
    ints = [[int(np.floor(float(x) * scale)) for x in v] + [0] * (parts * width - len(v)) for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], ints[i]))[:entries]
    cut = lambda v, j: v[j * width : (j + 1) * width]
    books = [[cut(ints[i], j) for i in order] for j in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for j in range(parts):
            own = [[] for _ in books[j]]
            for v in ints:
                own[nearest(cut(v, j), books[j])[1]].append(cut(v, j))
            books[j] = [[sum(c) // len(o) for c in zip(*o)] if o else b for o, b in zip(own, books[j])]
    found = [[nearest(cut(v, j), books[j]) for j in range(parts)] for v in ints]
    return [[e for _, e in f] for f in found], [sum(d for d, _ in f) for f in found], books


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string")


@pytest.mark.parametrize("size, width", [(60, 16), (300, 40), (9, 8), (40, 11)])
def test_codes_equal_a_full_comparison(spark, size, width):
    rng = np.random.default_rng(size)
    base = rng.normal(size=(5, width))
    rows = [(i, (base[i % 5] + rng.normal(0, 0.2, width)).astype("float32").tolist()) for i in range(size)]
    rows += [(size + i, rows[0][1]) for i in range(20)]  # copies
    rows += [(size + 20 + i, [0.0] * width) for i in range(5)]
    coded, books = vector_codes.compress(vectors_of(spark, [(i, v, i % 3 or None, "x") for i, v in rows]))
    codes, errors, want = plain_codes(rows)
    got = {r.id: r for r in coded.collect()}
    assert books.tolist() == want
    sums = {}
    for (i, _), e in zip(rows, errors):
        sums[i % 3 or None] = sums.get(i % 3 or None, 0) + e
    assert {i: (r.code, r.error, r.label_error) for i, r in got.items()} == {i: (c, e, sums[i % 3 or None]) for (i, _), c, e in zip(rows, codes, errors)}
    assert vector_codes.fingerprint(books) == hashlib.sha256(",".join(str(x) for b in want for e in b for x in e).encode()).hexdigest()


def test_bounds_sort_out_most_entries_and_never_the_nearest():
    rng = np.random.default_rng(3)
    entries = rng.integers(-4000, 4000, (16, 8))
    x = entries[rng.integers(0, 16, 5000)] + rng.integers(-900, 900, (5000, 8))
    x[:500] = (entries[3] + entries[7]) // 2  # ties or nearly
    index, error, exact = vector_codes.nearest(x, entries)
    far = ((x[:, None] - entries) ** 2).sum(axis=2)
    assert (index == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
    assert exact < 0.4 * far.size  # of components without any order; bounds by blocks do best where neighbours are alike
    smooth = np.repeat(entries[:, ::4], 4, axis=1)
    _, _, exact = vector_codes.nearest(smooth[rng.integers(0, 16, 5000)] + rng.integers(-300, 300, (5000, 8)), smooth)
    assert exact < 0.1 * far.size
    large = rng.integers(-vector_codes.MOST, vector_codes.MOST, (500, 8))
    index, error, _ = vector_codes.nearest(large + 1, large[:16])
    far = ((large[:, None] + 1 - large[:16]) ** 2).sum(axis=2)
    assert (index == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1, "x"), (2, [1.0, None], 1, "x"), (3, [nan], 1, "x"), (4, [inf, 0.0], 1, "x")]
    assert vector_codes.compress(vectors_of(spark, odd))[0].collect() == []
    coded, books = vector_codes.compress(vectors_of(spark, [*odd, (5, [1e30] * 8, None, "x"), (5, [-1e30] * 8, None, "x"), (None, [0.5], 2, "x"), (7, [], 2, "x")]))
    rows = coded.collect()
    assert sorted(r.id for r in rows if r.id is not None) == [5, 5, 7] and len(rows) == 4 and books.shape == (8, 4, 1)
    assert books[0, :2, 0].tolist() == [-vector_codes.MOST, vector_codes.MOST] and all(r.error == 0 for r in rows)


def test_label_sums_of_many_labels(spark):
    rows = [(i, i % 7 or None, [i], i) for i in range(300)]
    coded = spark.createDataFrame(rows, "id long, label long, code array<int>, error long")
    few, many = (sorted(map(tuple, vector_codes.with_label_error(coded, most=m).select("id", "label_error").collect())) for m in (100, 1))
    assert few == many and len(few) == 300


# --- 12 quality


def quality_rows(tables):
    read = lambda n: f"read_parquet('{Path(tables) / n}.parquet')"
    return duckdb.sql(f"SELECT doc_id, text, quality FROM {read('documents')} AS d JOIN {read('labels')} AS l USING (doc_id)").fetchall()


def test_quality_of_held_out_rows(spark, tables):
    got = {r.doc_id: r for r in queries.QUERIES["op12_quality"](spark, tables).collect()}
    rows = quality_rows(tables)
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    for label in (0, 1):
        own = [r.predicted == label for r, y in held if y == label]
        assert sum(own) >= 0.95 * len(own)
    assert len(got) == spark.read.parquet(f"{tables}/documents.parquet").count()


def test_quality_at_a_larger_scale_and_of_a_small_sample():
    rows = sorted(quality_rows("/root/testdata/sf0.1"))
    apart = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5][:800]
    model = quality.train([t or "" for _, t, _ in learn], np.array([y for _, _, y in learn]))
    import pyarrow as pa

    z = quality.margins(pa.array([t for _, t, _ in apart], pa.string()), *model.worth())
    good = z >= np.log(0.3 / 0.7)
    y = np.array([y for _, _, y in apart]) == 1
    assert (~good[~y]).mean() >= 0.95 and good[y].mean() >= 0.98


def test_features_are_words_and_grams():
    rows, owner = quality.features(["ab", "é", "abcdef"])
    sizes = np.bincount(owner).tolist()
    # " ab " has 2 grams of 3 and one of 4; " é " one of 3; " abcdef " 6 of 3, 5 of 4 and 4 of 5
    assert sizes == [1 + 2 + 1, 1 + 1, 1 + 6 + 5 + 4]
    again, own = quality.features(["abcdef", "ab"])
    assert sorted(again[own == 0]) == sorted(rows[owner == 2]) and sorted(again[own == 1]) == sorted(rows[owner == 0])


def test_quality_edges(spark, docs_of):
    texts = [None, "", " \n\t", "a", "x" * 300_000, "w " * 50_000, "\x1f\x1f\x1f\x1f", "\U0001f600   é"]
    docs = docs_of([*texts, *["good text here."] * 30, *["bad### text&&&"] * 30])
    labels = spark.createDataFrame([(i, int(i < 38), 0) for i in range(8, 68)] + [(None, 1, 0), (3, 7, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(rows) == 68 and rows[0].score == rows[1].score == rows[2].score and rows[0].lang == "en"
    assert {rows[i].predicted for i in range(8, 38)} == {1} and {rows[i].predicted for i in range(38, 68)} == {0}
    for given, want in ((labels.where("quality = 1"), 1.0), (labels.limit(0), 0.5)):
        constant = quality.fit(docs, given)
        assert {r.score for r in quality.score(docs, constant).collect()} == {want}
    assert quality.score(docs.limit(0), model).collect() == []
    bounded = quality.fit(docs, labels, sample_rows=40, sample_bytes=400)
    assert quality.score(docs, bounded).count() == 68


# --- 13 conversations

ROLES = ["system", "user", "assistant", "tool", None, "", "s", "User"]
TEXTS = ["a.", "b", "", "  ", "c!\n", None, "d?", "long. long. ", "é", "x\x1c"]


def some_turns(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(40), None]:
        for t in range(rng.randrange(1, 13)):
            for _ in range(rng.choice([1, 1, 1, 2])):
                rows.append((c, rng.choice([t, t, t + 2, None]), rng.choice(ROLES[:3] if rng.random() < 0.8 else ROLES), rng.choice(TEXTS)))
    return rows + [(999, t // 2, rng.choice(ROLES[:3]), rng.choice([f"x{t}.", f"x{t}", "a."])) for t in range(300)]


TURNS = "conv_id long, turn long, role string, text string"


def test_repair_query_equals_trying_all_edits(spark, tables, tmp_path):
    query = queries.QUERIES["op13_conversation_repair"]
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/conversations.parquet").collect()]
    assert {r.conv_id: tuple(r[1:]) for r in query(spark, tables).collect()} == brute.conversation_repair(rows)
    rows = some_turns(1)
    spark.createDataFrame(rows, TURNS).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.conv_id: tuple(r[1:]) for r in query(spark, str(tmp_path)).collect()} == brute.conversation_repair(rows)


@pytest.mark.parametrize("kept, stretch, piece", [(4096, 1 << 16, 16), (4096, 50, 1024), (3, 7, 4)])
def test_long_conversations_are_cut_into_stretches(spark, kept, stretch, piece):
    rows = [(c, t, r or " ", x or " ") for c, t, r, x in some_turns(2)]
    frame = spark.createDataFrame(rows, TURNS).withColumn("stretch", F.lit("extra"))
    reports, mended = conversations.repair(frame, True, kept, stretch, piece)
    by, lines = {}, {}
    for c, *rest in rows:
        by.setdefault(c, []).append(tuple(rest))
    for r in sorted(mended.collect(), key=lambda r: (r.stretch, r.seq, r.sub)):
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    order = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest"]
    got = {r.conv_id: tuple(r[k] for k in order) for r in reports.collect()}
    want = {c: brute.repaired(own) for c, own in by.items()}
    assert got == {c: w[0] for c, w in want.items()}
    assert lines == {c: w[1] for c, w in want.items() if w[1]}


def test_repair_of_nothing_and_of_rows_that_all_go(spark, tmp_path):
    frame = spark.createDataFrame([], TURNS)
    assert conversations.repair(frame)[0].collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "a.")], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


@pytest.mark.parametrize("seed", range(4))
def test_matrices_of_stretches_multiply_to_the_whole(seed):
    rng = random.Random(seed)
    for _ in range(150):
        classes = "".join(rng.choice("suao") for _ in range(rng.randrange(1, 9)))
        faults = "".join(rng.choice("  bdt") for _ in classes)
        cut = sorted(rng.sample(range(1, len(classes)), min(2, len(classes) - 1)))
        parts = []
        for a, b in zip([0, *cut], [*cut, len(classes)]):
            own = conversations._symbols(classes[a:b], faults[a:b])
            matrix = [(s, e, c, x) for e in conversations.GRAMMAR for s, (c, x, _) in conversations.shortest(own, {e: (0, "")}).items()]
            parts.append({"classes": classes[a:b], "matrix": matrix, "n": b - a, "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0})
        rows = conversations._solved("x", list(range(len(parts))), parts, 3)
        whole = conversations.solve(classes, faults)
        assert (rows[-1]["cost"], rows[-1]["audit"]) == whole[:2] and "".join(r["text"] for r in rows[:-1]) == whole[2]
