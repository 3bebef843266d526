"""Postings made within documents: as from tokens, without tokens that are shuffled or sorted with others'."""

import pytest

from lodestone.operators import index
from lodestone.plans import search_queries as q
from lodestone.plans.registry import QUERIES

ODD = [("seg_000001", -1, None), ("seg_000001", -2, ""), ("seg_000001", -3, "... !!"), ("seg_000001", -4, "Σας ΣΑΣ a - a b a"), ("seg_000001", -5, "one two"), ("seg_000001", -5, "two three")]


@pytest.fixture(scope="module")
def docs(spark):
    found = q.docs(spark, "/root/testdata/sf0.001").drop("path")
    return found.unionByName(spark.createDataFrame(ODD, "segment_id string, doc_id long, text string"))


def test_postings_of_texts_equal_those_of_tokens(docs):
    want = index.postings(index.tokens(docs))
    got = index.text_postings(docs).cache()
    rows = got.drop("tf", "doc_len")
    assert rows.exceptAll(want).count() == want.exceptAll(rows).count() == 0
    assert got.where("tf <> size(positions)").count() == 0
    lengths = index.doc_lengths(index.tokens(docs))
    own = got.select("segment_id", "doc_id", "doc_len").distinct()
    assert own.exceptAll(lengths).count() == lengths.exceptAll(own).count() == 0
    assert {(r.term, tuple(r.positions)) for r in got.where("doc_id = -5").collect()} == {("one", (0,)), ("two", (0, 1)), ("three", (1,))}
    got.unpersist()


@pytest.mark.parametrize("name", ["inverted_index", "position_gap_encode", "index_stats"])
def test_only_texts_are_dealt_for_postings(spark, name):
    """Before, the tokens of a task were grouped and sorted: its memory, or what it spilled, was many times its texts."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(pos" not in plan and "posexplode" not in plan
    assert "collect_list(text" in plan


def test_meta_of_texts_equals_that_of_tokens(docs):
    a, b = index.text_meta(docs), index.segment_meta(docs, index.tokens(docs))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_a_stored_segment_is_made_from_texts(spark, docs, tmp_path, monkeypatch):
    """A segment's postings come from texts by document: before, they were grouped from tokens and their lengths summed in a window."""
    from lodestone.sources import segments

    seen = []
    made = segments.text_postings
    monkeypatch.setattr(segments, "text_postings", lambda *a, **b: seen.append(b) or made(*a, **b))
    store = segments.SegmentStore(spark, f"file://{tmp_path}/store", buckets=4)
    own = docs.where("segment_id = 'seg_000001'").dropDuplicates(["doc_id"])
    store.append(own.select("doc_id", "text", index.F.lit("p").alias("path")))
    assert seen == [{"buckets": 4}]
    want = index.postings(index.tokens(own)).select("term", "doc_id", "positions")
    got = store.read("postings").select("term", "doc_id", "positions")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_texts_are_normalized_once(spark):
    """Terms of a marked text are those of its tokens; before, each token went through a regular expression of its own."""
    from lodestone.functions import text

    odd = ["ΟΔΟΣ ΣΑΣ. Σ a\u0001b \u0001 İstanbul ǅ ﬃ", "x y z　-​!", "a1²³ ½ Ⅷ é é \U0001d54f\U0001f600 don't", "", " \t\n", None, "\u0085a\u001cb c", "ẞß ŉ ΑΣ́ Σ1Σ_Σ"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    rows = rows.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(index.F.col("text").alias("t")))
    one = index.F.transform(text.raw_tokens(index.F.col("t")), text.normalize)
    all_at_once = index.F.transform(text.raw_tokens(text.marked(index.F.col("t"))), text.unmarked)
    assert rows.where(~one.eqNullSafe(all_at_once)).count() == 0
    plan = index.text_postings(q.docs(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(lower(translate(regexp_replace(" in plan
