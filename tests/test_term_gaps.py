"""Gaps of a term in one pass: equal to those by ranges, with one shuffle of postings and none of positions."""

import re

import pytest

from lodestone.operators import index
from lodestone.plans import search_queries as q
from lodestone.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["postings_size", "postings_size_mb", "doc_gap_encode", "doc_gap_decode"])
def test_postings_are_shuffled_once(spark, name):
    """Before, a range's last ids were joined to all postings, which were made and sorted twice or more, positions and all."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len([x for x in dealt if "term" in x]) == 1 and "Join" not in plan
    assert plan.count("Scan parquet") == 1
    assert re.search(r"Exchange hashpartitioning\(segment_id#\d+, term#\d+, \d+\), REPARTITION_BY_NUM", plan)


def test_one_pass_equals_ranges(spark):
    docs = q.docs(spark, "/root/testdata/sf0.001")
    posts = q.postings(spark, "/root/testdata/sf0.001").cache()
    dealt = index.by_term(posts, docs)
    rows = lambda f: sorted(map(tuple, f.collect()))
    assert rows(index.gap_rows(dealt, None)) == rows(index.gap_rows(posts, 16))
    assert rows(index.ungap_rows(index.gap_rows(dealt, None), "doc_id", None)) == rows(posts.select("segment_id", "term", "doc_id"))
    assert rows(index.postings_size(dealt, None)) == rows(index.postings_size(posts, 16))
    posts.unpersist()


def test_many_documents_go_by_ranges(spark, monkeypatch):
    docs = q.docs(spark, "/root/testdata/sf0.001")
    assert index.term_ranges(docs) is None
    monkeypatch.setattr(index, "RANGE_ROWS", docs.count() - 1)
    assert index.term_ranges(docs) == docs.count() - 1
    monkeypatch.setattr(index, "TERM_BYTES", 1 << 10)  # as many tasks as the texts need
    assert index.by_term(q.postings(spark, "/root/testdata/sf0.001"), docs).rdd.getNumPartitions() > 8


@pytest.mark.parametrize("name", ["doc_gap_encode", "doc_gap_decode", "postings_size"])
def test_ranges_shuffle_postings_once(spark, monkeypatch, name):
    """Beyond RANGE_ROWS documents all postings were shuffled again for each join with what the ranges before leave."""
    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, QUERIES[name](spark, d).collect()))
    monkeypatch.setattr(index, "RANGE_ROWS", 64)
    monkeypatch.setattr(index, "LIST_BITS", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = QUERIES[name](spark, d)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    assert sorted(map(tuple, found.collect())) == want
    ran = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]  # for all joins; own sizes of postings aren't wanted on both sides
    assert len([x for x in ran.splitlines() if "REPARTITION_BY_NUM" in x and "term" in x and "Reused" not in x]) == (2 if name == "postings_size" else 1)
    joins = plan.split("SortMergeJoin")[1:]
    for join in joins:  # the rows, the first child of a join, come sorted from the window without an exchange of their own
        below = join.splitlines()[1:]
        first = next(x for x in below if "Window" in x or "Exchange" in x)
        assert "Window" in first


def test_lists_of_ids_are_shuffled(spark):
    """A row an id was shuffled, with its segment and term."""
    rows = index.ids_by_term(q.docs(spark, "/root/testdata/sf0.001"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(_ids") < plan.index("REPARTITION_BY_NUM")
    posts = q.postings(spark, "/root/testdata/sf0.001").select("segment_id", "term", "doc_id")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, posts.collect()))
    text = "a b a"
    odd = spark.createDataFrame([("s", -5, text), ("s", 2**60 + 3, text), ("s", None, "c"), ("s", 1023, "b"), ("s", 1024, "b")], "segment_id string, doc_id long, text string")
    got = {tuple(r) for r in index.ids_by_term(odd).collect()}
    assert got == {("s", t, i) for t in "ab" for i in (-5, 2**60 + 3)} | {("s", "c", None), ("s", "b", 1023), ("s", "b", 1024)}
