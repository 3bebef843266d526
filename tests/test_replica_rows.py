"""replica_fallback() shuffles a row a block and a row an id, not one a replica."""

from lodestone.operators import blocks as B
from lodestone.plans.registry import QUERIES


def test_replicas_meet_before_they_are_shuffled(spark):
    plan = QUERIES["replica_fallback"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "node_id#" in x.split("hashpartitioning")[1].split(")")[0]]


def test_odd_rows(spark):
    blocks = spark.createDataFrame([("a", 0, "x"), ("a", 0, "x"), ("a", 0, "y"), ("b", 1, "x"), (None, 0, "x"), ("c", 0, None), ("d", 0, "z")], "path string, idx long, id string")
    replicas = spark.createDataFrame([("a", 0, 2, "m"), ("a", 0, 1, "n"), ("a", 0, 0, "o"), ("b", 1, 0, None), (None, 0, 0, "n"), ("c", 0, 0, "n"), ("d", 0, 0, "o")], "path string, idx long, ord long, node_id string")
    readable = spark.createDataFrame([("x", "n"), ("x", "n"), ("x", "m"), ("y", "m"), ("z", None), (None, "n")], "id string, node_id string")
    got = {tuple(r) for r in B.replica_fallback(blocks, replicas, readable).collect()}
    assert got == {("a", 0, "x", "n", "ok"), ("a", 0, "y", "m", "ok"), ("b", 1, "x", None, "no_replicas"), (None, 0, "x", None, "no_replicas"), ("c", 0, None, None, "unreadable"), ("d", 0, "z", None, "unreadable")}
