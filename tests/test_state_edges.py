"""Times and CLEARs of many commands, states as text, requests that are refused, nodes that are down."""

import random

from pyspark.sql import functions as F

from lodestone.operators import blocks, cluster, kv


def test_running_sums_at_one_time(spark, monkeypatch):
    """Most events fall on one time, many of them on one place in it; spans are cut all the same."""
    rng = random.Random(3)
    rows = [(rng.choice([7, 7, 7, 7, rng.randrange(2000)]), rng.choice([-1, -1, i]), rng.choice([1, -1, 0]), i) for i in range(600)]
    events = spark.createDataFrame(rows, "now long, seq long, delta long, i long")
    want = {r[3]: sum(o[2] for o in rows if o[:2] < r[:2]) for r in rows}
    assert {r.i: r.before for r in kv.running(events).collect()} == want
    monkeypatch.setattr(kv, "SLICE", 16)
    assert {r.i: r.before for r in kv.running(events).collect()} == want
    assert kv.running(events.limit(0)).collect() == []


def test_following_clear(spark, monkeypatch):
    monkeypatch.setattr(kv, "SLICE", 4)
    seqs = [0, 1, 3, 17, 18, 40, 200]
    clears = spark.createDataFrame([(s, 10 * s) for s in seqs], "seq long, now_ms long")
    got = {r.era: r.n and (r.n.seq, r.n.now_ms) for r in kv.following_clear(clears).collect()}
    assert got == {a: b and (b, 10 * b) for a, b in zip(seqs, [*seqs[1:], None])}
    assert kv.following_clear(clears.limit(0)).collect() == []


def test_replies_are_equal_in_small_slices(spark, monkeypatch):
    """Many CLEARs, KEYS and deadlines at equal times."""
    rng = random.Random(5)
    rows = []
    for seq in range(240):
        op = rng.choice(["SET", "SETEX", "SETEX", "DEL", "GET", "TTL", "PERSIST", "EXISTS", "CLEAR", "KEYS", "DBSIZE"])
        key = None if op in ("CLEAR", "KEYS", "DBSIZE") else rng.choice("abcdefgh")
        rows.append((seq, seq // 40, op, key, f"v{seq}", rng.randrange(1, 4) if op == "SETEX" else None))
    ops = spark.createDataFrame(rows, "seq long, now_ms long, op string, key string, value string, ttl_ms long")
    want = {r.seq: r.response for r in kv.responses(ops).collect()}
    assert len(want) == 240
    monkeypatch.setattr(kv, "SLICE", 5)
    assert {r.seq: r.response for r in kv.responses(ops).collect()} == want


def test_states_as_text(spark):
    texts = [(s,) for s in ('"alive"', '"suspect"', ' "dead" ', '"unknown"', '"Alive"', '""', "alive", "null", "3", None, "")]
    got = spark.createDataFrame(texts, "t string").select("t", cluster.parse_state(F.col("t")).alias("p")).collect()
    bad = "not a JSON string"
    assert [(r.p.state, r.p.error) for r in got] == [
        ("alive", None), ("suspect", None), ("dead", None), ("unknown", None), (None, "unknown node state: Alive"),
        (None, "unknown node state: "), (None, bad), (None, bad), (None, bad), (None, bad), (None, bad),
    ]
    written = spark.createDataFrame([(s,) for s in (*cluster.STATES, "gone", None)], "s string").select(cluster.state_json(F.col("s")).alias("j"))
    assert [r.j for r in written.collect()] == ['"unknown"', '"alive"', '"suspect"', '"dead"', '"unknown"', '"unknown"']


def test_refused_rows(spark):
    beats = spark.createDataFrame([("a", "x"), ("", "x"), (None, None), ("b", None), ("c", "")], "id string, addr string")
    assert [(r.id, r.reason) for r in cluster.rejected_heartbeats(beats).collect()] == [("", "empty_id"), (None, "empty_id"), ("b", "empty_addr"), ("c", "empty_addr")]
    asked = spark.createDataFrame([("p", 1, 1), ("", 1, 1), (None, 0, 1), ("p", None, 1), ("p", 1, 0), ("", 1, None), ("p", -1, -1)], "path string, block_size long, replicas long")
    reasons = ["empty_path", "invalid_block_size", "invalid_block_size", "invalid_replicas", "invalid_replicas", "invalid_block_size"]
    assert [r.reason for r in cluster.rejected_requests(asked).collect()] == reasons


def test_failover_equals_replica_fallback(spark):
    rows = [("p", i, f"b{i}", nodes) for i, nodes in enumerate([["x", "y"], ["y", "x"], ["y"], [], None, ["z", "y", "x"]])]
    listed = spark.createDataFrame(rows, "path string, idx long, id string, nodes array<string>")
    replicas = listed.select("path", "idx", "id", F.posexplode("nodes").alias("ord", "node_id"))
    for down in ([], ["y"], ["x", "y", "z"]):
        readable = replicas.where(~F.col("node_id").isin(down) if down else F.lit(True)).select("id", "node_id")
        want = blocks.replica_fallback(listed.drop("nodes"), replicas.drop("id"), readable)
        got = blocks.failover(listed, spark.createDataFrame([(n,) for n in down], "node_id string"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
