"""All eleven commands on a live log: random logs over several micro-batches equal one pass and the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import kv
from lodestone.streaming import kv as stream_kv

from .test_fixtures import sequential

OPS = "seq long, now_ms long, op string, key string, value string, ttl_ms long"


def some_log(seed, n, backwards=False):
    rng, log, now = random.Random(seed), [], 0
    for seq in range(n):
        now = max(0, now + rng.choice([0, 0, 1, 3, 20, *([-9] if backwards else [])]))
        op = rng.choices(list(kv.ARITY), [1, 6, 4, 5, 3, 8, 4, 5, 1, 1, 0.5])[0]
        alone = op in ("PING", "KEYS", "DBSIZE", "CLEAR")
        log.append((seq, now, op, None if alone else f"k{rng.randrange(14)}", f"v{seq}", rng.choice([0, 5, 40, 200])))
    return log


def play(spark, tmp_path, frames, schema, shards):
    """Replies to frames that come one after the other, each run from the checkpoint of the one before."""
    for frame in frames:
        frame.repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        stream_kv.start(source, f"file://{tmp_path}/checkpoint", f"file://{tmp_path}/out", shards, available_now=True).awaitTermination(300)
    return sorted((r.seq, r.response) for r in spark.read.parquet(f"{tmp_path}/out").collect())


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("seed, backwards, shards", [(1, False, 4), (2, True, 1)])
def test_random_logs_over_micro_batches(spark, tmp_path, seed, backwards, shards):
    log = some_log(seed, 600, backwards)
    ops = spark.createDataFrame(log, OPS)
    cuts = [0, 150, 151, 420, 600]
    frames = [ops.where((F.col("seq") >= a) & (F.col("seq") < b)) for a, b in zip(cuts, cuts[1:])]
    got = play(spark, tmp_path, frames, ops.schema, shards)
    assert got == sequential(log)[0]
    if not backwards:
        assert got == sorted((r.seq, r.response) for r in kv.responses(ops).collect())


def test_broken_lines_and_empty_replies(spark, tmp_path):
    lines = ["KEYS", "DBSIZE", "SET a 1", "GET", "SETEX b x 2", "HELLO", "", "PING", "KEYS", "CLEAR", "GET a", "KEYS"]
    parsed = kv.parse(spark.createDataFrame([(i, 100 + i, x) for i, x in enumerate(lines)], "seq long, now_ms long, text string")).drop("text")
    want = ["$", ":0", "+OK", "-ERR InvalidArity", "-ERR InvalidInteger", "-ERR UnknownCommand", "-ERR EmptyCommand", "+PONG", "$a", "+OK", "$nil", "$"]
    assert play(spark, tmp_path, [parsed], parsed.schema, 3) == [(i, r + "\r\n") for i, r in enumerate(want)]


def test_a_batch_played_again_gives_the_same_replies(spark, tmp_path):
    """The batch's output is lost after its state was stepped: the checkpoint's old state is used again."""
    log = some_log(5, 120)
    ops = spark.createDataFrame(log, OPS)
    ops.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(ops.schema).parquet(f"{tmp_path}/in")
    seen = []

    def fail_once(replies, number):
        seen.append(sorted(map(tuple, replies.collect())))
        if len(seen) == 1:
            raise RuntimeError("lost")

    first = stream_kv.start(source, f"file://{tmp_path}/checkpoint", fail_once, 2, available_now=True)
    with pytest.raises(Exception, match="lost"):
        first.awaitTermination(300)
    stream_kv.start(source, f"file://{tmp_path}/checkpoint", fail_once, 2, available_now=True).awaitTermination(300)
    assert len(seen) == 2 and seen[0] == seen[1] == sequential(log)[0]
