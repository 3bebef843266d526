"""Command logs as a stream, rows folded in the order of seq with the eviction of the reference semantics.

start() answers all eleven commands. Keys are dealt into a fixed number of shards; a shard's entries are map state in RocksDB, of which a
micro-batch touches the keys that it names. Commands on all keys (KEYS, DBSIZE, CLEAR) go to every shard, each of which sees them between its own
rows; what the shards say is put together by seq once the micro-batch is through. Time is the log's own (now_ms) and may go backwards; seq must
grow from batch to batch. An expired entry stays in the state until a command evicts it: a DEL before that still finds it.

Limits: a shard sorts its rows of a micro-batch, and after KEYS or DBSIZE holds its entries, in one task; more shards make both
smaller, and a source's trigger options bound the batch. The number of shards is fixed by the checkpoint.

responses() is the form with a state entry per key, for keyed commands alone; it leaves commands on all keys out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "seq long, key string, response string"
STATE = "present boolean, value string, deadline long"


def fold(rows: list[tuple], entry: tuple | None) -> tuple[list[tuple[int, str]], tuple | None]:
    """Replies to rows (seq, now_ms, op, value, ttl_ms) of one key and the entry (value, deadline) that is left."""
    out = []
    for seq, now, op, value, ttl in rows:
        late = entry is not None and entry[1] is not None and now >= entry[1]
        if op in ("SET", "SETEX"):
            entry, reply = (value, now + ttl if op == "SETEX" else None), "+OK"
        elif op == "DEL":
            entry, reply = None, f":{int(entry is not None)}"
        else:
            entry = None if late else entry
            if op == "GET":
                reply = "$nil" if entry is None else f"${entry[0]}"
            elif op == "EXISTS":
                reply = f":{int(entry is not None)}"
            elif op == "TTL":
                reply = ":-2" if entry is None else ":-1" if entry[1] is None else f":{entry[1] - now}"
            elif op == "PERSIST":
                reply = f":{int(entry is not None and entry[1] is not None)}"
                entry = entry and (entry[0], None)
            else:
                reply = "-ERR UnknownCommand"
        out.append((seq, reply + "\r\n"))
    return out, entry


def _of(value, kind):
    return None if value is None or pd.isna(value) else kind(value)


def _handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    entry = None
    if state.exists:
        present, value, deadline = state.get
        entry = (value, deadline) if present else None
    rows = pd.concat(list(frames)).sort_values("seq")
    log = [(int(r.seq), int(r.now_ms), r.op, r.value, _of(r.ttl_ms, int)) for r in rows.itertuples()]
    replies, entry = fold(log, entry)
    if entry is None:
        state.update((False, None, None))
    else:
        state.update((True, entry[0], entry[1]))
    yield pd.DataFrame({"seq": [s for s, _ in replies], "key": key[0], "response": [r for _, r in replies]})


def responses(ops: DataFrame) -> DataFrame:
    """(seq, key, response) for a stream of keyed commands; works on a batch frame through responses_batch()."""
    own = ops.where(F.col("key").isNotNull() & ~F.col("op").isin("KEYS", "DBSIZE", "CLEAR"))
    own = own.select("seq", "now_ms", "op", "key", "value", "ttl_ms")
    return own.groupBy("key").applyInPandasWithState(_handle, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def responses_batch(ops: DataFrame) -> DataFrame:
    """The same fold over a batch, for logs whose time goes backwards. All rows of a key meet in one task."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        replies, _ = fold([(int(r.seq), int(r.now_ms), r.op, r.value, _of(r.ttl_ms, int)) for r in rows.itertuples()], None)
        return pd.DataFrame({"seq": [s for s, _ in replies], "key": key[0], "response": [r for _, r in replies]})

    own = ops.where(F.col("key").isNotNull() & ~F.col("op").isin("KEYS", "DBSIZE", "CLEAR"))
    return own.groupBy("key").applyInPandas(run, OUT)


GLOBAL = ("KEYS", "DBSIZE", "CLEAR")
SHARDS = 64
#: What shards say: a reply, an error, or a shard's share of a global one (a key, or a number of entries).
SAID = "seq long, op string, part string, n long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Entries:
    """A shard's entries during a micro-batch: read when first named, written back once at its end."""

    def __init__(self, state):
        self.state, self.known, self.changed = state, {}, set()
        self.whole = self.cleared = False

    def get(self, key: str) -> tuple | None:
        if key not in self.known:
            there = not self.whole and not self.cleared and self.state.containsKey((key,))
            self.known[key] = tuple(self.state.getValue((key,))) if there else None
        return self.known[key]

    def put(self, key: str, entry: tuple | None) -> None:
        if self.get(key) != entry:
            self.known[key] = entry
            self.changed.add(key)

    def all(self) -> dict[str, tuple]:
        if not self.whole and not self.cleared:
            for key, entry in self.state.iterator():
                self.known.setdefault(key[0], tuple(entry))
        self.whole = True
        return {k: e for k, e in self.known.items() if e is not None}

    def clear(self) -> None:
        self.known, self.changed, self.cleared = {}, set(), True

    def save(self) -> None:
        if self.cleared:
            self.state.clear()
        for key in sorted(self.changed):
            if self.known[key] is not None:
                self.state.updateValue((key,), self.known[key])
            elif not self.cleared and self.state.containsKey((key,)):
                self.state.removeKey((key,))


class _Shard(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("entries", "key string", "value string, deadline long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        entries, out = _Entries(self.state), []
        for r in sorted(rows, key=lambda r: r.seq):
            if r.error is not None:
                out.append((r.seq, "reply", f"-ERR {r.error}\r\n", None))
            elif r.op == "PING":
                out.append((r.seq, "reply", "+PONG\r\n", None))
            elif r.op == "CLEAR":
                entries.clear()
                out.append((r.seq, r.op, None, 0))
            elif r.op in GLOBAL:
                live = entries.all()
                for k in [k for k, (_, deadline) in live.items() if deadline is not None and r.now_ms >= deadline]:
                    entries.put(k, None)
                    del live[k]
                out.append((r.seq, r.op, None, len(live)))
                out.extend((r.seq, r.op, k, 0) for k in live if r.op == "KEYS")
            else:
                replies, entry = fold([(r.seq, r.now_ms, r.op, r.value, r.ttl_ms)], entries.get(r.key))
                entries.put(r.key, entry)
                out.append((replies[0][0], "reply", replies[0][1], None))
        entries.save()
        for seq, op, part, n in out:
            yield Row(seq=seq, op=op, part=part, n=n)

    def close(self) -> None:
        pass


def said(ops: DataFrame, shards: int = SHARDS) -> DataFrame:
    """What each shard says to a stream of ops(seq, now_ms, op, key, value, ttl_ms and, if there is one, error)."""
    error = F.col("error") if "error" in ops.columns else F.lit(None).cast("string")
    everywhere = F.coalesce(F.col("op").isin(*GLOBAL), F.lit(False)) & F.isnull("error")
    own = F.pmod(F.xxhash64(F.coalesce("key", F.col("seq").cast("string"))), F.lit(shards)).cast("int")
    rows = ops.select("seq", "now_ms", "op", "key", "value", F.col("ttl_ms").cast("long").alias("ttl_ms"), error.alias("error"))
    dealt = rows.withColumn("shard", F.explode(F.when(everywhere, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(own))))
    return dealt.groupBy("shard").transformWithState(_Shard(), SAID, "append", "none")


def together(parts: DataFrame) -> DataFrame:
    """(seq, response) of a micro-batch from what its shards said."""
    shares = parts.where("op <> 'reply'").groupBy("seq", "op").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("part")).alias("keys"))
    text = F.when(F.col("op") == "CLEAR", "+OK").when(F.col("op") == "DBSIZE", F.concat(F.lit(":"), F.col("n").cast("string"))).otherwise(F.concat(F.lit("$"), F.array_join("keys", " ")))
    whole = shares.select("seq", F.concat(text, F.lit("\r\n")).alias("response"))
    return parts.where("op = 'reply'").select("seq", F.col("part").alias("response")).unionByName(whole)


def start(ops: DataFrame, checkpoint: str, answer: Callable[[DataFrame, int], None] | str, shards: int = SHARDS, available_now: bool = False) -> StreamingQuery:
    """Answer a stream of commands. answer takes (seq, response) and the number of each micro-batch, or is a folder for them.

    In a folder a batch has a part of its own, which a batch that is played again replaces; read it with Spark as Parquet. Sets the session's
    state store to RocksDB, which map state needs.
    """
    ops.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def give(parts: DataFrame, number: int) -> None:
        parts = parts.persist()  # two reads of a batch; the state is not to be stepped twice
        try:
            replies = together(parts)
            if isinstance(answer, str):
                replies.write.mode("overwrite").parquet(f"{answer}/batch={number}")
            else:
                answer(replies, number)
        finally:
            parts.unpersist()

    writer = said(ops, shards).writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(give)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
