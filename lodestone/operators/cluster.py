"""Nodes: heartbeats, health and placement. nodes(id, addr, capacity, used, last_seen, state)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States and default ages.
STATES = ("unknown", "alive", "suspect", "dead")
SUSPECT_AFTER_S, DEAD_AFTER_S = 30, 90


def latest_heartbeat(heartbeats: DataFrame, now: Column | None = None) -> DataFrame:
    """The last heartbeat of each node to arrive, whatever its own time; the node is alive.

    heartbeats(arrival_seq, id, addr, capacity, used, time). Empty or null id or addr: left out. A null time is now.
    """
    valid = heartbeats.where((F.col("id") != "") & (F.col("addr") != ""))
    last = valid.groupBy("id").agg(F.max_by(F.struct("addr", "capacity", "used", "time"), "arrival_seq").alias("b"))
    seen = F.coalesce(F.col("b.time"), now) if now is not None else F.col("b.time")
    return last.select("id", "b.addr", "b.capacity", "b.used", seen.alias("last_seen"), F.lit("alive").alias("state"))


def _missing(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def rejected_heartbeats(heartbeats: DataFrame) -> DataFrame:
    """The heartbeats that latest_heartbeat() leaves out, and why: reason is empty_id or, with an id, empty_addr."""
    reason = F.when(_missing("id"), "empty_id").when(_missing("addr"), "empty_addr")
    return heartbeats.withColumn("reason", reason).where("reason IS NOT NULL")


def rejected_requests(requests: DataFrame) -> DataFrame:
    """Requests(path, block_size, replicas, ...) to store a file that can't be met whatever the nodes, and why.

    reason: invalid_block_size and invalid_replicas (null or not positive), then empty_path. The first one counts.
    """
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    reason = F.when(~positive("block_size"), "invalid_block_size").when(~positive("replicas"), "invalid_replicas")
    return requests.withColumn("reason", reason.when(_missing("path"), "empty_path")).where("reason IS NOT NULL")


def parse_state(text: Column) -> Column:
    """struct(state, error) of a state's JSON text, a string with one of STATES exactly; error says what else it was.

    What is no JSON string is invalid, as is null.
    """
    value = F.from_json(F.concat(F.lit('{"s":'), text, F.lit("}")), "s string", {"mode": "PERMISSIVE"})["s"]
    value = F.when(text.rlike(r'(?s)^[ \t\r\n]*".*"[ \t\r\n]*$'), value)
    known = F.coalesce(value.isin(*STATES), F.lit(False))
    error = F.when(value.isNull(), "not a JSON string").when(~known, F.concat(F.lit("unknown node state: "), value))
    return F.struct(F.when(known, value).alias("state"), error.alias("error"))


def state_json(state: Column) -> Column:
    """A state as JSON text; whatever is no state is written as unknown. The inverse of parse_state()."""
    return F.concat(F.lit('"'), F.when(state.isin(*STATES), state).otherwise("unknown"), F.lit('"'))


def register(nodes: DataFrame, now: Column) -> DataFrame:
    """Fill in what a registration leaves out: last_seen now, state alive; a given state stays."""
    state = F.coalesce(F.nullif("state", F.lit("unknown")), F.lit("alive"))
    return nodes.withColumn("last_seen", F.coalesce("last_seen", now)).withColumn("state", state)


def unregister(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id"), "id", "left_anti")


def get_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The registered ones of ids(id); the whole frame is the list."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def update_state(nodes: DataFrame, node_id: str, state: str) -> DataFrame:
    """Set a node's state; a missing node changes nothing."""
    if state not in STATES:
        raise ValueError(f"unknown node state: {state}")
    return nodes.withColumn("state", F.when(F.col("id") == node_id, state).otherwise(F.col("state")))


def evaluate_health(nodes: DataFrame, now: Column, suspect_s: float = SUSPECT_AFTER_S, dead_s: float = DEAD_AFTER_S) -> DataFrame:
    """state from the age of last_seen; ages at a limit are past it; null: unknown. Earlier states don't count."""
    age = F.unix_micros(now) - F.unix_micros("last_seen")
    state = (
        F.when(F.col("last_seen").isNull(), "unknown")
        .when(age >= int(dead_s * 1_000_000), "dead")
        .when(age >= int(suspect_s * 1_000_000), "suspect")
        .otherwise("alive")
    )
    return nodes.withColumn("state", state)


def alive_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("state") == "alive")


def placement_candidates(nodes: DataFrame, block_size: int) -> DataFrame:
    """Alive nodes with room for a block, and their free bytes."""
    free = alive_nodes(nodes).withColumn("free", F.col("capacity") - F.col("used"))
    return free.where((F.col("free") >= 0) & (F.col("free") >= block_size))


def place_block(nodes: DataFrame, block_size: int, replicas: int) -> DataFrame:
    """(ord, id, free) of the nodes for a block: most free bytes first, then the smaller id.

    Empty unless there are as many candidates as replicas; place_status() says why.
    """
    found = placement_candidates(nodes, block_size).select("id", "free")
    best = found.orderBy(F.desc("free"), "id").limit(max(0, replicas))
    ranked = best.select(F.row_number().over(Window.orderBy(F.desc("free"), "id")).cast("long").alias("ord"), "id", "free")
    return ranked.join(best.agg(F.count("*").alias("n")), F.col("n") == replicas).drop("n")  # at most `replicas` rows


def place_status(nodes: DataFrame, block_size: int, replicas: int) -> DataFrame:
    """One row: candidates and status ok, no_alive_nodes or not_enough_nodes."""
    n = F.count("*")
    wanted = F.lit(replicas)
    status = F.when(wanted <= 0, "not_enough_nodes").when(n == 0, "no_alive_nodes").when(n < wanted, "not_enough_nodes").otherwise("ok")
    return placement_candidates(nodes, block_size).agg(n.alias("candidates"), status.alias("status"))
