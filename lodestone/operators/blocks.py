"""Files as fixed-size blocks with replicas.

Frames: files(path, content binary), blocks(path, idx, id, size, checksum, data), replicas(path, idx, ord, node_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import block_id
from .cluster import alive_nodes

#: Fixed value: the block size of the command line.
BLOCK_SIZE = 64 * 1024 * 1024
NODES = "array<struct<node_id:string,addr:string>>"
METADATA = f"path string, size long, blocks array<struct<idx:long,id:string,bytes:long,checksum:string,nodes:{NODES}>>"


def split_blocks(files: DataFrame, block_size: int = BLOCK_SIZE, *more: str) -> DataFrame:
    """Blocks of exactly block_size bytes, the last shorter; an empty or null file has none.

    The blocks are cut as the rows are made, so a file's bytes exist once. more: columns of files to keep.
    """
    if block_size <= 0:
        raise ValueError("a block has a positive size")
    size = F.octet_length("content")
    last = F.floor((size - 1) / block_size).cast("long")
    indexes = files.where(size > 0).select("path", "content", *more, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("idx"))
    data = F.substring(F.col("content"), (F.col("idx") * block_size + 1).cast("int"), F.lit(block_size))
    blocks = indexes.select("path", "idx", data.alias("data"), *more)
    return blocks.select(
        "path", "idx", block_id(F.col("idx"), F.col("data")).alias("id"), F.octet_length("data").cast("long").alias("size"),
        F.sha2("data", 256).alias("checksum"), "data", *more,
    )


def reassemble(blocks: DataFrame) -> DataFrame:
    """(path, content) from blocks(path, idx, data), in the order of idx. A cell holds 2 GB at most.

    FileStore.get() writes longer files, block by block.
    """
    return blocks.groupBy("path").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY idx)").alias("content"))


def allocate_files(files: DataFrame, nodes: DataFrame, replicas: int, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Adds nodes and status to files(path, content): where all blocks of a file go, or why it can't be stored.

    Placement reserves no space, so each block goes to the same nodes: the alive ones with most free bytes, then the
    smaller id, if as many as replicas have room for the file's largest block. status: ok, empty_path, no_alive_nodes
    (none has room) or not_enough_nodes. Files without bytes need no node.
    """
    free = alive_nodes(nodes).select("id", "addr", (F.col("capacity") - F.col("used")).alias("free"))
    best = free.orderBy(F.desc("free"), "id").limit(max(0, replicas))
    top = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("free")).alias("full"), F.col("id").alias("node_id"), "addr"))).alias("top"))
    largest = F.least(F.coalesce(F.octet_length("content"), F.lit(0)), F.lit(block_size))
    fits = F.filter("top", lambda n: -n["full"] >= largest)
    status = (
        F.when(F.coalesce("path", F.lit("")) == "", "empty_path")
        .when(largest == 0, "ok")
        .when(F.lit(replicas) <= 0, "not_enough_nodes")
        .when(F.size(fits) == 0, "no_alive_nodes")
        .when(F.size(fits) < replicas, "not_enough_nodes")
        .otherwise("ok")
    )
    names = F.transform("top", lambda n: F.struct(n["node_id"], n["addr"])).cast(NODES)
    joined = files.select("path", "content").crossJoin(F.broadcast(top))  # one row of `replicas` nodes at most
    return joined.select("path", "content", names.alias("nodes"), status.alias("status"))


def placed_blocks(placed: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """split_blocks() of the files that are ok, with their nodes."""
    return split_blocks(placed.where("status = 'ok'"), block_size, "nodes")


def placed_metadata(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, size, blocks) of the files that are ok, from blocks(path, idx, id, size, checksum, nodes)."""
    listed = F.array_sort(F.collect_list(F.struct("idx", "id", F.col("size").alias("bytes"), "checksum", "nodes")))
    per_file = blocks.groupBy("path").agg(F.sum("size").alias("size"), listed.alias("blocks"))
    empty = placed.where("status = 'ok'").where(F.coalesce(F.octet_length("content"), F.lit(0)) == 0)
    none = F.array().cast(f"array<struct<idx:long,id:string,bytes:long,checksum:string,nodes:{NODES}>>")
    return per_file.unionByName(empty.select("path", F.lit(0).cast("long").alias("size"), none.alias("blocks")))


def file_metadata(files: DataFrame, blocks: DataFrame, replicas: DataFrame) -> DataFrame:
    """(path, size, blocks array<struct>): each block with its replicas in order, none for a block without any.

    A file without blocks has size 0.
    """
    listed = replicas.groupBy("path", "idx").agg(F.array_sort(F.collect_list(F.struct("ord", "node_id"))).alias("r"))
    full = blocks.join(listed, ["path", "idx"], "left")
    nodes = F.transform(F.coalesce("r", F.array().cast("array<struct<ord:long,node_id:string>>")), lambda x: x["node_id"])
    per_file = full.groupBy("path").agg(
        F.sum("size").alias("size"),
        F.array_sort(F.collect_list(F.struct("idx", "id", F.col("size").alias("bytes"), "checksum", nodes.alias("nodes")))).alias("blocks"),
    )
    return files.select("path").join(per_file, "path", "left").na.fill(0, ["size"])


def replica_fallback(blocks: DataFrame, replicas: DataFrame, readable: DataFrame) -> DataFrame:
    """The first replica in order that is in readable(id, node_id), for each block.

    status: ok, no_replicas (none listed) or unreadable (none of those listed).
    """
    # a row a block and a row an id, put together within tasks before they are shuffled: a block has few replicas, an id few nodes
    own = blocks.groupBy("path", "idx").agg(F.collect_set(F.struct("id")).alias("ids"))
    listed = replicas.where("node_id IS NOT NULL").groupBy("path", "idx").agg(F.collect_list(F.struct("ord", "node_id")).alias("r"))
    there = readable.groupBy("id").agg(F.collect_set("node_id").alias("there"))
    tried = own.join(listed, ["path", "idx"], "left").select("path", "idx", "r", F.explode("ids").alias("i")).select("path", "idx", "i.id", "r").join(there, "id", "left")
    best = F.array_min(F.filter("r", lambda x: F.array_contains("there", x["node_id"])))
    picked = tried.select("path", "idx", "id", best.alias("best"), F.coalesce(F.size("r"), F.lit(0)).alias("listed"))
    status = F.when(F.col("best").isNotNull(), "ok").when(F.col("listed") <= 0, "no_replicas").otherwise("unreadable")
    return picked.select("path", "idx", "id", F.col("best.node_id").alias("node_id"), status.alias("status"))


def failover(blocks: DataFrame, down: DataFrame) -> DataFrame:
    """Adds node_id and status to blocks(path, idx, id, nodes array): replica_fallback() where whole nodes fail.

    node_id is the first of a block's nodes that is not in down(node_id). Nodes are few beside blocks, so they go to the blocks in one row
    and no block is shuffled. status: ok, no_replicas (none listed) or unreadable (all of them down).
    """
    one = down.agg(F.collect_set("node_id").alias("_down"))  # nodes of the cluster
    nodes = F.coalesce("nodes", F.array().cast("array<string>"))
    up = F.filter(nodes, lambda n: ~F.array_contains("_down", n))
    status = F.when(F.size(up) > 0, "ok").when(F.size(nodes) == 0, "no_replicas").otherwise("unreadable")
    joined = blocks.select("path", "idx", "id", "nodes").crossJoin(F.broadcast(one))  # a single row
    return joined.select("path", "idx", "id", F.get(up, F.lit(0)).alias("node_id"), status.alias("status"))


def block_stat(blocks: DataFrame) -> DataFrame:
    """size and checksum of each stored block id, hashed again from its bytes."""
    return blocks.groupBy("id").agg(F.max("size").alias("size"), F.max(F.sha2("data", 256)).alias("checksum"))


def storage_stats(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """used bytes and blocks of each node; stored(node_id, id, size), a node without any has zeros."""
    once = stored.groupBy("node_id", "id").agg(F.max("size").alias("size"))
    sums = once.groupBy("node_id").agg(F.sum("size").alias("used"), F.count("*").alias("blocks"))
    return nodes.select(F.col("id").alias("node_id"), "capacity").join(sums, "node_id", "left").na.fill(0, ["used", "blocks"])


def orphan_blocks(stored: DataFrame, blocks: DataFrame) -> DataFrame:
    """Stored blocks that no file refers to: a file's deletion leaves its blocks."""
    return stored.join(blocks.select("id"), "id", "left_anti")


def put_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace files by path."""
    return old.join(new.select("path"), "path", "left_anti").unionByName(new)


def delete_metadata(files: DataFrame, path: str) -> DataFrame:
    """Without a path; a missing one is no error."""
    return files.where(F.col("path") != path)
