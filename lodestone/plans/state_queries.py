"""Key-value, block and cluster queries over events, documents and lineitem's neighbours.

Log: seq = event_id, key = user_id, signup SET, click SETEX of a day, purchase PERSIST, error DEL, view GET; every
197th event is a DBSIZE. Heartbeats: node-(user_id % 10), in the order of event_id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import blocks as B
from ..operators import cluster as C
from ..operators import kv
from ..session import scratch_folder
from ..sources.block_store import BlockStore, FileStore
from .registry import query, table

DAY_MS = 86_400_000

OPS = f"""ops AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS now_ms, CASE WHEN event_id % 197 = 0 THEN 'DBSIZE' WHEN event_type = 'signup' THEN 'SET'
WHEN event_type = 'click' THEN 'SETEX' WHEN event_type = 'purchase' THEN 'PERSIST' WHEN event_type = 'error' THEN 'DEL' ELSE 'GET' END AS op,
CASE WHEN event_id % 197 <> 0 THEN CAST(user_id AS VARCHAR) END AS key, 'v' || event_id AS value FROM events),
k AS (SELECT *, sum(CAST(op IN ('SET', 'SETEX', 'DEL') AS BIGINT)) OVER (PARTITION BY key ORDER BY seq) AS epoch FROM ops WHERE op <> 'DBSIZE'),
opening AS (SELECT key, epoch, seq AS open_seq, op AS open_op, value AS open_value, CASE WHEN op = 'SETEX' THEN now_ms + {DAY_MS} END AS dl FROM k WHERE op IN ('SET', 'SETEX', 'DEL')),
seen AS (SELECT k.seq, k.now_ms, k.op, k.key, k.epoch, open_seq, open_op, open_value, dl,
min(CASE WHEN k.op = 'PERSIST' THEN k.now_ms END) OVER (PARTITION BY k.key, k.epoch ORDER BY k.seq) AS fp FROM k LEFT JOIN opening USING (key, epoch)),
judged AS (SELECT *, coalesce(open_op = 'SET' OR (open_op = 'SETEX' AND fp < dl), false) AS kept FROM seen),
final AS (SELECT DISTINCT ON (key) key, open_op, open_value, dl, kept, (SELECT max(now_ms) FROM ops) AS t FROM judged ORDER BY key, seq DESC),
replies AS (SELECT *, coalesce(kept OR (open_op = 'SETEX' AND t < dl), false) AS live FROM final)"""
SEEN_LIVE = "coalesce(kept OR (open_op = 'SETEX' AND now_ms < dl), false)"


def ops(spark, d):
    e = table(spark, d, "events")
    op = F.when(F.col("event_id") % 197 == 0, "DBSIZE")
    for event, name in (("signup", "SET"), ("click", "SETEX"), ("purchase", "PERSIST"), ("error", "DEL")):
        op = op.when(F.col("event_type") == event, name)
    return e.select(
        F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("now_ms"), op.otherwise("GET").alias("op"),
        F.when(F.col("event_id") % 197 != 0, F.col("user_id").cast("string")).alias("key"),
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"), F.lit(DAY_MS).cast("long").alias("ttl_ms"),
    )


def at_end(rows, log):
    """rows with the time of the log's last command as column t."""
    return rows.crossJoin(F.broadcast(log.agg(F.max("now_ms").alias("t"))))  # a single row


@query(f"WITH {OPS} SELECT key, open_value AS value, CASE WHEN NOT kept THEN dl END AS expires_at_ms FROM replies WHERE live")
def kv_state(spark, d):
    log = ops(spark, d)
    live = at_end(kv.final_epochs(log), log).where(kv.is_live(F.col("t")))
    return live.select("key", F.col("open_value").alias("value"), F.when(~kv.persisted(), F.col("dl")).alias("expires_at_ms"))


@query(f"WITH {OPS} SELECT key, CASE WHEN NOT live THEN -2 WHEN kept THEN -1 ELSE dl - t END AS ttl FROM replies")
def kv_ttl(spark, d):
    log = ops(spark, d)
    return at_end(kv.final_epochs(log), log).select("key", kv.ttl(F.col("t")).alias("ttl"))


@query(f"WITH {OPS} SELECT key FROM replies WHERE live")
def kv_live_keys(spark, d):
    return kv_state(spark, d).select("key")


@query(f"WITH {OPS} SELECT array_to_string(list(key ORDER BY key), ' ') AS keys FROM replies WHERE live")
def kv_keys(spark, d):
    """The reply of KEYS: by definition one value with all live keys."""
    keys = F.array_sort(F.collect_list("key"))
    return kv_live_keys(spark, d).agg(F.array_join(keys, " ").alias("keys"))


@query(f"WITH {OPS} SELECT count(*) AS live FROM replies WHERE live")
def kv_dbsize(spark, d):
    return kv_live_keys(spark, d).agg(F.count("*").alias("live"))


@query(f"WITH {OPS} SELECT count(*) AS removed FROM replies WHERE NOT live AND open_op IN ('SET', 'SETEX')")
def kv_expired_count(spark, d):
    log = ops(spark, d)
    gone = at_end(kv.final_epochs(log), log).where(F.col("open_op").isin("SET", "SETEX") & ~kv.is_live(F.col("t")))
    return gone.agg(F.count("*").alias("removed"))


@query(f"WITH {OPS} SELECT key, CAST(live AS BIGINT) AS present FROM replies")
def kv_exists(spark, d):
    log = ops(spark, d)
    return at_end(kv.final_epochs(log), log).select("key", kv.is_live(F.col("t")).cast("long").alias("present"))


@query(f"WITH {OPS} SELECT seq, key, CASE WHEN {SEEN_LIVE} THEN open_value END AS value FROM judged WHERE op = 'GET'")
def kv_get_log(spark, d):
    return kv.read_log(ops(spark, d), "GET").select("seq", "key", "value")


PERSISTS = f"""SELECT p.seq, p.key, CAST(open_op = 'SETEX' AND p.now_ms < dl AND NOT EXISTS (SELECT 1 FROM judged q WHERE q.key = p.key AND q.epoch = p.epoch AND q.op = 'PERSIST' AND q.seq < p.seq) AS BIGINT) AS r
FROM judged p WHERE p.op = 'PERSIST'"""


@query(f"WITH {OPS}, p AS ({PERSISTS}) SELECT seq, key, coalesce(r, 0) AS result FROM p")
def kv_persist_log(spark, d):
    return kv.persist_log(ops(spark, d))


DELS = """ends AS (SELECT key, epoch + 1 AS epoch, any_value(open_op) AS open_op, any_value(open_seq) AS open_seq, any_value(dl) AS dl, bool_or(kept) AS kept,
max(CASE WHEN op IN ('GET', 'PERSIST') THEN now_ms END) AS read_now FROM judged GROUP BY key, epoch),
dels AS (SELECT j.seq, j.key, e.*, (SELECT max(now_ms) FROM ops g WHERE g.op = 'DBSIZE' AND g.seq < j.seq AND g.seq > e.open_seq) AS g_now
FROM judged j LEFT JOIN ends e ON e.key = j.key AND e.epoch = j.epoch WHERE j.op = 'DEL')"""


@query(f"""WITH {OPS}, {DELS} SELECT seq, key, CAST(coalesce(open_op IN ('SET', 'SETEX'), false) AND NOT coalesce(NOT kept AND (read_now >= dl OR coalesce(g_now >= dl, false)), false) AS BIGINT) AS result FROM dels""")
def kv_del_log(spark, d):
    return kv.del_log(ops(spark, d))


LINES = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'get ' || user_id WHEN 1 THEN '  SET' || chr(9) || user_id || ' v' || event_id WHEN 2 THEN 'setex ' || user_id || ' 5000 x' WHEN 3 THEN 'SETEX ' || user_id || ' abc x'
WHEN 4 THEN 'GET a b' WHEN 5 THEN 'HELLO' WHEN 6 THEN '  ' WHEN 7 THEN 'dbsize' ELSE 'SETEX k x' END AS text FROM events"""


@query(f"""WITH lines AS ({LINES}), w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM lines), p AS (SELECT *, upper(w[1]) AS o FROM w),
e AS (SELECT *, CASE WHEN len(w) = 0 THEN 'EmptyCommand' WHEN o NOT IN ('GET', 'SET', 'SETEX', 'DBSIZE') THEN 'UnknownCommand'
WHEN len(w) - 1 <> CASE o WHEN 'GET' THEN 1 WHEN 'SET' THEN 2 WHEN 'SETEX' THEN 3 ELSE 0 END THEN 'InvalidArity' WHEN o = 'SETEX' AND try_cast(w[3] AS BIGINT) IS NULL THEN 'InvalidInteger' END AS error FROM p)
SELECT event_id, CASE WHEN error IS NULL THEN o END AS op, CASE WHEN error IS NULL THEN w[2] END AS key, CASE WHEN error IS NULL AND o = 'SETEX' THEN try_cast(w[3] AS BIGINT) END AS ttl_ms,
CASE WHEN error IS NULL THEN CASE o WHEN 'SET' THEN w[3] WHEN 'SETEX' THEN w[4] END END AS value, error FROM e""")
def kv_parse(spark, d):
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    forms = [
        F.concat(F.lit("get "), user), F.concat(F.lit("  SET\t"), user, F.lit(" v"), event), F.concat(F.lit("setex "), user, F.lit(" 5000 x")),
        F.concat(F.lit("SETEX "), user, F.lit(" abc x")), F.lit("GET a b"), F.lit("HELLO"), F.lit("  "), F.lit("dbsize"), F.lit("SETEX k x"),
    ]
    text = F.get(F.array(*forms), (F.col("event_id") % 9).cast("int"))
    return kv.parse(table(spark, d, "events").select("event_id", text.alias("text"))).drop("text")


@query(f"""WITH {OPS}, p AS ({PERSISTS}), {DELS},
r AS (SELECT seq, '+OK' AS response FROM ops WHERE op IN ('SET', 'SETEX')
UNION ALL SELECT seq, coalesce('$' || CASE WHEN {SEEN_LIVE} THEN open_value END, '$nil') FROM judged WHERE op = 'GET'
UNION ALL SELECT seq, ':' || coalesce(r, 0) FROM p
UNION ALL SELECT seq, ':' || CAST(coalesce(open_op IN ('SET', 'SETEX'), false) AND NOT coalesce(NOT kept AND (read_now >= dl OR coalesce(g_now >= dl, false)), false) AS BIGINT) FROM dels
UNION ALL SELECT o.seq, ':' || (SELECT count(*) FROM (SELECT DISTINCT ON (key) key, kept OR open_op = 'SETEX' AND o.now_ms < dl AS live FROM judged j WHERE j.seq < o.seq ORDER BY key, j.seq DESC) WHERE live) FROM ops o WHERE op = 'DBSIZE')
SELECT seq, response || chr(13) || chr(10) AS response FROM r""")
def kv_responses(spark, d):
    return kv.responses(ops(spark, d))


# A log with all commands and broken lines, by event_id; everything else as in OPS.
KINDS = (("PING", 97, 0), ("CLEAR", 499, 1), ("KEYS", 211, 2), ("DBSIZE", 197, 3), ("EXISTS", 13, 4), ("TTL", 11, 5))
ALL = f"""ops AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS now_ms, CASE {' '.join(f"WHEN event_id % {m} = {r} THEN '{k}'" for k, m, r in KINDS)} WHEN event_type = 'signup' THEN 'SET'
WHEN event_type = 'click' THEN 'SETEX' WHEN event_type = 'purchase' THEN 'PERSIST' WHEN event_type = 'error' THEN 'DEL' ELSE 'GET' END AS op,
CAST(user_id AS VARCHAR) AS key, 'v' || event_id AS value FROM events WHERE event_id % 101 <> 7),
own AS (SELECT * FROM ops WHERE op NOT IN ('PING', 'CLEAR', 'KEYS', 'DBSIZE')), names AS (SELECT DISTINCT key FROM own),
resets AS (SELECT key, seq, op, value, now_ms + {DAY_MS} AS dl FROM own WHERE op IN ('SET', 'SETEX', 'DEL') UNION ALL SELECT names.key, seq, op, NULL, NULL FROM ops, names WHERE op = 'CLEAR'),
asked AS (SELECT seq, now_ms, op, key FROM own UNION ALL SELECT seq, now_ms, op, names.key FROM ops, names WHERE op IN ('KEYS', 'DBSIZE')),
held AS (SELECT p.*, r.seq AS s, r.op AS o, r.value, CASE WHEN r.op = 'SETEX' THEN r.dl END AS dl FROM asked p ASOF LEFT JOIN resets r ON p.key = r.key AND p.seq > r.seq),
between_ AS (SELECT h.seq, h.key, min(CASE WHEN q.op = 'PERSIST' THEN q.now_ms END) AS fp, max(q.now_ms) AS seen FROM held h JOIN own q ON q.key = h.key AND q.seq > h.s AND q.seq < h.seq AND q.op IN ('GET', 'EXISTS', 'TTL', 'PERSIST') GROUP BY 1, 2),
swept AS (SELECT h.seq, h.key, max(g.now_ms) AS g FROM held h JOIN ops g ON g.op IN ('KEYS', 'DBSIZE') AND g.seq > h.s AND g.seq < h.seq WHERE h.op = 'DEL' GROUP BY 1, 2),
known AS (SELECT h.*, fp, greatest(seen, g) AS seen, coalesce(o = 'SET' OR o = 'SETEX' AND fp < dl, false) AS kept FROM held h LEFT JOIN between_ USING (seq, key) LEFT JOIN swept USING (seq, key)),
judged AS (SELECT *, kept OR coalesce(o = 'SETEX' AND now_ms < dl, false) AS live FROM known),
r AS (SELECT seq, '+OK' AS response FROM ops WHERE op IN ('SET', 'SETEX', 'CLEAR') UNION ALL SELECT seq, '+PONG' FROM ops WHERE op = 'PING'
UNION ALL SELECT event_id, '-ERR UnknownCommand' FROM events WHERE event_id % 101 = 7
UNION ALL SELECT seq, CASE op WHEN 'GET' THEN coalesce('$' || CASE WHEN live THEN value END, '$nil') WHEN 'EXISTS' THEN ':' || CAST(live AS INTEGER)
WHEN 'TTL' THEN ':' || CASE WHEN NOT live THEN -2 WHEN kept THEN -1 ELSE dl - now_ms END WHEN 'PERSIST' THEN ':' || CAST(live AND NOT kept AS INTEGER)
WHEN 'DEL' THEN ':' || CAST(coalesce(o IN ('SET', 'SETEX'), false) AND (kept OR NOT coalesce(seen >= dl, false)) AS INTEGER) END FROM judged WHERE op IN ('GET', 'EXISTS', 'TTL', 'PERSIST', 'DEL')
UNION ALL SELECT seq, ':' || count(*) FILTER (live) FROM judged WHERE op = 'DBSIZE' GROUP BY seq
UNION ALL SELECT seq, '$' || coalesce(string_agg(key, ' ' ORDER BY key) FILTER (live), '') FROM judged WHERE op = 'KEYS' GROUP BY seq)"""


def all_ops(spark, d):
    log, seq = ops(spark, d), F.col("seq")
    op = F
    for name, m, r in KINDS:
        op = op.when(seq % m == r, name)
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type", F.col("user_id").cast("string").alias("user"))
    for event, name in (("signup", "SET"), ("click", "SETEX"), ("purchase", "PERSIST"), ("error", "DEL")):
        op = op.when(F.col("event_type") == event, name)
    found = log.drop("op", "key").join(e, "seq").withColumn("op", op.otherwise("GET"))
    key = F.when(~F.col("op").isin("PING", "CLEAR", "KEYS", "DBSIZE"), F.col("user"))
    error = F.when(seq % 101 == 7, "UnknownCommand")
    return found.select("seq", "now_ms", "op", key.alias("key"), "value", "ttl_ms", error.alias("error"))


@query(f"WITH {ALL} SELECT seq, response || chr(13) || chr(10) AS response FROM r")
def kv_all_responses(spark, d):
    """Replies to all eleven commands and to broken lines, each at its time."""
    return kv.responses(all_ops(spark, d))


BLOCK = 64
HEX = f"""files AS (SELECT source || '/' || doc_id AS path, hex(encode(text)) AS h FROM documents WHERE octet_length(encode(text)) > 0),
cut AS (SELECT path, unnest(range(CAST(ceil(length(h) / {2 * BLOCK}.0) AS BIGINT))) AS idx, h FROM files),
raw AS (SELECT path, idx, substring(h, CAST(idx * {2 * BLOCK} + 1 AS BIGINT), {2 * BLOCK}) AS b FROM cut),
blocks AS (SELECT path, idx, length(b) // 2 AS size, sha256(from_hex(b)) AS checksum, printf('block-%06d-%s', idx, substring(sha256(from_hex(b)), 1, 16)) AS id FROM raw)"""


def files(spark, d):
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select(path.alias("path"), F.col("text").cast("binary").alias("content"))


def split(spark, d):
    return B.split_blocks(files(spark, d), BLOCK)


@query(f"WITH {HEX} SELECT path, idx, size, checksum FROM blocks")
def split_blocks(spark, d):
    return split(spark, d).select("path", "idx", "size", "checksum")


@query(f"WITH {HEX} SELECT path, idx, id FROM blocks")
def block_ids(spark, d):
    return split(spark, d).select("path", "idx", "id")


@query(f"WITH {HEX} SELECT DISTINCT id, substring(id, 1, 2) || '/' || substring(id, 3, 2) || '/' || id AS path FROM blocks UNION ALL SELECT 'abc', 'abc'")
def block_path(spark, d):
    found = split(spark, d).select("id").unionByName(spark.createDataFrame([("abc",)], "id string")).distinct()
    return found.select("id", ids.block_path(F.col("id")).alias("path"))


@query(f"WITH {HEX} SELECT id, max(size) AS size, max(checksum) AS checksum FROM blocks GROUP BY id")
def block_stat(spark, d):
    return B.block_stat(split(spark, d))


@query("SELECT source || '/' || doc_id AS path, md5(text) AS digest FROM documents WHERE octet_length(encode(text)) > 0")
def reassemble_blocks(spark, d):
    return B.reassemble(split(spark, d)).select("path", F.md5("content").alias("digest"))


REPLICAS = HEX + """, replicas AS (SELECT path, idx, CAST(o AS BIGINT) AS ord, id, size, 'node-' || ((idx + o * 3) % 7) AS node_id FROM blocks, range(3) AS r(o) WHERE idx % 5 <> 4)"""


def replicas(found):
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("ord")
    rows = found.where("idx % 5 <> 4").select("path", "idx", "id", "size", at)
    return rows.withColumn("node_id", F.concat(F.lit("node-"), ((F.col("idx") + F.col("ord") * 3) % 7).cast("string")))


@query(f"""WITH {REPLICAS}, listed AS (SELECT path, idx, string_agg(node_id, ',' ORDER BY ord) AS nodes FROM replicas GROUP BY 1, 2),
m AS (SELECT path, CAST(sum(size) AS BIGINT) AS size, string_agg(id || '@' || coalesce(nodes, ''), ';' ORDER BY idx) AS blocks FROM blocks LEFT JOIN listed USING (path, idx) GROUP BY 1)
SELECT source || '/' || doc_id AS path, coalesce(size, 0) AS size, coalesce(blocks, '') AS blocks FROM documents LEFT JOIN m ON path = source || '/' || doc_id""")
def file_metadata(spark, d):
    found = split(spark, d).drop("data")
    made = B.file_metadata(files(spark, d), found, replicas(found).drop("id", "size"))
    shown = F.array_join(F.transform("blocks", lambda b: F.concat(b["id"], F.lit("@"), F.array_join(b["nodes"], ","))), ";")
    return made.select("path", "size", F.coalesce(shown, F.lit("")).alias("blocks"))


@query(f"""WITH {REPLICAS}, ok AS (SELECT path, idx, ord, node_id FROM replicas WHERE node_id NOT IN ('node-0', 'node-3', 'node-6') ),
best AS (SELECT path, idx, arg_min(node_id, ord) AS node_id FROM ok GROUP BY 1, 2), n AS (SELECT DISTINCT path, idx FROM replicas)
SELECT b.path, b.idx, b.id, best.node_id, CASE WHEN best.node_id IS NOT NULL THEN 'ok' WHEN n.idx IS NULL THEN 'no_replicas' ELSE 'unreadable' END AS status
FROM blocks b LEFT JOIN best USING (path, idx) LEFT JOIN n USING (path, idx)""")
def replica_fallback(spark, d):
    found = split(spark, d).drop("data")
    all_replicas = replicas(found)
    readable = all_replicas.where(~F.col("node_id").isin("node-0", "node-3", "node-6")).select("id", "node_id")
    return B.replica_fallback(found, all_replicas.drop("id", "size"), readable)


@query(f"""WITH {REPLICAS}, ok AS (SELECT path, idx, ord, node_id FROM replicas WHERE node_id NOT IN ('node-0', 'node-3', 'node-6') ),
best AS (SELECT path, idx, arg_min(node_id, ord) AS node_id FROM ok GROUP BY 1, 2), n AS (SELECT DISTINCT path, idx FROM replicas)
SELECT b.path, b.idx, b.id, best.node_id, CASE WHEN best.node_id IS NOT NULL THEN 'ok' WHEN n.idx IS NULL THEN 'no_replicas' ELSE 'unreadable' END AS status
FROM blocks b LEFT JOIN best USING (path, idx) LEFT JOIN n USING (path, idx)""")
def node_failover(spark, d):
    """replica_fallback where three nodes are down; each block carries its nodes in order."""
    nodes = F.transform(F.array(*[F.lit(o) for o in range(3)]), lambda o: F.concat(F.lit("node-"), ((F.col("idx") + o * 3) % 7).cast("string")))
    listed = split(spark, d).select("path", "idx", "id", F.when(F.col("idx") % 5 != 4, nodes).alias("nodes"))
    down = spark.range(0, 7, 3).select(F.concat(F.lit("node-"), F.col("id").cast("string")).alias("node_id"))
    return B.failover(listed, down)


@query(f"""WITH {REPLICAS}, stored AS (SELECT DISTINCT node_id, id, size FROM replicas), sums AS (SELECT node_id, CAST(sum(size) AS BIGINT) AS used, count(*) AS blocks FROM stored GROUP BY 1),
nodes AS (SELECT 'node-' || i AS node_id FROM range(9) AS r(i))
SELECT node_id, CAST(1073741824 AS BIGINT) AS capacity, coalesce(used, 0) AS used, coalesce(blocks, 0) AS blocks FROM nodes LEFT JOIN sums USING (node_id)""")
def storage_stats(spark, d):
    nodes = spark.range(9).select(F.concat(F.lit("node-"), F.col("id").cast("string")).alias("id"), F.lit(1 << 30).cast("long").alias("capacity"))
    return B.storage_stats(nodes, replicas(split(spark, d).drop("data")))


@query(f"WITH {HEX} SELECT DISTINCT id FROM blocks WHERE id NOT IN (SELECT id FROM blocks WHERE path NOT LIKE '%7')")
def orphan_blocks(spark, d):
    """What is left of files whose path ends in 7 once their metadata is deleted."""
    found = split(spark, d).select("path", "id")
    return B.orphan_blocks(found.select("id").distinct(), found.where("path NOT LIKE '%7'"))


CAS = " || '/' || ".join(f"substring(sha1(source || doc_id), {5 * i + 1}, 5)" for i in range(8))


@query(f"SELECT doc_id, {CAS} AS path, sha1(source || doc_id) AS filename FROM documents")
def cas_path(spark, d):
    key = F.concat("source", F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", ids.cas_path(key).alias("path"), F.sha1(key.cast("binary")).alias("filename"))


@query("SELECT doc_id, md5(source || doc_id) AS digest FROM documents")
def md5_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.concat("source", F.col("doc_id").cast("string"))).alias("digest"))


# Ages that give all three states at sf0.01, and at least three nodes that are alive.
SUSPECT_S, DEAD_S, SILENT = 1500.0, 12000.0, 3
BEATS = f"""beats AS (SELECT event_id AS arrival_seq, 'node-' || (user_id % 10) AS id, 'host-' || (user_id % 10) || ':' || (event_id % 3) AS addr, CAST(1000 AS BIGINT) AS capacity,
least(1000, greatest(0, CAST(trunc(value) AS BIGINT))) AS used, ts AS time FROM events WHERE NOT (user_id % 10 < {SILENT} AND event_id % 1000 > 500 - 150 * (user_id % 10))),
latest AS (SELECT DISTINCT ON (id) id, addr, capacity, used, time AS last_seen FROM beats ORDER BY id, arrival_seq DESC),
health AS (SELECT *, CASE WHEN epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_seen) >= {int(DEAD_S * 1e6)} THEN 'dead'
WHEN epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_seen) >= {int(SUSPECT_S * 1e6)} THEN 'suspect' ELSE 'alive' END AS state FROM latest)"""


def heartbeats(spark, d):
    """Nodes 0 to 2 fall silent in the second half of each thousand of events."""
    e = table(spark, d, "events").withColumn("n", F.col("user_id") % 10)
    silent = (F.col("n") < SILENT) & (F.col("event_id") % 1000 > 500 - 150 * F.col("n"))
    used = F.least(F.lit(1000).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("value").cast("long")))
    node = F.col("n").cast("string")
    return e.where(~silent).select(
        F.col("event_id").alias("arrival_seq"), F.concat(F.lit("node-"), node).alias("id"),
        F.concat(F.lit("host-"), node, F.lit(":"), (F.col("event_id") % 3).cast("string")).alias("addr"),
        F.lit(1000).cast("long").alias("capacity"), used.alias("used"), F.col("ts").cast("timestamp").alias("time"),
    )


@query(f"WITH {BEATS} SELECT id, addr, capacity, used, epoch_us(last_seen) AS last_seen_us, 'alive' AS state FROM latest")
def latest_heartbeat(spark, d):
    return C.latest_heartbeat(heartbeats(spark, d)).withColumn("last_seen_us", F.unix_micros("last_seen")).drop("last_seen")


def healthy(spark, d):
    now = table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("now"))
    nodes = C.latest_heartbeat(heartbeats(spark, d)).crossJoin(F.broadcast(now))  # a single row
    return C.evaluate_health(nodes, F.col("now"), SUSPECT_S, DEAD_S).drop("now")


@query(f"WITH {BEATS} SELECT id, state FROM health")
def node_health(spark, d):
    return healthy(spark, d).select("id", "state")


@query(f"WITH {BEATS} SELECT id, used FROM health WHERE state = 'alive'")
def alive_nodes(spark, d):
    return C.alive_nodes(healthy(spark, d)).select("id", "used")


FREE = f"{BEATS}, free AS (SELECT id, capacity - used AS free FROM health WHERE state = 'alive' AND capacity - used >= 100)"


@query(f"WITH {FREE} SELECT id, free FROM free")
def placement_candidates(spark, d):
    return C.placement_candidates(healthy(spark, d), 100).select("id", "free")


@query(f"WITH {FREE}, o AS (SELECT row_number() OVER (ORDER BY free DESC, id) AS ord, id, free FROM free) SELECT * FROM o WHERE ord <= 3 AND (SELECT count(*) FROM free) >= 3")
def place_block(spark, d):
    return C.place_block(healthy(spark, d), 100, 3)


@query(f"WITH {FREE} SELECT count(*) AS candidates, CASE WHEN count(*) = 0 THEN 'no_alive_nodes' WHEN count(*) < 3 THEN 'not_enough_nodes' ELSE 'ok' END AS status FROM free")
def place_status(spark, d):
    return C.place_status(healthy(spark, d), 100, 3)


@query("""SELECT 'node-' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 1000000 ELSE 5000000 END AS last_seen_us,
CASE s_suppkey % 4 WHEN 0 THEN 'alive' WHEN 1 THEN 'alive' WHEN 2 THEN 'dead' ELSE 'suspect' END AS state FROM supplier""")
def register_nodes(spark, d):
    n = F.col("s_suppkey")
    state = F.when(n % 4 == 1, "unknown").when(n % 4 == 2, "dead").when(n % 4 == 3, "suspect")
    nodes = table(spark, d, "supplier").select(
        F.concat(F.lit("node-"), n.cast("string")).alias("id"), F.when(n % 3 == 0, F.timestamp_seconds(F.lit(1))).alias("last_seen"), state.alias("state")
    )
    done = C.register(nodes, F.timestamp_seconds(F.lit(5)))
    return done.select("id", F.unix_micros("last_seen").alias("last_seen_us"), "state")


@query("""SELECT event_id, CASE WHEN user_id % 9 = 0 THEN 'empty_id' ELSE 'empty_addr' END AS reason FROM events WHERE user_id % 9 = 0 OR event_id % 11 < 2""")
def rejected_heartbeats(spark, d):
    """Heartbeats of every ninth user have no id, those of two events in eleven no address (empty or null)."""
    n = F.col("event_id") % 11
    sent = table(spark, d, "events").select(
        "event_id", F.when(F.col("user_id") % 9 == 0, "").otherwise(F.col("user_id").cast("string")).alias("id"),
        F.when(n == 0, "").when(n > 1, F.concat(F.lit("host:"), n.cast("string"))).alias("addr"),
    )
    return C.rejected_heartbeats(sent).select("event_id", "reason")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 5 THEN 'invalid_block_size' WHEN l_linenumber < 2 THEN 'invalid_replicas' ELSE 'empty_path' END AS reason
FROM lineitem WHERE l_quantity <= 5 OR l_linenumber < 2 OR l_partkey % 10 = 0""")
def rejected_requests(spark, d):
    """Requests with the quantity less 5 as block size, the line number less 1 as replicas and no path for every tenth part."""
    asked = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 10 != 0, F.col("l_partkey").cast("string")).alias("path"),
        (F.col("l_quantity") - 5).alias("block_size"), (F.col("l_linenumber") - 1).alias("replicas"),
    )
    return C.rejected_requests(asked).select("l_orderkey", "l_linenumber", "reason")


@query("""WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'alive' WHEN 1 THEN 'suspect' WHEN 2 THEN 'dead' WHEN 3 THEN 'unknown' ELSE event_type END AS s FROM events)
SELECT event_id, CASE WHEN event_id % 6 < 4 THEN s END AS state,
CASE event_id % 6 WHEN 4 THEN 'unknown node state: ' || s WHEN 5 THEN 'not a JSON string' END AS error,
'"' || CASE WHEN event_id % 6 < 4 THEN s ELSE 'unknown' END || '"' AS written FROM t""")
def parsed_states(spark, d):
    """States as JSON text, of six events one with another word and one without quotes, and the text written from them again."""
    n = F.col("event_id") % 6
    word = F.when(n == 0, "alive").when(n == 1, "suspect").when(n == 2, "dead").when(n == 3, "unknown").otherwise(F.col("event_type"))
    text = F.when(n < 5, F.concat(F.lit('"'), word, F.lit('"'))).otherwise(word)
    rows = table(spark, d, "events").select("event_id", C.parse_state(text).alias("p"))
    return rows.select("event_id", "p.state", "p.error", C.state_json(F.col("p.state")).alias("written"))


@query("""SELECT 'node-' || s_suppkey AS id, CASE WHEN s_suppkey = 3 THEN 'dead' ELSE 'alive' END AS state FROM supplier
WHERE s_suppkey % 5 <> 0 AND s_suppkey <= 50""")
def registry_changes(spark, d):
    """Of all nodes every fifth is taken out, one is set to dead, then the first fifty ids are asked for."""
    n = F.col("s_suppkey")
    name = F.concat(F.lit("node-"), n.cast("string")).alias("id")
    suppliers = table(spark, d, "supplier")
    nodes = suppliers.select(name, F.lit("alive").alias("state"))
    left = C.unregister(nodes, suppliers.where(n % 5 == 0).select(name))
    changed = C.update_state(C.update_state(left, "node-3", "dead"), "no such node", "dead")
    return C.get_nodes(changed, suppliers.where(n <= 50).select(name))


@query("SELECT doc_id, '/' || source || '/' || doc_id AS path, '/files/' || source || '/' || doc_id AS url FROM documents")
def file_urls(spark, d):
    url = F.concat_ws("/", F.lit("/files"), "source", F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", ids.path_from_url(url).alias("path"), ids.url_from_path(ids.path_from_url(url)).alias("url"))


# Blocks of 1200 bytes: nodes have 1000 free at most, so long files find no place.
FILE_BLOCK, COPIES = 1200, 3
PUT = f"""{BEATS}, best AS (SELECT id, addr, capacity - used AS free, row_number() OVER (ORDER BY capacity - used DESC, id) AS ord FROM health WHERE state = 'alive'),
docs AS (SELECT source || '/' || doc_id AS path, coalesce(octet_length(encode(text)), 0) AS size, hex(encode(text)) AS h FROM documents),
fits AS (SELECT path, size, h, (SELECT count(*) FROM best WHERE ord <= {COPIES} AND free >= least(size, {FILE_BLOCK})) AS n FROM docs),
put AS (SELECT path, size, h, CASE WHEN size = 0 OR n = {COPIES} THEN 'ok' WHEN n = 0 THEN 'no_alive_nodes' ELSE 'not_enough_nodes' END AS status FROM fits),
cut AS (SELECT path, unnest(range(CAST(ceil(size / {FILE_BLOCK}.0) AS BIGINT))) AS idx, h FROM put WHERE status = 'ok'),
raw AS (SELECT path, idx, from_hex(substring(h, CAST(idx * {2 * FILE_BLOCK} + 1 AS BIGINT), {2 * FILE_BLOCK})) AS data FROM cut),
blocks AS (SELECT path, idx, printf('block-%06d-%s', idx, substring(sha256(data), 1, 16)) AS id, sha256(data) AS checksum, octet_length(data) AS size FROM raw)"""


def put_documents(spark, d):
    store = FileStore(spark, scratch_folder(spark, "files"))
    return store, store.put(files(spark, d), healthy(spark, d), COPIES, FILE_BLOCK)


@query(f"WITH {PUT} SELECT path, status FROM put")
def put_files(spark, d):
    """Split, place, write and commit: what became of each file."""
    return put_documents(spark, d)[1]


@query(f"""WITH {PUT}, names AS (SELECT string_agg(id || '=' || addr, ',' ORDER BY ord) AS nodes FROM best WHERE ord <= {COPIES}),
listed AS (SELECT path, string_agg(id || '@' || nodes, ';' ORDER BY idx) AS blocks FROM blocks, names GROUP BY 1)
SELECT path, CAST(size AS BIGINT) AS size, coalesce(blocks, '') AS blocks FROM put LEFT JOIN listed USING (path) WHERE status = 'ok' AND path NOT LIKE '%7'""")
def stored_files(spark, d):
    """The metadata of what was put, without the files that were deleted since."""
    store, _ = put_documents(spark, d)
    store.delete(files(spark, d).where("path LIKE '%7'"))
    nodes = lambda b: F.array_join(F.transform(b["nodes"], lambda n: F.concat_ws("=", n["node_id"], n["addr"])), ",")
    return store.stat().select("path", "size", F.array_join(F.transform("blocks", lambda b: F.concat_ws("@", b["id"], nodes(b))), ";").alias("blocks"))


@query(f"WITH {PUT} SELECT path, md5(text) AS digest FROM put JOIN documents ON path = source || '/' || doc_id WHERE status = 'ok' AND size > 0")
def read_files(spark, d):
    """The bytes of what was put."""
    return put_documents(spark, d)[0].read().select("path", F.md5("content").alias("digest"))


@query(f"""WITH {HEX}, once AS (SELECT DISTINCT id, b FROM blocks JOIN raw USING (path, idx)), kept AS (SELECT id, CASE WHEN id LIKE '%0' THEN 'new' || id ELSE decode(from_hex('')) END AS n, b FROM once WHERE id NOT LIKE '%1' OR id LIKE 'block-000000%')
SELECT id, CASE WHEN id LIKE '%0' THEN octet_length(encode(n)) ELSE length(b) // 2 END AS size, CASE WHEN id LIKE '%0' THEN sha256(n) ELSE sha256(from_hex(b)) END AS checksum FROM kept""")
def block_store(spark, d):
    """Puts, a put over blocks ending in 0, a deletion of those ending in 1 (and of one that isn't there), and a put of some again."""
    store, found = BlockStore(spark, scratch_folder(spark, "blocks")), split(spark, d).select("id", "data")
    store.put(found)
    store.put(found.where("id LIKE '%0'").select("id", F.concat(F.lit("new"), "id").cast("binary").alias("data")))
    store.delete(found.where("id LIKE '%1'").select("id").unionByName(spark.createDataFrame([("none",)], "id string")))
    store.put(found.where("id LIKE 'block-000000%1'"))
    return store.stat()
