"""Keyed state with time to live, evaluated from a log of commands in closed form.

ops(seq long, now_ms long, op, key, value, ttl_ms): seq orders the log and now_ms never falls along it (for logs where
it does, see streaming.kv, which folds the rows of a key one by one). CLEAR commands cut the log into eras; every SET,
SETEX or DEL opens an epoch of its key within an era. In an epoch the first PERSIST decides: before the deadline the
entry stays for good.

Work is shuffled by key, and the few global commands (CLEAR, KEYS, DBSIZE) are looked up as-of through slices of seq or
counted through spans of time, so no window runs over the whole log. A key of many rows is cut into slices of seq too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_folder

RESETS = ("SET", "SETEX", "DEL")
READS = ("GET", "EXISTS", "TTL", "PERSIST")
GLOBAL_READS = ("KEYS", "DBSIZE")
#: Rows of the log (by seq) in a slice of the as-of lookup.
SLICE = 1 << 16
#: Keys of more than SLICE rows that are broadcast at most; more are joined by shuffles.
MOST_BROADCAST = 100_000
#: The frame of all rows before.
BEFORE = (Window.unboundedPreceding, -1)

# The number of arguments of each command.
ARITY = {"PING": 0, "GET": 1, "SET": 2, "DEL": 1, "EXISTS": 1, "SETEX": 3, "TTL": 1, "PERSIST": 1, "KEYS": 0, "DBSIZE": 0, "CLEAR": 0}


def parse(lines: DataFrame, text: str = "text") -> DataFrame:
    """Adds op, key, ttl_ms, value and error to a column of command lines.

    Words are separated by ASCII blanks; the command's case doesn't matter. The number of arguments is looked at
    before the integer. Errors: EmptyCommand (null text too), UnknownCommand, InvalidArity, InvalidInteger.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \t\r\n]+"), lambda w: w != "")
    out = lines.withColumn("_w", words).withColumn("op", F.upper(F.get("_w", F.lit(0))))
    arity = F.create_map(*[F.lit(x) for pair in ARITY.items() for x in pair])
    ttl = F.when(F.get("_w", F.lit(2)).rlike(r"^[+-]?[0-9]+$"), F.get("_w", F.lit(2)).try_cast("long"))
    error = (
        F.when(F.size("_w") == 0, "EmptyCommand")
        .when(~F.col("op").isin(*ARITY), "UnknownCommand")
        .when(F.size("_w") - 1 != arity[F.col("op")], "InvalidArity")
        .when((F.col("op") == "SETEX") & ttl.isNull(), "InvalidInteger")
    )
    out = out.withColumn("error", error)
    fine = F.col("error").isNull()
    return out.select(
        *lines.columns,
        F.when(fine, F.col("op")).alias("op"),
        F.when(fine, F.get("_w", F.lit(1))).alias("key"),
        F.when(fine & (F.col("op") == "SETEX"), ttl).alias("ttl_ms"),
        F.when(fine & (F.col("op") == "SET"), F.get("_w", F.lit(2))).when(fine & (F.col("op") == "SETEX"), F.get("_w", F.lit(3))).alias("value"),
        "error",
    )


def reply_ok() -> Column:
    return F.lit("+OK\r\n")


def reply_value(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), value, F.lit("\r\n")), F.lit("$nil\r\n"))


def reply_int(value: Column) -> Column:
    return F.concat(F.lit(":"), value.cast("string"), F.lit("\r\n"))


def reply_list(keys: Column) -> Column:
    return F.concat(F.lit("$"), F.array_join(keys, " "), F.lit("\r\n"))


def reply_error(name: Column) -> Column:
    return F.concat(F.lit("-ERR "), name, F.lit("\r\n"))


def _carried(per: DataFrame, at: str, m: str) -> DataFrame:
    """(at, before): the largest m of all rows before, over slices of slices, so that one task has n / SLICE rows of them at most."""
    over = F.floor(F.col(at) / SLICE)
    inner = per.withColumn("_over", over).withColumn("_in", F.max(m).over(Window.partitionBy("_over").orderBy(at).rowsBetween(*BEFORE)))
    outer = per.groupBy(over.alias("_over")).agg(F.max(m).alias("_m"))
    outer = outer.select("_over", F.max("_m").over(Window.orderBy("_over").rowsBetween(*BEFORE)).alias("_out"))
    return inner.join(outer, "_over").select(at, F.greatest("_in", "_out").alias("before"))


def last_before(ops: DataFrame, rows: DataFrame, kinds: tuple[str, ...], name: str) -> DataFrame:
    """Adds to rows(seq) the seq and time of the last command of some kinds before: <name>_seq, <name>_now.

    As-of by slices: the last one within the row's own slice, else the last of the slices before.
    """
    own = F.struct("seq", "now_ms")
    marks = ops.where(F.col("op").isin(*kinds)).select("seq", own.alias("g"), F.lit(None).alias("_r"))
    probe = rows.select(rows.seq, F.lit(None).alias("g"), F.struct(*rows.columns).alias("_r"))
    slice_ = F.floor(F.col("seq") / SLICE)
    both = probe.unionByName(marks.select("seq", "g", F.col("_r").cast(probe.schema["_r"].dataType))).withColumn("_slice", slice_)
    inside = F.last("g", ignorenulls=True).over(Window.partitionBy("_slice").orderBy("seq", F.asc_nulls_first("g")))
    per_slice = ops.groupBy(slice_.alias("_slice")).agg(F.max(F.when(F.col("op").isin(*kinds), own)).alias("m"))
    found = both.withColumn("_in", inside).where(F.col("_r").isNotNull()).join(_carried(per_slice, "_slice", "m"), "_slice", "left")
    g = F.coalesce("_in", "before")
    return found.select("_r.*", g["seq"].alias(f"{name}_seq"), g["now_ms"].alias(f"{name}_now"))


def keyed(ops: DataFrame) -> DataFrame:
    """Rows of a key with their era: the seq of the last CLEAR before, -1 without. Global commands and PING are left out."""
    own = ops.where(F.col("key").isNotNull() & ~F.col("op").isin("CLEAR", *GLOBAL_READS, "PING"))
    own = own.select("seq", "now_ms", "op", "key", "value", "ttl_ms")
    none = F.lit(-1).cast("long")
    if not ops.where("op = 'CLEAR'").limit(1).count():
        return own.withColumn("era", none)
    return last_before(ops, own, ("CLEAR",), "c").withColumn("era", F.coalesce("c_seq", none)).drop("c_seq", "c_now")


def _opened(rows: DataFrame, *part: str) -> DataFrame:
    """Adds epoch, o (the epoch's opening) and p (its first PERSIST up to the row) within the rows that agree in part."""
    reset = F.col("op").isin(*RESETS)
    order = Window.partitionBy(*part).orderBy("seq")
    opening = F.last(F.when(reset, F.struct("op", "seq", "value", "now_ms", "ttl_ms")), ignorenulls=True).over(order)
    rows = rows.withColumn("epoch", F.sum(reset.cast("long")).over(order)).withColumn("o", opening)
    first = F.min(F.when(F.col("op") == "PERSIST", F.struct("now_ms", "seq"))).over(Window.partitionBy(*part, "epoch").orderBy("seq"))
    return rows.withColumn("p", first)


def _opened_in_slices(rows: DataFrame) -> DataFrame:
    """_opened() by key and era, where no task gets more than a slice of a key: what earlier slices leave is carried on."""
    part = ("key", "era", "_slice")
    own = _opened(rows.withColumn("_slice", F.floor(F.col("seq") / SLICE)), *part)
    per = own.groupBy(*part).agg(F.max("epoch").alias("n"), F.max_by(F.struct("o", "p"), "seq").alias("last"))
    order = Window.partitionBy("key", "era").orderBy("_slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_run", F.sum((F.col("n") > 0).cast("long")).over(order))
    per = per.withColumn("_p", F.min("last.p").over(Window.partitionBy("key", "era", "_run").orderBy("_slice")))
    per = per.select(*part, F.sum("n").over(before).alias("n0"), F.last("last.o", ignorenulls=True).over(before).alias("o0"), F.lag("_p").over(order).alias("p0"))
    first = F.col("epoch") == 0  # the epoch of an earlier slice
    joined = own.join(per, list(part)).withColumn("o", F.when(first, F.col("o0")).otherwise(F.col("o")))
    joined = joined.withColumn("p", F.when(first, F.least("p0", "p")).otherwise(F.col("p")))
    return joined.withColumn("epoch", F.col("epoch") + F.coalesce("n0", F.lit(0))).drop("_slice", "n0", "o0", "p0")


def with_epochs(ops: DataFrame) -> DataFrame:
    """Adds to each keyed row its era and epoch and that epoch's opening (open_op, open_seq, open_now, open_value, dl, fp).

    dl is the deadline of a SETEX, fp the time of the first PERSIST of the epoch at or before the row, fp_seq its seq.
    Keys with more than SLICE rows are worked on in slices.
    """
    rows = keyed(ops)
    hot = ops.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SLICE).where("key IS NOT NULL").select("key")
    if n_hot := hot.count():
        hot = F.broadcast(hot) if n_hot <= MOST_BROADCAST else hot
        cold = _opened(rows.join(hot, "key", "left_anti"), "key", "era")
        rows = cold.unionByName(_opened_in_slices(rows.join(hot, "key", "left_semi")))
    else:
        rows = _opened(rows, "key", "era")
    return rows.select(
        "seq", "now_ms", "op", "key", "value", "era", "epoch", F.col("p.now_ms").alias("fp"), F.col("p.seq").alias("fp_seq"),
        F.col("o.op").alias("open_op"),
        F.col("o.seq").alias("open_seq"),
        F.col("o.now_ms").alias("open_now"),
        F.col("o.value").alias("open_value"),
        F.when(F.col("o.op") == "SETEX", F.col("o.now_ms") + F.col("o.ttl_ms")).alias("dl"),
    )


def persisted() -> Column:
    return (F.col("open_op") == "SET") | ((F.col("open_op") == "SETEX") & F.coalesce(F.col("fp") < F.col("dl"), F.lit(False)))


def is_live(now: Column) -> Column:
    """Whether the entry of an epoch lives at a time."""
    held = F.coalesce(F.col("open_op").isin("SET", "SETEX"), F.lit(False))
    return held & (persisted() | F.coalesce(now < F.col("dl"), F.lit(False)))


def ttl(now: Column) -> Column:
    """Milliseconds left, -1 without a deadline, -2 for a missing or expired key."""
    return F.when(~is_live(now), F.lit(-2).cast("long")).when(persisted(), F.lit(-1).cast("long")).otherwise(F.col("dl") - now)


def final_epochs(ops: DataFrame, until_seq: int | None = None) -> DataFrame:
    """The last epoch of each key, at the end of the log or after row until_seq. One shuffle by key."""
    ops = ops if until_seq is None else ops.where(F.col("seq") <= until_seq)
    last = with_epochs(ops).groupBy("key").agg(F.max_by(F.struct("era", "epoch", "open_op", "open_seq", "open_value", "dl", "fp"), "seq").alias("e"))
    cleared = ops.where("op = 'CLEAR'").agg(F.max("seq").alias("cleared"))
    last = last.select("key", "e.*").crossJoin(F.broadcast(cleared))  # a single row
    gone = F.coalesce(F.col("cleared") > F.col("era"), F.lit(False))
    return last.withColumn("open_op", F.when(gone, "CLEAR").otherwise(F.col("open_op"))).drop("era", "cleared")


def state(ops: DataFrame, now: Column, until_seq: int | None = None) -> DataFrame:
    """(key, value, expires_at_ms) of the live keys; expires_at_ms is null without a deadline."""
    live = final_epochs(ops, until_seq).where(is_live(now))
    return live.select("key", F.col("open_value").alias("value"), F.when(~persisted(), F.col("dl")).alias("expires_at_ms"))


def expired_count(ops: DataFrame, now: Column) -> DataFrame:
    """Entries that a clean-up at a time removes."""
    return final_epochs(ops).agg(F.count_if(F.col("open_op").isin("SET", "SETEX") & ~is_live(now)).alias("removed"))


def _rows(ops: DataFrame, rows: DataFrame | None) -> DataFrame:
    """rows, which is with_epochs(ops) where the caller has it already."""
    return with_epochs(ops) if rows is None else rows


def read_log(ops: DataFrame, op: str, rows: DataFrame | None = None) -> DataFrame:
    """(seq, key, live, value, ttl) as each row of one kind of read saw them."""
    rows = _rows(ops, rows).where(F.col("op") == op)
    now = F.col("now_ms")
    return rows.select("seq", "key", is_live(now).alias("live"), F.when(is_live(now), F.col("open_value")).alias("value"), ttl(now).alias("ttl"))


def persist_log(ops: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(seq, key, result): 1 only for the PERSIST that takes the deadline of a live entry."""
    rows = _rows(ops, rows)
    result = (F.col("open_op") == "SETEX") & (F.col("now_ms") < F.col("dl")) & (F.col("fp_seq") == F.col("seq"))
    return rows.withColumn("r", F.coalesce(result, F.lit(False)).cast("long")).where("op = 'PERSIST'").select("seq", "key", F.col("r").alias("result"))


def del_log(ops: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(seq, key, result): 1 if the key held an entry, expired or not, that no command had evicted yet.

    An expired entry is evicted by the next read of its key or by the next global read.
    """
    rows = _rows(ops, rows)
    last_read = F.max_by(F.when(F.col("op").isin(*READS), F.col("now_ms")), F.when(F.col("op").isin(*READS), F.col("seq")))
    spans = rows.groupBy("key", "era", "epoch").agg(
        F.max_by(F.struct("open_op", "open_seq", "dl", "fp"), "seq").alias("e"), last_read.alias("read_now")
    )
    spans = spans.select("key", "era", (F.col("epoch") + 1).alias("epoch"), "e.*", "read_now")
    dels = rows.where("op = 'DEL'").select("seq", "key", "era", "epoch")
    joined = last_before(ops, dels.join(spans, ["key", "era", "epoch"], "left"), GLOBAL_READS, "g")
    late = F.coalesce(F.col("read_now") >= F.col("dl"), F.lit(False))
    swept = F.coalesce((F.col("g_seq") > F.col("open_seq")) & (F.col("g_now") >= F.col("dl")), F.lit(False))
    held = F.coalesce(F.col("open_op").isin("SET", "SETEX"), F.lit(False))
    gone = (F.col("open_op") == "SETEX") & ~persisted() & (late | swept)
    return joined.select("seq", "key", (held & ~F.coalesce(gone, F.lit(False))).cast("long").alias("result"))


def following_clear(clears: DataFrame) -> DataFrame:
    """(era, n): for each of clears(seq, now_ms) the next one, null for the last.

    The next one within its own slice, else the first of the slices after; no task gets more than a slice.
    """
    own = F.struct("seq", "now_ms")
    back = clears.withColumn("_slice", -F.floor(F.col("seq") / SLICE))  # counted from the end
    inside = back.withColumn("_in", F.lead(own).over(Window.partitionBy("_slice").orderBy("seq")))
    per = back.groupBy("_slice").agg(F.min(own).alias("f"))
    # the nearest slice after has the largest number of those counted from the end
    per = per.select("_slice", F.struct(F.col("_slice").alias("s"), "f").alias("m"))
    found = inside.join(_carried(per, "_slice", "m"), "_slice")
    return found.select(F.col("seq").alias("era"), F.coalesce("_in", "before.f").alias("n"))


def lives(ops: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(key, from_now, from_seq, to_now, to_seq): when entries are live, in the order of (time, seq); to_* null: to the end.

    An entry ends with the key's next reset, the next CLEAR, or at its deadline: seq -1 there, before all commands.
    """
    rows = _rows(ops, rows)
    per = rows.where(F.col("epoch") > 0).groupBy("key", "era", "epoch").agg(
        F.max_by(F.struct("open_op", "open_seq", "open_now", "dl", "fp"), "seq").alias("e")
    )
    following = per.select("key", "era", (F.col("epoch") - 1).alias("epoch"), F.col("e.open_now").alias("n_now"), F.col("e.open_seq").alias("n_seq"))
    per = per.join(following, ["key", "era", "epoch"], "left").select("key", "era", "e.*", "n_now", "n_seq")
    clears = ops.where("op = 'CLEAR'").select("seq", "now_ms")
    # the CLEAR that ends an era: a row for each CLEAR
    first = clears.agg(F.min(F.struct("seq", "now_ms")).alias("n")).select(F.lit(-1).cast("long").alias("era"), "n")
    ends = first.unionByName(following_clear(clears))
    per = per.join(ends.where("n IS NOT NULL"), "era", "left")
    end = F.coalesce(
        F.when(F.col("n_seq").isNotNull(), F.struct(F.col("n_now").alias("now"), F.col("n_seq").alias("seq"))),
        F.when(F.col("n").isNotNull(), F.struct(F.col("n.now_ms").alias("now"), F.col("n.seq").alias("seq"))),
    )
    late = F.when(~persisted(), F.struct(F.col("dl").alias("now"), F.lit(-1).cast("long").alias("seq")))
    per = per.where(F.col("open_op").isin("SET", "SETEX") & (persisted() | (F.col("dl") > F.col("open_now")))).withColumn("end", F.least(end, late))
    return per.select("key", F.col("open_now").alias("from_now"), F.col("open_seq").alias("from_seq"), F.col("end.now").alias("to_now"), F.col("end.seq").alias("to_seq"))


def running(events: DataFrame) -> DataFrame:
    """Adds to events(now, seq, delta) the sum of delta over all events with a smaller (now, seq).

    Within spans of time that hold about SLICE events each, after the sums of the spans before. Where a span has many
    more (a time at which much ends at once), its events of one (now, seq) are summed first, and those of one time are
    cut into slices of seq.
    """
    r = events.agg(F.min("now").alias("a"), F.max("now").alias("b"), F.count("*").alias("n")).first()
    width = max(1, ((r.b or 0) - (r.a or 0)) // max(1, r.n // SLICE) + 1)
    placed = events.withColumn("_span", F.floor(F.col("now") / F.lit(width)))
    spans = placed.groupBy("_span").agg(F.sum("delta").alias("_d"), F.count("*").alias("_n"))
    full = spans.where(F.col("_n") > 4 * SLICE).select("_span")
    spans = spans.select("_span", F.coalesce(F.sum("_d").over(Window.orderBy("_span").rowsBetween(*BEFORE)), F.lit(0)).alias("_before"))
    if r.n > 4 * SLICE and (n_full := full.count()):
        full = F.broadcast(full) if n_full <= MOST_BROADCAST else full
        inside = _within_span(placed.join(full, "_span", "left_anti")).unionByName(_within_full_span(placed.join(full, "_span", "left_semi")))
    else:
        inside = _within_span(placed)
    return inside.join(spans, "_span").withColumn("before", (F.col("_in") + F.col("_before")).cast("long")).drop("_span", "_in", "_before")


def _within_span(placed: DataFrame) -> DataFrame:
    order = Window.partitionBy("_span").orderBy("now", "seq").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = F.sum("delta").over(Window.partitionBy("_span", "now", "seq"))
    return placed.withColumn("_in", F.sum("delta").over(order) - peers)


def _within_full_span(placed: DataFrame) -> DataFrame:
    """The same for spans with many events: over (now, slice of seq) and within those."""
    part = ("_span", "now", "_slice")
    points = placed.groupBy("_span", "now", "seq").agg(F.sum("delta").alias("_d")).withColumn("_slice", F.floor(F.col("seq") / SLICE))
    slices = points.groupBy(*part).agg(F.sum("_d").alias("_s"))
    carried = F.sum("_s").over(Window.partitionBy("_span").orderBy("now", "_slice").rowsBetween(*BEFORE))
    own = F.sum("_d").over(Window.partitionBy(*part).orderBy("seq").rowsBetween(*BEFORE))
    both = points.withColumn("_own", own).join(slices.withColumn("_c", carried), list(part))
    total = F.coalesce("_own", F.lit(0)) + F.coalesce("_c", F.lit(0))
    return placed.join(both.select("_span", "now", "seq", total.alias("_in")), ["_span", "now", "seq"])


def dbsize_log(ops: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(seq, live): what each DBSIZE saw. Entries that begin and end are summed; no command meets the keys."""
    spans, one = lives(ops) if spans is None else spans, lambda x: F.lit(x).cast("long")
    nothing = F.lit(None).cast("long").alias("ask")
    events = spans.select(F.col("from_now").alias("now"), F.col("from_seq").alias("seq"), one(1).alias("delta"), nothing)
    ends = spans.where("to_now IS NOT NULL").select(F.col("to_now").alias("now"), F.col("to_seq").alias("seq"), one(-1).alias("delta"), nothing)
    asks = ops.where("op = 'DBSIZE'").select(F.col("now_ms").alias("now"), "seq", one(0).alias("delta"), F.col("seq").alias("ask"))
    return running(events.unionByName(ends).unionByName(asks)).where("ask IS NOT NULL").select(F.col("ask").alias("seq"), F.col("before").alias("live"))


def keys_log(ops: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(seq, keys array): what each KEYS saw, sorted. By definition one value with all live keys for each command.

    KEYS commands are numbered; an entry is in those numbered after its begin and before its end.
    """
    spans, one = lives(ops) if spans is None else spans, lambda x: F.lit(x).cast("long")
    asks = ops.where("op = 'KEYS'").select(F.col("now_ms").alias("now"), "seq", one(1).alias("delta"), F.lit("ask").alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("other"))
    begins = spans.select(F.col("from_now").alias("now"), F.col("from_seq").alias("seq"), one(0).alias("delta"), F.lit("begin").alias("kind"), "key", F.col("from_seq").alias("other"))
    ends = spans.where("to_now IS NOT NULL").select(F.col("to_now").alias("now"), F.col("to_seq").alias("seq"), one(0).alias("delta"), F.lit("end").alias("kind"), "key", F.col("from_seq").alias("other"))
    placed = running(asks.unionByName(begins).unionByName(ends))
    total = ops.where("op = 'KEYS'").agg(F.count("*").alias("all"))
    life = placed.where("kind <> 'ask'").groupBy("key", "other").agg(F.max(F.when(F.col("kind") == "begin", F.col("before"))).alias("a"), F.max(F.when(F.col("kind") == "end", F.col("before"))).alias("b"))
    life = life.crossJoin(F.broadcast(total)).withColumn("b", F.coalesce("b", "all")).where("b > a")  # a single row
    seen = life.select("key", F.explode(F.sequence(F.col("a") + 1, F.col("b"))).alias("number"))
    lists = seen.groupBy("number").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    numbers = placed.where("kind = 'ask'").select("seq", (F.col("before") + 1).alias("number"))
    return numbers.join(lists, "number", "left").select("seq", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))


def _written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table in the shared folder: several logs read them, by columns and kinds, and none computes them again."""
    path = scratch_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def responses(ops: DataFrame) -> DataFrame:
    """(seq, response) of every command. Rows with an error, if ops has such a column, get an error reply and do nothing else."""
    out = None
    if "error" in ops.columns:
        out = ops.where("error IS NOT NULL").select("seq", reply_error(F.col("error")).alias("response"))
        ops = ops.where("error IS NULL").drop("error")
    fine = ops.where(F.col("op").isin("SET", "SETEX", "CLEAR")).select("seq", reply_ok().alias("response"))
    out = fine if out is None else out.unionByName(fine)
    out = out.unionByName(ops.where("op = 'PING'").select("seq", F.lit("+PONG\r\n").alias("response")))
    rows, spans = _written(with_epochs(ops), "kv-rows"), None
    if ops.where(F.col("op").isin(*GLOBAL_READS)).limit(1).count():
        spans = _written(lives(ops, rows), "kv-lives")
    for op, reply in (("GET", reply_value(F.col("value"))), ("EXISTS", reply_int(F.col("live").cast("int"))), ("TTL", reply_int(F.col("ttl")))):
        out = out.unionByName(read_log(ops, op, rows).select("seq", reply.alias("response")))
    for log in (persist_log(ops, rows), del_log(ops, rows)):
        out = out.unionByName(log.select("seq", reply_int(F.col("result")).alias("response")))
    if spans is None:
        return out
    out = out.unionByName(dbsize_log(ops, spans).select("seq", reply_int(F.col("live")).alias("response")))
    return out.unionByName(keys_log(ops, spans).select("seq", reply_list(F.col("keys")).alias("response")))
