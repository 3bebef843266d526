"""Repair of a conversation's structure by weighted finite-state composition.

An input acceptor spells a conversation's rows in order of turn, an edit transducer keeps, reroles, deletes or inserts
rows, and an acceptor takes the role initials (s?(ua)+)?. Weights are pairs of a cost and the edits' initials (K, R, D, I); adding
takes the smaller cost and, of equal ones, the ASCII-least string, multiplying adds costs and joins strings. The composition
is lazy: arcs of a grammar state and an input symbol are made when they are first reached, and the shortest path is found
backwards in topological order.

Two things keep it small. Two insertions in a row lead from a state after the beginning back to itself, so at most two stand
before a row. And an arc takes its insertions and then one row, so that of two strings over the same rows neither begins the
other; hence a stretch of a conversation is one matrix of weights from each grammar state to each other, and the
matrices of neighbouring stretches multiply to that of both.

That is how a conversation of any length is spread out: rows are sorted by a range shuffle over (conversation, turn, ...), so a long
one lies in many tasks; a task solves the conversations that begin and end within it, and gives a matrix for each
other stretch; the matrices of a conversation (a path of a character a row, at most 16 of them a stretch) are multiplied in one
task, and its rows get their edits by a join. Only the digest must see all of a conversation's texts in order: it is taken
as a stream over sorted rows, a conversation at a time, in constant memory.

Faults of a row, the first counts: blank (nothing but space and tab to carriage return), duplicate (an earlier row has its role and
text), truncated (the last other character is none of .!?). Costs: keep 0, rerole to user or assistant 3, delete 4 and the only
choice for blank and duplicate rows, insert a row of empty text 3, 3 more for a truncated row that stays.

Defined cases: null roles and texts count as one space; null ids are one conversation; null turns come first; rows of
one turn are taken by role and then text (both by their first 256 characters and, for texts, SHA-256), equal ones in any order; a role is what its first
character says, any other than s, u and a can't be kept; no rows give no conversation; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import runs, small_batches, written

GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
#: Weight of ending in a state: nothing, or the rows that are still missing.
ENDS = {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of text and rows of a conversation that a task keeps until its end; of longer ones it gives stretches.
KEPT_BYTES, KEPT_ROWS = 4 << 20, 4096
#: Most rows of a stretch, and rows of a piece of a stretch's edits in the join with the rows.
STRETCH_ROWS, PIECE = 1 << 16, 1024


def edits(symbol: str) -> Iterator[tuple[str, str | None, int]]:
    """(label, role or None, cost) of a row: s, u, a or o (other), a capital if it is truncated, d if it must go."""
    yield "D", None, DELETE
    if symbol != "d":
        extra = TRUNCATED if symbol.isupper() else 0
        if symbol.lower() in "sua":
            yield "K", symbol.lower(), extra
        for role in ROLES:
            yield "R", role, REROLE + extra


@lru_cache(None)  # four states and nine symbols
def arcs(state: int, symbol: str) -> dict[int, tuple[int, str]]:
    """The least (cost, string) to each state that insertions and then one row lead to."""
    best: dict[int, tuple[int, str]] = {}
    at = [(state, 0, "")]
    for _ in range(3):
        for g, cost, string in at:
            for label, role, more in edits(symbol):
                to = g if role is None else GRAMMAR[g].get(role)
                if to is not None:
                    weight = (cost + more, string + label)
                    best[to] = min(best.get(to, weight), weight)
        at = [(to, cost + INSERT, string + "I") for g, cost, string in at for role, to in GRAMMAR[g].items() if role in ROLES]
    return best


def _ranked(weights: dict[int, tuple[int, tuple]]) -> dict[int, tuple[int, int]]:
    """(cost, place of the string among the others) of {state: (cost, string or what orders like it)}."""
    order = {s: i for i, s in enumerate(sorted({s for _, s in weights.values()}))}
    return {g: (cost, order[s]) for g, (cost, s) in weights.items()}


def shortest(symbols: str, ends: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str, int]]:
    """{start: (cost, string, end)} of the best paths over the symbols, without the ends' own strings."""
    best = _ranked(ends)
    steps = []
    for symbol in reversed(symbols):
        found = {}
        for g in GRAMMAR:
            ways = [(cost + best[to][0], string, best[to][1], to) for to, (cost, string) in arcs(g, symbol).items() if to in best]
            if ways:
                found[g] = min(ways)
        steps.append(found)
        best = _ranked({g: (cost, (string, place)) for g, (cost, string, place, _) in found.items()})
    out = {}
    for g in best:
        path, at = [], g
        for found in reversed(steps):
            _, string, _, at = found[at]
            path.append(string)
        out[g] = (best[g][0], "".join(path), at)
    return out


def operations(state: int, string: str, classes: str) -> tuple[str, int]:
    """(five characters a row, the last state) of a path: roles inserted before the row (2), its own edit (k, d, or its new role), after (2).

    Only a conversation's last row has insertions after it.
    """
    out, before, i = [], "", 0
    for label in string:
        if label == "I":
            role = "a" if state == 2 else "u"
            before, state = before + role, GRAMMAR[state][role]
            continue
        own = "d"
        if label != "D":
            own = classes[i] if label == "K" else ("a" if state == 2 else "u")
            state = GRAMMAR[state][own]
        out.append(before.ljust(2, "-") + ("k" if label == "K" else own) + "--")
        before, i = "", i + 1
    if before and out:
        out[-1] = out[-1][:3] + before.ljust(2, "-")
    return "".join(out), state


def _symbols(classes: str, faults: str) -> str:
    return "".join("d" if f in "bd" else c.upper() if f == "t" else c for c, f in zip(classes, faults))


def _illegal(classes: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(classes, classes[1:]))


def solve(classes: str, faults: str) -> tuple[int, str, str]:
    """(cost, audit, operations) of a whole conversation; most conversations are short and alike."""
    return (_known if len(classes) <= 64 else _known.__wrapped__)(classes, faults)


@lru_cache(1 << 16)
def _known(classes: str, faults: str) -> tuple[int, str, str]:
    cost, string, end = shortest(_symbols(classes, faults), ENDS)[0]
    string += ENDS[end][1]
    return cost, string, operations(0, string, classes)[0]


def lines(role: str, text: str, ops: str) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the rows that a row turns into."""
    made = [("insert", ROLES[r], "") for r in ops[:2] if r != "-"]
    if ops[2] == "k":
        made.append(("keep", role, text))
    elif ops[2] != "d":
        made.append(("rerole", ROLES[ops[2]], text))
    return made + [("insert", ROLES[r], "") for r in ops[3:] if r != "-"]


class Stretch:
    """Counts of neighbouring rows of a conversation; nothing that grows but a character or two a row."""

    def __init__(self) -> None:
        self.classes: list[str] = []
        self.faults: list[str] = []
        self.low = self.high = None
        self.turns = 0

    def add(self, kind: str, fault: str, turn: int | None) -> None:
        self.classes.append(kind)
        self.faults.append(fault)
        if turn is not None:
            self.turns += self.high is None or turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def counts(self) -> dict:
        return {"n": len(self.classes), "blank": self.faults.count("b"), "duplicate": self.faults.count("d"), "truncated": self.faults.count("t"), "illegal": _illegal("".join(self.classes)), "low": self.low, "high": self.high, "turns": self.turns}


def _report(counts: dict, cost: int, audit: str, digest: str | None) -> dict:
    gaps = 0 if counts["low"] is None else min(counts["high"] - counts["low"] + 1 - counts["turns"], (1 << 63) - 1)
    return {"gaps": gaps, "cost": cost, "audit": audit, "digest": digest} | {k: counts[k] for k in ("blank", "duplicate", "truncated", "illegal")}


def _digest(own: list[tuple[str, str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in own).encode()).hexdigest()


REPORT = "gaps long, cost long, audit string, digest string, blank long, duplicate long, truncated long, illegal long"
#: kind: done (a conversation's report), open (a stretch), row (a row of a stretch) and repaired (a row, ready).
PARTS = f"kind string, c string, stretch long, seq long, sub int, edit string, role string, text string, payload string, {REPORT}"
NAMES = [f.split()[0] for f in PARTS.split(", ")]
TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    arrays = [pa.array([r.get(n) for r in rows], TYPES[f.split()[1]]) for n, f in zip(NAMES, PARTS.split(", "))]
    return pa.RecordBatch.from_arrays(arrays, NAMES)


def _summarise(batches: Iterator[pa.RecordBatch], keep_rows: bool, kept_rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (c, turn, role, text, fault, mark) to reports of whole conversations and stretches of others.

    A row with a mark comes before the row that it calls a duplicate. The first and the last conversation of a task may
    go on in its neighbours; they and long ones are given as stretches.
    """
    base, n = TaskContext.get().partitionId() << 32, 0
    out: list[dict] = []
    size = 0
    name = marked = None
    first, goes_on = True, False
    own, kept, kept_bytes, stretch = Stretch(), [], 0, None

    def let_go() -> None:  # the rows that are kept become rows of a stretch
        nonlocal stretch, n, kept, kept_bytes
        if stretch is None:
            stretch, n = base + n, n + 1
        at = len(own.classes) - len(kept)
        for i, (role, text) in enumerate(kept):
            out.append({"kind": "row", "c": name, "stretch": stretch, "seq": at + i, "role": role, "text": text})
        kept, kept_bytes = [], 0

    def close(last: bool, cut: bool = False) -> None:
        nonlocal stretch, n, kept, kept_bytes, own, first, goes_on
        if not own.classes:
            first, goes_on = False, cut
            return
        classes, faults = "".join(own.classes), "".join(own.faults)
        if first or last or cut or goes_on or stretch is not None:
            let_go()
            matrix = []
            for end in GRAMMAR:
                for start, (cost, string, _) in shortest(_symbols(classes, faults), {end: (0, "")}).items():
                    matrix.append((start, end, cost, string))
            out.append({"kind": "open", "c": name, "stretch": stretch, "payload": json.dumps({"classes": classes, "matrix": matrix} | own.counts())})
        else:
            cost, audit, ops = solve(classes, faults)
            made = [x for i, (role, text) in enumerate(kept) for x in lines(role, text, ops[5 * i : 5 * i + 5])]
            out.append({"kind": "done", "c": name} | _report(own.counts(), cost, audit, _digest(made)))
            if keep_rows:
                stretch, n = base + n, n + 1
                out.extend({"kind": "repaired", "c": name, "stretch": stretch, "seq": i, "sub": 0, "edit": e, "role": r, "text": t} for i, (e, r, t) in enumerate(made))
        own, kept, kept_bytes, stretch, first, goes_on = Stretch(), [], 0, None, False, cut

    for batch in small_batches(batches, "text"):
        for c, turn, role, text, fault, mark in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if c != name:
                if name is not None:
                    close(False)
                name = c
            if mark:
                marked = True
                continue
            own.add(role[:1] if role[:1] in ("s", "u", "a") else "o", "d" if marked and fault != "b" else fault, turn)
            marked = None
            kept.append((role, text))
            kept_bytes += len(text)
            size += len(text) + 100
            if kept_bytes > KEPT_BYTES or len(own.classes) > kept_rows:
                let_go()
            if len(own.classes) >= most:
                close(False, cut=True)
            if size > KEPT_BYTES and out:
                yield _batch(out)
                out.clear()
                size = 0
    close(True)
    if out:
        yield _batch(out)


def _compose(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """Stretches (c, stretch, payload), sorted, to a report of each conversation and its stretches' edits in pieces."""
    for table in runs(batches, "c"):
        names, ids, payloads = (table.column(x).to_pylist() for x in ("c", "stretch", "payload"))
        a = 0
        while a < len(names):
            b = a
            while b < len(names) and names[b] == names[a]:
                b += 1
            rows = _solved(names[a], ids[a:b], [json.loads(p) for p in payloads[a:b]], piece)
            for i in range(0, len(rows), 4096):
                yield _batch(rows[i : i + 4096])
            a = b


def _solved(name: str, ids: list[int], parts: list[dict], piece: int) -> list[dict]:
    best, steps = _ranked(ENDS), []
    for part in reversed(parts):
        found: dict[int, tuple] = {}
        for start, end, cost, string in part["matrix"]:
            if end in best:
                way = (cost + best[end][0], string, best[end][1], end)
                found[start] = min(found.get(start, way), way)
        steps.append(found)
        best = _ranked({g: (cost, (string, place)) for g, (cost, string, place, _) in found.items()})
    state, audit, out = 0, [], []
    total = dict(parts[0])
    for before, part in zip(parts, parts[1:]):
        for k in ("n", "blank", "duplicate", "truncated", "illegal", "turns"):
            total[k] += part[k]
        total["illegal"] += _illegal(before["classes"][-1] + part["classes"][0])
        if part["low"] is not None:
            total["turns"] -= total["high"] == part["low"]
            total["low"] = part["low"] if total["low"] is None else total["low"]
            total["high"] = part["high"]
    cost = steps[-1][0][0]
    for i, (stretch, part, found) in enumerate(zip(ids, parts, reversed(steps))):
        _, string, _, end = found[state]
        string += ENDS[end][1] if i == len(parts) - 1 else ""
        ops, _ = operations(state, string, part["classes"])
        for k in range(0, part["n"], piece):
            out.append({"kind": "piece", "c": name, "stretch": stretch, "seq": k // piece, "text": ops[5 * k : 5 * (k + piece)]})
        audit.append(string)
        state = end
    return [*out, {"kind": "report", "c": name} | _report(total, cost, "".join(audit), None)]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, stretch, seq, role, text, ops) to repaired rows."""
    for batch in small_batches(batches, "text"):
        rows = []
        for c, stretch, seq, role, text, ops in zip(*(x.to_pylist() for x in batch.columns)):
            rows.extend({"kind": "repaired", "c": c, "stretch": stretch, "seq": seq, "sub": i, "edit": e, "role": r, "text": t} for i, (e, r, t) in enumerate(lines(role, text, ops)))
        yield _batch(rows)


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted repaired rows (c, role, text) to a digest a conversation; memory follows a batch."""
    name = digest = None
    out: list[tuple[str, str]] = []
    for batch in small_batches(batches, "text"):
        for c, role, text in zip(*(x.to_pylist() for x in batch.columns)):
            if c != name:
                if name is not None:
                    out.append((name, digest.hexdigest()))
                name, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
    if name is not None:
        out.append((name, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], ["c", "streamed"])


def _bare(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def repair(turns: DataFrame, keep_rows: bool = False, kept_rows: int = KEPT_ROWS, stretch_rows: int = STRETCH_ROWS, piece: int = PIECE) -> tuple[DataFrame, DataFrame | None]:
    """(reports, rows) of turns(conv_id, turn, role, text).

    reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and digest (SHA-256 of the repaired rows as role:text,
    joined by newlines). rows, if they are to be kept: conv_id, stretch, seq, sub, edit, role, text of the repaired conversations, in the order
    of the three numbers within one.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    c = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("x"), F.col("conv_id").cast("string")))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select(c.alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    fault = F.when(_bare(F.col("text")) == "", "b").when(F.right(_bare(F.col("text")), F.lit(1)).isin(".", "!", "?"), " ").otherwise("t")
    digest = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    rows = rows.select("*", fault.alias("fault"), F.left("role", F.lit(256)).alias("r"), F.left("text", F.lit(256)).alias("t"), digest.alias("h"), F.monotonically_increasing_id().alias("uid"))
    rows = written(rows, "turns")
    order = ["turn", "r", "t", "h", "uid"]
    slim = rows.select("c", *order)
    firsts = slim.groupBy("c", "h").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = written(firsts.select("c", "h", F.col("first.uid").alias("first")), "first-rows")
    later = slim.join(firsts, ["c", "h"]).where("uid <> first").select("c", *order, F.lit(True).alias("mark"))
    marked = rows.withColumn("mark", F.lit(False)).unionByName(later, allowMissingColumns=True)
    dealt = marked.repartitionByRange("c", *order).sortWithinPartitions("c", *order, F.desc("mark"))
    parts = dealt.select("c", "turn", "role", "text", "fault", "mark").mapInArrow(lambda b: _summarise(b, keep_rows, kept_rows, stretch_rows), PARTS)
    parts = written(parts, "repair-parts")
    solved = parts.where("kind = 'open'").select("c", "stretch", "payload").repartition("c").sortWithinPartitions("c", "stretch")
    solved = written(solved.mapInArrow(lambda b: _compose(b, piece), PARTS), "repair-solved")
    pieces = solved.where("kind = 'piece'").select("stretch", F.col("seq").alias("piece"), F.col("text").alias("all_ops"))
    opened = parts.where("kind = 'row'").withColumn("piece", F.floor(F.col("seq") / piece))
    at = (F.col("seq") % piece * 5 + 1).cast("int")
    opened = opened.join(pieces, ["stretch", "piece"]).select("c", "stretch", "seq", "role", "text", F.substring(F.col("all_ops"), at, F.lit(5)).alias("ops"))
    mended = opened.mapInArrow(_apply, PARTS)
    if keep_rows:
        mended = written(mended, "repair-rows")
    ordered = mended.select("c", "stretch", "seq", "sub", "role", "text").repartition("c").sortWithinPartitions("c", "stretch", "seq", "sub")
    digests = ordered.select("c", "role", "text").mapInArrow(_stream_digests, "c string, streamed string")
    nothing = F.lit(hashlib.sha256().hexdigest())  # of a conversation all of whose rows go
    names = [f.split()[0] for f in REPORT.split(", ")]
    long = solved.where("kind = 'report'").join(digests, "c", "left").withColumn("digest", F.coalesce("streamed", nothing))
    reports = parts.where("kind = 'done'").select("c", *names).unionByName(long.select("c", *names))
    own = F.when(F.col("c") != "", F.expr("substring(c, 2)")).cast(kind).alias("conv_id")
    if not keep_rows:
        return reports.select(own, *names), None
    fixed = parts.where("kind = 'repaired'").unionByName(mended)
    return reports.select(own, *names), fixed.select(own, "stretch", "seq", "sub", "edit", "role", "text")
