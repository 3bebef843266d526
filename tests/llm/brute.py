"""Plain Python versions of the operators."""

import hashlib
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache


def words(text):
    return (text or "").encode().lower().split()


def sets(text, k):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < k else (tuple(w[i : i + k]) for i in range(len(w) - k + 1)))


def near_duplicates(rows, k, percent=80):
    """{id: (size, component)} by comparing all pairs."""
    own = {i: sets(t, k) for i, t in rows}
    up = {i: i for i in own}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(own)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = own[i], own[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(own[i]), find(i)) for i in own}


def passages(rows, n):
    """Ids of documents that share n words in a row with another one."""
    seen = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            seen[tuple(w[k : k + n])].add(i)
    return {i for s in seen.values() if len(s) > 1 for i in s}


def contaminated(rows, items, k=5, percent=80):
    """{(doc, item)}: any item-sized window of the document, wherever it begins, is similar enough."""
    from collections import Counter

    out = set()
    for i, t in rows:
        w = words(t)
        for j, item in items:
            v = words(item)
            width = min(k, len(v))
            if not v or len(w) < width:
                continue
            x = [tuple(w[a : a + width]) for a in range(len(w) - width + 1)]
            y = [tuple(v[a : a + width]) for a in range(len(v) - width + 1)]
            there = set(y)
            if not there & set(x):
                continue
            b = Counter(y)
            for s in range(max(1, len(x) - len(y) + 1)):
                a = Counter(x[s : s + len(y)])
                common = sum((a & b).values())
                if 100 * common >= percent * (sum(a.values()) + sum(b.values()) - common):
                    out.add((i, j))
                    break
    return out


# --- conversations

GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    """(conv_id, turn, role, text) after the fixed damages."""
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub(r"[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def repaired(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest and lines of one conversation's (turn, role, text) by trying all edits."""
    rows = sorted(rows, key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2].encode()))
    seen, faults = set(), ""
    for _, r, x in rows:
        bare = x.strip(BLANK)
        faults += "b" if not bare else "d" if (r, x) in seen else "t" if bare[-1] not in ".!?" else " "
        seen.add((r, x))
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def go(i, g, inserted):
        ways = [(0, "", ())] if i == len(rows) and g in (0, 3) else []

        def way(rest, cost, label, line=()):
            if rest is not None:
                ways.append((cost + rest[0], label + rest[1], line + rest[2]))

        for o in "ua":
            if inserted < 3 and o in GRAMMAR[g]:
                way(go(i, GRAMMAR[g][o], inserted + 1), 3, "I", ((names[o], ""),))
        if i < len(rows):
            _, r, x = rows[i]
            way(go(i + 1, g, 0), 4, "D")
            if faults[i] not in "bd":
                more = 3 if faults[i] == "t" else 0
                if r[:1] in GRAMMAR[g]:
                    way(go(i + 1, GRAMMAR[g][r[:1]], 0), more, "K", ((r, x),))
                for o in "ua":
                    if o in GRAMMAR[g]:
                        way(go(i + 1, GRAMMAR[g][o], 0), 3 + more, "R", ((names[o], x),))
        return min(ways, key=lambda w: w[:2]) if ways else None

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    cost, audit, lines = go(0, 0, 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    first = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest), list(lines)


def conversation_repair(rows):
    """{conv_id: the query's other columns}."""
    by = {c: [] for c, _, _, _ in rows}
    for c, *rest in damaged(rows):
        by[c].append(tuple(rest))
    return {c: repaired(own)[0] for c, own in by.items()}
