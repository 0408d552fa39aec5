"""Conversation repair against a shortest-path search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from zlib import crc32

from tracemill.llm import conversations

ROWS = "conv_id long, turn long, role string, text string"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def naive(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = lambda v: " " if v is None else str(v)
        h, role, text = crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, fault = set(), []
    for _, r, x in out:
        body = x.rstrip(" \t\n\x0b\x0c\r")
        fault.append(1 if not body else 2 if (r, x) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((r, x))
    at = [t for t, _, _ in out if t is not None]
    gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(out) and state in ("", "a"):
            break
        for first, name in (("u", "user"), ("a", "assistant")):
            if (state, first) in STEP:
                heapq.heappush(heap, (cost + 5, audit + "I", i, STEP[state, first], (*lines, (name, ""))))
        if i < len(out):
            (_, r, x), f = out[i], fault[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if f not in (1, 2):
                for name, letter, more in ((r, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if (state, name[:1]) in STEP:
                        heapq.heappush(heap, (cost + more + 5 * (f == 3), audit + letter, i + 1, STEP[state, name[:1]], (*lines, (name, x))))
    text = "\n".join(f"{a}:{b}" for a, b in lines)
    return gaps, fault.count(1), fault.count(2), fault.count(3), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def compared(df):
    rows = df.select("conv_id", "turn", "role", "text").collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append(tuple(r))
    got = conversations.repaired(df).collect()
    assert len(got) == len(by)
    assert {r.conv_id: tuple(r)[1:] for r in got} == {k: naive(v) for k, v in by.items()}


def test_odd_conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in range(120):
        for t in range(rng.choice([1, 2, 3, 5, 8, 13, 40])):
            rows.append((None if c == 7 else c, rng.choice([t, t, t, t + 2, None]), rng.choice(["user", "assistant", "system", "user", "tool", None]), rng.choice(["Hi.", "No", "ok!", "", "  ", "a. \n", "é?", None, f"t{t}."])))
    rows += [(999, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)]
    compared(spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS conv", "'x' AS seq", "'y' AS fault"))


def test_whole_table(spark):
    compared(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))


def test_no_conversations(spark):
    assert conversations.repaired(spark.createDataFrame([], ROWS)).collect() == []


def test_a_conversation_that_loses_all_rows(spark):
    gone = next((c, t) for c in range(100) for t in range(9) if crc32(f"{c}:{t}".encode()) % 20 == 0)
    (r,) = conversations.repaired(spark.createDataFrame([(*gone, "user", "Hi.")], ROWS)).collect()
    assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_batches_are_cut_at_conversations(spark):
    held = conversations.AT_ONCE
    rows = spark.range(held + 5000).selectExpr("id DIV 7 AS conv_id", "id % 7 AS turn", "IF(id % 7 % 2 = 0, 'user', 'assistant') AS role", "concat('Say ', id, '.') AS text").coalesce(1)
    got = conversations.repaired(rows, damage=False).selectExpr("count(*) AS n", "sum(length(audit)) AS edits", "count_if(audit = 'KKKKKKD') AS odd").first()
    assert (got.n, got.odd) == (-(-(held + 5000) // 7), got.n - (1 if (held + 5000) % 7 else 0))
