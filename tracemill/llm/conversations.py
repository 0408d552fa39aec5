"""Repair of damaged conversations: the cheapest edits by a dynamic program over turns, for many conversations at once.

A conversation's roles must read (system)? (user assistant)*. Turns are kept, given another role or deleted, and empty
turns inserted. States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn. A task
lays the conversations of similar length out as time-major tensors, goes backwards over the turns and keeps every
state's cost from there to the end, then goes forwards and takes the least letter of those edits that reach it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm._shared import parked

#: What edits cost, and what a truncated turn costs if it stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_FAR = 1 << 20
#: The state after a user or assistant turn is inserted or set, which the state before decides; and after a turn of each role (system, user, assistant, other), -1 if it can't stand there.
_SET = np.array([2, 2, 3, 2])
_KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Turns that a task lays out together, but for a longer conversation.
AT_ONCE = 200_000
BLANK, DUPLICATE, TRUNC = 1, 2, 3


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text) with repeatable faults: by a hash of conv and turn a row goes, loses its text or its full
    stops, is repeated, or becomes the user's."""
    blank = F.lit(" ")
    h = F.crc32(F.concat(F.coalesce(F.col("conv").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    found = rows.withColumn("_h", h).filter("_h <> 0").select(
        "conv",
        "turn",
        F.when(F.col("_h") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return found.drop("copy")


def turns(rows: DataFrame) -> DataFrame:
    """``rows`` numbered within their conversation by turn (nulls first), role and text: seq from 1 on, with ``fault``: 1 blank, 2 a role and text
    seen earlier, 3 without an end, 0 none."""
    order = [F.asc_nulls_first("turn"), "role", "text"]
    body = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    end = F.substring(body, -1, 1)
    seen = F.row_number().over(Window.partitionBy("conv", "role", F.xxhash64("text"), "text").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(F.length(body) == 0, BLANK).when(F.col("seen"), DUPLICATE).when(~end.isin(".", "!", "?"), TRUNC).otherwise(0)
    numbered = rows.withColumn("seen", seen).withColumn("seq", F.row_number().over(Window.partitionBy("conv").orderBy(*order, "seen")).cast("long"))
    return parked(numbered.select("conv", "seq", "turn", "role", "text", fault.cast("byte").alias("fault")), "turns")


def backward(role: np.ndarray, fault: np.ndarray, here: np.ndarray) -> np.ndarray:
    """costs[t, state, conversation]: the least cost from turn t on, in that state before it. Arrays are [turn, conversation]; ``here`` is
    False behind a conversation's end."""
    t_max, n = role.shape
    costs = np.empty((t_max + 1, 4, n), np.int32)
    costs[t_max] = np.array([0, 2 * INSERT, INSERT, 0])[:, None]
    for t in range(t_max - 1, -1, -1):
        after = costs[t + 1]
        stays = np.where(fault[t] == TRUNC, TRUNCATED, 0) + np.where((fault[t] == BLANK) | (fault[t] == DUPLICATE), _FAR, 0)
        best = np.empty((4, n), np.int32)
        for q in range(4):
            to = _KEEP[q][role[t]]
            keep = np.where(to < 0, _FAR, after[np.maximum(to, 0), np.arange(n)]) + stays
            best[q] = np.minimum(np.minimum(after[q] + DELETE, after[_SET[q]] + REROLE + stays), keep)
        two, three = np.minimum(best[2], best[3] + INSERT), np.minimum(best[3], best[2] + INSERT)
        best = np.stack([np.minimum(best[0], two + INSERT), np.minimum(best[1], two + INSERT), two, three])
        costs[t] = np.where(here[t], best, after)
    return costs


#: Letters of edits in their order, which decides ties.
_D, _I, _K, _R = (ord(c) for c in "DIKR")


def trace(role: np.ndarray, fault: np.ndarray, here: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, states): [turn, slot, conversation], the letters of up to three inserts before a turn and of the turn itself, 0 for none, and
    the state after each; the last turn holds the inserts at the end."""
    t_max, n = role.shape
    edits, states = np.zeros((t_max + 1, 4, n), np.uint8), np.zeros((t_max + 1, 4, n), np.int8)
    q, every = np.zeros(n, np.int64), np.arange(n)
    for t in range(t_max + 1):
        last = t == t_max
        own = np.zeros(n, bool) if last else here[t]
        for slot in range(3):
            now = costs[t, q, every]
            delete = own & (costs[min(t + 1, t_max), q, every] + DELETE == now)
            add = ~delete & (own | last) & (costs[t, _SET[q], every] + INSERT == now)
            edits[t, slot][add] = _I
            q = np.where(add, _SET[q], q)
            states[t, slot] = q
        if last:
            break
        after, now = costs[t + 1], costs[t, q, every]
        stays = np.where(fault[t] == TRUNC, TRUNCATED, 0) + np.where((fault[t] == BLANK) | (fault[t] == DUPLICATE), _FAR, 0)
        to = _KEEP[q, role[t]]
        delete = after[q, every] + DELETE == now
        keep = ~delete & (to >= 0) & (after[np.maximum(to, 0), every] + stays == now)
        edits[t, 3] = np.where(own, np.where(delete, _D, np.where(keep, _K, _R)), 0)
        q = np.where(own, np.where(delete, q, np.where(keep, to, _SET[q])), q)
        states[t, 3] = q
    return edits, states


def _laid_out(codes: tuple[np.ndarray, ...], starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(which conversations, where their turns stand, tensors of role, fault and presence), by powers of two of their length."""
    level = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    for k in np.unique(level):
        some = np.flatnonzero(level == k)
        t_max = int(sizes[some].max())
        at = starts[some][None, :] + np.arange(t_max)[:, None]
        here = np.arange(t_max)[:, None] < sizes[some][None, :]
        at = np.where(here, at, 0)
        yield some, at, here, *[np.where(here, c[at], 0) for c in codes]


def edited(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, sums) of turns(). lines (conv, seq, added, letter, state): before each row, and behind the last one, how many turns are inserted
    and the first one's state; the row's own letter and the state after it. sums: a row for each conversation.

    A task holds the codes of a conversation's turns, a few bytes each, and no texts.
    """
    first = F.substring("role", 1, 1)
    code = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).cast("byte")
    slim = rows.select("conv", "seq", "turn", code.alias("code"), "fault")
    conv = rows.schema["conv"].dataType.simpleString()
    names = ["kind", "conv", "seq", "added", "begin", "letter", "state", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    longs = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"

    def worked(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        seq, role, fault = (whole.column(c).to_numpy() for c in ("seq", "code", "fault"))
        turn = whole.column("turn").combine_chunks()
        known = turn.is_valid().to_numpy(zero_copy_only=False)
        value = turn.fill_null(0).to_numpy().astype(np.int64)
        starts = np.flatnonzero(seq == 1)
        sizes = np.diff(np.append(starts, len(seq)))
        of = np.repeat(np.arange(len(starts)), sizes)
        inside = np.append(False, of[1:] == of[:-1])
        total = lambda mask: np.bincount(of[mask], minlength=len(starts))
        # turns come in order, so their extremes are the first and the last that is known, and new ones differ from those before
        ends = starts + sizes - 1
        nulls = total(~known)
        some = nulls < sizes
        new = known & ~(inside & np.append(False, known[:-1]) & np.append(False, value[1:] == value[:-1]))
        gaps = np.where(some, value[ends] - value[np.minimum(starts + nulls, ends)] + 1 - total(new), 0)
        before, now = np.append(0, role[:-1]), role
        fine = ((now == 1) & ((before == 0) | (before == 2))) | ((now == 2) & (before == 1))
        illegal = total(inside & ~fine)
        counts = [gaps, *[total(fault == f) for f in (BLANK, DUPLICATE, TRUNC)], illegal]
        conv_of = whole.column("conv").combine_chunks()
        for which, at, here, r, f in _laid_out((role, fault), starts, sizes):
            costs = backward(r, f, here)
            edits, states = trace(r, f, here, costs)
            flat = edits.transpose(2, 0, 1).reshape(len(which), -1)
            audits = [row[row > 0].tobytes().decode() for row in flat]
            n, ids = len(which), conv_of.take(pa.array(starts[which]))
            blank = [pa.nulls(n, k) for k in (pa.int64(), pa.int32(), pa.int8(), pa.string(), pa.int8())]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int8)), ids, *blank, *[pa.array(c[which].astype(np.int64)) for c in counts], pa.array(costs[0, 0].astype(np.int64)), pa.array(audits, pa.string())], names)
            added = (edits[:, :3] == _I).sum(1).astype(np.int32)
            begin = states[:, 0]
            shown = np.concatenate([here, added[-1:] > 0])
            t, c = np.nonzero(shown)
            letters = np.array([bytes([x]).decode() if x else "" for x in range(128)])[edits[t, 3, c]]
            m = len(t)
            own = [pa.array(np.where(t < len(here), t, sizes[which][c]).astype(np.int64) + 1), pa.array(added[t, c]), pa.array(begin[t, c]), pa.array(letters, pa.string()), pa.array(states[t, 3, c])]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int8)), ids.take(pa.array(c)), *own, *[pa.nulls(m, pa.int64()) for _ in range(6)], pa.nulls(m, pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            seq = batch.column("seq").to_numpy()
            begins = np.flatnonzero(seq == 1)
            # what is held is whole up to the last conversation that begins here
            if n + len(seq) > AT_ONCE and len(begins) and n + begins[-1] > 0:
                held.append(batch.slice(0, int(begins[-1])))
                yield from worked(pa.Table.from_batches(held))
                batch = batch.slice(int(begins[-1]))
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
        if n:
            yield from worked(pa.Table.from_batches(held))

    dealt = slim.repartition("conv").sortWithinPartitions("conv", "seq")
    found = parked(dealt.mapInArrow(run, f"kind byte, conv {conv}, seq long, added int, begin byte, letter string, state byte, {longs}, audit string"), "edits")
    return found.filter("kind = 0").select("conv", "seq", "added", "begin", "letter", "state"), found.filter("kind = 1").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(conv, seq, text): the `role:text` lines that each row contributes, those of inserted turns first; rows without any are left out."""
    name = lambda state: F.when(state == 2, "user").otherwise("assistant")
    first, second = F.concat(name(F.col("begin")), F.lit(":")), F.concat(name(5 - F.col("begin")), F.lit(":"))
    inserted: Column = F.slice(F.array(first, second, first), 1, F.col("added"))
    role = F.when(F.col("letter") == "K", F.col("role")).otherwise(name(F.col("state")))
    own = F.when(F.col("letter").isin("K", "R"), F.array(F.concat(role, F.lit(":"), "text"))).otherwise(F.array().cast("array<string>"))
    x, y = lines.alias("x"), rows.alias("y")
    met = x.join(y, F.col("x.conv").eqNullSafe(F.col("y.conv")) & (F.col("x.seq") == F.col("y.seq")), "left")
    joined = met.select("x.conv", "x.seq", F.concat(inserted, own).alias("parts")).filter(F.size("parts") > 0)
    return joined.select("conv", "seq", F.array_join("parts", "\n").alias("text"))


def digests(lines: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of lines (conv, seq, text) joined by line breaks; a task reads a conversation's texts one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for batch in batches:
            convs, out = batch.column("conv"), []
            firsts = batch.column("first").to_pylist()
            for k, text in enumerate(batch.column("text").to_pylist()):
                if firsts[k]:
                    if h is not None:
                        out.append((now, h.hexdigest()))
                    now, h = convs[k].as_py(), hashlib.sha256(text.encode())
                else:
                    h.update(b"\n" + text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], convs.type), pa.array([x[1] for x in out])], ["conv", "repaired_sha256"])
            kind = convs.type
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([h.hexdigest()])], ["conv", "repaired_sha256"])

    first = F.row_number().over(Window.partitionBy("conv").orderBy("seq")) == 1
    # the window deals the lines by conversation and sorts them
    return lines.withColumn("first", first).mapInArrow(run, f"conv {lines.schema['conv'].dataType.simpleString()}, repaired_sha256 string")


def repaired(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null roles and texts count as one blank; null turns come first and count for no gap; a null id is a conversation. Rows of
    one turn are ordered by role and text. With ``damage``, rows are damaged by damaged() first; a conversation that loses all
    of them has zeros, an empty audit and the digest of the empty text. Other columns are ignored.
    """
    plain = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = turns(damaged(plain) if damage else plain.fillna(" ", ["role", "text"]))
    lines, sums = edited(rows)
    ids = plain.select("conv").distinct()
    hashes = digests(repaired_lines(rows, lines))
    same = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv"))
    met = ids.alias("i").join(sums.alias("s"), same("i", "s"), "left").join(hashes.alias("h"), same("i", "h"), "left")
    zeros = [F.coalesce(F.col(f"s.{c}"), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select(F.col("i.conv").alias(conv_col), *zeros, F.coalesce("s.audit", F.lit("")).alias("audit"), F.coalesce("h.repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
