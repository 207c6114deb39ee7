"""Conversation structure repair by depth-first branch and bound.

A conversation is right if its roles are `(s?(ua)+)?`: perhaps a system turn, then users and assistants in turn, ended by an assistant. Turns may be kept (0),
get the role user or assistant (2) or be deleted (3), and empty turns of user or assistant may be inserted anywhere (2). Blank turns and turns that repeat an earlier
one (role and text) have to be deleted; a truncated turn that stays costs 1 more. The cheapest edits are wanted, of these the
ones whose letters (D, I, K, R) come first.

The search holds an explicit stack of prefixes of edits, most promising on top. Suffix lower bounds come from the relaxed problem that leaves letters aside. (A looser
one, in which a change of role may yield either role, let the search of 400 turns with many system turns among them run on for minutes.) A prefix is given up when its cost and its bound exceed the incumbent's cost, or equal it while its letters come after. For each node, a number of turns read and a state
of the pattern, a table holds the best prefix so far; a worse one is not followed. The search ends when the stack is empty, which proves the incumbent.

Only codes of one byte a turn enter the search; texts meet their conversation's edits in one sorted stream, one text at a time. A conversation is one sequence of edits, so
its codes lie in one task. Null roles and texts become one space. Turns are in order of turn (null first), then role and the text's SHA-256; of equal rows the later ones
are duplicates. A null conv_id is a conversation of its own; a conversation without turns has the empty repair; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.llm.common import SPACES, runs, stored

#: States of the pattern: nothing yet, a system turn, a user's turn is open, an assistant has answered.
START, SYSTEM, OPEN, ANSWERED = range(4)
#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, STAYS = 2, 3, 2, 1
#: Codes of turns: the role's initial (s, u, a, other), 4 more if truncated; then turns to delete, and turns that damage dropped.
MUST_DELETE, DROPPED = 8, 9
#: Conversations of up to so many turns whose repair a task remembers, and how many of them.
SHORT, MEMO = 48, 100_000
ROWS = 4096


def turn_to(state: int) -> int:
    """The state after a turn whose role the pattern dictates."""
    return ANSWERED if state == OPEN else OPEN


def keeps(state: int, role: int) -> int | None:
    """The state after a turn that keeps its role, None where the pattern forbids it."""
    if role == 0:
        return SYSTEM if state == START else None
    if role == 1:
        return None if state == OPEN else OPEN
    return ANSWERED if role == 2 and state == OPEN else None


def _choices(state: int, code: int) -> tuple[tuple[int, int, int], ...]:
    """(letter, cost, next state) of the edits of a turn."""
    out = [(ord("D"), DELETE, state)]
    if code < MUST_DELETE:
        late = STAYS if code >= 4 else 0
        if (then := keeps(state, code % 4)) is not None:
            out.append((ord("K"), late, then))
        out.append((ord("R"), REROLE + late, turn_to(state)))
    return tuple(out)


CHOICES = tuple(tuple(_choices(state, code) for code in range(MUST_DELETE + 1)) for state in range(4))


def suffix_bounds(codes: bytes) -> array:
    """Four numbers for each count of turns read: what the rest costs at least from each state, its letters left aside."""

    def inserted(low: list[int]) -> list[int]:
        for _ in range(2):
            low = [min(low[s], INSERT + low[turn_to(s)]) for s in range(4)]
        return low

    far = 1 << 40
    low = inserted([0, far, far, 0])
    out = array("q", low * (len(codes) + 1))
    for i in range(len(codes) - 1, -1, -1):
        low = inserted([min(cost + low[then] for _, cost, then in CHOICES[s][codes[i]]) for s in range(4)])
        out[4 * i : 4 * i + 4] = array("q", low)
    return out


def cheapest(codes: bytes) -> tuple[int, str]:
    """The cost and the letters of the cheapest edits, ties by letters."""
    n, bound = len(codes), suffix_bounds(codes)
    parent, letter, cost = array("q", [-1]), bytearray(1), array("q", [0])  # prefixes by number: what they extend, by which letter, at which cost
    table = array("q", [-1]) * (4 * n + 4)  # the best prefix of each node
    table[START] = 0
    stack, best, ends, path = [(0, START)], -1, 1 << 60, {}

    def before(a: int, b: int) -> bool:
        """Whether the letters of prefix a come before those of b; the two part somewhere. Prefixes are numbered after what they extend."""
        x = y = 0
        while a != b:
            if a > b:
                x, a = letter[a], parent[a]
            else:
                y, b = letter[b], parent[b]
        return x < y

    def hopeless(prefix: int) -> bool:
        """Whether the incumbent's letters come before those of a prefix, and so of all that extend it."""
        last = 0
        while prefix not in path:
            last, prefix = letter[prefix], parent[prefix]
        return path[prefix] < last

    while stack:
        prefix, node = stack.pop()
        i, state = node >> 2, node & 3
        if table[node] != prefix or (least := cost[prefix] + bound[node]) > ends or (least == ends and hopeless(prefix)):
            continue
        if i == n and state in (START, ANSWERED):
            # a prefix that extends this one costs more; one that it extends has been given up or is no end
            if cost[prefix] < ends or before(prefix, best):
                best, ends, path = prefix, cost[prefix], {prefix: 0}
                at = prefix
                while parent[at] >= 0:
                    path[parent[at]] = letter[at]
                    at = parent[at]
            continue
        edits = [(bound[4 * i + turn_to(state)] + INSERT, 73, INSERT, 4 * i + turn_to(state))]  # 73: I
        if i < n:
            edits += [(bound[4 * i + 4 + then] + price, sign, price, 4 * i + 4 + then) for sign, price, then in CHOICES[state][codes[i]]]
        for _, sign, price, to in sorted(edits, reverse=True):  # the most promising one, of equal ones the first letter, ends on top
            total, held = cost[prefix] + price, table[to]
            if total + bound[to] > ends or (held >= 0 and total > cost[held]):
                continue
            parent.append(prefix)
            letter.append(sign)
            cost.append(total)
            new = len(parent) - 1
            if held >= 0 and total == cost[held] and not before(new, held):
                parent.pop(), letter.pop(), cost.pop()
                continue
            table[to] = new
            stack.append((new, to))
    out = bytearray()
    while parent[best] >= 0:
        out.append(letter[best])
        best = parent[best]
    return ends, out[::-1].decode()


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): conversations with the faults that the query plants; gone rows count for nothing but their conv_id."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(F.col("_f") == 1, F.lit("")).when(F.col("_f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), fault.alias("_f"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_f") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_f") == 0).alias("gone"), "_f")
    return rows.withColumn("_f", F.explode(F.when(F.col("_f") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_f")


def _present(turns: DataFrame) -> DataFrame:
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), gone.alias("gone"))


def coded(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, code, fault): turns by their faults: 1 blank, 2 duplicate, 3 truncated; texts stay behind."""
    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    rows = _present(turns).select("conv_id", "turn", "role", F.when(~F.col("gone"), F.sha2("text", 256)).alias("digest"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"), "gone")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "gone").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(F.col("gone"), 0).when(F.col("blank"), 1).when(again, 2).when(F.col("cut"), 3).otherwise(0)
    role = F.coalesce(F.nullif(F.position(F.substring("role", 1, 1), F.lit("sua")) * (F.length("role") > 0).cast("int"), F.lit(0)) - 1, F.lit(3))
    rows = rows.withColumn("fault", fault.cast("byte"))
    return rows.select("conv_id", "turn", "role", "digest", F.when(F.col("gone"), DROPPED).when(F.col("fault").isin(1, 2), MUST_DELETE).otherwise(role + F.when(F.col("fault") == 3, 4).otherwise(0)).cast("byte").alias("code"), "fault")


#: What is known of a conversation, and of a turn that stays: its key, its place among the edits, its role, and whether it is inserted.
SUMMARY = pa.struct([(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
SUMMARY_DDL = "struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string>"
EDITS = {"turn": pa.int64(), "role": pa.string(), "digest": pa.string(), "seq": pa.int64(), "out_role": pa.string(), "inserted": pa.bool_(), "summary": SUMMARY}


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of ROWS."""
    while held := list(itertools.islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*held, strict=True), types, strict=True)], names=names)


def _edited(run: pa.Table, memo: dict[bytes, tuple[int, str]]) -> Iterator[tuple]:
    """The rows of one conversation's edits: turns that stay, then the summary."""
    conv = run.column("conv_id")[0].as_py()
    code, fault = (run.column(c).to_numpy() for c in ("code", "fault"))
    here = np.flatnonzero(code != DROPPED)
    run, counts = run.take(pa.array(here)), np.bincount(fault[here], minlength=4)
    codes = code[here].astype(np.uint8).tobytes()
    if (found := memo.get(codes)) is None:
        found = cheapest(codes)
        if len(codes) <= SHORT and len(memo) < MEMO:
            memo[codes] = found
    cost, audit = found
    times = run.column("turn").drop_null().to_numpy()  # in order
    gaps = int(times[-1] - times[0]) - int((times[1:] != times[:-1]).sum()) if len(times) else 0
    illegal, last, place, system_first = 0, None, 0, 0
    key: tuple = (None, None, None)
    edits = iter(enumerate(audit))

    def dictated() -> str:
        return ("user", "assistant")[(place - system_first) % 2]

    for at in range(0, run.num_rows, ROWS):
        part = run.slice(at, ROWS)
        for turn, role, digest in zip(*(part.column(c).to_pylist() for c in ("turn", "role", "digest")), strict=True):
            key, initial = (turn, role, digest), role[:1]
            illegal += last is not None and last + initial not in ("su", "ua", "au")
            last = initial
            for seq, letter in edits:
                if letter != "D":
                    yield conv, *key, seq, role if letter == "K" else dictated(), letter == "I", None
                    system_first |= place == 0 and letter == "K" and initial == "s"
                    place += 1
                if letter != "I":
                    break
    for seq, _ in edits:
        yield conv, *key, seq, dictated(), True, None
        place += 1
    yield conv, None, None, None, -2, None, None, {"gaps": gaps, "blank": int(counts[1]), "duplicate": int(counts[2]), "truncated": int(counts[3]), "illegal": illegal, "cost": cost, "audit": audit}


def planned(turns: DataFrame) -> DataFrame:
    """The edits of all conversations: a row for each turn that stays or is inserted (key: turn, role, digest; an inserted one has the key of a neighbour), with its place among the
    edits (seq) and its new role; and for each conversation a row without a key (seq -2) that has its summary."""
    codes = coded(turns)
    kind = codes.schema["conv_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        if (first := next(batches, None)) is None:
            return
        memo: dict[bytes, tuple[int, str]] = {}
        rows = (row for run in runs(itertools.chain([first], batches), "conv_id") for row in _edited(run, memo))
        yield from _batches(rows, ["conv_id", *EDITS], [first.schema.field("conv_id").type, *EDITS.values()])

    ordered = codes.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest")
    return stored(ordered.mapInArrow(search, f"conv_id {kind}, turn long, role string, digest string, seq long, out_role string, inserted boolean, summary {SUMMARY_DDL}"))


def _met(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """Texts and edits of each conversation in one sorted stream: the summary, then each text before the edits that use it."""
    texts = _present(turns).where("not gone").select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), F.lit(-1).cast("long").alias("seq"), "text")
    rows = plan.unionByName(texts, allowMissingColumns=True).select("conv_id", "seq", "out_role", "inserted", "summary", "text", "turn", "role", "digest")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "seq")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, summary, role, text) in order: for each conversation its summary, then its repaired turns. One text is held at a time, besides a small part of a batch."""
    text = None
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for conv, seq, out_role, inserted, summary, own in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns[:6]), strict=True):
                if seq == -2:
                    yield conv, summary, None, None
                elif seq == -1:
                    text = own
                else:
                    yield conv, None, out_role, "" if inserted else text


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): all conversations repaired, places from 0. turns: conv_id, turn, role, text."""
    met = _met(turns, planned(turns))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place = 0
        for conv, summary, role, text in _streamed(batches):
            if summary is not None:
                place = 0
                continue
            yield conv, place, role, text
            place += 1

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        if (first := next(batches, None)) is not None:
            yield from _batches(placed(itertools.chain([first], batches)), ["conv_id", "place", "role", "text"], [first.schema.field(0).type, pa.int64(), pa.string(), pa.string()])

    return met.mapInArrow(write, f"conv_id {met.schema['conv_id'].dataType.simpleString()}, place long, role string, text string")


def repair_digests(turns: DataFrame) -> DataFrame:
    """A row for each conversation: its faults, the cheapest edits, and the SHA-256 of the repaired turns, `role:text` in lines."""
    met = _met(turns, planned(turns))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known, state, some = None, None, False
        for conv, summary, role, text in _streamed(batches):
            if summary is not None:
                if known is not None:
                    yield *known, state.hexdigest()
                known, state, some = (conv, *summary.values()), hashlib.sha256(), False
                continue
            state.update(("\n" * some + role + ":" + text).encode("utf-8", "surrogatepass"))
            some = True
        if known is not None:
            yield *known, state.hexdigest()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        if (first := next(batches, None)) is not None:
            names = ["conv_id", *(f.name for f in SUMMARY), "repaired_sha256"]
            yield from _batches(digests(itertools.chain([first], batches)), names, [first.schema.field(0).type, *(f.type for f in SUMMARY), pa.string()])

    return met.mapInArrow(write, f"conv_id {met.schema['conv_id'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired."""
    return repair_digests(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
