"""Repair and prefix trie of conversations against plain Python, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from claimweave.llm import repair, trie

SCHEMA = "conv_id long, turn long, role string, text string, cost long, depth long, digest string, kept boolean"


def table(spark, rows):
    """Rows with columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, 1, 2, "x", True) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    texts = ["Hello.", "What?", "no end", "", "   ", None, "a\nb!", "é漢字 \U0001f600.", "x" * 200_000 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "superuser"]
    out = []
    for conv in [*range(40), 5000, -7, None]:
        for turn in range(r.randint(0, 9)):
            out.append((conv, r.choice([turn, turn, turn, turn + 1, None]), r.choice(roles), r.choice(texts)))
    out += [(77, t, ("user", "assistant")[t % 2], f"t{t // 2}.") for t in range(300)]
    return out + out[5:9]


def expected_edits(codes):
    """The best (cost, letters) by trying all prefixes state by state, cheapest first; codes: (initial, delete, late)."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "")}

    def grow(best):
        for _ in range(3):
            for q, (c, a) in list(best.items()):
                for role in "ua":
                    if (to := step[q].get(role)) is not None and (c + 2, a + "I") < best.get(to, (10**9, "")):
                        best[to] = (c + 2, a + "I")
        return best

    for initial, delete, late in codes:
        new = {}
        for q, (c, a) in grow(best).items():
            ways = [(c + 3, a + "D", q)]
            if not delete:
                if initial in step[q]:
                    ways.append((c + late, a + "K", step[q][initial]))
                ways += [(c + 2 + late, a + "R", step[q][x]) for x in "ua" if x in step[q]]
            for cost, audit, to in ways:
                new[to] = min(new.get(to, (10**9, "")), (cost, audit))
        best = new
    best = grow(best)
    return min(best[q] for q in ("", "a") if q in best)


def expected_repair(rows, plant):
    out, by = {}, {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20 if plant else -1
        own = by.setdefault(conv, [])
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for conv, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        seen, codes, counts = set(), [], [0, 0, 0, 0]
        for _, role, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0
            seen.add((role, text))
            counts[fault] += 1
            codes.append((role[:1], fault in (1, 2), int(fault == 3)))
        cost, audit = expected_edits(codes)
        turns, at = [], 0
        for letter in audit:
            role, text = (None, "") if letter == "I" else own[at][1:]
            at += letter != "I"
            if letter != "D":
                last = turns[-1][0][:1] if turns else ""
                turns.append((role if letter == "K" else "assistant" if last == "u" else "user", text))
        times = [t for t, _, _ in own if t is not None]
        gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (gaps, *counts[1:], illegal, cost, audit, turns)
    return out


def test_search_against_all_prefixes():
    signs = [("s", 0, 0), ("u", 0, 0), ("a", 0, 0), ("x", 0, 0), ("s", 0, 1), ("u", 0, 1), ("a", 0, 1), ("x", 0, 1), ("", 1, 0)]
    r = random.Random(1)
    for n in range(4):
        for codes in itertools.product(range(9), repeat=n):
            assert repair.cheapest(bytes(codes)) == expected_edits([signs[c] for c in codes])
    for _ in range(500):
        codes = r.choices(range(9), [r.random() for _ in range(9)], k=r.randint(5, 60))
        assert repair.cheapest(bytes(codes)) == expected_edits([signs[c] for c in codes])
    long = bytes(r.choices(range(9), k=20_000))
    cost, audit = repair.cheapest(long)
    assert len(audit.replace("I", "")) == 20_000 and cost == expected_edits([signs[c] for c in long])[0]


@pytest.mark.parametrize("plant", [True, False])
def test_repair_against_plain_python(spark, rows, plant):
    turns = table(spark, rows)
    turns = repair.damaged(turns) if plant else turns
    want = expected_repair(rows, plant)
    got = {r.conv_id: r for r in repair.repair_digests(turns).collect()}
    assert got.keys() == want.keys()
    whole = {}
    for r in repair.repaired_turns(turns).orderBy("conv_id", "place").collect():
        whole.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, (*numbers, turns) in want.items():
        r = got[conv]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == numbers, conv
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()
        assert whole.get(conv, []) == turns
        assert re.fullmatch("(s?(ua)+)?", "".join(a[:1] for a, _ in turns))


def test_repair_of_nothing(spark):
    assert repair.repair_digests(repair.damaged(table(spark, []).limit(0))).count() == 0
    assert repair.repaired_turns(table(spark, [])).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    r = repair.repair_digests(repair.damaged(table(spark, [(dropped, 0, "user", "x")]))).first()
    assert (r.gaps, r.cost, r.audit, r.repaired_sha256) == (0, 0, "", hashlib.sha256(b"").hexdigest())


def expected_trie(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn, role or "", text or ""))
    digest = lambda x: hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()
    own = {c: [x[1:] for x in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, digest(x)))] for c, v in by.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = (*own.get(base, [])[:h], *own[c][h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        own = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in own) if own else 1
        saved[p] = sum(saved[x] for x in own) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(own), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()))
    return out


def test_trie_against_plain_python(spark, rows):
    r = random.Random(9)
    shared = [("user", "Hi."), ("assistant", "Yes?"), ("user", "Tell."), ("assistant", "No."), *[("user", f"{k}") for k in range(20)]]
    more = list(rows)
    for conv in range(200, 260):  # long common starts that part inside blocks, at their ends, and not at all
        path = shared[: r.choice([3, 7, 8, 9, 16, 17, 24])] + [("user", r.choice("ab")) for _ in range(r.choice([0, 0, 1, 9]))]
        more += [(conv, k, *x) for k, x in enumerate(path)]
    more += [(c, k, *x) for c in range(300, 420) for k, x in enumerate(shared)]
    frame = table(spark, more)
    nodes = trie.prefix_trie(trie.rebuilt(trie.digested(frame)))
    got = [tuple(x) for x in nodes.drop("prefix").collect()]
    want = expected_trie(more)
    assert len(got) == len(want) and set(got) == want
    assert nodes.select("prefix").distinct().count() == len(want)


@pytest.mark.parametrize("kind", ["long", "int", "double"])
def test_trie_of_any_ids(spark, tmp_path, kind):
    """Ids at the ends of a long borrow and lend like others; whatever the type of the ids, they are whole numbers and leave as long."""
    ids = [-(2**63), -(2**63) + 3, -(2**63) + 4, *range(2**63 - 9, 2**63)] if kind == "long" else [*range(1, 12), 10**8]
    rows = [(c, k, "user", f"{c % 3} {k}") for c in ids for k in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv_id", F.col("conv_id").cast(kind)).write.parquet(f"{tmp_path}/conversations.parquet")
    nodes = trie.op13_prefix_trie(spark, str(tmp_path))
    assert {nodes.schema[c].dataType.simpleString() for c in nodes.columns if c != "ends_sha256"} == {"bigint"}
    assert {tuple(x) for x in nodes.collect()} == expected_trie(rows)


def test_trie_of_paths_as_they_are(spark):
    frame = table(spark, [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "user", "b"), (None, 0, "user", "a")])
    got = {(r.depth, r.conv_id): r for r in trie.prefix_trie(trie.paths(trie.digested(frame))).collect()}
    assert len(got) == 3 and got[0, 1].n_convs == 2 and got[1, 1].n_children == 1 and got[2, 2].parent_conv_id == 1 and got[0, 1].saved_tokens == 1
    assert got[1, 1].ends_sha256 == hashlib.sha256(b"1").hexdigest()
    assert trie.prefix_trie(trie.paths(trie.digested(frame.where("conv_id > 5")))).count() == 0


def test_many_members_end_at_one_node(spark):
    """Ids in several parts: the hash is that of the whole list."""
    ids = spark.range(0, 40_000).select(F.unhex(F.lit("00")).alias("prefix"), F.col("id").alias("conv_id"))
    part, trie.PART = trie.PART, 10_000
    try:
        got = trie.end_digests(ids).collect()
    finally:
        trie.PART = part
    assert len(got) == 1 and got[0].ends_sha256 == hashlib.sha256(",".join(map(str, range(40_000))).encode()).hexdigest()
