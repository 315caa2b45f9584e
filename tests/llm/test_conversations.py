import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from plantlens.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, fault string, audit int, place string"
BLANK, LAST = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


def damage(rows):
    """(conv_id, turn, role, text) to what stands there after the made-up faults."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(turns, faults, all_ways):
    """(cost, audit, repaired lines) by a search in the order of (cost, audit) over single edits; no matrix, no tree."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if at == len(turns) and state in ("", "a"):
            return cost, audit, list(lines)
        if not all_ways:
            if (at, state) in seen:
                continue
            seen.add((at, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in after:
                heapq.heappush(heap, (cost + 3, audit + "I", at, after[state, role[0]], (*lines, f"{role}:")))
        if at < len(turns):
            _, role, text = turns[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, lines))
            if faults[at] not in ("blank", "duplicate"):
                more = 3 * (faults[at] == "truncated")
                for edit, to, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if (state, to[:1]) in after:
                        heapq.heappush(heap, (cost + price + more, audit + edit, at + 1, after[state, to[:1]], (*lines, f"{to}:{text}")))


def brute(rows, all_ways=False):
    out = {}
    for conv, turns in damage(rows).items():
        turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            last = LAST.search(text)
            faults.append("blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "truncated" if last[1] not in ".!?" else "")
            seen.add((role, text))
        at = {t[0] for t in turns if t[0] is not None}
        cost, audit, lines = cheapest(turns, faults, all_ways)
        out[conv] = {
            "gaps": max(at) - min(at) + 1 - len(at) if at else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(turns, turns[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }
    return out


def repaired(spark, rows, settings=conversations.RepairSettings(), parts=4):
    turns = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(parts)
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    got = [r.asDict() for r in conversations.repair(conversations.damaged(turns, F.crc32(named) % 20), settings).collect()]
    assert len({g["conv_id"] for g in got}) == len(got)
    return {g.pop("conv_id"): g for g in got}


def talk(rng, conv, many):
    texts = ["Yes.", "No!", "cut off", "", " \n", "Why?", "a. b", "Ok. \t", None]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    start = rng.randint(-2, 2)
    return [(conv, rng.choice([None, start + k, start + k, start + k + (k > 2)]), rng.choice(roles), rng.choice(texts + [f"t{k}.", f"q{k}?"])) for k in range(many)]


def test_short_conversations_equal_all_ways_of_editing(spark):
    rng = random.Random(8)
    rows = [r for conv in range(150) for r in talk(rng, conv, rng.randint(1, 4))] + talk(rng, None, 4)
    assert repaired(spark, rows) == brute(rows, all_ways=True)


@pytest.mark.parametrize("settings", [conversations.RepairSettings(chunk_turns=2, fan=2), conversations.RepairSettings(chunk_turns=5, fan=3, chunk_chars=20)])
def test_long_conversations_in_a_tree(spark, settings):
    rng = random.Random(9)
    rows = [r for conv in range(12) for r in talk(rng, conv, rng.randint(1, 60))]
    rows += [(77, k // 3, "user" if k % 2 else "assistant", "same.") for k in range(40)] + [(78, 5, "user", "equal rows.")] * 30 + [(79, k, "tool", "x") for k in range(20)]
    want = brute(rows)
    assert repaired(spark, rows, settings) == want
    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert repaired(spark, shuffled, conversations.RepairSettings(), 2) == want


def test_empty_table_and_dropped_rows(spark):
    assert repaired(spark, []) == {}
    gone = [c for c in range(300) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = repaired(spark, [(c, 0, "user", "x") for c in gone])
    assert len(got) == len(gone) > 5
    assert all(g == {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()} for g in got.values())


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in queries.op13_conversation_repair(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(rows)


def test_sql_equals_the_search():
    rng = random.Random(12)
    rows = [r for conv in range(60) for r in talk(rng, conv, rng.randint(1, 12))] + talk(rng, None, 5)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.execute(queries.ORACLE_SQL["op13_conversation_repair"])
    names = [d[0] for d in found.description]
    got = {r[0]: dict(zip(names[1:], r[1:])) for r in found.fetchall()}
    assert got == brute(rows)
