"""Repair of conversation structure with a min-plus matrix scan.

A repaired conversation's roles are `s?` and then `ua` again and again: four states (start, after s, after u, after a). The
edits of one turn (keep, rerole, delete) are a 4x4 matrix whose elements are the cheapest (cost, audit) from one state to
another, multiplied by the closure of insertions. Products of such matrices are associative: an audit is never the beginning
of another one of equal cost over the same turns, so that the ASCII-least of equal costs stays the least whatever follows.

Turns are sorted by ranges and cut into chunks of bounded size, so that a very long conversation is many chunks on many
executors. Each chunk is multiplied out in a task; the products of a conversation's chunks are reduced in a tree, and the
states at the borders of chunks come back down the tree. With both states of a chunk its edits are known and are applied
where its turns lie. Equal rows of a conversation are one row with a count from the start, so that no key is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plantlens.llm.common import row_key, shared_folder, stage_table

#: Costs of the edits, and what a turn that stays truncated adds.
RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: (state before, state after) of a turn whose role has this initial.
STEPS = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
#: A matrix: {(before, after): (cost, audit)}; what is absent can't be reached.
Matrix = dict[tuple[int, int], tuple[int, str]]
SUMMARY = "struct<blank:long,duplicate:long,truncated:long,illegal:long,first:string,last:string,low:long,high:long,turns:long>"
ELEMENT = "array<struct<before:int,after:int,cost:long,audit:string>>"
TURNS = "array<struct<turn:long,role:string,text:string,n:long,fault:string>>"
#: A node of the tree: id is unique and orders the nodes of a conversation, as part and seq do.
NODE = f"conv_id long, id long, part long, seq long, element {ELEMENT}, summary {SUMMARY}"
STATES = "id long, before int, after int"


@dataclass(frozen=True)
class RepairSettings:
    """Turns and characters of a chunk, and chunks that are reduced together."""

    chunk_turns: int = 2048
    chunk_chars: int = 1 << 20
    fan: int = 32


def times(x: Matrix, y: Matrix) -> Matrix:
    """The min-plus product: costs add up, audits follow one another, the least (cost, audit) stays."""
    out: Matrix = {}
    for (a, b), (cost, audit) in x.items():
        for c in range(4):
            if (b, c) in y:
                also = y[b, c]
                found = (cost + also[0], audit + also[1])
                if (a, c) not in out or found < out[a, c]:
                    out[a, c] = found
    return out


ONE: Matrix = {(s, s): (0, "") for s in range(4)}


def _insertions() -> Matrix:
    once = {**ONE, **{step: (INSERT, "I") for role in "ua" for step in STEPS[role]}}
    return times(times(once, once), once)  # from a state to another in two insertions at most


CLOSURE = _insertions()


@lru_cache(maxsize=256)
def turn_matrix(initial: str, fault: str) -> Matrix:
    """The edits of one turn and what is inserted after it. Faults: blank, duplicate, truncated or none (an empty string)."""
    out: Matrix = {(s, s): (DELETE, "D") for s in range(4)}
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        moves = [(step, (RE_ROLE + more, "R")) for to in "ua" for step in STEPS[to]] + [(step, (more, "K")) for step in STEPS.get(initial, ())]
        for step, found in moves:
            out[step] = min(found, out.get(step, found))
    return times(out, CLOSURE)


def _power(matrix: Matrix, n: int) -> Matrix:
    out = ONE
    while n:
        if n & 1:
            out = times(out, matrix)
        matrix, n = times(matrix, matrix), n >> 1
    return out


def _steps(turns: list[dict]) -> Iterator[tuple[Matrix, dict, str, int]]:
    """(matrix, turn, fault, times) of each run of equal rows: the first with its own fault, the others duplicates."""
    for t in turns:
        if t["n"]:
            yield turn_matrix(t["role"][:1], t["fault"]), t, t["fault"], 1
            if t["n"] > 1:
                again = "blank" if t["fault"] == "blank" else "duplicate"
                yield _power(turn_matrix(t["role"][:1], again), t["n"] - 1), t, again, t["n"] - 1


def _fold(matrices: list[Matrix]) -> Matrix:
    """The product as a tree of halves, so that long audits are put together once for each level."""
    while len(matrices) > 1:
        matrices = [times(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0] if matrices else ONE


def _opened(matrices: list[Matrix], before: int) -> list[Matrix]:
    """With insertions before the first turn. Further on in a conversation they are those after the turn before, and change nothing."""
    return [CLOSURE, *matrices] if before == START else matrices


def _path(matrices: list[Matrix], before: int, after: int) -> list[int]:
    """The states at the borders of some neighbours, on the cheapest way from `before` to `after`."""
    best, ways = {before: (0, "")}, []
    for m in matrices:
        found: dict[int, tuple[tuple[int, str], int]] = {}
        for (a, b), (cost, audit) in m.items():
            if a in best:
                way = ((best[a][0] + cost, best[a][1] + audit), a)
                found[b] = min(way, found.get(b, way))
        ways.append({b: a for b, (_, a) in found.items()})
        best = {b: w for b, (w, _) in found.items()}
    states = [after]
    for way in reversed(ways):
        states.append(way[states[-1]])
    return states[::-1]


def _best(matrix: Matrix) -> tuple[tuple[int, str], int]:
    """(cost, audit) of a whole conversation and its final state: nothing is left, or the last turn is an assistant's."""
    whole = times(CLOSURE, matrix)
    return min((whole[START, s], s) for s in (START, ASSISTANT))


def _element(matrix: Matrix) -> list[dict]:
    return [{"before": a, "after": b, "cost": c, "audit": s} for (a, b), (c, s) in sorted(matrix.items())]


def _matrix(element: list[dict]) -> Matrix:
    return {(e["before"], e["after"]): (e["cost"], e["audit"]) for e in element}


def _illegal(x: str | None, y: str | None) -> bool:
    return x is not None and y is not None and x + y not in ("su", "ua", "au")


def _summary(turns: list[dict]) -> dict:
    """Counts of a chunk, with roles and turns at its ends for what lies across the borders."""
    count = {kind: 0 for kind in ("blank", "duplicate", "truncated")}
    for _, _, fault, n in _steps(turns):
        if fault:
            count[fault] += n
    real = [t for t in turns if t["n"]]
    roles = [t["role"][:1] for t in real]
    illegal = sum(map(_illegal, roles, roles[1:])) + sum(t["n"] - 1 for t in real)  # equal roles are never in order
    seen = sorted({t["turn"] for t in real if t["turn"] is not None})
    return count | {"illegal": illegal, "first": roles[0] if real else None, "last": roles[-1] if real else None, "low": seen[0] if seen else None, "high": seen[-1] if seen else None, "turns": len(seen)}


def _joined(x: dict, y: dict) -> dict:
    """The summary of two neighbours."""
    out = {k: x[k] + y[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += _illegal(x["last"], y["first"])
    out["turns"] -= x["high"] is not None and x["high"] == y["low"]
    ends = {k: a[k] if a[k] is not None else b[k] for k, a, b in (("first", x, y), ("low", x, y), ("last", y, x), ("high", y, x))}
    return out | ends


def _repaired(turns: list[dict], before: int, after: int) -> list[str]:
    """The repaired `role:text` lines of a chunk between two states."""
    steps = list(_steps(turns))
    matrices = _opened([m for m, *_ in steps], before)
    states, lines, state = _path(matrices, before, after), [], before
    for m, s, t, turn in zip(matrices, states, states[1:], [None] * (len(matrices) - len(steps)) + [x[1] for x in steps]):
        for edit in m[s, t][1]:
            if edit != "D":
                role = turn["role"] if edit == "K" else ROLES[ASSISTANT if state == USER else USER]
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
                lines.append(f"{role}:{'' if edit == 'I' else turn['text']}")
    return lines


def damaged(conversations: DataFrame, faults: Column) -> DataFrame:
    """Made-up faults by number: 0 drops a row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4 makes it a user's.

    Returns conv_id, turn, role, text and n, the number of times that the row now stands there (0 for a dropped one).
    Nulls in role and text are read as one space.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    return conversations.withColumn("fault_number", faults).select(
        "conv_id", "turn",
        F.when(F.col("fault_number") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("fault_number") == 1, "").when(F.col("fault_number") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(F.col("fault_number") == 0, 0).when(F.col("fault_number") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _counted(turns: DataFrame) -> DataFrame:
    """Equal rows once, with their number and the fault of the first: rows of a conversation without turns keep n = 0."""
    real = F.col("n") > 0
    text, role = (F.when(real, F.coalesce(c, F.lit(" "))).otherwise("") for c in ("text", "role"))
    turn = F.when(real, F.col("turn"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), turn.cast("long").alias("turn"), role.alias("role"), text.alias("text"), "n")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    keyed = rows.withColumns(dict(zip(("uid", "vid"), row_key("conv_id", "role", "text"))))
    place = F.struct(F.col("turn").isNotNull().alias("at"), "turn")  # nulls come first
    repeated = keyed.where(real).groupBy("uid", "vid").agg(F.min(place).alias("first_place"), F.count("*").alias("places")).where("places > 1").drop("places")
    marked = keyed.withColumn("place", place).join(repeated, ["uid", "vid"], "left")
    later = F.coalesce(F.col("place") != F.col("first_place"), F.lit(False))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*$", 1)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(later, "duplicate").when(~F.coalesce(last, F.lit("")).isin(".", "!", "?"), "truncated").otherwise("")
    return marked.withColumn("fault", fault).select("conv_id", "turn", "role", "text", "n", "fault")


def _per_row(df: DataFrame, schema: str, body: Callable[[dict], dict | list[dict]]) -> DataFrame:
    """body gives a row, or several, as dictionaries for each row of df."""

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                made = [body(row) for row in batch.slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_pylist([r for m in made for r in (m if isinstance(m, list) else [m])], arrow)

    return df.mapInArrow(run, schema)


def _chunks(rows: DataFrame, settings: RepairSettings) -> DataFrame:
    """(conv_id, id, part, seq, turns): turns in order, in chunks of one conversation each. Ranges of turns are sorted apart."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    spread = rows.repartitionByRange(*order, F.substring("text", 1, 256)).sortWithinPartitions(*order, "text")
    schema = f"conv_id long, id long, part long, seq long, turns {TURNS}"

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, conv, part, seq = [], 0, None, 0, 0
        made = lambda: pa.RecordBatch.from_pylist([{"conv_id": conv, "id": (part << 40) + seq, "part": part, "seq": seq, "turns": held}], arrow)
        for batch in batches:
            for row in batch.to_pylist():
                if held and (conv != row["conv_id"] or len(held) >= settings.chunk_turns or size >= settings.chunk_chars):
                    yield made()
                    held, size, seq = [], 0, seq + 1
                conv, part = row.pop("conv_id"), row.pop("part")
                held.append(row)
                size += len(row["text"])
        if held:
            yield made()

    return stage_table(spread.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, schema), "conversation-chunks")


def _reduced(row: dict) -> dict:
    """A group of neighbours as one node."""
    nodes = sorted(row["nodes"], key=lambda n: n["id"])
    summary = nodes[0]["summary"]
    for n in nodes[1:]:
        summary = _joined(summary, n["summary"])
    return {k: row[k] for k in ("conv_id", "id", "part", "seq")} | {"element": _element(_fold([_matrix(n["element"]) for n in nodes])), "summary": summary}


def _descended(row: dict) -> list[dict]:
    """The states of the nodes of a group whose own states are known."""
    nodes = sorted(row["nodes"], key=lambda n: n["id"])
    opened = _opened([_matrix(n["element"]) for n in nodes], row["before"])
    states = _path(opened, row["before"], row["after"])
    states = [row["before"], *states[-len(nodes) :]]
    return [{"id": n["id"], "before": s, "after": t} for n, s, t in zip(nodes, states, states[1:])]


def _tree(level: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of conversations that have several, to one for each conversation, and the states of the given ones.

    First neighbours within a part of the sorted rows are reduced, fan by fan, then parts.
    """
    groups: list[DataFrame] = []
    for inside in (True, False):
        key = ["conv_id", "part"] if inside else ["conv_id"]
        up = {"part": F.col("part") if inside else F.floor(F.col("part") / fan), "seq": F.floor(F.col("seq") / fan) if inside else F.lit(0).cast("long")}
        while level.groupBy(*key).count().where("count > 1").limit(1).count():
            nodes = level.withColumns(up).groupBy("conv_id", "part", "seq").agg(F.min("id").alias("id"), F.collect_list(F.struct(level["id"], "element", "summary")).alias("nodes"))
            groups.append(stage_table(nodes, "conversation-groups"))
            level = stage_table(_per_row(groups[-1], NODE, _reduced), "conversation-level")
    states = _per_row(level, STATES, lambda row: {"id": row["id"], "before": START, "after": _best(_matrix(row["element"]))[1]})
    for held in reversed(groups):
        states = stage_table(_per_row(held.join(states, "id").select("nodes", "before", "after"), STATES, _descended), "conversation-states")
    return level, states


def _report(row: dict) -> dict:
    (cost, audit), _ = _best(_matrix(row["element"]))
    s = row["summary"]
    gaps = min(s["high"] - s["low"] + 1 - s["turns"], (1 << 63) - 1) if s["turns"] else 0
    return {"conv_id": row["conv_id"], "gaps": gaps, "cost": cost, "audit": audit} | {k: s[k] for k in ("blank", "duplicate", "truncated", "illegal")}


def _hashes(pieces: DataFrame) -> DataFrame:
    """(conv_id, id, lines) to (conv_id, repaired_sha256). The lines stream through in order, none is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun = (), None, False
        for batch in batches:
            for row in batch.to_pylist():
                if conv != (row["conv_id"],):
                    if conv:
                        yield pa.RecordBatch.from_pydict({"conv_id": pa.array(conv, pa.int64()), "repaired_sha256": [state.hexdigest()]})
                    conv, state, begun = (row["conv_id"],), hashlib.sha256(), False
                for line in row["lines"]:
                    state.update((b"\n" if begun else b"") + line.encode())
                    begun = True
        if conv:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array(conv, pa.int64()), "repaired_sha256": [state.hexdigest()]})

    return pieces.select("conv_id", "id", "lines").repartition("conv_id").sortWithinPartitions("conv_id", "id").mapInArrow(run, "conv_id long, repaired_sha256 string")


def repaired_turns(turns: DataFrame, settings: RepairSettings = RepairSettings()) -> tuple[DataFrame, DataFrame]:
    """What repair says, without hashes, and the repaired conversations: (conv_id, id, lines, alone), chunks that id orders.

    turns as in repair. lines are `role:text`; alone: whether a conversation is in one chunk.
    """
    shared_folder(turns.sparkSession)
    chunks = _chunks(_counted(turns), settings)
    keep = ("conv_id", "id", "part", "seq")
    leaf = lambda row: {k: row[k] for k in keep} | {"element": _element(_fold([m for m, *_ in _steps(row["turns"])])), "summary": _summary(row["turns"])}
    leaves = stage_table(_per_row(chunks, NODE, leaf), "conversation-leaves")
    several = leaves.groupBy("conv_id").agg(F.count("*").alias("many")).where("many > 1").select(F.col("conv_id").alias("of")).checkpoint()
    long_ = F.col("conv_id").eqNullSafe(F.col("of"))
    roots, states = _tree(stage_table(leaves.join(several, long_, "left_semi"), "conversation-level"), settings.fan)
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    report = _per_row(leaves.join(several, long_, "left_anti").unionByName(roots), schema, _report)

    def applied(row):
        alone = row["before"] is None
        before, after = (START, _best(_fold([m for m, *_ in _steps(row["turns"])]))[1]) if alone else (row["before"], row["after"])
        return {"conv_id": row["conv_id"], "id": row["id"], "lines": _repaired(row["turns"], before, after), "alone": alone}

    pieces = _per_row(chunks.join(states, "id", "left"), "conv_id long, id long, lines array<string>, alone boolean", applied)
    return report, pieces


def repair(turns: DataFrame, settings: RepairSettings = RepairSettings()) -> DataFrame:
    """turns (conv_id, turn, role, text, n: how often the row stands there) to one row for each conversation.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (the cheapest edits in order, the ASCII-least of
    equal costs) and repaired_sha256 (of the repaired `role:text` lines, joined by newlines). Rows are in the order of turns,
    nulls first; rows of equal turns in the order of role and text. A conversation all of whose rows have n = 0 gives zeros, an
    empty audit and the hash of nothing. A null role or text is read as one space, a null conv_id is a conversation of its own;
    repeated rows count as often as they come. A role whose initial isn't s, u or a can't be kept. An empty table gives none.
    Other columns aren't read, so they may have any name. An audit is one string, so it has at most 2^31 letters. A hash needs
    its conversation's lines one after the other: those of one in several chunks stream through one task.
    """
    report, pieces = repaired_turns(turns, settings)
    pieces = stage_table(pieces, "conversation-repaired")
    at_once = pieces.where("alone").select("conv_id", F.sha2(F.array_join("lines", "\n"), 256).alias("repaired_sha256"))
    hashed = at_once.union(_hashes(pieces.where("not alone"))).withColumnRenamed("conv_id", "of")
    return report.join(hashed, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
