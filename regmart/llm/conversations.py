"""Conversation structure repair: Knuth's agenda of lightest derivations.

A repair item is (rows consumed, state of the role pattern); the states are nothing yet, after a system turn, after a user turn, after an assistant turn. Deductions
keep, rerole, delete or insert a turn; each adds its cost and appends its letter, so a conclusion is never below its premise in the order (cost, audit), which is what
Knuth's algorithm asks of a superior function. The agenda pops items in that order, and the first value popped for an item is final; so is the goal's.
Among audits of one item two of equal cost are never prefixes of each other (the longer one would hold an insertion more), so appending keeps their order.

No conversation has to fit one task: rows travel as codes (initial, fault, number of copies), range-sorted by conversation and turn. A task cuts what it has of a conversation
into chunks of ``CHUNK`` rows. A conversation inside one chunk is settled there. For the others a chunk gives the lightest derivation from every state to every state, and a
second agenda derives the goal from the chunks, two antecedents to a deduction: what is reached before the chunk, and the chunk. What meets in one task there is a
few audits of the conversation, as long as the audit that the result holds in one cell. Texts are shuffled once and streamed row by row past their audit.

Defined cases: null roles and texts are one space; rows of one conversation go by turn (nulls first), then by role and a digest of the text, copies next to each other; a
null conv_id is a conversation of its own; the digest by which texts are compared is MD5 of their bytes; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regmart.llm.common import checkpointed, partitions

CHUNK = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a kept turn of this initial leads to, by the state before it, and the turn that a state asks for.
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = {NOTHING: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAMES = {"u": "user", "a": "assistant"}
DONE = (NOTHING, ASSISTANT)
BLANKS = " \t\n\x0b\f\r"
LEAST, MOST = -(1 << 63), (1 << 63) - 1

Item = tuple[int, int]
Value = tuple[int, str]


def lightest(axiom: Item, deduce: Callable[[Item], Iterator[tuple[int, str, Item]]], wanted: set[Item]) -> dict[Item, Value]:
    """Lightest (cost, audit) of the wanted items that can be derived. ``deduce`` gives what an item adds to a conclusion, and the conclusion."""
    agenda: list[tuple[int, str, Item]] = [(0, "", axiom)]
    final: set[Item] = set()
    found: dict[Item, Value] = {}
    while agenda and len(found) < len(wanted):
        cost, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final.add(item)
        if item in wanted:
            found[item] = (cost, audit)
        for more, letters, conclusion in deduce(item):
            if conclusion not in final:
                heapq.heappush(agenda, (cost + more, audit + letters, conclusion))
    return found


def edits(codes: str) -> Callable[[Item], Iterator[tuple[int, str, Item]]]:
    """Deductions over rows. ``codes`` has two characters a row: its role's initial and its fault (b, d, t or -)."""
    n = len(codes) // 2

    def deduce(item: Item) -> Iterator[tuple[int, str, Item]]:
        i, state = item
        wanted = WANTED[state]
        if i < n:
            initial, fault = codes[2 * i], codes[2 * i + 1]
            yield DELETE, "D", (i + 1, state)
            if fault not in "bd":
                extra = TRUNCATED if fault == "t" else 0
                if (state, initial) in NEXT:
                    yield KEEP + extra, "K", (i + 1, NEXT[state, initial])
                if initial != wanted:
                    yield REROLE + extra, "R", (i + 1, NEXT[state, wanted])
        yield INSERT, "I", (i, NEXT[state, wanted])
        if i == n and state in DONE:
            yield 0, "", (n + 1, NOTHING)

    return deduce


@lru_cache(1 << 15)
def whole(codes: str) -> Value:
    """Lightest repair of a conversation."""
    goal = (len(codes) // 2 + 1, NOTHING)
    return lightest((0, NOTHING), edits(codes), {goal})[goal]


def crossings(codes: str) -> list[tuple[int, int, int, str]]:
    """Lightest derivation over a chunk from every state to every state that it leads to: from, to, cost, audit."""
    n, deduce = len(codes) // 2, edits(codes)
    return [(p, q, *value) for p in range(4) for (_, q), value in lightest((0, p), deduce, {(n, q) for q in range(4)} - ({(n, NOTHING)} if p else set())).items()]


def over_chunks(chunks: list[list[tuple[int, int, int, str]]]) -> Value:
    """Lightest repair of a conversation that is given by the crossings of its chunks."""
    goal = (len(chunks) + 1, NOTHING)

    def deduce(item: Item) -> Iterator[tuple[int, str, Item]]:
        k, state = item
        if k < len(chunks):
            for p, q, cost, audit in chunks[k]:
                if p == state:
                    yield cost, audit, (k + 1, q)
        elif state in DONE:
            yield 0, "", goal

    return lightest((0, NOTHING), deduce, {goal})[goal]


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of every row, under fixed names and types; null roles and texts are one space."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), F.lit(1).alias("copies"))


def damage(rows: DataFrame, modulus: int = 20) -> DataFrame:
    """``turns`` with faults that a checksum of the row's name decides: a row goes, loses its text, loses its sentence ends, is there twice, or becomes the user's."""
    name = F.concat(*(F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")))
    kind = F.crc32(name) % modulus
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    found = turns(rows).withColumn("kind", kind).filter("kind <> 0")
    return found.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


ORDER = ("turn", "role", "digest")


def by_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def coded(found: DataFrame) -> DataFrame:
    """A row for rows alike: conv_id, turn, role, digest, initial, fault of the first copy, copies."""
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    mark = F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("-")
    alike = found.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), mark.alias("mark"), "copies")
    alike = checkpointed(alike.groupBy("conv_id", "turn", "role", "digest", "mark").agg(F.sum("copies").alias("copies")).withColumn("conv_key", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))))
    same = ["conv_key", "role", "digest"]
    told = alike.filter("mark <> 'b'").groupBy(*same).agg(F.count("*").alias("turns"), F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("first"))
    told = told.filter("turns > 1").select(*same, F.col("first.turn").alias("first_turn"), F.lit(True).alias("told"))
    fault = F.when(F.coalesce("told", F.lit(False)) & ~F.col("first_turn").eqNullSafe(F.col("turn")), "d").otherwise(F.col("mark"))
    return alike.join(told, same, "left").select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "copies")


CHUNKS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("settled", pa.bool_()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("initials", pa.string()), ("turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ("ways", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
])
CHUNK_COLUMNS = "conv_id long, part int, seq long, settled boolean, blank long, duplicate long, truncated long, illegal long, initials string, turns long, first_turn long, last_turn long, cost long, audit string, ways array<int>, costs array<long>, audits array<string>"
LEGAL = ("su", "ua", "au")


def illegal_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the conversations of one sorted range. Only its first and its last conversation can go on in another one; all others are settled here if they fit a chunk."""
    seq, out = 0, []
    conv, codes, own, began = None, [], [], False  # the rows of the chunk so far: codes and turns
    opens = False  # whether the conversation began with these rows, in this range, and is not its first

    def chunk(ends: bool, opens: bool) -> dict:
        nonlocal seq
        seq += 1
        text = "".join(codes)
        known = [t for t in own if t is not None]
        row = {"conv_id": conv, "seq": seq, "settled": ends and opens, "initials": "".join(text[::2]), "turns": len(set(known)), "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None}
        row |= {"blank": text[1::2].count("b"), "duplicate": text[1::2].count("d"), "truncated": text[1::2].count("t")}
        row["illegal"] = illegal_pairs(row["initials"])
        if row["settled"]:
            row["cost"], row["audit"] = whole(text)
        else:
            found = crossings(text)
            row |= {"ways": [4 * p + q for p, q, _, _ in found], "costs": [c for _, _, c, _ in found], "audits": [a for *_, a in found]}
        row["initials"] = row["initials"][0] + row["initials"][-1]
        codes.clear()
        own.clear()
        return row

    def batch(rows: list[dict]) -> pa.RecordBatch:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_pylist([{name: None for name in CHUNKS.names} | {"part": part} | r for r in rows], CHUNKS)

    for b in batches:
        for conv_id, turn, initial, fault, copies in zip(*(c.to_pylist() for c in b.columns)):
            if not began or conv_id != conv:
                if codes:
                    out.append(chunk(True, opens))
                conv, opens, began = conv_id, began, True
            initial = initial if initial and initial in "sua" else "x"
            for k in range(copies):
                if len(codes) == CHUNK:
                    out.append(chunk(False, opens))
                    opens = False
                codes.append(initial + (fault if not k or fault == "b" else "d"))
                own.append(turn)
            if len(out) >= 512:
                yield batch(out)
                out = []
    if codes:
        out.append(chunk(False, False))
    if out:
        yield batch(out)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPORT_NAMES = [x.split()[0] for x in REPORT.split(", ")]


def gathered(key: tuple, table: pa.Table) -> pa.Table:
    """The report of a conversation from its chunks."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    cost, audit = over_chunks([[(w // 4, w % 4, c, a) for w, c, a in zip(r["ways"], r["costs"], r["audits"])] for r in rows])
    pairs = list(zip(rows, rows[1:]))
    turns = sum(r["turns"] for r in rows) - sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in pairs)
    known = [r for r in rows if r["turns"]]
    out = {n: sum(r[n] for r in rows) for n in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += sum(a["initials"][1] + b["initials"][0] not in LEGAL for a, b in pairs)
    out["gaps"] = min(MOST, known[-1]["last_turn"] - known[0]["first_turn"] + 1 - turns) if known else 0
    out |= {"conv_id": rows[0]["conv_id"], "cost": cost, "audit": audit}
    return pa.table({n: pa.array([out[n]], pa.string() if n == "audit" else pa.int64()) for n in REPORT_NAMES})


def audits(found: DataFrame) -> DataFrame:
    """A row for each conversation that has rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost and the audit of its lightest repair."""
    rows = checkpointed(coded(found))
    order = [F.col("conv_id").asc_nulls_first(), *by_order()]
    ranged = rows.repartitionByRange(partitions(found), *order).sortWithinPartitions(*order)
    chunks = checkpointed(ranged.select("conv_id", "turn", "initial", "fault", "copies").mapInArrow(cut, CHUNK_COLUMNS))
    span = F.try_add(F.try_subtract("last_turn", "first_turn"), 1 - F.col("turns"))
    gaps = F.when(F.col("turns") == 0, F.lit(0)).otherwise(F.coalesce(span, F.lit(MOST)))
    settled = chunks.filter("settled").withColumn("gaps", gaps.cast("long")).select(*REPORT_NAMES)
    return settled.unionByName(chunks.filter("not settled").groupBy("conv_id").applyInArrow(gathered, REPORT))


class Repair:
    """Follows an audit over the rows of a conversation, one at a time."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit.startswith("I", self.at):
            self.at += 1
            wanted = WANTED[self.state]
            self.state = NEXT[self.state, wanted]
            yield "I", NAMES[wanted], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """What stands in the repaired conversation for the next row, and before it."""
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            initial = role[:1] if letter == "K" else WANTED[self.state]
            self.state = NEXT[self.state, initial]
            yield letter, role if letter == "K" else NAMES[initial], text


def streamed(found: DataFrame, reports: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Rows of conversations sorted behind their report: ``kind`` 0 for an id by itself, 1 for the report, 2 for a turn."""
    texts = found.select("conv_id", F.lit(2).alias("kind"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "text", "copies")
    both = texts.unionByName(reports.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    if ids is not None:
        both = both.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(0).alias("kind")).distinct(), allowMissingColumns=True)
    return both.repartition(partitions(found), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", *by_order()).select("kind", "role", "text", "copies", *REPORT_NAMES)


def repaired(found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (K, R or I), role, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, position, conv, out = Repair(""), 0, None, []

        def emit(rows: Iterator[tuple[str, str, str]]) -> None:
            nonlocal position
            for edit, role, text in rows:
                out.append((conv, position, edit, role, text))
                position += 1

        def batch() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], ["conv_id", "position", "edit", "role", "text"])
            out.clear()
            return found

        for b in batches:
            names = b.schema.names
            for values in zip(*(c.to_pylist() for c in b.columns)):
                r = dict(zip(names, values))
                if r["kind"] == 1:
                    emit(repair.inserted())
                    repair, position, conv = Repair(r["audit"]), 0, r["conv_id"]
                else:
                    for _ in range(r["copies"]):
                        emit(repair.row(r["role"], r["text"]))
            yield batch()
        emit(repair.inserted())
        yield batch()

    return streamed(found, audits(found)).mapInArrow(run, "conv_id long, position long, edit string, role string, text string")


def report(found: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each conv_id of ``ids``: the figures of ``audits`` (zeros without rows) and repaired_sha256, the digest of the repaired turns as ``role:text``, joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out = None, []  # the conversation at hand: its report, its repair, its hash, whether a turn was hashed

        def feed(rows: Iterator[tuple[str, str, str]]) -> None:
            for _, role, text in rows:
                current[2].update(f"{chr(10) if current[3] else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                current[3] = True

        def close() -> None:
            if current:
                feed(current[1].inserted())
                out.append(current[0] | {"repaired_sha256": current[2].hexdigest()})

        def batch() -> pa.RecordBatch:
            names = [*REPORT_NAMES, "repaired_sha256"]
            found = pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names], names)
            out.clear()
            return found

        for b in batches:
            names = b.schema.names
            for values in zip(*(c.to_pylist() for c in b.columns)):
                r = dict(zip(names, values))
                if r["kind"] == 0:
                    close()
                    current = [{n: 0 for n in REPORT_NAMES} | {"conv_id": r["conv_id"], "audit": ""}, Repair(""), hashlib.sha256(), False]
                elif r["kind"] == 1:
                    current[0], current[1] = {n: r[n] for n in REPORT_NAMES}, Repair(r["audit"])
                else:
                    for _ in range(r["copies"]):
                        feed(current[1].row(r["role"], r["text"]))
            yield batch()
        close()
        yield batch()

    return streamed(found, audits(found), ids).mapInArrow(run, f"{REPORT}, repaired_sha256 string")
