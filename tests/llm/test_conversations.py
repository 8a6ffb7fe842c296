"""Repair of conversations against enumeration and a plain table over whole conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from regmart.llm import conversations
from regmart.llm.conversations import crossings, over_chunks, whole

BLANKS = " \t\n\x0b\x0c\r"
PATTERN = re.compile(r"(s?(ua)+)?")


def every_repair(codes):
    """(cost, audit) of all edits with up to two insertions at a place, by enumeration."""
    rows = [(codes[i], codes[i + 1]) for i in range(0, len(codes), 2)]
    best = None
    inserts = [s for n in range(3) for s in itertools.product("ua", repeat=n)]
    choices = []
    for initial, fault in rows:
        extra = 5 if fault == "t" else 0
        own = [(2, "D", "")]
        if fault not in "bd":
            own += [(extra, "K", initial), (1 + extra, "R", "u"), (1 + extra, "R", "a")]
        choices += [[(5 * len(s), "I" * len(s), "".join(s)) for s in inserts], own]
    choices.append([(5 * len(s), "I" * len(s), "".join(s)) for s in inserts])
    for picked in itertools.product(*choices):
        if PATTERN.fullmatch("".join(p[2] for p in picked)):
            value = (sum(p[0] for p in picked), "".join(p[1] for p in picked))
            best = value if best is None or value < best else best
    return best


def test_agenda_against_enumeration():
    assert whole("") == (0, "")
    kinds = [i + f for i in "suax" for f in "-bdt"]
    for codes in [*kinds, *map("".join, itertools.product(kinds, repeat=2))]:
        assert whole(codes) == every_repair(codes), codes
    rnd = random.Random(1)
    for _ in range(60):
        codes = "".join(rnd.choice(kinds) for _ in range(3))
        assert whole(codes) == every_repair(codes), codes


def test_chunks_give_the_same_as_the_whole():
    rnd = random.Random(2)
    for _ in range(200):
        rows = [rnd.choice("ssuuuaaax") + rnd.choice("---bdtt") for _ in range(rnd.randrange(40))]
        cuts = sorted(rnd.sample(range(len(rows) + 1), min(len(rows), rnd.randrange(4))))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        assert over_chunks([crossings("".join(p)) for p in parts]) == whole("".join(rows))


def plain(rows):
    """The contract, conversation by conversation, with a table over (row, state) filled from the end."""
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, [])
        show = lambda x: " " if x is None else str(x)
        role, text = show(role), show(text)
        k = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        by_conv[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, codes, faults = set(), [], []
        for _, role, text in own:
            bare = text.strip(BLANKS)
            faults.append("b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t")
            seen.add((role, text))
            codes.append(role[:1])
        table = {(len(own), s): (0, "") if s in (0, 3) else None for s in range(4)}
        move = lambda s, i: {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, i))
        for i in range(len(own), -1, -1):
            if i < len(own):
                for s in range(4):
                    ways = [(2, "D", table[i + 1, s])]
                    if faults[i] not in "bd":
                        extra = 5 * (faults[i] == "t")
                        ways += [(c + extra, letter, table[i + 1, move(s, r)]) for c, letter, r in ((0, "K", codes[i]), (1, "R", "u"), (1, "R", "a")) if move(s, r) is not None]
                    table[i, s] = min([(c + v[0], letter + v[1]) for c, letter, v in ways if v], default=None)
            for _ in range(4):  # insertions, until nothing changes
                for s in range(4):
                    for r in "ua":
                        if move(s, r) is not None and (v := table[i, move(s, r)]):
                            table[i, s] = min(x for x in (table[i, s], (5 + v[0], "I" + v[1])) if x)
        cost, audit = table[0, 0]
        state, left, lines = 0, list(own), []
        for letter in audit:
            role, text = left.pop(0)[1:] if letter != "I" else ("", "")
            if letter != "D":
                wanted = "assistant" if state == 2 else "user"
                role = role if letter == "K" else wanted
                state = move(state, role[:1])
                lines.append(f"{role}:{text}")
        known = [t for t, *_ in own if t is not None]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, cost long, kind string"


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = conversations.report(conversations.damage(df), df).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def sample(n, rnd, turns=12):
    texts = ["Yes.", "no", "", " \n", "What?! ", "same.", "é ü.", "end ", None]
    return [(c if c else None, t if rnd.random() < 0.9 else None, rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rnd.choice(texts) if rnd.random() < 0.5 else f"text {c} {t}.") for c in range(n) for t in range(rnd.randrange(1, turns))]


def test_report_against_plain_table(spark):
    rows = sample(150, random.Random(4))
    rows += rows[:30]  # repeated rows
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", "same.") for t in range(300)]  # copies that fill a conversation
    rows += [(501, 0, "user", "hello there.")] * 200
    assert found(spark, rows) == plain(rows)


def test_conversations_over_chunks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", 7)
    rnd = random.Random(5)
    rows = sample(20, rnd) + [(900, t, rnd.choice(["system", "user", "assistant"]), rnd.choice(["a.", f"t {t}", f"u {t}.", ""])) for t in range(700)] + sample(20, rnd)
    assert found(spark, rows) == plain(rows)


def test_repaired_rows_alternate(spark):
    rows = sample(60, random.Random(6))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversations.repaired(conversations.damage(df)).collect()
    by_conv = {}
    for r in sorted(got, key=lambda r: r.position):
        by_conv.setdefault(r.conv_id, []).append((r.role, r.text))
    want = {k: v[-1] for k, v in plain(rows).items()}
    for conv, own in by_conv.items():
        assert PATTERN.fullmatch("".join(role[0] for role, _ in own))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in own).encode()).hexdigest() == want[conv]


@pytest.mark.parametrize("conv", [None, 3])
def test_nothing_left_and_empty_tables(spark, conv):
    gone = [t for t in range(400) if zlib.crc32(f"{' ' if conv is None else conv}:{t}".encode()) % 20 == 0][:2]
    empty = hashlib.sha256(b"").hexdigest()
    assert found(spark, [(conv, t, "user", "x.") for t in gone]) == {conv: (0, 0, 0, 0, 0, 0, "", empty)}
    assert found(spark, []) == {}
    assert conversations.repaired(conversations.damage(spark.createDataFrame([], SCHEMA))).count() == 0
    big = [(conv, t, "user", "x.") for t in (-(1 << 63), (1 << 63) - 1)]
    assert found(spark, big)[conv][0] in (0, (1 << 63) - 1)
