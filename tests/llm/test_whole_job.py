"""Operators against brute force where a bound inside them once changed the result."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa

from regmart.llm import jaccard, lm, mixing, suffix
from regmart.llm.common import row_key


def test_suffix_index_reports_every_position_across_batches(monkeypatch):
    monkeypatch.setattr(suffix, "BATCH_WINDOWS", 100)
    rnd, length = random.Random(3), 50
    word = lambda n: bytes(rnd.choice(b"abcdefgh") for _ in range(n))
    passages = [word(80) for _ in range(6)]
    # A document repeats a passage in different contexts; smaller ids come in later batches, as runs come in no order of their ids.
    runs = [(doc, 1000 * i, word(9) + rnd.choice(passages) + word(7)) for doc in range(12) for i in range(4)]
    rnd.shuffle(runs)
    least = {}
    for doc, _, run in runs:
        for p in range(len(run) - length + 1):
            least[run[p : p + length]] = min(doc, least.get(run[p : p + length], doc))
    want = {(doc, start + p) for doc, start, run in runs for p in range(len(run) - length + 1) if least[run[p : p + length]] < doc}
    columns = [np.array(x, kind) for x, kind in zip(zip(*((d, 0, s, len(r) - length + 1) for d, s, r in runs)), ("<i8", "<i8", "<i8", "<i4"))]
    packed = suffix.pack(*columns, b"".join(r for *_, r in runs))
    table = pa.table([pa.array([x], pa.binary()) for x in packed], names=["doc", "version", "start", "count", "text"])
    doc, _, start, count = suffix.later_windows(table, length)
    got = {(int(d), int(s) + i) for d, s, c in zip(doc, start, count) for i in range(int(c))}
    assert got == want


def test_suffix_sends_a_repeated_run_once():
    runs = [(0, b"alone"), *((doc, b"passage of many") for doc in range(1, 1000)), (5000, b"twice here"), (5000, b"twice here"), (5001, b"twice here")]
    size = np.array([len(r) for _, r in runs])
    late = suffix.late_runs(b"".join(r for _, r in runs), np.cumsum(size) - size, size, np.array([d for d, _ in runs]))
    assert [runs[i] for i in np.flatnonzero(~late)] == [(0, b"alone"), (1, b"passage of many"), (5000, b"twice here"), (5000, b"twice here")]  # every position of the first document goes on
    # Names without text are late, whatever else the bucket holds.
    packed = [suffix.pack(*(np.array([x], kind) for x, kind in zip(entry, ("<i8", "<i8", "<i8", "<i4"))), text) for entry, text in (((1, 7, 3, 2), bytes(range(51))), ((2, 8, 5, 2), b""))]
    table = pa.table([pa.array(x, pa.binary()) for x in zip(*packed)], names=["doc", "version", "start", "count", "text"])
    assert [x.tolist() for x in suffix.later_windows(table, 50)] == [[2], [8], [5], [2]]


def test_suffix_texts_of_one_id(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passages = [word(90) for _ in range(8)]
    # Thousands of texts under null ids and under one id, of all lengths: 16 bits cannot tell them apart.
    rows = [(i, p) for i, p in enumerate(passages)]
    rows += [(None if k % 2 else 99, f"{k} " + word(rnd.randrange(60)) + rnd.choice(passages) + word(rnd.randrange(9))) for k in range(3000)]
    want, least, last = [], {}, lambda i: 1 << 63 if i is None else i
    for i, t in rows:
        for p in range(len(t) - 49):
            least[t[p : p + 50]] = min(last(i), least.get(t[p : p + 50], 1 << 63))
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if least[t[p : p + 50]] < last(i):
                gone[p : p + 50] = b"\1" * 50
        want.append((i, len(t), sum(gone), hashlib.sha256(bytes(b for b, x in zip(t.encode(), gone) if not x)).hexdigest()))
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), keep_text=False).collect()
    order = lambda r: (r[0] is None, *map(str, r))
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got), key=order) == sorted(want, key=order)


def test_lm_learns_classes_beyond_the_seed(spark):
    rnd = random.Random(7)
    # Two kinds of words that look alike and alternate; there are many more of them than words of the seed.
    kinds = [[f"w{k}{i:04d}x" for i in range(150)] for k in "ab"]
    texts = [" ".join(rnd.choice(kinds[j % 2]) for j in range(60)) for _ in range(400)] + ["", "unseenword w_x 77", "w_x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 == 2}
    seen = {}
    for i, t in enumerate(texts):
        if i not in held:
            for w in t.split():
                seen[w] = seen.get(w, 0) + 1
    chunks = spark.createDataFrame(lm.chunked(rows, 5, 3000).collect(), lm.CHUNKS)  # fixed, as chunks are named by task
    assert chunks.count() > 5
    start = lm.seed(chunks, 20, 2)
    answers = lm.clustered(chunks, start, 5)
    found = lm.vocabulary(answers).collect()
    assert {bytes(r.word).decode(): r.n for r in found} == seen
    assert all((r["class"] is None) == (r.n < 2) for r in found)
    sides = [{r["class"] for r in found if bytes(r.word).decode() in kind and r["class"] is not None} for kind in kinds]
    assert len(sides[0]) == len(sides[1]) == 1 and sides[0] != sides[1]
    got = lm.score(rows, top_words=20, classes=2, chunk_tokens=3000).collect()
    per_token = sum(r.score for r in got) / sum(r.n_tokens for r in got)
    assert per_token > -math.log10(150) - 0.2  # as sure as the kinds allow; by forms alone it is log10(300)

    # Scores from the classes, by the plain formula.
    of, g = {bytes(r.word).decode(): r["class"] for r in found}, len(start.table)
    form = lambda w: start.first_form + lm.form(w.encode())
    cls = lambda w: start.end if w is None else form(w) if of.get(w) is None else of[w]
    table, ends = np.zeros((g, g)), len(texts) - len(held)
    for i, t in enumerate(texts):
        if i not in held:
            line = [None, *t.split(), None]
            for a, b in zip(line, line[1:]):
                table[cls(a), cls(b)] += 1
    size, move = table.sum(axis=0), lm.smoothed(table)
    once = [w for w in seen if of[w] is None]
    def emission(w):
        c = cls(w)
        if w is None or of.get(w) is not None:
            return (ends if w is None else seen[w]) / size[c]
        if w in seen:
            return (seen[w] - lm.DISCOUNT) / size[c]
        alike = [x for x in once if form(x) == c]
        left = lm.DISCOUNT * len(alike) / max(1, size[c]) if alike else 1.0
        raw = "".join(alike).encode()
        total = len(raw) + len(alike) + 257
        for byte in w.encode():
            left *= (raw.count(byte) + 1) / total
        return left * (len(alike) + 1) / total
    for r in got:
        line = [None, *texts[r.doc_id].split(), None]
        want = sum(math.log10(move[cls(a), cls(b)]) + math.log10(emission(b)) for a, b in zip(line, line[1:]))
        assert abs(r.score - want) < 1e-6 * max(1, abs(want)), (r, want)


def test_lm_classes_grow_with_the_input():
    assert lm.class_count(10**10) > lm.class_count(10**9) > lm.class_count(10**7) > 0


def test_jaccard_rows_that_repeat_an_id(spark):
    a, b, c = ("the river rose and people moved uphill before noon " + w for w in ("alpha", "completely different words stand here in this one", "x y z"))
    rows = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (9, None), (9, c), (9, None), (None, a), (None, ""), (None, "")], "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id or 0, r.n_shingles > 0, r.component_id) for r in jaccard.similar(rows).collect()), key=str)
    assert got == sorted([(3, True, 3), (5, True, 3), (5, True, 3), (7, True, 3), (9, True, 9), (9, False, 9), (9, False, 9), (0, True, None), (0, False, None), (0, False, None)], key=str)
    kept = jaccard.one_of_each(rows.unionByName(rows)).collect()
    want = [(3, a), (5, b), (9, c), *[(9, None)] * 4, *[(None, "")] * 4]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(want, key=str)


def test_components_of_hubs_and_chains(spark):
    from regmart.llm.graph import components

    rnd = random.Random(11)
    hub = [(1_000_000 + i, 7) for i in range(4000)] + [(2_000_000 + i, 999_999) for i in range(3000)] + [(999_999, 7)]
    chain = [(i, i + 1) for i in range(5000, 5600)]
    loose = [(rnd.randrange(20_000, 21_000), rnd.randrange(20_000, 21_000)) for _ in range(600)]
    links = hub + chain + loose
    root = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for x, y in links:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    rnd.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for pair in links for x in pair if pair[0] != pair[1] or x in got}


def plain_targets(sizes, weights=(3, 1, 2)):
    """Targets by giving out the rest again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {s: 0.0 for s in names}, set(names), 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            for s in open_:
                target[s] += left * weight[s] / total
            break
        for s in full:
            left -= 2 * sizes[s] - target[s]
            target[s] = 2.0 * sizes[s]
        open_ -= full
    return target


def test_mixing_against_plain_targets(spark):
    rnd = random.Random(2)
    for n_sources in (1, 5, 40):
        rows = [(i if i % 9 else None, " w" * rnd.choice((0, 1, 3, 10, 60)), None if i % n_sources == 4 else f"s{i % n_sources:02d}") for i in range(900)]
        rows += [(5000, " hot" * 7, "s00")] * 450 + [(5000, "other", "s00"), (5001, None, None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        sizes = {}
        for _, t, s in rows:
            sizes[s] = sizes.get(s, 0) + len((t or "").split())
        want = plain_targets(sizes)
        got = mixing.plan(docs).collect()
        assert len(got) == len(rows)
        for s in sizes:
            mine = [r for r in got if r.source == s]
            assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and r.passes <= 2 for r in mine)
            assert abs(sum(r["size"] * r.passes for r in mine) - want[s]) <= 60
        out = mixing.mixed_documents(docs).collect()
        count = lambda xs: sorted(f"{x}" for x in xs)
        assert count((r.doc_id, r.source, len((r.text or "").split())) for r in out) == count((r.doc_id, r.source, r["size"]) for r in mixing.plan(docs, key=row_key(docs)).collect() for _ in range(r.passes))
        firsts = [r.first_position for r in mixing.mixed(docs).collect()]
        taken = [x for x in firsts if x is not None]
        assert firsts[: len(taken)] == sorted(taken) and len(firsts) == len(rows)


def test_sketches_never_rule_out_a_link():
    rnd = np.random.default_rng(5)
    ruled_out = 0
    for _ in range(3000):
        x = np.unique(rnd.integers(0, 1 << 62, rnd.integers(1, 300)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rnd.random(len(x)) < rnd.choice((0.5, 0.9, 0.97))], rnd.integers(0, 1 << 62, rnd.integers(1, 30)).astype(np.uint64)]))
        shared = len(np.intersect1d(x, y))
        fine = jaccard.may_link(len(x), jaccard.odd_sketch(x), len(y), jaccard.odd_sketch(y), 80, 100)
        assert fine or 100 * shared < 80 * (len(x) + len(y) - shared)
        ruled_out += not fine
    assert ruled_out > 1000
