"""LM scoring: class-based n-grams after Brown, with classes from exchange clustering.

1. One scan cuts the texts into chunks of about ``CHUNK`` tokens: a chunk holds its distinct words, dealt by hash to buckets, and its texts as numbers of those words.
2. The ``TOP_WORDS`` most frequent words (counted over every chunk in which they make up 1 / ``RARE`` of the tokens or more) are the seed: exchange clustering in the driver
   moves a word to the class that raises the likelihood of the class bigrams most, until none moves or after ``PASSES`` passes. All other words are in classes by
   their form (digits, end mark, length) as yet.
3. Every chunk sends its words to their buckets, with the counts of (word, class before) and (word, class after) in its training texts. A bucket adds them up and moves every
   word of two or more occurrences, seeds as well, to the class under which its neighbours are likeliest, against the broadcast table of seed classes. Only words that
   occur once or never stay in forms. The bucket answers each chunk with the counts and classes of its words, so no vocabulary is ever held whole.
4. Chunks turn their numbers into classes; class transitions are counted over every training text and smoothed with class frequencies.

A word's emission is its share of its class. In form classes an absolute discount leaves room for unknown words, and each takes its share of it by its spelling: the
product of its bytes' probabilities among the words of that form that occur once, so emissions add up to one at most.

What is broadcast or collected is bounded by the seed's bigrams and by the squared number of classes, a small power of the number of tokens.

Defined cases: a null or empty text is the end token alone; repeated rows and null ids are scored row by row; a null id trains (its remainder is unknown, not
held out); without training texts every count is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regmart.llm.common import as_bytes, checkpointed, crc_of_id, documents, partitions, session

TOP_WORDS, CLASSES, RARE = 1000, 32, 1 << 15
DISCOUNT, PRIOR, PASSES = 0.6, 50.0, 6
#: Learned classes are the number of training tokens to this power, CLASSES at least.
GROWTH = 0.22
#: Tokens of a chunk; a longer text is in one chunk.
CHUNK = 1 << 21
FORMS = 12
NO_CLASS = 0xFFFF
_DIGIT = re.compile(rb"[0-9]").search


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def form(word: bytes) -> int:
    """One of FORMS classes of a word: digits, a mark at its end, or neither; by length."""
    n, last = len(word), word[-1]
    kind = 0 if _DIGIT(word) else 1 if last < 0x30 or 0x39 < last < 0x61 or 0x7A < last < 0x80 else 2
    return kind * 4 + (0 if n <= 3 else 1 if n <= 6 else 2 if n <= 9 else 3)


class Numbers(dict):
    """Word -> number, from 1 in the order in which words come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self) + 1
        return out


def pack(array: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array if isinstance(array, bytes) else np.ascontiguousarray(array).tobytes())


def unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31), kind)


def words_of(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31)
    return raw.split(b" ") if raw else []


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, n_top: int, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of every symbol. Symbols beyond the top words keep a class of their own; top words are exchanged."""
    m = len(bigrams)
    classes = max(1, min(classes, n_top)) if n_top else 0
    of = np.concatenate([np.arange(n_top) % max(1, classes), classes + np.arange(m - n_top)]).astype(np.int64)
    g = classes + m - n_top
    table = np.zeros((g, g))
    np.add.at(table, (of[:, None], of[None, :]), bigrams)
    for _ in range(passes):
        moved = 0
        for w in range(n_top):
            own, self_n = of[w], bigrams[w, w]
            after = np.bincount(of, bigrams[w], g)
            before = np.bincount(of, bigrams[:, w], g)
            after[own] -= self_n
            before[own] -= self_n
            if not (after.any() or before.any()):
                continue
            table[own] -= after
            table[:, own] -= before
            table[own, own] -= self_n
            rows, cols = table[:classes], table[:, :classes].T
            k = np.arange(classes)
            gain = (xlogx(rows + after) - xlogx(rows)).sum(axis=1) + (xlogx(cols + before) - xlogx(cols)).sum(axis=1)
            diagonal = table[k, k]
            gain += xlogx(diagonal + after[k] + before[k] + self_n) - xlogx(diagonal + after[k]) - xlogx(diagonal + before[k]) + xlogx(diagonal)
            out, into = rows.sum(axis=1), cols.sum(axis=1)
            gain -= xlogx(out + after.sum() + self_n) - xlogx(out) + xlogx(into + before.sum() + self_n) - xlogx(into)
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            of[w] = best
            table[best] += after
            table[:, best] += before
            table[best, best] += self_n
        if not moved:
            break
    return of


def is_training() -> F.Column:
    return F.coalesce(crc_of_id() % 7 != 2, F.lit(True))


CHUNKS = "chunk long, doc_id array<long>, train array<boolean>, size array<int>, line binary, words binary, forms binary, cuts binary"


def chunked(docs: DataFrame, buckets: int, chunk_tokens: int = CHUNK) -> DataFrame:
    """A row a chunk: its documents and their sizes (the end token counts), ``line``: word numbers of all texts (from 1; 0 is the end), ``words`` in the order of
    their buckets, their forms, and where each bucket begins. Chunks are named by task, so the result must be checkpointed before its names are used."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32

        def flush(count: int) -> pa.RecordBatch:
            words = list(numbers)
            bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.zeros(len(words) + 1, "<u4")
            place[order + 1] = np.arange(1, len(words) + 1)
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).astype("<u4")
            words = [words[i] for i in order.tolist()]
            blobs = (place[np.array(line, np.int64)], b" ".join(words), np.array([form(w) for w in words], np.uint8), cuts)
            row = [pa.array([first + count], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([trains], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*row, *(pa.array([pack(x)], pa.binary()) for x in blobs)], [c.split(" ")[0] for c in CHUNKS.split(", ")])

        numbers, line, ids, trains, sizes, count = Numbers(), [], [], [], [], 0
        for batch in batches:
            for doc_id, text, train in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                before = len(line)
                line += map(numbers.__getitem__, tokens(text))
                line.append(0)
                ids.append(doc_id)
                trains.append(train)
                sizes.append(len(line) - before)
                if len(line) >= chunk_tokens:
                    yield flush(count)
                    numbers, line, ids, trains, sizes, count = Numbers(), [], [], [], [], count + 1
        if ids:
            yield flush(count)

    return documents(docs).select("doc_id", "text", is_training().alias("train")).mapInArrow(cut, CHUNKS)


def trained_tokens(train: list[bool], size: list[int]) -> np.ndarray:
    """Which tokens of a chunk are of training texts."""
    return np.repeat(np.array(train, bool), size)


def class_count(n_tokens: int) -> int:
    """Learned classes for so many training tokens."""
    return max(CLASSES, round(n_tokens**GROWTH))


@dataclass(frozen=True)
class Seed:
    """``of``: class of every symbol (seed words, forms, the end); ``classes`` of them are learned, then come the forms and the end; ``table``: class bigrams."""

    top: list[bytes]
    of: np.ndarray
    classes: int
    table: np.ndarray

    @property
    def first_form(self) -> int:
        return self.classes

    @property
    def end(self) -> int:
        return self.classes + FORMS


def smoothed(table: np.ndarray) -> np.ndarray:
    size = table.sum(axis=0)
    share = (size + 1) / (size.sum() + len(table))
    return (table + PRIOR * share) / (table.sum(axis=1, keepdims=True) + PRIOR)


def symbols_of(top: dict[bytes, int], words: list[bytes], forms: np.ndarray) -> np.ndarray:
    """Symbols by word number: the end, then every word's rank in the seed or its form."""
    end = len(top) + FORMS
    rank = np.fromiter((top.get(w, -1) for w in words), np.int64, len(words))
    return np.concatenate([[end], np.where(rank < 0, len(top) + forms.astype(np.int64), rank)])


def frequent(chunks: DataFrame, most: int) -> tuple[list[bytes], int]:
    """The seed words, most frequent first, and the number of training tokens."""

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for train, size, line, words in zip(*(c.to_pylist() for c in batch.columns)):
                n = np.bincount(unpack(line, "<u4")[trained_tokens(train, size)], minlength=1)
                words, total = words_of(words), int(n.sum())
                at = np.flatnonzero(n[1:] * RARE > total)
                yield pa.RecordBatch.from_arrays([pa.array([None, *(words[i] for i in at)], pa.binary()), pa.array([total, *n[1:][at].tolist()], pa.int64())], ["word", "n"])

    counts = checkpointed(chunks.select("train", "size", "line", "words").mapInArrow(often, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.filter("word is null").first()
    top = counts.filter("word is not null").orderBy(F.desc("n"), "word").limit(most).collect()
    return [bytes(r.word) for r in top], total.n if total else 0


def seed(chunks: DataFrame, top_words: int, classes: int | None) -> Seed:
    """Classes of the most frequent words."""
    top, n_tokens = frequent(chunks, top_words)
    end = len(top) + FORMS
    shared = session(chunks).sparkContext.broadcast({w: i for i, w in enumerate(top)})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((end + 1) ** 2, np.int64)
        for batch in batches:
            for train, size, line, words, forms in zip(*(c.to_pylist() for c in batch.columns)):
                found = symbols_of(shared.value, words_of(words), unpack(forms, "u1"))[unpack(line, "<u4")]
                code = np.concatenate([[end], found[:-1]]) * (end + 1) + found  # a text follows an end
                total += np.bincount(code[trained_tokens(train, size)], minlength=len(total))
        at = np.flatnonzero(total)
        for low in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[low : low + (1 << 16)]), pa.array(total[at[low : low + (1 << 16)]])], ["code", "n"])

    rows = chunks.select("train", "size", "line", "words", "forms").mapInArrow(pairs, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # at most (TOP_WORDS + FORMS + 1) squared rows
    bigrams = np.zeros((end + 1, end + 1))
    bigrams.ravel()[rows.code.to_numpy(dtype=np.int64)] = rows.n
    of = exchange(bigrams, len(top), classes or class_count(n_tokens))
    g = int(of.max()) + 1
    table = np.zeros((g, g))
    np.add.at(table, (of[:, None], of[None, :]), bigrams)
    return Seed(top, of, g - FORMS - 1, table)


def best_classes(counted: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """The class of every word that makes its neighbours likeliest; ``counted``: a row a word, how often each class comes before it and (second half) after it."""
    g = len(table)
    log = np.log(smoothed(table))
    before, after = counted[:, :g], counted[:, g:]
    score = before @ log[:, :classes] + after @ log[:classes].T - before.sum(axis=1, keepdims=True) * np.log(np.maximum(table.sum(axis=0)[:classes], 1.0))
    return score.argmax(axis=1)


def clustered(chunks: DataFrame, start: Seed, buckets: int) -> DataFrame:
    """Answers: chunk, bucket, and n and class of the chunk's words of that bucket, in their order. A row without a chunk holds a bucket's sums by form:
    tokens, distinct words, words that occur once, and the bytes of these (256 is their end); and as ``words`` its vocabulary."""
    g = len(start.table)
    top = {w: i for i, w in enumerate(start.top)}
    shared = session(chunks).sparkContext.broadcast((start, top))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, top = shared.value
        for batch in batches:
            for chunk, train, size, line, words, forms, cuts in zip(*(c.to_pylist() for c in batch.columns)):
                words, at, cuts = words_of(words), unpack(line, "<u4").astype(np.int64), unpack(cuts, "<u4")
                own = s.of[symbols_of(top, words, unpack(forms, "u1"))][at]
                middle = np.flatnonzero((at > 0) & trained_tokens(train, size))
                before = np.where(middle > 0, own[middle - 1], s.end)
                codes, n = np.unique(np.concatenate([at[middle] * (2 * g) + before, at[middle] * (2 * g) + g + own[middle + 1]]), return_counts=True)
                word = codes // (2 * g) - 1
                per_word, where = np.bincount(word, minlength=len(words)), np.searchsorted(word, cuts)
                out = []
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(where[b], where[b + 1])
                    arrays = (per_word[cuts[b] : cuts[b + 1]].astype("<u4"), (codes[part] % (2 * g)).astype("<u4"), n[part].astype("<u4"))
                    out.append((chunk, b, pack(b" ".join(words[cuts[b] : cuts[b + 1]])), *map(pack, arrays)))
                kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], ["chunk", "bucket", "words", "size", "code", "n"])

    def moved(rows: pa.Table) -> pa.Table:
        s, _ = shared.value
        numbers = Numbers()
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        asked: list[np.ndarray] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            k, n = (np.concatenate(x) for x in zip((keys, sums), *held))
            k, at = np.unique(k, return_inverse=True)
            return k, np.bincount(at, n, len(k)).astype(np.int64)

        for words, size, code, n in zip(*(rows.column(c).to_pylist() for c in ("words", "size", "code", "n"))):
            ids = np.fromiter(map(numbers.__getitem__, words_of(words)), np.int64) - 1
            asked.append(ids.astype("<u4"))
            held.append((np.repeat(ids, unpack(size, "<u4")) * (2 * g) + unpack(code, "<u4"), unpack(n, "<u4").astype(np.int64)))
            if sum(len(x[0]) for x in held) > CHUNK:
                keys, sums = added()
                held = []
        keys, sums = added()
        words = list(numbers)
        total, of = np.zeros(len(words), np.int64), np.full(len(words), NO_CLASS, "<u2")
        step = max(1, (1 << 20) // g)
        for low in range(0, len(words), step):
            a, b = np.searchsorted(keys, [low * 2 * g, min(low + step, len(words)) * 2 * g])
            counted = np.zeros((min(step, len(words) - low), 2 * g))
            counted.ravel()[keys[a:b] - low * 2 * g] = sums[a:b]
            total[low : low + step] = counted[:, :g].sum(axis=1)
            if s.classes:
                of[low : low + step] = best_classes(counted, s.table, s.classes)
        of[total < 2] = NO_CLASS
        forms = np.array([form(w) for w in words], np.int64)
        stats = np.zeros((FORMS, 3 + 257), np.int64)
        stats[:, 0] = np.bincount(forms, total, FORMS)
        stats[:, 1] = np.bincount(forms[total > 0], minlength=FORMS)
        alone = (total > 0) & (of == NO_CLASS)
        stats[:, 2] = np.bincount(forms[alone], minlength=FORMS)
        for f in range(FORMS):
            stats[f, 3:259] = np.bincount(np.frombuffer(b"".join([words[i] for i in np.flatnonzero(alone & (forms == f))]), np.uint8), minlength=256)
        stats[:, 259] = stats[:, 2]
        bucket = rows.column("bucket")[0].as_py()
        chunk = [*rows.column("chunk").to_pylist(), None]
        n_blobs = [*(pack(total[i].astype("<i8")) for i in asked), pack(total.astype("<i8"))]
        class_blobs = [*(pack(of[i]) for i in asked), pack(of)]
        tail = [None] * len(asked)
        return pa.table(
            [pa.array(chunk, pa.int64()), pa.array([bucket] * len(chunk), pa.int32()), pa.array(n_blobs, pa.binary()), pa.array(class_blobs, pa.binary()), pa.array([*tail, stats.tobytes()], pa.binary()), pa.array([*tail, pack(b" ".join(words))], pa.binary())],
            names=["chunk", "bucket", "n", "class", "stats", "words"],
        )

    asked = chunks.select("chunk", "train", "size", "line", "words", "forms", "cuts").mapInArrow(neighbours, "chunk long, bucket int, words binary, size binary, code binary, n binary")
    return asked.groupBy("bucket").applyInArrow(moved, "chunk long, bucket int, n binary, class binary, stats binary, words binary")


def vocabulary(answers: DataFrame) -> DataFrame:
    """word, n and class (null: the form's) of every word of the training texts."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, of, words in zip(*(c.to_pylist() for c in batch.columns)):
                n, of, words = unpack(n, "<i8"), unpack(of, "<u2"), words_of(words)
                kept = np.flatnonzero(n > 0)
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in kept], pa.binary()), pa.array(n[kept]), pa.array(of[kept].astype(np.int32), mask=of[kept] == NO_CLASS)], ["word", "n", "class"])

    return answers.filter("chunk is null").select("n", "class", "words").mapInArrow(listed, "word binary, n long, class int")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, top_words: int = TOP_WORDS, classes: int | None = None, chunk_tokens: int = CHUNK) -> DataFrame:
    """Scores of every document under the base unigram model and the class model."""
    context, buckets = session(docs).sparkContext, partitions(docs)
    chunks = checkpointed(chunked(docs, buckets, chunk_tokens))
    start = seed(chunks, top_words, classes)
    answers = checkpointed(clustered(chunks, start, buckets))
    first_form, end, g = start.first_form, start.end, len(start.table)
    ends = int(start.table[end].sum())
    summed = np.zeros((FORMS, 3 + 257))
    for r in answers.filter("chunk is null").select("stats").toLocalIterator():  # a small table a bucket
        summed += np.frombuffer(r.stats, np.int64).reshape(summed.shape)
    n_all, v_all = int(summed[:, 0].sum()) + ends, int(summed[:, 1].sum()) + (ends > 0)
    once = summed[:, 2]
    spelling = np.log10((summed[:, 3:] + 1) / (summed[:, 3:] + 1).sum(axis=1, keepdims=True))

    def classed(texts: pa.Table, found: pa.Table) -> pa.Table:
        log_total, out = math.log10(n_all + v_all + 1), []
        blobs = dict(zip(found.column("bucket").to_pylist(), zip(found.column("n").to_pylist(), found.column("class").to_pylist())))
        for doc_id, train, size, line, words, forms in zip(*(texts.column(c).to_pylist() for c in ("doc_id", "train", "size", "line", "words", "forms"))):
            words, forms = words_of(words), unpack(forms, "u1").astype(np.int64)
            n = np.concatenate([[ends], *(unpack(blobs[b][0], "<i8") for b in sorted(blobs))]).astype(np.int64)
            of = np.concatenate([[end], *(unpack(blobs[b][1], "<u2") for b in sorted(blobs))]).astype(np.int64)
            of[1:] = np.where(of[1:] == NO_CLASS, first_form + forms, of[1:])
            emit = np.log10(np.maximum(n - np.where((of >= first_form) & (of < end), DISCOUNT, 0.0), 0.1))
            for i in np.flatnonzero(n == 0).tolist():
                emit[i] = 0.0 if i == 0 else float(spelling[forms[i - 1], np.frombuffer(words[i - 1], np.uint8)].sum() + spelling[forms[i - 1], 256])
            at = unpack(line, "<u4").astype(np.int64)
            begins = np.cumsum(size) - size
            sums = [np.add.reduceat(x[at], begins) for x in (np.log10(n + 1) - log_total, emit)]
            out.append((doc_id, train, size, *(x.tolist() for x in sums), pack((2 * of + (n > 0)).astype("<u2")[at])))
        kinds = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=["doc_id", "train", "size", "base", "emit", "line"])

    texts = chunks.select("chunk", "doc_id", "train", "size", "line", "words", "forms")
    found = answers.filter("chunk is not null").select("chunk", "bucket", "n", "class")
    lines = checkpointed(texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(classed, "doc_id array<long>, train array<boolean>, size array<int>, base array<double>, emit array<double>, line binary"))

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(g * g, np.int64)
        for batch in batches:
            for train, size, line in zip(*(c.to_pylist() for c in batch.columns)):
                c = unpack(line, "<u2").astype(np.int64) >> 1
                code = np.concatenate([[end], c[:-1]]) * g + c
                total += np.bincount(code[trained_tokens(train, size)], minlength=len(total))
        at = np.flatnonzero(total)
        for low in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[low : low + (1 << 16)]), pa.array(total[at[low : low + (1 << 16)]])], ["code", "n"])

    pairs = lines.select("train", "size", "line").mapInArrow(transitions, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # at most the squared number of classes
    table = np.zeros((g, g))
    table.ravel()[pairs.code.to_numpy(dtype=np.int64)] = pairs.n
    size = table.sum(axis=0)
    log_unknown = np.zeros(g)
    form_size = size[first_form : first_form + FORMS]
    log_unknown[first_form : first_form + FORMS] = np.log10(np.where(once > 0, DISCOUNT * once / np.maximum(form_size, 1), 1.0))
    shared = context.broadcast((np.log10(smoothed(table)), np.stack([log_unknown, -np.log10(np.maximum(size, 1))], axis=1).ravel()))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition, by_code = shared.value
        for batch in batches:
            for doc_id, train, n, base, emit, line in zip(*(c.to_pylist() for c in batch.columns)):
                code = unpack(line, "<u2").astype(np.int64)
                c, n = code >> 1, np.array(n, np.int64)
                begins = np.cumsum(n) - n
                rest = np.add.reduceat(by_code[code] + transition[np.concatenate([[end], c[:-1]]), c], begins)
                known = np.add.reduceat(code & 1, begins)
                columns = [pa.array(doc_id, pa.int64()), pa.array([not x for x in train]), pa.array(n), pa.array(known), pa.array(np.full(len(n), n_all)), pa.array(base, pa.float64()), pa.array(np.array(emit) + rest)]
                yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in SCORES.split(", ")])

    return lines.select("doc_id", "train", "size", "base", "emit", "line").mapInArrow(scored, SCORES)
