"""Suffix-array dedup: removes bytes of long strings that an earlier document has as well.

A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id. Windows of ``length`` bytes are the suffixes cut at that depth; they
are dealt by content and indexed by a logarithmic family of suffix arrays:

1. Every window has an anchor, the least of the hashes of its ``K``-byte strings; equal windows have equal anchors, and a run of windows shares one. Anchors whose
   string occurs in one document only rule out all their windows, so only hashes are shuffled for them (once, packed by task).
2. The runs of the other anchors travel as text to the bucket of their anchor, but for those that an earlier document of the same slice of a home has as well: they are late already, and
   of them only names travel, so a passage of many documents reaches its bucket once a slice. There, batch by batch, runs that are the same text are merged, the windows of the rest get a
   suffix array (sorted by their bytes as big-endian words), which is merge-scanned against the arrays of all levels: of equal windows the least document
   keeps its own (at all its positions), all others are reported. What is left becomes level 0; levels of equal size merge, so an index of n batches has log n levels.
3. Reported windows return to their document, whose bytes under them go.

Buckets are by content of ``K`` bytes, so neither a document nor a copied text is gathered in one task; a frequent line goes to one bucket, but once a slice of ``SLICE_BYTES``,
not once a document, and identical runs are one entry there. The number of buckets follows the shuffle partitions.

A row is named by its id and the 64-bit hash of its text. Its home is dealt by both, so rows of one id (or of none) are spread over all homes; candidates carry 16 bits of the
hash only, which marks some runs in vain where an id has many texts, and runs and reports carry all of it.

Defined cases: a null or empty text has no bytes; a text shorter than ``length`` keeps all; documents of one id do not count as earlier than each other; null ids come last
and count as one id, with the greatest long there is (a document of that id and one without take nothing from each other); repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regmart.llm.common import SLICE_BYTES, Rolling, documents, mix, partitions, slices

LENGTH, K = 50, 16
#: Windows of a batch of the index.
BATCH_WINDOWS = 1 << 18
#: Anchors or windows a task holds before it hands them on.
FLUSH = 1 << 20
NO_ID = (1 << 63) - 1
#: Candidates name a text by its hash modulo this.
SHORT = 1 << 16


class Runs:
    """Runs of windows that share an anchor, over a slice of texts: ``text`` (index in the slice), ``start``, ``count``, ``anchor`` hash; ``data`` and ``at`` find the bytes."""

    def __init__(self, texts: list[bytes], length: int, k: int):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        begins = ends - [len(t) for t in texts]
        n = len(self.data) - length + 1
        if n <= 0:
            self.text = self.start = self.count = self.at = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        bits = max(int(len(self.data)).bit_length(), 1)
        low = np.uint64((1 << bits) - 1)
        hashes = mix(Rolling(self.data).windows(k))
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        width, have = length - k + 1, 1
        while 2 * have <= width:
            least = np.minimum(least[: len(least) - have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        anchor = (least & low).astype(np.int64)
        valid = np.zeros(n, bool)
        for a, b in zip(begins.tolist(), ends.tolist()):
            valid[a : max(a, b - length + 1)] = True
        change = np.empty(n, bool)
        change[0] = True
        change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
        cuts = np.flatnonzero(change)
        count = np.diff(np.append(cuts, n))
        keep = valid[cuts]
        self.at, self.count = cuts[keep], count[keep]
        self.text = np.searchsorted(ends, self.at, "right")
        self.start = self.at - begins[self.text]
        self.anchor = hashes[anchor[self.at]]


def pack(*arrays: np.ndarray | bytes) -> list[bytes]:
    """Compressed arrays, numbers byte by byte: all first bytes, then all second ones, so that leading zeros cost nothing."""
    z = zstandard.ZstdCompressor(level=1)
    return [z.compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()) for a in arrays]


def unpack(blob: bytes, kind: str | None = None) -> np.ndarray | bytes:
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31)
    if not kind:
        return raw
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def steps(ascending: np.ndarray) -> np.ndarray:
    """First number and differences of ascending ones; ``np.cumsum`` gives them back."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def groups(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, first, last + 1) of the runs of equal keys."""
    cuts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else []
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        yield int(keys[a]), int(a), int(b)


class Level:
    """A suffix array: windows as rows of big-endian words in ascending order, each with its document and a number for reports."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, ref: np.ndarray):
        self.words, self.doc, self.ref = words, doc, ref

    def __len__(self) -> int:
        return len(self.doc)

    @staticmethod
    def merged(parts: list["Level"]) -> tuple["Level", np.ndarray]:
        """One array of all entries of every window's least document, and the numbers of the entries that an earlier document has as well."""
        words, doc, ref = (np.concatenate([getattr(p, f) for p in parts]) for f in ("words", "doc", "ref"))
        order = np.lexsort((doc, *words.T[::-1]))
        words, doc, ref = words[order], doc[order], ref[order]
        first = np.ones(len(doc), bool)
        first[1:] = (words[1:] != words[:-1]).any(axis=1)
        least = doc[first][np.cumsum(first) - 1] if len(doc) else doc
        keep = doc == least  # every position: a later batch may bring a smaller document, which takes them all
        return Level(words[keep], doc[keep], ref[keep]), ref[~keep]


class Family:
    """Levels of the index; level i holds up to 2 ** i batches."""

    def __init__(self):
        self.levels: list[Level | None] = []
        self.reported: list[np.ndarray] = []

    def add(self, batch: Level) -> None:
        batch, gone = Level.merged([batch])
        self.reported.append(gone)
        # Merge-scan against every level: what either side has later than the other is reported and leaves.
        for i, level in enumerate(self.levels):
            if level is not None and len(level) and len(batch):
                both, gone = Level.merged([level, batch])
                self.reported.append(gone)
                mine = np.isin(both.ref, batch.ref)
                self.levels[i], batch = Level(both.words[~mine], both.doc[~mine], both.ref[~mine]), Level(both.words[mine], both.doc[mine], both.ref[mine])
        i = 0
        while i < len(self.levels) and self.levels[i] is not None:
            batch, _ = Level.merged([self.levels[i], batch])
            self.levels[i] = None
            i += 1
        self.levels[i : i + 1] = [batch]


def window_words(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Windows at ``at`` as rows of 8-byte big-endian words, the last one overlapping."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    steps = [*range(0, length - 8, 8), length - 8]
    return np.stack([words[at + s].copy().view(">u8").ravel().astype(np.uint64) for s in steps], axis=1)


def late_runs(data: bytes, at: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Marks the runs, given by ascending document, whose whole text an earlier document of these has."""
    first: dict[bytes, int] = {}
    return np.fromiter((first.setdefault(data[a : a + n], d) < d for a, n, d in zip(at.tolist(), size.tolist(), doc.tolist())), bool, len(at))


def later_windows(table: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """(document, version, first window, number of windows) of the windows that an earlier document has, of all runs of a bucket."""
    out: list[tuple[int, int, int, int]] = []
    late: list[np.ndarray] = []
    known: dict[bytes, tuple[int, int, int, int]] = {}
    again: list[tuple[bytes, tuple[int, int, int, int]]] = []
    for row in zip(*(table.column(c).to_pylist() for c in ("doc", "version", "start", "count", "text"))):
        doc, version, start, count = (unpack(x, k) for x, k in zip(row[:4], ("<i8", "<i8", "<i8", "<i4")))
        text, p = unpack(row[4]), 0
        if not text:  # runs that are known to be late
            late.append(np.stack([doc, version, start, count.astype(np.int64)], axis=1))
            continue
        for entry in zip(doc.tolist(), version.tolist(), start.tolist(), count.tolist()):
            run = text[p : p + entry[3] + length - 1]
            p += len(run)
            old = known.setdefault(run, entry)
            if old is entry:
                continue
            if entry[0] > old[0]:
                out.append(entry)
            elif entry[0] < old[0]:
                out.append(old)
                known[run] = entry
            else:
                again.append((run, entry))  # the same document once more: its windows fare as the first ones do
    runs = [*known.items(), *again]
    whole = list(np.concatenate([np.array(out, np.int64).reshape(-1, 4), *late]).T)
    if not runs:
        return tuple(whole)
    data = np.frombuffer(b"".join([r for r, _ in runs]), np.uint8)
    doc, version, start, count = (np.array(x, np.int64) for x in zip(*(e for _, e in runs)))
    which = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    sizes = count + length - 1
    at = (np.cumsum(sizes) - sizes)[which] + step
    # Only windows whose hash occurs more than once can have an equal: the others need no suffix array.
    hashes = np.concatenate([Rolling(data[lo : hi + length - 1]).windows(length) for lo, hi in ((i, min(i + SLICE_BYTES, len(data) - length + 1)) for i in range(0, len(data) - length + 1, SLICE_BYTES))])[at]
    ordered = np.sort(hashes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        keep = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes)
        which, step, at = which[keep], step[keep], at[keep]
        family = Family()
        for i in range(0, len(at), BATCH_WINDOWS):
            part = slice(i, i + BATCH_WINDOWS)
            family.add(Level(window_words(data, at[part], length), doc[which[part]], np.arange(len(at))[part]))
        gone = np.unique(np.concatenate(family.reported))
        which, step = which[gone], step[gone]
        whole = [np.concatenate([x, y]) for x, y in zip(whole, (doc[which], version[which], start[which] + step, np.ones(len(which), np.int64)))]
    return tuple(whole)


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes left) and spans (start:end of what went)."""
    rows = documents(docs, id_col=id_col, text_col=text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("version"), F.col("text").cast("binary").alias("text"), F.col("doc_id").isNull().alias("no_id"))
    buckets = partitions(docs, 2)
    homes = buckets | 1
    home = F.pmod(F.pmod(F.col("doc"), F.lit(homes)) + F.pmod(F.col("version"), F.lit(SHORT)), F.lit(homes)).cast("int")

    def home_of(doc: np.ndarray, version: np.ndarray) -> np.ndarray:
        return np.mod(np.mod(doc, homes) + np.mod(version.astype(np.int64), SHORT), homes)

    def each(doc: list[int], version: list[int], text: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, Runs]]:
        for part in slices(text):
            yield np.array([doc[i] for i in part], np.int64), np.array([version[i] for i in part], np.int64), Runs([text[i] for i in part], length, k)

    def dealt(kinds: list[list[np.ndarray]], key: np.ndarray, second: np.ndarray, names: list[str], name: str) -> pa.RecordBatch:
        arrays = [np.concatenate(x) for x in kinds]
        order = np.lexsort((second, key))
        key, arrays = key[order], [a[order] for a in arrays]
        found = [(b, pack(*(steps(a[lo:hi]) if n == "hash" else a[lo:hi] for n, a in zip(names, arrays)))) for b, lo, hi in groups(key)]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), *(pa.array([p[i] for _, p in found], pa.binary()) for i in range(len(names)))], [name, *names])

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[list[np.ndarray]] = [[], [], [], []]
        held = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(kinds[0])
            return dealt(kinds, ((h >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64), h, ["hash", "doc", "version", "start"], "bucket")

        for batch in batches:
            for doc, version, runs in each(*(batch.column(i).to_pylist() for i in range(3))):
                for into, x in zip(kinds, (runs.anchor, doc[runs.text], np.mod(version, SHORT).astype(np.uint16)[runs.text], runs.start)):
                    into.append(x)
                held += len(runs.at)
                if held >= FLUSH:
                    yield flush()
                    kinds, held = [[], [], [], []], 0
        if held:
            yield flush()

    def shared_anchors(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.cumsum(unpack(x, "<u8"), dtype=np.uint64) for x in table.column("hash").to_pylist()])
        doc, version, start = (np.concatenate([unpack(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("doc", "<i8"), ("version", "<u2"), ("start", "<i8")))
        order = np.argsort(h, kind="stable")
        h, doc, version, start = h[order], doc[order], version[order], start[order]
        cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(cuts, len(h)))
        many = np.repeat(np.minimum.reduceat(doc, cuts) < np.maximum.reduceat(doc, cuts), sizes) if len(h) else np.zeros(0, bool)
        doc, version, start = doc[many], version[many], start[many]
        out = dealt([[doc], [version], [start]], home_of(doc, version), doc, ["doc", "version", "start"], "home")
        return pa.Table.from_batches([out])

    def texts_of(table: pa.Table) -> tuple[list[int], list[int], list[bytes], list[bool]]:
        order = np.lexsort((table.column("version").to_numpy(), table.column("doc").to_numpy()))
        table = table.take(pa.array(order))
        return table.column("doc").to_pylist(), table.column("version").to_pylist(), table.column("text").to_pylist(), table.column("no_id").to_pylist()

    def runs_of(texts: pa.Table, found: pa.Table) -> pa.Table:
        names = ["doc", "version", "start", "count", "text"]
        out: list[pa.RecordBatch] = []
        if texts.num_rows and found.num_rows:
            d, v, s = (np.concatenate([unpack(x, kind) for x in found.column(c).to_pylist()]) for c, kind in (("doc", "<i8"), ("version", "<u2"), ("start", "<i8")))
            wanted = np.unique(np.stack([d, v.astype(np.int64), s], axis=1), axis=0)
            mark = mix(wanted[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(wanted[:, 1].astype(np.uint64) << np.uint64(44) | wanted[:, 2].astype(np.uint64)))
            mark.sort()
            done: set[tuple[int, int]] = set()
            own_bucket = texts.column("home")[0].as_py() % buckets
            doc, version, text, _ = texts_of(texts)
            fresh = [i for i, x in enumerate(zip(doc, version)) if x not in done and not done.add(x)]
            for docs_, versions, runs in each(*([x[i] for i in fresh] for x in (doc, version, text))):
                if not len(runs.at):
                    continue
                named = lambda x: (docs_[runs.text[x]], versions[runs.text[x]], runs.start[x], runs.count[x].astype(np.int32))  # noqa: E731, B023
                own = mix(docs_[runs.text].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.mod(versions, SHORT)[runs.text].astype(np.uint64) << np.uint64(44) | runs.start.astype(np.uint64)))
                spot = np.minimum(np.searchsorted(mark, own), len(mark) - 1)
                hit = np.flatnonzero(mark[spot] == own)
                raw = runs.data.tobytes()
                late = late_runs(raw, runs.at[hit], runs.count[hit] + length - 1, docs_[runs.text[hit]])
                known, hit = hit[late], hit[~late]  # of the known ones names travel, to the bucket of the home's number
                bucket = ((runs.anchor[hit] >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((runs.anchor[hit], bucket))
                hit, bucket = hit[order], bucket[order]
                rows_ = [(own_bucket, *pack(*named(known), b""))] if len(known) else []
                for b, lo, hi in groups(bucket):
                    one = hit[lo:hi]
                    joined = b"".join([raw[a : a + c + length - 1] for a, c in zip(runs.at[one].tolist(), runs.count[one].tolist())])
                    rows_.append((b, *pack(*named(one), joined)))
                out.append(pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows_) if rows_ else [[]] * 6)], ["bucket", *names]))
        empty = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in names)])
        return pa.Table.from_batches(out, empty)

    def scan_bucket(table: pa.Table) -> pa.Table:
        d, v, s, c = later_windows(table, length)
        return pa.Table.from_batches([dealt([[d], [v], [s], [c]], home_of(d, v), d, ["doc", "version", "start", "count"], "home")])

    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        rows_ = []
        if texts.num_rows:
            d, v, s, c = (np.concatenate([unpack(x, kind) for x in found.column(n).to_pylist()] or [np.zeros(0, kind)]) for n, kind in (("doc", "<i8"), ("version", "<i8"), ("start", "<i8"), ("count", "<i8")))
            order = np.lexsort((v, d))
            d, v, s, c = d[order], v[order], s[order], c[order]
            for doc, version, text, no_id in zip(*texts_of(texts)):
                lo, hi = np.searchsorted(d, doc), np.searchsorted(d, doc, "right")
                own = slice(lo + np.searchsorted(v[lo:hi], version), lo + np.searchsorted(v[lo:hi], version, "right"))
                n, kept, spans, removed = len(text), text, "", 0
                if own.stop > own.start:
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, s[own], 1)
                    np.add.at(depth, np.minimum(s[own] + c[own] + length - 1, n), -1)
                    gone = np.cumsum(depth[:n]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    removed = int(gone.sum())
                    spans = ",".join(f"{a}:{b}" for a, b in zip(edges[::2], edges[1::2]))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                row = (None if no_id else doc, n, removed, spans.count(":"), hashlib.sha256(kept).hexdigest())
                rows_.append((*row, kept, spans) if keep_text else row)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())[: 7 if keep_text else 5]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows_) if rows_ else [[]] * len(kinds), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: len(kinds)])

    at_home = rows.withColumn("home", home).repartition("home")
    candidates = rows.mapInArrow(anchors, "bucket int, hash binary, doc binary, version binary, start binary").groupBy("bucket").applyInArrow(shared_anchors, "home int, doc binary, version binary, start binary")
    runs = at_home.groupBy("home").cogroup(candidates.groupBy("home")).applyInArrow(runs_of, "bucket int, doc binary, version binary, start binary, count binary, text binary")
    later = runs.groupBy("bucket").applyInArrow(scan_bucket, "home int, doc binary, version binary, start binary, count binary")
    again = at_home.toDF(*at_home.columns)
    more = ", kept binary, spans string" if keep_text else ""
    return again.groupBy("home").cogroup(later.groupBy("home")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more)
