"""N-gram Jaccard join: similar documents and their components, by a prefix-tree join of shingle sets.

1. Every text becomes a sorted set of 64-bit shingle hashes. Equal sets are one class from here on.
2. Candidates, exact: two sets within the threshold differ in at most D elements, D set by their sizes. The hash space is cut into more than D parts; at least one part
   holds the same elements of both. Parts are hashed and meet in buckets; sizes are cut into classes so that both sides use the same parts. What is shuffled is
   about 10 bytes a part, packed by task.
3. Sets that meet are compared in a prefix tree: sets in one global order of n-grams, common prefixes shared, all queries descending together with their
   overlaps so far, a subtree left as soon as the remaining lengths cannot reach the threshold.
   First every set is compared with the least of its partners (the least sets of its meetings). Where some partners of a set are not in its component after that, they are
   joined in full, in blocks of ``BLOCK`` sets, each block pair a task of its own. Before texts travel, sizes and parity sketches rule out pairs that surely miss the threshold.
4. Links, as spanning forests, become components by star contraction.

Defined cases: a null or empty text has no shingles and links with nothing; fewer words than n make one shingle; in ``similar`` rows that repeat an id are one document, linked
wherever one of its texts is (a row of it without words keeps the id as its component), and rows without an id have no component; in ``one_of_each`` every row is a document;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regmart.llm.common import Rolling, as_bytes, checkpointed, documents, mix, partitions, pieces, row_key, slices
from regmart.llm.graph import components, forest

#: Sets, and n-grams of them, compared in one task on either side.
BLOCK = 512
MASS = 1 << 20
FLUSH = 1 << 20
#: Partners of a set that one task compares with it, about.
PARTNERS = 256
#: Bytes of a part's signature within its bucket (a chance match is a candidate, no more), and of a set's name.
SIGNATURE, NAME = 5, 6
#: Bytes of text that a task packs at a time.
PACK_BYTES = 1 << 25

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text."""
    for part in slices(texts):
        raw = _LOWER[np.frombuffer(b" ".join([b"", *(texts[i] for i in part), b""]), np.uint8)]
        edges = np.diff(_SPACE[raw].astype(np.int8))
        starts, ends = np.flatnonzero(edges == -1) + 1, np.flatnonzero(edges == 1) + 1
        words = mix(Rolling(raw).spans(starts, ends)) if len(starts) else np.zeros(0, np.uint64)
        last = np.cumsum([len(texts[i]) + 1 for i in part])
        firsts = np.concatenate([[0], np.searchsorted(starts, last)])
        grams = words[: max(0, len(words) - n + 1)].copy()
        for j in range(1, n):
            grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j])
        for a, b in zip(firsts[:-1], firsts[1:]):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield np.array([int.from_bytes(hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest(), "little")], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def name_of(key: bytes) -> int:
    """The name by which sets meet: NAME bytes of the key. Sets that share a name are told apart again when their texts are fetched."""
    return int.from_bytes(key[:NAME], "little")


def odd_sketch(s: np.ndarray) -> bytes:
    """Bits, about as many as elements: a bit is set if an odd number of elements fall on it. Two sets differ in at least as many elements as their sketches in bits."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    odd = np.bincount((mix(s) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart_at_least(a: bytes, b: bytes) -> int:
    """Least number of elements in which the sets of two sketches differ; the longer sketch is folded to the shorter one's length."""
    if len(a) < len(b):
        a, b = b, a
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits >>= 1
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ y).bit_count()


def may_link(size_a: int, sketch_a: bytes, size_b: int, sketch_b: bytes, num: int, den: int) -> bool:
    """Whether sizes and sketches leave room for the threshold; sets that reach it always pass."""
    return num * max(size_a, size_b) <= den * min(size_a, size_b) and apart_at_least(sketch_a, sketch_b) * (den + num) <= (size_a + size_b) * (den - num)


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of numbers, byte by byte, compressed: the high bytes of sorted numbers all but vanish."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def from_planes(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()


@lru_cache(maxsize=64)
def size_classes(num: int, den: int, most: int = 1 << 32) -> np.ndarray:
    """Least sizes of the size classes: a set's partners lie in its class or a neighbouring one."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * den // num + 1)
    return np.array(out, np.int64)


def scheme(i: int, num: int, den: int) -> tuple[int, int]:
    """Parts for pairs whose smaller set is of size class i, and how many of them may be empty without being told."""
    x = int(size_classes(num, den)[i + 1]) - 1
    differ = (x + x * den // num) * (den - num) // (den + num)
    spare = 0 if differ == 0 else 1 + differ // 16
    return differ + 1 + spare, spare


def part_signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the parts of a set, under the scheme of its size class and that of the class below."""
    i = int(np.searchsorted(size_classes(num, den), len(s), "right")) - 1
    out = []
    for k in {i, max(0, i - 1)}:
        parts, spare = scheme(k, num, den)
        of = ((s >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.diff(of[order], prepend=-1))
        sums = np.add.reduceat(mix(s[order] ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
        present = of[order][starts]
        if parts - len(present) > spare:
            empty = np.setdiff1d(np.arange(parts), present)
            sums, present = np.concatenate([sums, np.zeros(len(empty), np.uint64)]), np.concatenate([present, empty])
        out.append(mix(sums + mix(present.astype(np.uint64) * np.uint64(64) + np.uint64(k) * np.uint64(1 << 40))))
    return np.concatenate(out)


def needed(x: np.ndarray | int, y: np.ndarray | int, num: int, den: int):
    """Least overlap of sets of sizes x and y within the threshold: den * o >= num * (x + y - o)."""
    return -(-num * (x + y) // (den + num))


def tree_join(queries: list[np.ndarray], sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, set) of all pairs within the threshold, by one descent of all queries through the prefix tree of the sets.

    The tree is implicit: sets as rows of n-gram numbers in lexical order, with the lengths of the prefixes that neighbours share.
    """
    grams, counts = np.unique(np.concatenate(sets), return_counts=True)
    rank = np.empty(len(grams), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(grams))
    rows = [np.sort(rank[np.searchsorted(grams, s)]) for s in sets]
    order = sorted(range(len(rows)), key=lambda i: rows[i].astype(">u4").tobytes())
    rows = [rows[i] for i in order]
    length = np.array([len(r) for r in rows])
    shared = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows)):
        m = min(length[i - 1], length[i])
        unequal = np.flatnonzero(rows[i - 1][:m] != rows[i][:m])
        shared[i] = unequal[0] if len(unequal) else m
    # Queries as postings: by n-gram number for the overlaps, by query for the n-grams that are left.
    size = np.array([len(q) for q in queries])
    flat, owner = np.concatenate(queries), np.repeat(np.arange(len(queries)), size)
    at = np.minimum(np.searchsorted(grams, flat), len(grams) - 1)
    known = grams[at] == flat
    number, owner, width = rank[at[known]], owner[known], len(grams) + 1
    by_number = np.argsort(number, kind="stable")
    posting, first = owner[by_number], np.searchsorted(number[by_number], np.arange(width))
    place = np.sort(owner * width + number)
    last = np.cumsum(np.bincount(owner, minlength=len(queries)))
    found_q, found_s = [], []
    stack = [(0, len(rows), 0, np.arange(len(queries)), np.zeros(len(queries), np.int64))]
    while stack:
        low, high, depth, active, overlap = stack.pop()
        end = int(length[low]) if high - low == 1 else int(min(shared[low + 1 : high].min(), length[low]))
        segment = rows[low][depth:end]
        if len(segment):
            counts = first[segment + 1] - first[segment]
            hits = posting[np.repeat(first[segment] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            overlap = overlap + np.bincount(hits, minlength=len(queries))[active]
        least, most = int(length[low:high].min()), int(length[low:high].max())
        after = last[active] - np.searchsorted(place, active * width + rows[low][end - 1] + 1) if end else size[active]
        ok = overlap + np.minimum(after, most - end) >= needed(size[active], least, num, den)
        active, overlap = active[ok], overlap[ok]
        if not len(active):
            continue
        k = low
        while k < high and length[k] == end:
            hit = active[overlap >= needed(size[active], end, num, den)]
            found_q.append(hit)
            found_s.append(np.full(len(hit), order[k]))
            k += 1
        if k < high:
            cuts = [k, *(k + 1 + np.flatnonzero(shared[k + 1 : high] <= end)), high]
            stack.extend((int(a), int(b), end, active, overlap) for a, b in zip(cuts[:-1], cuts[1:]))
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_q), np.concatenate(found_s)) if found_q else (none, none)


def _sets(column: pa.ChunkedArray, n: int) -> list[np.ndarray]:
    z = zstandard.ZstdDecompressor()
    return list(shingle_sets([z.decompress(x, max_output_size=1 << 31) for x in column.to_pylist()], n))


def _links(a: np.ndarray, b: np.ndarray) -> pa.Table:
    if len(a):
        a, b = forest(np.asarray(a, np.int64), np.asarray(b, np.int64))
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


ROWS = "doc_id long, text_hash long, row_hash long, n_shingles long, set_key binary, set_id long, sketch binary"


def shingle_rows(rows: DataFrame, n: int) -> DataFrame:
    """n_shingles, set_key (null for an empty set) and set_id (its name) of every row of doc_id, text_hash, row_hash and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3):
            sizes, keys, sketches = [], [], []
            for s in shingle_sets(as_bytes(batch.column(3)), n):
                sizes.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                sketches.append(odd_sketch(s) if len(s) else None)
            ids = [name_of(k) if k else None for k in keys]
            more = [pa.array(x, kind) for x, kind in ((sizes, pa.int64()), (keys, pa.binary()), (ids, pa.int64()), (sketches, pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *more], [c.split(" ")[0] for c in ROWS.split(", ")])

    return rows.select("doc_id", "text_hash", "row_hash", "text").mapInArrow(run, ROWS)


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """class_id, set_id and compressed text of the ``wanted`` rows (class_id, set_id, row_hash, text_hash), each once.

    Texts travel packed by task and bucket, rows alike only once a pack, so neither a frequent row nor a frequent id makes a large group.
    """
    buckets = partitions(rows, 2)
    bucket = F.pmod("row_hash", F.lit(buckets)).cast("int").alias("bucket")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], bytes] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys, texts = np.array(list(held), np.int64).reshape(-1, 2), list(held.values())
            to = np.mod(keys[:, 0], buckets)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
            z, out = zstandard.ZstdCompressor(level=1), []
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                own = order[a:b]
                out.append((int(to[own[0]]), keys[own].tobytes(), np.array([len(texts[i]) for i in own], "<i8").tobytes(), z.compress(b"".join([texts[i] for i in own]))))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, (pa.int32(), *[pa.binary()] * 3))], ["bucket", "keys", "sizes", "texts"])

        for batch in pieces(batches, 2):
            for row, text, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                if (row, text) not in held:
                    held[row, text] = raw
                    size += len(raw)
            if size >= PACK_BYTES:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    def fetch(packs: pa.Table, asked: pa.Table) -> pa.Table:
        to = {(r, t): (c, s) for r, t, c, s in zip(*(asked.column(x).to_pylist() for x in ("row_hash", "text_hash", "class_id", "set_id")))}
        z, out = zstandard.ZstdCompressor(level=3), []
        for keys, sizes, texts in zip(*(packs.column(x).to_pylist() for x in ("keys", "sizes", "texts"))) if to else ():
            keys, ends = np.frombuffer(keys, np.int64).reshape(-1, 2).tolist(), np.cumsum(np.frombuffer(sizes, "<i8")).tolist()
            raw = zstandard.ZstdDecompressor().decompress(texts, max_output_size=1 << 31)
            for (row, text), a, b in zip(keys, [0, *ends], ends):
                if (row, text) in to:
                    out.append((*to.pop((row, text)), z.compress(raw[a:b])))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.binary()))], names=["class_id", "set_id", "text"])

    packs = rows.select("row_hash", "text_hash", "text").mapInArrow(pack, "bucket int, keys binary, sizes binary, texts binary")
    return packs.groupBy("bucket").cogroup(wanted.select("class_id", "set_id", "row_hash", "text_hash", bucket).groupBy("bucket")).applyInArrow(fetch, "class_id long, set_id long, text binary")


def linked_by(pairs: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (class ids) among ``pairs`` (a, b, portion) of set ids: partners come to their lesser member, portion by portion."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return _links([], [])
        q, s = tree_join(_sets(left.column("own_text"), n), _sets(right.column("text"), n), num, den)
        return _links(left.column("class_id").to_numpy()[q], right.column("partner").to_numpy()[s])

    partner = sets.select(F.col("set_id").alias("b"), F.col("class_id").alias("partner"), "text")
    near = pairs.join(partner, "b").select("a", "portion", "partner", "text").toDF("a", "portion", "partner", "text")  # attributes of its own
    own = pairs.select("a", "portion").distinct().join(sets.select(F.col("set_id").alias("a"), "class_id", F.col("text").alias("own_text")), "a")
    keys = ("a", "portion")
    return own.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(compare, "a long, b long")


def sifted(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` without those that sizes and sketches rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [may_link(*row, num, den) for row in zip(*(batch.column(c).to_pylist() for c in ("size_a", "sketch_a", "size_b", "sketch_b")))]
            yield batch.select(["a", "b", "portion"]).filter(pa.array(fine, pa.bool_()))

    known = classes.select("set_id", "size", "sketch")
    own = pairs.select("a", "portion").distinct().join(known.toDF("a", "size_a", "sketch_a"), "a")
    both = pairs.join(own, ["a", "portion"]).join(known.toDF("b", "size_b", "sketch_b"), "b")
    return checkpointed(both.select("a", "b", "portion", "size_a", "sketch_a", "size_b", "sketch_b").mapInArrow(run, "a long, b long, portion int").distinct())


def apart(pairs: DataFrame, sets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Component of every class, and the pairs with their classes and whether these lie in different components. A set with many partners meets them portion by portion."""
    place = checkpointed(sets.select("set_id", "class_id").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select("set_id", "class_id", F.coalesce("component", "class_id").alias("component")))
    own = pairs.select("a", "portion").distinct().join(place.toDF("a", "class_a", "component_a"), "a")
    ends = pairs.join(own, ["a", "portion"]).join(place.toDF("b", "class_b", "component_b"), "b")
    return place, checkpointed(ends.select("a", "b", "portion", "class_a", "class_b", (F.col("component_a") != F.col("component_b")).alias("apart")))


def meetings(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Stars of the meetings: (a, b) for every set id b that meets a in a part, a being the least one there; ``portion`` splits the partners of a."""
    buckets = partitions(docs, 4)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            sig = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            own = np.repeat(np.array([o for o, _ in owners], np.int64), [c for _, c in owners]) if owners else np.zeros(0, np.int64)
            bucket = (sig >> np.uint64(40)) % np.uint64(buckets)
            order = np.lexsort((own, bucket))
            sig, own, bucket = sig[order], own[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
            ends = np.append(cuts[1:], len(sig))
            found = [(planes(sig[a:b], SIGNATURE), planes(own[a:b].astype(np.uint64), NAME)) for a, b in zip(cuts, ends)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), *(pa.array([x[i] for x in found], pa.binary()) for i in range(2))], ["bucket", "sigs", "owners"])

        for batch in pieces(batches, 0):
            for s in shingle_sets(as_bytes(batch.column(0)), n):
                if not len(s):
                    continue
                keys.append(part_signatures(s, num, den))
                owners.append((name_of(set_key(s)), len(keys[-1])))
                held += len(keys[-1])
                if held >= FLUSH:
                    yield flush()
                    keys, owners, held = [], [], 0
        yield flush()

    def meet(table: pa.Table) -> pa.Table:
        sig = np.concatenate([from_planes(x, SIGNATURE) for x in table.column("sigs").to_pylist()])
        own = np.concatenate([from_planes(x, NAME) for x in table.column("owners").to_pylist()]).astype(np.int64)
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        least = own[first][np.cumsum(first) - 1] if len(own) else own
        star = least != own
        pairs = np.unique(np.stack([least[star], own[star]]), axis=1)
        _, at, n = np.unique(pairs[0], return_inverse=True, return_counts=True)
        portion = mix(pairs[1].astype(np.uint64)) % (-(-n[at] // PARTNERS)).astype(np.uint64)
        return pa.table([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(portion.astype(np.int32))], names=["a", "b", "portion"])

    packed = docs.select("text").mapInArrow(parts, "bucket int, sigs binary, owners binary")
    return packed.groupBy("bucket").applyInArrow(meet, "a long, b long, portion int").groupBy("a", "b").agg(F.max("portion").alias("portion"))


def linked_sets(rows: DataFrame, n: int, num: int, den: int, one_document_per_id: bool) -> tuple[DataFrame, DataFrame]:
    """Every row (row, doc_id, text_hash, n_shingles, set_key) and, for every set_key, its component (a long; sets with the same one are linked).

    Sets are nodes, named by the least number of their rows, and stand for all rows that have them. With ``one_document_per_id``, sets that share an id are linked.
    """
    known = checkpointed(shingle_rows(rows, n).withColumn("row", F.monotonically_increasing_id()))  # numbers hold once they are in the shared folder
    of = F.min(F.struct("doc_id", "text_hash", "row_hash")).alias("of")
    classes = checkpointed(known.filter("set_key is not null").groupBy("set_key").agg(F.min("row").alias("class_id"), of, F.first("set_id").alias("set_id"), F.max("n_shingles").alias("size"), F.max("sketch").alias("sketch")))
    pairs = checkpointed(meetings(rows, n, num, den))
    wanted = classes.join(pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct(), "set_id", "left_semi")
    sets = checkpointed(texts_of(rows, wanted.select("class_id", "set_id", "of.row_hash", "of.text_hash")))

    # First every set is compared with the least of its partners.
    first = sifted(pairs.groupBy("b").agg(F.min(F.struct("a", "portion")).alias("least")).select("least.a", "b", "least.portion"), classes, num, den)
    labels = checkpointed(components(checkpointed(linked_by(first, sets, n, num, den))))

    # All sets that met in some part are partners of one set. Where partners of a set are not in one component with it, they may still be similar to it or to each other: such a
    # set and its partners are a gathering, which is compared in full, in blocks: by sizes and sketches first, then those of which the sketches leave room for a link.
    place, ends = apart(pairs, sets, labels)
    each = ends.select("class_a", "portion").distinct()
    centers = ends.filter("apart").select("class_a").distinct()
    met = ends.join(each.join(centers, "class_a"), ["class_a", "portion"], "left_semi").select(F.col("class_a").alias("gathering"), "portion", F.col("class_b").alias("class_id"))
    gathered = checkpointed(met.unionByName(centers.select(F.col("class_a").alias("gathering"), F.lit(-1).alias("portion"), F.col("class_a").alias("class_id"))))
    seen = place.select("class_id", "component").join(classes.select("class_id", "size", "sketch"), "class_id")

    def in_blocks(members: DataFrame, of: DataFrame, most: float) -> DataFrame:
        """A row for each block pair that a member of a gathering is in, with what ``of`` has of it."""
        rows_ = members.join(of, "class_id")
        blocks = rows_.groupBy("gathering").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / most)).cast("int").alias("blocks"))
        blocks = members.select("gathering", "portion").distinct().join(blocks, "gathering")
        mine = rows_.join(blocks, ["gathering", "portion"]).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
        split = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return split.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")

    def sift(table: pa.Table) -> pa.Table:
        rows_ = list(zip(*(table.column(c).to_pylist() for c in ("block", "size", "component", "sketch"))))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        one, two = ([k for k, r in enumerate(rows_) if r[0] == b] for b in (i, j))
        kept = set()
        for x in one:
            for y in two:
                p, q = rows_[x], rows_[y]
                if p[2] != q[2] and not (x in kept and y in kept) and may_link(p[1], p[3], q[1], q[3], num, den):
                    kept |= {x, y}
        return table.select(["gathering", "portion", "class_id"]).take(pa.array(sorted(kept), pa.int64()))

    left = checkpointed(in_blocks(gathered, seen, 64 * MASS).groupBy("gathering", "i", "j").applyInArrow(sift, "gathering long, portion int, class_id long").distinct())
    tasks = in_blocks(left, seen.drop("sketch"), MASS).drop("portion", "size")
    tasks = tasks.join(sets.select("class_id", "text"), "class_id")

    def join_block(table: pa.Table) -> pa.Table:
        ids, component, block = (table.column(c).to_numpy() for c in ("class_id", "component", "block"))
        grams = _sets(table.column("text"), n)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not (len(one) and len(two)):
            return _links([], [])
        q, s = tree_join([grams[k] for k in one], [grams[k] for k in two], num, den)
        q, s = one[q], two[s]
        cross = component[q] != component[s]
        return _links(ids[q][cross], ids[s][cross])

    # Stars of the first round stand for its links.
    more = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(checkpointed(tasks.groupBy("gathering", "i", "j").applyInArrow(join_block, "a long, b long")))
    if one_document_per_id:
        repeated = known.filter("doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).filter("x < y").select("doc_id")
        many = known.join(repeated, "doc_id").filter("set_key is not null").select("doc_id", "set_key").distinct().join(classes.select("set_key", "class_id"), "set_key")
        more = more.unionByName(many.join(many.groupBy("doc_id").agg(F.min("class_id").alias("b")), "doc_id").select(F.col("class_id").alias("a"), "b"))
    final = components(more)
    return known, classes.join(final.withColumnRenamed("node", "class_id"), "class_id", "left").select("set_key", F.coalesce("component", "class_id").alias("component"))


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, and hashes of the text and of both, which together name rows that are alike."""
    return documents(docs, id_col=id_col, text_col=text_col).withColumn("text_hash", F.xxhash64("text")).withColumn("row_hash", F.xxhash64("doc_id", "text", F.lit(0)))


def similar(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reached by links of Jaccard similarity num / den or more) of every document."""
    rows = hashed(docs, id_col, text_col)
    known, linked = linked_sets(rows.filter("doc_id is not null"), n, num, den, True)
    placed = known.join(linked, "set_key", "left").select("doc_id", "n_shingles", "set_key", "component")
    least = placed.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_set = linked.join(least, "component").select("set_key", "component_id")
    of_id = known.join(of_set, "set_key", "left")
    with_id = of_id.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    bare = shingle_rows(rows.filter("doc_id is null"), n).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return with_id.unionByName(bare)


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that are linked to another that stays: of each group of linked rows the one with the least
    doc_id (null last), then the least text hash. Rows of one id with texts of their own are rows of their own; of rows alike in id and text the one with the least hash of the whole row stays; rows without words all stay."""
    known, linked = linked_sets(hashed(docs), n, num, den, False)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    placed = known.join(linked, "set_key")
    least = placed.groupBy("component").agg(F.min(place).alias("least"))
    kept = least.select(F.col("least.doc_id").alias("_id"), F.col("least.text_hash").alias("_hash"))
    twice = known.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    wordless = known.filter("set_key is null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    marks = kept.withColumn("_words", F.lit(True)).unionByName(wordless.withColumn("_words", F.lit(False)))
    marks = marks.join(twice.withColumn("_twice", F.lit(True)), on=[marks["_id"].eqNullSafe(twice["_id"]), marks["_hash"] == twice["_hash"]], how="left").select(marks["_id"], marks["_hash"], "_words", F.coalesce("_twice", F.lit(False)).alias("_twice"))
    names = docs.columns
    own = docs.withColumn("_own_id", F.col("doc_id").cast("long")).withColumn("_own_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    stay = checkpointed(marks)
    met = lambda some: own.join(some, (F.col("_own_hash") == F.col("_hash")) & F.col("_own_id").eqNullSafe(F.col("_id")))
    once = met(stay.filter("not (_twice and _words)")).select(*names)
    one = F.min_by(F.struct(*(F.col(f"`{c}`") for c in names)), F.struct(*(F.xxhash64(F.lit(i), row_key(docs)) for i in range(2)))).alias("_row")
    return once.unionByName(met(stay.filter("_twice and _words")).groupBy("_own_id", "_own_hash").agg(one).select("_row.*"))
