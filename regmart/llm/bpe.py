"""Byte-level BPE: encode and decode with a public tokenizer file.

Each short word is merged over a contiguous array of part boundaries and the ranks of adjacent parts: the least
rank is found by a scan, its boundary deleted, and only the two neighbouring ranks are looked up again. Words
beyond ``SCAN_BYTES`` use a heap over the same ranks, for a scan would be quadratic there. The vocabulary is of fixed
size and is broadcast; texts never leave their partition, so there is no shuffle.

Defined cases: a null or empty text has no tokens; a special token's string in a text is that token, as the
tokenizers library has it; repeated rows and null ids are encoded row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from regmart.llm.common import documents, pieces, session

SCAN_BYTES = 256
#: Words whose ids a task keeps at hand; beyond it the table starts afresh.
CACHED_WORDS = 300_000
#: Fixed value: the word pattern of this family of byte-level vocabularies.
WORD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same pattern for texts of these characters only, in the standard library's faster matcher; any other text takes the general one.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
UNUSUAL = re.compile(rf"[^\t\n\r\x20-\x7e{LETTERS}]").search
COMMON_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+").findall


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """``ranks``: left id << 20 | right id -> rank; ``merged``: rank -> id; ``token_bytes``: id -> bytes; ``special``: string -> id."""

    byte_ids: list[int]
    ranks: dict[int, int]
    merged: list[int]
    token_bytes: dict[int, bytes]
    special: dict[str, int]


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, ids = byte_letters(), spec["model"]["vocab"]
    token_bytes = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
    ranks, merged = {}, []
    for rank, merge in enumerate(spec["model"]["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        ranks.setdefault(ids[a] << 20 | ids[b], rank)
        merged.append(ids[a + b])
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    token_bytes |= {i: t.encode() for t, i in special.items()}
    by_byte = {b: ids[c] for c, b in letters.items()}
    return Vocabulary([by_byte[b] for b in range(256)], ranks, merged, token_bytes, special)


class Encoder(dict):
    """Maps a word to its ids; misses are merged and kept."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.any_words = regex.compile(WORD).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def words(self, text: str) -> list[str]:
        return self.any_words(text) if UNUSUAL(text) else COMMON_WORDS(text)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if word in self.v.special:
            return (self.v.special[word],)
        if len(self) >= CACHED_WORDS:
            self.clear()
        raw = word.encode()
        ids = self.merge_short(raw) if len(raw) <= SCAN_BYTES else self.merge_long(raw)
        if len(raw) <= SCAN_BYTES:
            self[word] = ids
        return ids

    def merge_short(self, raw: bytes) -> tuple[int, ...]:
        """Parts and the ranks between neighbours stay contiguous; one scan finds the least rank."""
        rank, merged, byte_ids, none = self.v.ranks.get, self.v.merged, self.v.byte_ids, 1 << 60
        parts = [byte_ids[b] for b in raw]
        ranks = [rank(a << 20 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != none:
            i = ranks.index(least)
            parts[i] = new = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 20 | new, none)
            if i < len(ranks):
                ranks[i] = rank(new << 20 | parts[i + 1], none)
        return tuple(parts)

    def merge_long(self, raw: bytes) -> tuple[int, ...]:
        """The same merges, least rank and then leftmost first, from a heap over linked parts."""
        ranks = self.v.ranks
        parts: list[int | None] = [self.v.byte_ids[b] for b in raw]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(a << 20 | b for a, b in zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            least, i, pair = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] << 20 | parts[j] != pair:
                continue
            parts[i], parts[j] = self.v.merged[least], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (p := parts[a] << 20 | parts[b]) in ranks:
                    heapq.heappush(heap, (ranks[p], a, p))
        return tuple(p for p in parts if p is not None)

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens, in order."""
        if self.special is None or not any(s in text for s in self.v.special):
            return self.words(text)
        return list(chain.from_iterable([p] if p in self.v.special else self.words(p) for p in self.special.split(text)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text))))

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes of the tokens, joined; what is not UTF-8 becomes U+FFFD."""
        return b"".join(map(self.v.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class Printed(dict):
    """Maps a word to its ids as text, the bytes they decode to, and its ids packed: a text then needs one look-up a word."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> tuple[str, bytes, bytes]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self.encoder.__missing__(word)
        self.encoder.clear()
        out = ",".join(map(str, ids)), b"".join(map(self.encoder.v.token_bytes.__getitem__, ids)), array("i", ids).tobytes()
        if len(word) <= SCAN_BYTES:
            self[word] = out
        return out

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        found = list(map(self.__getitem__, self.encoder.pieces(text)))
        ids, raw = ",".join([x[0] for x in found]), b"".join([x[1] for x in found])
        return ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest()

    def packed(self, text: str) -> tuple[np.ndarray, str]:
        """The ids of a text, and the text they decode to."""
        found = list(map(self.__getitem__, self.encoder.pieces(text)))
        return np.frombuffer(b"".join([x[2] for x in found]), np.int32), b"".join([x[1] for x in found]).decode("utf-8", "replace")


ENCODED = "doc_id long, token_ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _run(docs: DataFrame, path: str, schema: str, digest: bool) -> DataFrame:
    shared = session(docs).sparkContext.broadcast(load(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        printed = Printed(encoder)
        for batch in pieces(batches, 1):
            texts = batch.column(1).to_pylist()
            if digest:
                columns = zip(*map(printed.digest, texts)) if texts else [[]] * 3
                arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()))]
            else:
                found = [printed.packed(t) for t in texts]
                offsets = np.cumsum([0, *(len(ids) for ids, _ in found)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int32), *(ids for ids, _ in found)])
                arrays = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([t for _, t in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [c.split(" ")[0] for c in schema.split(", ")])

    return documents(docs).mapInArrow(encode, schema)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, token_ids and the text decoded from them, for every whole text."""
    return _run(docs, path, ENCODED, digest=False)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded text; the ids themselves stay in the tasks."""
    return _run(docs, path, DIGESTS, digest=True)
