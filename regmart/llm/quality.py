"""Quality classifier: naive Bayes support vectors.

Indicators of words, word pairs, word shapes and shape pairs are hashed to ``BUCKETS`` columns. Class counts give log-count ratios
r = log((p / |p|) / (q / |q|)); the indicators scaled by r feed a linear hinge-loss model fitted by dual coordinate descent.
Both are learned from a sample of the labelled rows: ids chosen by hash, about ``SAMPLE_ROWS`` of them and at most ``SAMPLE_COLUMNS`` indicators, so what
is broadcast (ids, model) and what the driver holds have a fixed bound at every size. A text never travels: the ids of the sample go to the
scan of the documents. Scoring is one scan without a shuffle.

Defined cases: an empty or null text has one indicator of its own; null labels, labels without an id and labels that meet no document teach nothing; an id that is labelled
twice has the label given more often (1 where both are as frequent); equal rows of one id teach once; without labels of both classes every score is the share of
label 1 (0.5 if none); repeated rows and null ids are scored row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regmart.llm.common import checkpointed, crc_of_id, documents, mix, session

BUCKETS = 1 << 20
SMOOTHING = 1.0
#: Labelled rows, and their indicators, that the model learns from at most.
SAMPLE_ROWS, SAMPLE_COLUMNS = 6000, 1 << 24
COST, PASSES = 1.0, 12
THRESHOLD = 0.3

_SHAPE = {c: "0" for c in range(0x30, 0x3A)} | {c: "a" for c in range(0x61, 0x7B)} | {c: "A" for c in range(0x41, 0x5B)}


class _Shapes(dict):
    def __missing__(self, c: int) -> str:
        x = chr(c)
        self[c] = out = "A" if x.isupper() else "a" if x.isalpha() else "0" if x.isnumeric() else x if c < 0x80 or x.isspace() else "?"
        return out


_TABLE = _Shapes(_SHAPE)
_RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Classes of the word's characters, runs as one."""
    return _RUN.sub(r"\1", word.translate(_TABLE))


def _crc(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace"))


class _Words(dict):
    """Word -> hashes of its lower-cased form and of its shape (doubled, plus one for a plain word), in one number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        s = shape(word)
        out = _crc("w" + word.lower()) << 32 | (_crc("s" + s) >> 1) << 1 | (s in ("a", "Aa", "A"))
        if len(word) <= 64:
            self[word] = out
        return out


_WORDS = _Words()


def indicators(text: str) -> np.ndarray:
    """Sorted distinct columns of a text's n-gram indicators."""
    words = text.split()
    if not words:
        return np.array([_crc("empty") % BUCKETS], np.int32)
    both = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    word, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    plain = int((form & np.uint64(1)).sum())
    pairs = mix(word[:-1] << np.uint64(32) | word[1:])
    forms = mix(form[:-1] << np.uint64(32) | form[1:])
    lines = [x for x in text.split("\n") if x]
    ratios = (f"d{8 * len(np.unique(pairs)) // max(1, len(pairs))}", f"l{4 * len(set(lines)) // len(lines)}", f"p{8 * plain // len(words)}")
    found = np.concatenate([mix(word), mix(form + np.uint64(1 << 40)), pairs, forms, np.array([_crc(x) for x in ratios], np.uint64)])
    return np.unique((found % np.uint64(BUCKETS)).astype(np.int32))


@dataclass(frozen=True)
class Model:
    """``weights`` already hold the ratios; score = logistic(scale * margin + shift)."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def score(self, columns: np.ndarray) -> float:
        margin = (float(self.weights[columns].sum()) / max(1.0, np.sqrt(len(columns)))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -40, 40))))


def ratios(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Log-count ratio of every column."""
    p, q = pos + SMOOTHING, neg + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = COST, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1-loss linear support vector machine; rows are unit-scaled r times indicators."""
    w, bias = np.zeros(len(r)), 0.0
    values = [r[c] / max(1.0, np.sqrt(len(c))) for c in rows]
    norms = np.array([float(v @ v) + 1.0 for v in values])
    share = np.array([1 / max(1e-9, (y == k).mean()) for k in (-1, 1)])
    upper = cost * np.where(y > 0, share[1], share[0]) / 2
    alpha, order = np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            c, v = rows[i], values[i]
            slope = y[i] * (float(w[c] @ v) + bias) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), upper[i])
            if step := (new - alpha[i]) * y[i]:
                w[c] += step * v
                bias += step
                alpha[i] = new
    return w * r, bias


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic scale and shift of margins, by a few Newton steps with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = np.array([((p - t) * margins).sum() + 1e-3 * a, (p - t).sum()])
        h = p * (1 - p)
        m = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def sampled(docs: DataFrame, labels: DataFrame, label_col: str, sample_rows: int, sample_columns: int) -> list[tuple[np.ndarray, bool]]:
    """Indicators and labels of the sample, in a fixed order."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.sum(2 * F.col(label_col) - 1) >= 0).alias("good"))
    share = lambda n, most: int((1 << 20) * min(1.0, most / max(1, n)))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    few = checkpointed(known.filter(chance < share(known.count(), sample_rows)))
    ids = F.broadcast(few)  # about SAMPLE_ROWS rows of 9 bytes
    # An id may have many texts: a scan of ids alone tells how many rows the sample would have.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(ids, "doc_id").count()
    by_text = F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(1 << 20))
    found = documents(docs).join(ids, "doc_id").filter(by_text < share(rows, 2 * sample_rows)).select("doc_id", "text", "good")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, good in zip(*(c.to_pylist() for c in batch.columns)):
                columns = indicators(text)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([good]), pa.array([len(columns)], pa.int64()), pa.array([columns.astype("<i4").tobytes()], pa.binary())], ["doc_id", "good", "n", "columns"])

    taught = checkpointed(found.mapInArrow(extract, "doc_id long, good boolean, n long, columns binary").distinct())
    total = taught.agg(F.sum("n")).first()[0] or 0
    kept = taught.filter(F.pmod(F.xxhash64("columns"), F.lit(1 << 20)) < share(total, sample_columns)).collect()
    return [(np.frombuffer(r.columns, "<i4").astype(np.int64), r.good) for r in sorted(kept, key=lambda r: (r.doc_id, r.columns))]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_columns: int = SAMPLE_COLUMNS) -> Model:
    """Fits on a sample of ``docs`` joined to ``labels`` by doc_id; give it training labels only."""
    sample = sampled(docs, labels, label_col, sample_rows, sample_columns)
    found, y = [c for c, _ in sample], np.array([1.0 if good else -1.0 for _, good in sample])
    n_pos, n_neg = int((y > 0).sum()), int((y < 0).sum())
    if not (n_pos and n_neg):
        share = n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.5
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    pos, neg = (np.bincount(np.concatenate([c for c, k in zip(found, y) if k == sign]), minlength=BUCKETS) for sign in (1, -1))
    r = ratios(pos, neg)
    w, bias = descend(found, y, r)
    plain = Model(w.astype(np.float32), bias, 1.0, 0.0)
    margins = np.array([float(plain.weights[c].sum()) / max(1.0, np.sqrt(len(c))) + bias for c in found])
    scale, shift = calibrate(margins, y)
    return Model(plain.weights, bias, scale, shift)


SCORES = "doc_id long, score double, predicted int"


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score of label 1 and the prediction at ``threshold`` for every document."""
    shared = session(docs).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = np.array([m.score(indicators(t)) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return documents(docs).mapInArrow(run, SCORES)


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, all columns as they are; the texts are scored where they lie."""
    shared = session(docs).sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(indicators(t or "")) for t in column.to_pylist()], pa.float64())

    return docs.filter(scored(F.col(text_col).cast("string")) >= threshold)


def train_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labels whose CRC-32 of doc_id is not a multiple of 5 and scores all: doc_id, held_out, score, predicted."""
    model = train(docs, labels.filter(crc_of_id() % 5 != 0))
    return score(docs, model).select("doc_id", F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
