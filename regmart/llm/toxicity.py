"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text.

Folding: compatibility forms, letters of other scripts that look like Latin ones, digits and signs that stand for letters before a letter, marks and invisible characters; what is no
letter parts words. A word with accents is matched without them too. Lexicon entries are beginnings of words, of ``SHORTEST`` to ``LONGEST`` letters; an entry's weight is its log-odds
of documents of label 1 against label 0, less its standard error. At a word only the heaviest entry counts. Exception phrases, words or word pairs that hold an entry and are
commoner in documents of label 0, cancel the matches that they cover. The sum of weights, divided by a power of the text's length, goes through a logistic function.

The lexicon is learned from a sample of the labelled rows: ids chosen by hash, about ``SAMPLE_BAD`` of label 1 and ``SAMPLE_FINE`` of label 0; of their entries the ``ENTRIES`` heaviest
and of the exceptions the ``EXCEPTIONS`` commonest make the model, so what is broadcast has a fixed bound. Counting and matching run in tasks. The least weight, the power and the
logistic function are fitted on halves of the sample, each scored with the lexicon of the other half. A text never travels for the model: the ids of the sample go to the scan. Scoring is one scan.

Defined cases: null and empty texts have no words and the score of a text without matches; labels other than 0 and 1, labels without an id and labels that meet no document teach
nothing; an id that is labelled twice has the label given more often (1 where both are as frequent); equal rows of one id teach once; without labels of both classes every score is the share of label 1 (0.5 if none);
repeated rows and null ids are scored row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regmart.llm.common import checkpointed, crc_of_id, documents, partitions, pieces, session
from regmart.llm.quality import SCORES, calibrate

SAMPLE_BAD, SAMPLE_FINE = 3000, 6000
ENTRIES, EXCEPTIONS = 50_000, 20_000
SHORTEST, LONGEST = 3, 12
SMOOTHING = 0.5
LEAST_WEIGHTS, POWERS = (2.0, 2.5, 3.0, 3.5, 4.0), (0.1, 0.25, 0.5)
THRESHOLD = 0.7

# Letters of other scripts and the Latin letters that they look like.
CYRILLIC, CYRILLIC_AS = "авеіјкмнорстухѕԁԛԝһ", "abeijkmhopctyxsdqwh"
GREEK, GREEK_AS = "αεικνορτυχ", "aeikvoptux"
OTHER, OTHER_AS = "ıɑɡ", "iag"
# Digits and signs, and the letters that they stand for.
SIGNS, SIGNS_AS = "013457@$!|€", "oieastasile"

_LOOKS = dict(zip(map(ord, CYRILLIC + GREEK + OTHER), CYRILLIC_AS + GREEK_AS + OTHER_AS))
_SIGN = dict(zip(map(ord, SIGNS), SIGNS_AS))
#: A run of signs that a letter follows.
_RUN = re.compile(rf"(?<![{re.escape(SIGNS)}])[{re.escape(SIGNS)}]+(?=[^\W\d_])")


class _Letters(dict):
    """What a character becomes: a letter, nothing (marks, invisible characters), or a blank."""

    def __missing__(self, c: int) -> str:
        kind = unicodedata.category(chr(c))
        self[c] = out = _LOOKS.get(c) or (chr(c) if kind[0] == "L" else "" if kind in ("Mn", "Me", "Cf") else " ")
        return out


class _Bare(dict):
    """A letter without its accents, one for one."""

    def __missing__(self, c: int) -> str:
        base = unicodedata.normalize("NFD", chr(c))[0]
        self[c] = out = _LOOKS.get(ord(base), base)
        return out


_LETTERS, _BARE = _Letters(), _Bare()


def fold(text: str) -> str:
    """The text's words, a blank before each and behind the last."""
    text = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    if not text.isascii():
        text = "".join(_LOOKS.get(ord(c), c) if c > "\x7f" else c for c in text)
    text = _RUN.sub(lambda m: m.group().translate(_SIGN), text)
    return f" {' '.join(text.translate(_LETTERS).split())} "


def forms(text: str) -> list[str]:
    """The folded text, and without accents if it has some; positions in both are the same."""
    folded = fold(text)
    bare = folded if folded.isascii() else folded.translate(_BARE)
    return [folded] if bare == folded else [folded, bare]


def beginnings(text: str) -> set[str]:
    """Beginnings of the words of a text, in all its forms."""
    words = {w[:LONGEST] for form in forms(text) for w in form.split()}
    return {w[:n] for w in words for n in range(SHORTEST, len(w) + 1)}


@dataclass
class Lexicon:
    """Entries with weights and exception phrases (words with a blank before, between and behind)."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(f" {entry}", (weight, len(entry) + 1))
        for phrase in self.exceptions:
            if phrase not in found:  # a phrase ends in a blank, an entry never does
                found.add_word(phrase, (None, len(phrase)))
        found.make_automaton()
        return found if len(found) else None

    def without_shadowed(self) -> Lexicon:
        """Entries that outweigh all their own beginnings: the others never count."""
        kept: dict[str, float] = {}
        for entry in sorted(self.weights, key=len):
            if all(self.weights.get(entry[:n], -np.inf) < self.weights[entry] for n in range(SHORTEST, len(entry))):
                kept[entry] = self.weights[entry]
        return Lexicon(kept, self.exceptions)


def matches(automaton, text_forms: list[str]) -> list[tuple[int, float]]:
    """Positions and weights of the heaviest entry at each word that no exception phrase covers."""
    hits: dict[int, tuple[float, int]] = {}
    cover: list[tuple[int, int]] = []
    for form in text_forms:
        for end, (weight, size) in automaton.iter(form):
            start = end - size + 1
            if weight is None:
                cover.append((start, end))
            elif start not in hits or hits[start][0] < weight:
                hits[start] = (weight, end)
    if not cover:
        return [(start, weight) for start, (weight, _) in hits.items()]
    cover.sort()
    out, i, reach = [], 0, -1
    for start in sorted(hits):
        while i < len(cover) and cover[i][0] <= start:
            reach = max(reach, cover[i][1])
            i += 1
        if reach < hits[start][1]:
            out.append((start, hits[start][0]))
    return out


@dataclass
class Model:
    """score = logistic(scale * sum of weights / (words + 1) ** power + shift)."""

    lexicon: Lexicon
    power: float
    scale: float
    shift: float

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "built"}

    def score(self, text: str) -> float:
        if not hasattr(self, "built"):
            self.built = self.lexicon.automaton()
        x = 0.0
        if self.built is not None and text:
            both = forms(text)
            if found := matches(self.built, both):
                x = sum(w for _, w in found) / (both[0].count(" ")) ** self.power
        return float(1 / (1 + np.exp(-np.clip(self.scale * x + self.shift, -40, 40))))


def sampled(docs: DataFrame, labels: DataFrame, label_col: str, most_bad: int, most_fine: int) -> DataFrame:
    """text, bad and half (0 or 1) of the rows to learn from."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.sum(2 * F.col(label_col) - 1) >= 0).alias("bad"))
    most = {True: most_bad, False: most_fine}

    def share(counts: dict[bool, int], times: int):
        limits = {k: int((1 << 20) * min(1.0, times * most[k] / max(1, counts.get(k, 0)))) for k in most}
        return F.when(F.col("bad"), limits[True]).otherwise(limits[False])

    counts = lambda df: {r.bad: r["count"] for r in df.groupBy("bad").count().collect()}  # noqa: E731 - two rows
    few = F.broadcast(checkpointed(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share(counts(known), 1))))  # about SAMPLE_BAD + SAMPLE_FINE rows
    # An id may have many texts: a scan of ids alone tells how many rows the sample would have.
    rows = counts(docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(few, "doc_id"))
    found = documents(docs).join(few, "doc_id").filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(1 << 20)) < share(rows, 2))
    dealt = found.distinct().repartition(partitions(docs, 2), F.xxhash64("doc_id", "text"))  # work for all tasks, small as the sample is
    return checkpointed(dealt.select("text", "bad", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")))


def counted(sample: DataFrame, terms) -> DataFrame:
    """term, and documents by label and half: bad0, bad1, fine0, fine1. ``terms`` gives the distinct terms of a text; counts of a task are added up before they leave it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(4)]

        def flush() -> pa.RecordBatch:
            all_terms = sorted(set().union(*counts))
            columns = [pa.array(all_terms, pa.string()), *(pa.array([c[t] for t in all_terms], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["term", "bad0", "bad1", "fine0", "fine1"])

        for batch in pieces(batches, 0):
            for text, bad, half in zip(*(c.to_pylist() for c in batch.columns)):
                counts[half if bad else 2 + half].update(terms(text))
            if sum(map(len, counts)) > 1_000_000:
                yield flush()
        yield flush()

    found = sample.select("text", "bad", "half").mapInArrow(run, "term string, bad0 long, bad1 long, fine0 long, fine1 long")
    return found.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("bad0", "bad1", "fine0", "fine1")))


def lexicons(sample: DataFrame, sizes: dict[tuple[bool, int], int], entries: int) -> list[Lexicon]:
    """Lexicons of half 0, of half 1 and of the whole sample."""
    least = min(LEAST_WEIGHTS)
    of = lambda label, halves: sum(sizes.get((label, h), 0) for h in halves)
    counts = checkpointed(counted(sample, beginnings).filter("bad0 + bad1 >= 2"))
    out = []
    for halves in ((0,), (1,), (0, 1)):
        b, f = (sum(F.col(f"{name}{h}") for h in halves) + SMOOTHING for name in ("bad", "fine"))
        weight = F.log(b / (of(True, halves) + 2 * SMOOTHING)) - F.log(f / (of(False, halves) + 2 * SMOOTHING)) - F.sqrt(1 / b + 1 / f)
        rows = counts.select("term", weight.alias("weight")).filter(F.col("weight") >= least).orderBy(F.col("weight").desc(), "term").limit(entries).collect()  # ENTRIES rows
        out.append(Lexicon({r.term: r.weight for r in rows}).without_shadowed())
    return out


def phrases(lexicon: Lexicon):
    """Function from a text to the words and word pairs of it that hold an entry."""
    built: list = []

    def find(text: str) -> set[str]:
        if not built:
            built.append(lexicon.automaton())
        out: set[str] = set()
        both = forms(text)
        for start, _ in matches(built[0], both) if built[0] else ():
            for form in both:
                end = form.index(" ", start + 1)
                out.add(form[start : end + 1])
                if start:
                    out.add(form[form.rindex(" ", 0, start) : end + 1])
                if end + 1 < len(form):
                    out.add(form[start : form.index(" ", end + 1) + 1])
        return out

    return find


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_bad: int = SAMPLE_BAD, sample_fine: int = SAMPLE_FINE, entries: int = ENTRIES, exceptions: int = EXCEPTIONS) -> Model:
    """Fits on a sample of ``docs`` joined to ``labels`` by doc_id; give it training labels only."""
    sample = sampled(docs, labels, label_col, sample_bad, sample_fine)
    sizes = {(r.bad, r.half): r["count"] for r in sample.groupBy("bad", "half").count().collect()}
    n_bad, n_fine = (sum(n for (bad, _), n in sizes.items() if bad == label) for label in (True, False))
    if not (n_bad and n_fine):
        share = n_bad / (n_bad + n_fine) if n_bad + n_fine else 0.5
        return Model(Lexicon({}), 0.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    halves = lexicons(sample, sizes, entries)
    # Sums of weights over each least weight, of every row by the lexicon of the other half.
    shared = session(docs).sparkContext.broadcast(halves)

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = [x.automaton() for x in shared.value[:2]]
        for batch in pieces(batches, 0):
            rows = []
            for text, bad, half in zip(*(c.to_pylist() for c in batch.columns)):
                both, other = forms(text), built[1 - half]
                found = np.array([w for _, w in matches(other, both)] if other else [])
                rows.append((bad, both[0].count(" "), [float(found[found >= least].sum()) for least in LEAST_WEIGHTS]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.bool_(), pa.int64(), pa.list_(pa.float64())))], ["bad", "n", "sums"])

    rows = sample.select("text", "bad", "half").mapInArrow(crossed, "bad boolean, n long, sums array<double>").collect()  # the sample's rows, a few numbers each
    y = np.array([1.0 if r.bad else -1.0 for r in rows])
    n, sums = np.array([r.n for r in rows], np.float64), np.array([r.sums for r in rows])
    fits = []
    for i, least in enumerate(LEAST_WEIGHTS):
        for power in POWERS:
            x = sums[:, i] / n**power
            scale, shift = calibrate(x, y)
            loss = np.log1p(np.exp(-np.clip(y * (scale * x + shift), -40, 40))).mean()
            fits.append((loss, least, power, scale, shift))
    _, least, power, scale, shift = min(fits)
    lexicon = Lexicon({t: w for t, w in halves[2].weights.items() if w >= least})
    told = counted(sample, phrases(lexicon)).select("term", (F.col("bad0") + F.col("bad1")).alias("bad"), (F.col("fine0") + F.col("fine1")).alias("fine")).filter("fine >= 3")
    rarer = (F.col("bad") + SMOOTHING) / (n_bad + 1) < (F.col("fine") + SMOOTHING) / (n_fine + 1)
    lexicon.exceptions = {r.term for r in told.filter(rarer).orderBy(F.col("fine").desc(), "term").limit(exceptions).collect()}
    return Model(lexicon, power, scale, shift)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score of label 1 and the prediction at ``threshold`` for every document."""
    shared = session(docs).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches, 1):
            scores = np.array([m.score(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return documents(docs).mapInArrow(run, SCORES)


def train_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labels whose CRC-32 of doc_id leaves no 1 on division by 3, and scores all: doc_id, held_out, score, predicted."""
    model = train(docs, labels.filter(crc_of_id() % 3 != 1))
    return score(docs, model).select("doc_id", F.coalesce(crc_of_id() % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")
