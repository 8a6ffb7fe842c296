"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One step of work inside a task looks at about so many bytes of text at a time, so memory does not follow the batch.
SLICE_BYTES = 1 << 21


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``. Only a session on one machine (tests) may leave it unset: it gets a temporary one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage through the shared folder."""
    shared_folder(session(df))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns an operator needs, under fixed names: other columns cannot clash with those it makes. A null text is empty."""
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    return docs.select(*cols, *(F.col(c) for c in more))


def partitions(df: DataFrame, times: int = 1) -> int:
    """Shuffle partitions as the session sizes them, a few times as many for memory-hungry groups."""
    return max(8, int(session(df).conf.get("spark.sql.shuffle.partitions"))) * times


def as_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[range]:
    """Runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield range(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield range(start, len(texts))


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut, without copies, into slices of about ``most`` bytes in column ``text``, so that what Python holds does not follow the batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, "right")))
            yield batch.slice(low, high - low)
            low = high


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Rolling:
    """Hashes of any spans of a byte string from one prefix sum: sum of (byte + 1) * base ** i modulo 2 ** 64."""

    _power: np.ndarray | None = None
    _inverse: np.ndarray | None = None

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if Rolling._power is None or len(Rolling._power) < n:
            size = max(n, SLICE_BYTES + 1)
            for name, base in (("_power", int(_ODD)), ("_inverse", pow(int(_ODD), -1, 1 << 64))):
                with np.errstate(over="ignore"):
                    setattr(Rolling, name, np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))]))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Rolling._power[: n - 1], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * Rolling._inverse[starts]

    def windows(self, k: int) -> np.ndarray:
        m = len(self.sums) - k
        return (self.sums[k:] - self.sums[:m]) * Rolling._inverse[:m] if m > 0 else np.zeros(0, np.uint64)


def crc_of_id(id_col: str = "doc_id") -> Column:
    """CRC-32 of the id's decimal text."""
    return F.crc32(F.col(id_col).cast("string"))


def row_key(docs: DataFrame) -> Column:
    """Hash of a whole row, all columns of ``docs``."""
    return F.xxhash64(*(F.coalesce(F.to_json(c) if t.startswith(("map", "array", "struct")) else F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c, t in docs.dtypes))
