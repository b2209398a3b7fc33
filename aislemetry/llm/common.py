"""Shared helpers: table access and vectorised word views over Arrow text.

Words everywhere are runs of bytes other than space, tab, newline, vertical tab, form feed and carriage return.
A null text counts as the empty text.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislemetry.session import cut

SLICE_BYTES = 1 << 20       # text handled by one vectorised pass; a longer text is a slice of its own
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sampled(rows: DataFrame, key, size: int) -> DataFrame:
    """At most `size` rows, picked by a hash of `key`; all of them where there are no more."""
    n = rows.count()
    share = min(1.0, size / max(n, 1))
    picked = rows if share == 1.0 else rows.where(
        F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000))
    return picked.limit(size)


def gathered(rows: DataFrame, per_task: int) -> DataFrame:
    """`rows` in reliable storage, read by one task per `per_task` rows, so small tables make few shuffle files."""
    kept = cut(rows)
    return kept.coalesce(-(-kept.count() // per_task) or 1)


def field_name(df: DataFrame, wanted: str) -> str:
    """A column name that `df` does not have yet."""
    while wanted.lower() in {c.lower() for c in df.columns}:
        wanted = "_" + wanted
    return wanted


# ---------------------------------------------------------------- Arrow slices

def texts(column: pa.Array) -> pa.Array:
    """Text column with nulls as empty texts, 64-bit offsets."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string array without nulls, and len + 1 offsets into them."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column="text", limit=SLICE_BYTES):
    """(first row, bytes, offsets) of consecutive row groups with at most `limit` bytes, one row at least."""
    data, offsets = buffers(texts(batch.column(column)))
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


# ---------------------------------------------------------------- hashing

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        steps = np.full(n, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
        steps[1:] = _INVERSE
        _inverses = np.multiply.accumulate(steps)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(salt & _MASK))


def segment_hashes(data: np.ndarray, starts: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
    """Hash of the kept bytes from each start up to the next one; the same bytes give the same hash anywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverses = _grown(len(data))
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)]
    if kept is not None:
        terms[~kept] = 0
    return mix(np.add.reduceat(terms, starts) * inverses[starts])


def per_row(counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a value per byte for each row."""
    total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class Words:
    """Words of a slice: first byte, end, row and hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, blank=SPACE):
        inside = ~blank[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[heads] = inside[heads]
        self.inside = inside
        self.start = np.flatnonzero(first)
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.rows = len(offsets) - 1
        self.count = np.bincount(self.row, minlength=self.rows)
        self.hash = segment_hashes(data, self.start, inside)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words inside one row."""
        n = len(self.start)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:n - k + 1] == self.row[k - 1:])
        total = np.zeros(len(at), np.uint64)
        for j, factor in enumerate(seeds(k, 5)):
            total += self.hash[at + j] * (factor | np.uint64(1))
        return at, mix(total)


# ---------------------------------------------------------------- Spark side

def crc_rest(doc_id, base: int):
    """crc32 of the id as text, modulo `base`; what splits learning rows from held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(base)

