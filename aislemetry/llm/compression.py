"""Quality rules by compression bands.

zstandard ratios (compressed bytes / bytes) are taken of the whole document and of each fixed chunk. Repetitive text
compresses far below what prose of its length does, noise far above; both limits depend on the length, since short
texts carry the frame overhead and long ones profit from a longer window. Chunks are taken from two of them upwards and
judged by the limits of their own length, so a part of noise cannot hide behind the ratio of the whole text.

Defined results: a null or empty text has no words, ratio null and is not kept; equal texts get equal verdicts; input
rows are never merged or dropped by `measure`; an input column with the name of an output column is replaced.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetry.llm.common import Words, per_row, segment_hashes, slices

LEVEL = 3
CHUNK = 2_048               # bytes of a fixed chunk; a shorter last piece joins the chunk before it
WINDOW = 5                  # words of a repeated window

#: (bytes below, lowest ratio, highest ratio): verdict limits by length. The lower ones were measured on natural-language
#: prose with a wide margin. The upper ones lie below the least ratio of base64 at the band's longest texts and above that
#: of prose in Latin, Greek, Cyrillic and Korean script at its shortest. Under 256 bytes short prose in Korean compresses
#: no better than base64 does: there the limits stop random printable text from 128 bytes, and base64, which has few
#: blanks, has less than ten words.
BANDS = ((128, 0.40, 2.00), (256, 0.30, 1.035), (320, 0.30, 0.885), (384, 0.30, 0.865), (512, 0.30, 0.835),
         (768, 0.28, 0.80), (1_024, 0.28, 0.785), (2_048, 0.28, 0.765), (8_192, 0.25, 0.735), (1 << 62, 0.20, 0.735))

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "n_bytes long, ratio double, chunk_low double, chunk_high double, base_failed boolean, kept boolean")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def bands_of(n_bytes: np.ndarray, bands=BANDS) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted([b[0] for b in bands], n_bytes, "right")
    return np.array([b[1] for b in bands])[at], np.array([b[2] for b in bands])[at]


def _ratios(packer, text: bytes) -> tuple[float, float, float, int, int]:
    """Ratio of the text, lowest and highest of its chunks, and the bytes of those two chunks."""
    whole = len(packer.compress(text)) / len(text)
    if len(text) < 2 * CHUNK:
        return whole, whole, whole, len(text), len(text)
    cuts = [*range(0, len(text) - CHUNK + 1, CHUNK), len(text)]
    parts = [(len(packer.compress(text[a:b])) / (b - a), b - a) for a, b in zip(cuts, cuts[1:])]
    low, high = min(parts), max(parts)
    return whole, low[0], high[0], low[1], high[1]


def repeated_words(words: Words) -> np.ndarray:
    at, key = words.windows(WINDOW)
    if not len(at):
        return np.zeros(words.rows, np.int64)
    own = key ^ (words.row[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, back, times = np.unique(own, return_inverse=True, return_counts=True)
    hit = at[times[back] > 1]
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    return np.bincount(words.row[np.cumsum(edge[:-1]) > 0], minlength=words.rows)


def repeated_lines(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    breaks = data == 10
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    first[1:] |= breaks[:-1]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(words.rows, np.int64)
    worded = np.zeros(len(start), bool)
    worded[np.searchsorted(start, words.start, "right") - 1] = True
    row = np.searchsorted(offsets, start, "right") - 1
    key = segment_hashes(data, start, ~breaks) ^ (row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    key, row = key[worded], row[worded]
    _, earliest = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[earliest] = False
    return np.bincount(row[again], minlength=words.rows)


def _measured(batches, level, bands):
    packer = zstandard.ZstdCompressor(level=level)
    for batch in batches:
        rest = batch.drop_columns(["__text"])
        for row, data, offsets in slices(batch, "__text"):
            n_bytes = np.diff(offsets)
            words = Words(data, offsets)
            inside = words.inside
            chars = per_row(inside & ((data & 0xC0) != 0x80), offsets)
            symbols = per_row(_SYMBOL[data], offsets)
            lines, repeats = repeated_lines(data, offsets, words), repeated_words(words)
            raw = data.tobytes()
            ratio = np.full((words.rows, 3), np.nan)
            sizes = np.ones((words.rows, 2), np.int64)
            for i in np.flatnonzero(n_bytes):
                *ratio[i], sizes[i, 0], sizes[i, 1] = _ratios(packer, raw[offsets[i]:offsets[i + 1]])
            failed = (words.count < 10) | (100 * repeats > 20 * words.count)
            low, high = bands_of(n_bytes, bands)
            low_of_chunk, _ = bands_of(sizes[:, 0], bands)
            _, high_of_chunk = bands_of(sizes[:, 1], bands)
            good = ((ratio[:, 0] >= low) & (ratio[:, 0] <= high) & (ratio[:, 1] >= low_of_chunk)
                    & (ratio[:, 2] <= high_of_chunk))
            columns = [*rest.slice(row, words.rows).columns]
            columns += [pa.array(x, pa.int64()) for x in (words.count, chars, symbols, lines, repeats, n_bytes)]
            columns += [pa.array(ratio[:, k], pa.float64(), from_pandas=True) for k in range(3)]
            columns += [pa.array(failed), pa.array(~failed & good)]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest.schema.names, *_NAMES])


_NAMES = [part.split()[0] for part in MEASURES.split(", ")]


def measure(docs: DataFrame, text="text", keep=("doc_id",), level=LEVEL, bands=BANDS) -> DataFrame:
    """One row per document: the `keep` columns, counts, ratios, `base_failed` and the verdict `kept`."""
    kept = [c for c in keep if c not in _NAMES]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields
                          if f.name != "__text"), MEASURES])
    return source.mapInArrow(lambda it: _measured(it, level, bands), schema)


def accept(docs: DataFrame, text="text", level=LEVEL, bands=BANDS) -> DataFrame:
    """The documents that pass, with their own columns; one scan, no shuffle."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(f"`{text}`").alias("text"))
    judged = measure(packed, "text", ("__row",), level, bands).where("kept")
    return judged.select(*[F.col("__row").getField(c).alias(c) for c in names])
