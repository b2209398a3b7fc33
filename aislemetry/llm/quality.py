"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

One pass turns every text into `len(NAMES)` statistics. Random Fourier features approximate a Gaussian kernel over the
standardised statistics. Every task sums its part of the normal equations (features x features) and Spark adds the
sums cell by cell; the driver solves one system of fixed size. Scores of the learning rows are binned into 1/1000
steps, and the pool-adjacent-violators fit of these bins maps a score to a probability.

Defined results: a null or empty text has the statistics of no words and gets a score; without learning rows every
score is 0.5; several labels of one id count as their mean, null labels as none; equal texts get equal scores.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetry.llm.common import Words, crc_rest, per_row, slices
from aislemetry.llm.compression import repeated_lines, repeated_words
from aislemetry.session import cut

FEATURES = 160
GAMMA = 0.04                # of the kernel exp(-gamma |x - y|^2) over standardised statistics
RIDGE = 1e-3                # times the number of learning rows
STEPS = 1000                # score bins of the calibration

NAMES = ("log_words", "log_bytes", "word_length", "word_spread", "symbols", "capitals", "digits", "bars", "marks",
         "not_ascii", "lines", "repeated_lines", "repeated_words", "distinct", "most_common", "ratio")
_IS = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in {
    "symbols": b"#*$%&<>", "capitals": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "bars": b"|",
    "marks": b"!?", "lines": b"\n"}.items()}


def statistics(data: np.ndarray, offsets: np.ndarray, packer) -> np.ndarray:
    """[rows, len(NAMES)] statistics of a slice."""
    words = Words(data, offsets)
    n_bytes = np.diff(offsets)
    size, n = np.maximum(n_bytes, 1), np.maximum(words.count, 1)
    chars = per_row(words.inside, offsets)
    length = np.add.reduceat(words.inside, words.start).astype(float) if len(words.start) else np.zeros(0)
    mean = chars / n
    spread = np.sqrt(np.maximum(np.bincount(words.row, length ** 2, words.rows) / n - mean ** 2, 0))
    own = words.hash ^ (words.row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, at, times = np.unique(own, return_index=True, return_counts=True)
    row = words.row[at]
    distinct = np.bincount(row, minlength=words.rows)
    most = np.zeros(words.rows)
    np.maximum.at(most, row, times)
    raw = data.tobytes()
    ratio = np.array([len(packer.compress(raw[a:b])) / (b - a) if b > a else 1.0
                      for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
    share = {name: per_row(table[data], offsets) / size for name, table in _IS.items()}
    n_lines = share["lines"] * size + 1
    return np.column_stack([
        np.log1p(words.count), np.log1p(n_bytes), np.minimum(mean, 50), np.minimum(spread, 50),
        *(np.sqrt(share[k]) for k in ("symbols", "capitals", "digits", "bars", "marks")),
        np.sqrt(per_row(data >= 128, offsets) / size), np.log1p(words.count / n_lines),
        np.sqrt(repeated_lines(data, offsets, words) / n_lines), np.sqrt(repeated_words(words) / n),
        distinct / n, np.sqrt(most / n), np.minimum(ratio, 1.5)])


def _measured(batches):
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for row, data, offsets in slices(batch):
            stats = statistics(data, offsets, packer)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, len(stats)), pa.array(list(stats), pa.list_(pa.float64()))],
                names=["doc_id", "x"])


def measure(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(_measured, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Kernel:
    """Standardisation and the random projection; fixed size."""

    def __init__(self, mean, spread, features=FEATURES, gamma=GAMMA, seed=17):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = np.asarray(mean), np.maximum(np.asarray(spread), 1e-6)
        self.w = rng.standard_normal((len(self.mean), features)) * np.sqrt(2 * gamma)
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.column_stack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones(len(x))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _sums(batches, kernel):
    """This task's part of the normal equations: (i, j, value) with j = -1 for the right side."""
    size = len(kernel.b) + 1
    left, right, n = np.zeros((size, size)), np.zeros(size), 0
    for batch in batches:
        if batch.num_rows:
            f = kernel(_matrix(batch.column("x"), len(kernel.mean)))
            left += f.T @ f
            right += f.T @ np.asarray(batch.column("y"))
            n += batch.num_rows
    if n:
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([i, np.arange(size)]), pa.int32()),
             pa.array(np.concatenate([j, np.full(size, -1)]), pa.int32()),
             pa.array(np.concatenate([left[i, j], right]))], names=["i", "j", "v"])


def pooled(values: list[float], weights: list[float]) -> list[float]:
    """Isotonic fit of values in order: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [v for v, _, k in blocks for _ in range(int(k))]


def _scored(batches, kernel, weights, curve):
    for batch in batches:
        if batch.num_rows == 0:
            continue
        raw = kernel(_matrix(batch.column("x"), len(kernel.mean))) @ weights
        out = raw if curve is None else np.interp(raw, curve[0], curve[1])
        yield pa.RecordBatch.from_arrays([*batch.drop_columns(["x"]).columns, pa.array(out, pa.float64())],
                                         names=[*batch.drop_columns(["x"]).schema.names, "score"])


def _apply(rows: DataFrame, keep: list[str], kernel, weights, curve=None) -> DataFrame:
    source = rows.select(*keep, "x")
    schema = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(lambda it: _scored(it, kernel, weights, curve), f"{schema}, score double")


def learn(measured: DataFrame, marks: DataFrame, ridge=RIDGE):
    """(kernel, weights, calibration curve) from rows (doc_id, x) and (doc_id, y); None without learning rows."""
    rows = cut(measured.join(marks, "doc_id").select("x", F.col("y").cast("double").alias("y")))
    width = len(NAMES)
    moments = rows.agg(F.count("*").alias("n"), *[f(F.col("x")[k]).alias(f"{name}{k}") for k in range(width) for name, f in
                                                  (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments["n"]:
        return None
    kernel = Kernel([moments[f"m{k}"] for k in range(width)], [moments[f"s{k}"] for k in range(width)])
    size = len(kernel.b) + 1
    left, right = np.zeros((size, size)), np.zeros(size)
    cells = rows.mapInArrow(lambda it: _sums(it, kernel), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v"))
    for i, j, v in cells.collect():
        if j < 0:
            right[i] = v
        else:
            left[i, j] = left[j, i] = v
    penalty = np.full(size, ridge * moments["n"])
    penalty[-1] = 0
    weights = np.linalg.solve(left + np.diag(penalty) + 1e-9 * np.eye(size), right)
    # Scores far outside 0 to 1 fall into the outermost bins, so there are at most 4 x STEPS + 1 and every row counts.
    raw = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("score")))
    bins = (_apply(rows, ["y"], kernel, weights).groupBy(F.round(raw * STEPS).alias("k"))
            .agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("k").collect())
    fit = pooled([r["y"] for r in bins], [r["n"] for r in bins])
    return kernel, weights, (np.array([r["k"] / STEPS for r in bins]), np.clip(fit, 0.0, 1.0))


def score(docs: DataFrame, labels: DataFrame, mark="quality", text="text", doc_id="doc_id", base=3, held=1) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels of held-out ids are not read."""
    measured = cut(measure(docs, text, doc_id))
    marks = (labels.where(F.col(mark).isNotNull() & (crc_rest(F.col("doc_id"), base) != held))
             .groupBy("doc_id").agg(F.avg(mark).alias("y")))
    model = learn(measured, marks)
    if model is None:
        scored = measured.select("doc_id", F.lit(0.5).alias("score"))
    else:
        scored = _apply(measured, ["doc_id"], *model)
    return scored.select("doc_id", F.coalesce(crc_rest(F.col("doc_id"), base) == held, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
