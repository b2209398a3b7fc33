"""Toxicity by maximum-scoring segments.

Words are runs of letters, ASCII letters in lower case. On a bounded sample of different labelled texts every word
gets the log odds of its presence in toxic against other texts under an informative Dirichlet prior (pseudo-words, a
`PRIOR` share of the counted words, spread like the pooled counts). Words that `SUPPORT` of the toxic texts hold and
whose z score passes `Z` make the table, at most `TABLE` of them; every other word costs `DRIFT`, so that the score of
clean text falls on average.

A linear-time scan finds all maximal-scoring segments of a text: what is between two table words is one negative step,
so the scan's work per text is in the table words. Segment scores follow an extreme-value law: with lambda from the
clean word distribution and its scale from clean documents, a segment's expected number in a text of n words is
K n exp(-lambda S). Significant segments (expected number at most `EXPECTED`) are the toxic passages; `passages` returns
them with their places. They are aggregated by the extreme-value law of their sum: r segments whose normalised scores
lambda S - ln(K n) add up to T are as rare as exp(-T) T^(r-1) / (r! (r-1)!). The document's statistic is the rarest of
its best segment alone, its two best together, and so on through all significant ones; a logistic curve over the
statistic's histogram turns it into a probability.

Defined results: null and empty texts have no segment and get a score; without toxic learning rows all scores are 0
(or 1 where all are toxic); several labels of one id are learnt each, null labels not; equal texts get equal scores.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetry.llm.common import Words, crc_rest, mix, sampled, slices
from aislemetry.session import cut

SAMPLE = 30_000             # labelled documents that are learnt from, at most
PRIOR = 0.01                # pseudo-words, as a share of the counted words
Z = 4.0
SUPPORT = 0.02              # of the toxic texts hold a word of the table, five at least
TABLE = 4_096
DRIFT = 0.35
EXPECTED = 0.05
STEP = 0.25                 # width of a histogram bin of the document statistic

_BLANK = np.ones(256, bool)
_BLANK[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(_LOWER[data], offsets, _BLANK)


def segments(position: list[int], value: list[float], drift=DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, last word, score) of a text.

    `position` and `value` are its scoring words in order; every other word scores -drift. Segments are kept on a
    stack with the running totals before and behind each; a new one merges backwards into the nearest segment that
    starts lower, as long as its end is higher. Each merge removes a segment, so the scan is linear.
    """
    stack: list[tuple[int, int, float, float, int]] = []    # first, last, total before, total behind, lower one's index
    total, next_word = 0.0, 0
    for at, gain in zip(position, value):
        total -= drift * (at - next_word)
        first, before = at, total
        total += gain
        next_word = at + 1
        behind = total
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= before:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= behind:
                stack.append((first, at, before, behind, k))
                break
            first, _, before, _, _ = stack[k]
            del stack[k:]
    return [(a, b, behind - before) for a, b, before, behind, _ in stack]


# ---------------------------------------------------------------- learning

def _counted(batches):
    for batch in batches:
        y = np.asarray(batch.column("y"))
        for row, data, offsets in slices(batch):
            words = words_of(data, offsets)
            toxic = y[row:row + words.rows] > 0
            # A word counts once per text, else one text that repeats itself would make a table word.
            _, once = np.unique(words.hash ^ mix(words.row.astype(np.uint64)), return_index=True)
            present, owner = words.hash[once], words.row[once]
            for flag in (False, True):
                key, n = np.unique(present[toxic[owner] == flag], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), flag)),
                                                  pa.array(n, pa.int64())], names=["word", "toxic", "n"])


def learn_words(rows: DataFrame, table=TABLE) -> dict:
    """Word table and totals from (text, y) rows."""
    counts = cut(rows.mapInArrow(_counted, "word long, toxic boolean, n long").groupBy("word").agg(
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("o")))
    total = counts.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.coalesce(F.sum("o"), F.lit(0)).alias("o")).first()
    if not total["t"] or not total["o"]:
        return {"words": np.zeros(0, np.int64), "values": np.zeros(0), "clean": np.zeros(0), "o": total["o"]}
    prior = F.lit(PRIOR) * (F.col("t") + F.col("o"))
    pseudo = PRIOR * (total["t"] + total["o"])
    log_odds = (F.log((F.col("t") + prior) / (total["t"] + pseudo - F.col("t") - prior))
                - F.log((F.col("o") + prior) / (total["o"] + pseudo - F.col("o") - prior)))
    spread = F.sqrt(1 / (F.col("t") + prior + 0.5) + 1 / (F.col("o") + prior + 0.5))
    texts = rows.where("y > 0").count()
    best = (counts.where(F.col("t") >= max(5, math.ceil(SUPPORT * texts))).select("word", "o", log_odds.alias("v"), (log_odds / spread).alias("z"))
            .where((F.col("z") > Z) & (F.col("v") > 0.7)).orderBy(F.desc("z"), "word").limit(table).collect())
    best.sort(key=lambda r: r["word"])
    return {"words": np.array([r["word"] for r in best], np.int64), "values": np.array([r["v"] for r in best]),
            "clean": np.array([r["o"] for r in best], float), "o": total["o"]}


def decay(model: dict, drift=DRIFT) -> float:
    """Lambda: the positive root of the clean words' moment equation sum p exp(lambda s) = 1."""
    if not len(model["words"]):
        return 1.0
    p = (model["clean"] + 0.5) / (model["o"] + 1.0)
    rest = max(1e-9, 1 - p.sum())

    def excess(x):
        return float((p * np.exp(np.minimum(x * model["values"], 600))).sum() + rest * math.exp(-x * drift) - 1)

    low, high = 1e-3, 20.0
    if excess(low) >= 0:
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _found(words: Words, model: dict, drift: float) -> list[list[tuple[int, int, float]]]:
    """Maximal segments of every row; word numbers count from the row's first word."""
    own = words.hash.view(np.int64)
    table = model["words"]
    out: list = [[] for _ in range(words.rows)]
    if not len(table) or not len(own):
        return out
    at = np.minimum(np.searchsorted(table, own), len(table) - 1)
    hit = np.flatnonzero(table[at] == own)
    first = np.concatenate([[0], np.cumsum(words.count)])[:-1]
    rows, cuts = np.unique(words.row[hit], return_index=True)
    for row, part in zip(rows.tolist(), np.split(hit, cuts[1:])):
        out[row] = segments((part - first[row]).tolist(), model["values"][at[part]].tolist(), drift)
    return out


def together(values: list[float]) -> float:
    """Statistic of a text: the highest -ln of how rare its best r segments are, r from one to all significant ones."""
    ranked = sorted(values, reverse=True)
    best = total = ranked[0]
    for r, x in enumerate(ranked[1:], 2):
        if x < -math.log(EXPECTED):
            break
        total += x
        best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
    return best


def _scanned(batches, model, lam, log_k, curve, drift):
    for batch in batches:
        rest = batch.drop_columns(["text"])
        for row, data, offsets in slices(batch):
            words = words_of(data, offsets)
            found = _found(words, model, drift)
            log_n = np.log(np.maximum(words.count, 1))
            # Minus the log of each segment's expected number.
            rare = [[lam * s - ln - log_k for *_, s in own] for own, ln in zip(found, log_n)]
            # A text without a scoring word has no segment to judge: the lowest statistic, whatever its length.
            statistic = np.array([np.clip(together(own), -20, 40) if own else -20.0 for own in rare], float)
            passages = [sum(x >= -math.log(EXPECTED) for x in own) for own in rare]
            score = 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * statistic, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*rest.slice(row, words.rows).columns, pa.array(statistic), pa.array(passages, pa.int64()),
                 pa.array(score)], names=[*rest.schema.names, "statistic", "n_passages", "score"])


def _scan(rows: DataFrame, keep: list[str], model, lam, log_k, curve=(0.0, 1.0), drift=DRIFT) -> DataFrame:
    source = rows.select(*keep, "text")
    schema = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(lambda it: _scanned(it, model, lam, log_k, curve, drift),
                             f"{schema}, statistic double, n_passages long, score double")


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds=60) -> tuple[float, float]:
    """Newton fit of a weighted one-variable logistic curve with a weak prior; the slope stays positive."""
    a, b = 0.0, 0.1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = n * p * (1 - p)
        grad = np.array([(n * (y - p)).sum() - 1e-2 * a, (n * (y - p) * x).sum() - 1e-2 * b])
        hess = np.array([[w.sum() + 1e-2, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a + step[0], max(1e-3, b + step[1])
    return float(a), float(b)


def learn(docs: DataFrame, labels: DataFrame, mark="toxic", base=5, held=0, sample=SAMPLE):
    """(word model, lambda, log K, curve); learning labels are those whose id's crc32 rest is not `held`.

    The picked labels are at most `sample` rows of two numbers, a size that the parameter bounds, and are broadcast.
    """
    usable = labels.where(F.col(mark).isNotNull() & F.col("doc_id").isNotNull()
                          & (crc_rest(F.col("doc_id"), base) != held)).select(
        F.col("doc_id").cast("long").alias("id"), F.col(mark).cast("int").alias("y"))
    picked = sampled(usable, F.col("id"), sample)
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(picked), "id")
               .withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "y"]).select("text", "y"))
    model = learn_words(rows)
    lam = decay(model)
    width = F.floor(F.col("statistic") / STEP)

    def histogram(log_k):
        return _scan(rows, ["y"], model, lam, log_k).groupBy("y", width.alias("bin")).count().collect()

    first = histogram(0.0)
    if not first:
        return model, lam, 0.0, (-30.0, 1e-3)
    clean = [(r["bin"] + 0.5, r["count"]) for r in first if r["y"] == 0 and r["bin"] * STEP > -19]
    # The mean of a standard extreme-value law is Euler's constant; clean texts with a segment set the location.
    log_k = sum(x * STEP * n for x, n in clean) / sum(n for _, n in clean) - 0.5772 if clean else 0.0
    bins = histogram(log_k)
    x = np.array([(r["bin"] + 0.5) * STEP for r in bins])
    y, n = np.array([r["y"] for r in bins], float), np.array([r["count"] for r in bins], float)
    if len(set(y.tolist())) < 2:
        return model, lam, log_k, (30.0 if y[0] else -30.0, 1e-3)
    return model, lam, log_k, logistic(x, y, n)


def score(docs: DataFrame, labels: DataFrame, text="text", doc_id="doc_id", mark="toxic", base=5, held=0,
          sample=SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages (significant segments) and the statistic of every row."""
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    model, lam, log_k, curve = learn(source, labels, mark, base, held, sample)
    out = _scan(source, ["doc_id"], model, lam, log_k, curve)
    return out.select("doc_id", F.coalesce(crc_rest(F.col("doc_id"), base) == held, F.lit(False)).alias("held_out"),
                      "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "statistic")


def _placed(batches, model, lam, log_k, drift, names):
    for batch in batches:
        rest = batch.drop_columns(["text"])
        for row, data, offsets in slices(batch):
            words = words_of(data, offsets)
            first = np.concatenate([[0], np.cumsum(words.count)])[:-1]
            # Code points before every byte; the blank after a word ends it, and so does the end of its text.
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            blank = np.append(np.flatnonzero(_BLANK[data]), len(data))
            out: list[tuple] = []
            for n, own in enumerate(_found(words, model, drift)):
                log_n = math.log(max(int(words.count[n]), 1))
                for a, b, s in own:
                    rare = lam * s - log_n - log_k
                    if rare >= -math.log(EXPECTED):
                        start, last = int(words.start[first[n] + a]), int(words.start[first[n] + b])
                        end = min(int(blank[np.searchsorted(blank, last)]), int(offsets[n + 1]))
                        base = points[offsets[n]]
                        out.append((n, a, b + 1, int(points[start] - base), int(points[end] - base), s, math.exp(-rare)))
            at, *columns = zip(*out) if out else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays(
                [c.take(pa.array([row + n for n in at], pa.int64())) for c in rest.columns]
                + [pa.array(c, k) for c, k in zip(columns, kinds)], names=[*rest.schema.names, *names])


def passages(docs: DataFrame, labels: DataFrame, text="text", doc_id="doc_id", mark="toxic", base=5, held=0,
             sample=SAMPLE) -> DataFrame:
    """One row per significant passage: doc_id, first_word and end_word, start and end (code points, end exclusive), its
    score and how many such segments a clean text of that length would hold."""
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    model, lam, log_k, _ = learn(source, labels, mark, base, held, sample)
    names = ["first_word", "end_word", "start", "end", "score", "expected"]
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lambda it: _placed(it, model, lam, log_k, DRIFT, names),
                             f"doc_id {kind}, first_word long, end_word long, start long, end long, score double, expected double")
