"""Language identification in two steps: language family, then one-versus-one linear machines within it.

Features are hashed byte pairs and triples of the text (ASCII letters in lower case, everything between words one
blank), square roots of their shares, scaled to unit length. Families come from `FAMILIES`; a language that the table
does not name joins the family whose mean is nearest. Both steps vote one-versus-one with linear support vector
machines fitted by dual coordinate descent on a bounded sample per language.

Defined results: `und` with score 0 for a null text, a text without a letter, or when nothing could be learnt; with
one learnt language that one; equal texts get equal answers; learning rows with a null language or text are not used.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetry.llm.common import crc_rest, slices

WIDTH = 1_024               # hashed features
SAMPLE = 600                # learning texts per language, about
EPOCHS = 12
COST = 4.0

# Families of common language codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "hr", "sr", "sl", "be", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ne", "ur", "pa", "gu"),
}

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[128:] = np.arange(128, 256)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)


def features(data: np.ndarray, offsets: np.ndarray, width=WIDTH) -> np.ndarray:
    """[rows, width] unit vectors; a row without letters is zero."""
    rows = len(offsets) - 1
    plain = _PLAIN[data]
    row = np.repeat(np.arange(rows), np.diff(offsets))
    keep = np.ones(len(plain), bool)                     # blanks in a row are one
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32) | (row[1:] != row[:-1])
    plain, row = plain[keep].astype(np.uint32), row[keep]
    total = np.zeros(rows * width, np.int64)
    for size, salt in ((2, 0x51ED270B), (3, 0xA3B195F1)):
        n = len(plain) - size + 1
        if n <= 0:
            continue
        h = plain[:n] * np.uint32(0x9E3779B1)
        for k in range(1, size):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + plain[k:k + n]
        h = (h + np.uint32(salt)) * np.uint32(0xC2B2AE3D)
        good = (row[:n] == row[size - 1:]) & ((plain[:n] != 32) | (plain[1:n + 1] != 32))
        at = row[:n][good] * width + (h[good] >> np.uint32(16)) % np.uint32(width)
        total += np.bincount(at, minlength=rows * width)
    x = np.sqrt(total.reshape(rows, width).astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def machine(x: np.ndarray, y: np.ndarray, cost=COST, epochs=EPOCHS, seed=5) -> np.ndarray:
    """Weights (last one the bias) of a linear machine with squared hinge loss, by dual coordinate descent."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    norm, alpha, w = (x * x).sum(1) + 0.5 / cost, np.zeros(len(x)), np.zeros(x.shape[1])
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(0.0, alpha[i] - slope / norm[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Votes:
    """One-versus-one machines of some classes; answers class numbers and the share of support for each."""

    def __init__(self, x, label, names):
        self.names = list(names)
        self.pairs = []
        for a, b in combinations(range(len(self.names)), 2):
            own = np.isin(label, [self.names[a], self.names[b]])
            y = np.where(label[own] == self.names[a], 1.0, -1.0)
            self.pairs.append((a, b, machine(x[own], y)))

    def __call__(self, x):
        n = len(self.names)
        votes, margin = np.zeros((len(x), n)), np.zeros((len(x), n))
        for a, b, w in self.pairs:
            m = x @ w[:-1] + w[-1]
            votes[np.arange(len(x)), np.where(m >= 0, a, b)] += 1
            margin[:, a] += np.tanh(m)
            margin[:, b] -= np.tanh(m)
        best = (votes + 1e-3 * margin).argmax(1)
        support = np.exp(2 * margin / max(1, n - 1))
        return best, (support / support.sum(1, keepdims=True))[np.arange(len(x)), best]


class Model:
    def __init__(self, x: np.ndarray, lang: np.ndarray):
        known = {code: family for family, codes in FAMILIES.items() for code in codes}
        langs = sorted(set(lang.tolist()))
        mean = {code: x[lang == code].mean(0) for code in langs}
        family = {code: known[code] for code in langs if code in known}
        for code in langs:
            if code not in family:
                near = max(family, key=lambda other: float(mean[code] @ mean[other]), default=None) if family else None
                family[code] = known.get(near, family.get(near)) if near else "other"
        self.groups = {name: [c for c in langs if family[c] == name] for name in sorted(set(family.values()))}
        own = np.array([family[c] for c in lang.tolist()])
        self.top = Votes(x, own, self.groups)
        self.within = {name: Votes(x, lang, codes) for name, codes in self.groups.items()}

    def __call__(self, x) -> tuple[np.ndarray, np.ndarray]:
        first, support = self.top(x)
        lang, score = np.empty(len(x), object), np.zeros(len(x))
        for k, name in enumerate(self.top.names):
            rows = np.flatnonzero(first == k)
            if len(rows):
                best, own = self.within[name](x[rows])
                lang[rows] = np.array(self.groups[name], object)[best]
                score[rows] = support[rows] * own
        return lang, score


# ---------------------------------------------------------------- Spark side

def _featured(batches):
    for batch in batches:
        for row, data, offsets in slices(batch):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(row, len(x)),
                                              pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "x"])


def learn(docs: DataFrame, text="text", lang="lang", doc_id="doc_id", base=4, held=2, sample=SAMPLE) -> Model | None:
    """Fit on about `sample` different texts per language, picked by a hash of the text.

    The driver gets these vectors: languages x sample x WIDTH numbers, whatever the size of the table.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()
                        & F.coalesce(crc_rest(F.col(doc_id), base) != held, F.lit(False))).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    hashed = usable.select("lang", F.xxhash64("text").alias("h"))
    sizes = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return None
    limit = F.create_map(*[F.lit(v) for code, n in sizes.items() for v in (
        code, min(1_000_000, int(1_000_000 * sample / max(n, 1)) + 1))])
    picked = usable.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < limit[F.col("lang")])
    rows = picked.mapInArrow(_featured, "lang string, x binary").dropDuplicates(["lang", "x"]).collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    good = x.any(1)
    return Model(x[good], np.array([r["lang"] for r in rows], object)[good]) if good.any() else None


def _predicted(batches, model):
    for batch in batches:
        values = batch.column("text")
        for row, data, offsets in slices(batch):
            x = features(data, offsets)
            for i in np.flatnonzero(~x.any(1) & (np.diff(offsets) == 1)):
                # A lone letter has no byte pair of its own; the blanks around it make two.
                own = np.array([32, data[offsets[i]], 32], np.uint8)
                x[i] = features(own, np.array([0, 3]))[0]
            lettered = x.any(1)
            for i in np.flatnonzero(lettered):
                # Bytes beyond ASCII may be letters or not; ASCII letters settle it for nearly every text.
                own = data[offsets[i]:offsets[i + 1]]
                if not (((own | 32) >= 97) & ((own | 32) <= 122) & (own < 128)).any():
                    lettered[i] = any(map(str.isalpha, values[row + int(i)].as_py()))
            lang, score = np.full(len(x), "und", object), np.zeros(len(x))
            if model is not None and lettered.any():
                lang[lettered], score[lettered] = model(x[lettered])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, len(x)), pa.array(lang, pa.string()), pa.array(score)],
                names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, text="text", lang="lang", doc_id="doc_id", base=4, held=2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    model = learn(docs, text, lang, doc_id, base, held)
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    out = source.mapInArrow(lambda it: _predicted(it, model),
                            f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(crc_rest(F.col("doc_id"), base) == held, F.lit(False)).alias("held_out"),
                      "lang_pred", "score")
