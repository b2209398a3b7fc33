"""Document fingerprints: quartile bucket digests.

Hashed byte triplets of a sliding five-byte window are counted in 128 buckets. Each bucket is encoded by the quartile
of its count, beside a checksum, a logarithmic length and the quartiles' ratios. Two digests are compared by a
difference score (quartile steps, the far step counting six, plus length, ratio and checksum differences) that is
bounded by `BOUND`; likeness is 1 - score / BOUND.

`with_next` gives every document the following one in descending id order without a global sort in one task: ids are
dealt into ranges by approximate quantiles, each range is sorted within its partition, and the head of each range is
copied to the end of the range before it (one row per range).

Defined results: a null text counts as empty; texts of fewer than five bytes are padded; equal texts have equal
digests; among rows with one id, and among null ids (which come last), the order is that of the text's hash, falling;
a single row is its own next; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 128
BOUND = 300
WINDOW = 5
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def triplet_counts(data: bytes) -> np.ndarray:
    """Counts of the hashed triplets (first byte and two of the next four) of every window."""
    if len(data) < WINDOW:
        return np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    n = len(raw) - WINDOW + 1
    first, second, third = (raw * np.uint32(f) for f in _FACTORS)
    counts = np.zeros(BUCKETS, np.int64)
    for salt, (i, j) in enumerate(combinations(range(1, WINDOW), 2)):
        h = first[:n] + second[i:i + n]
        h ^= h >> np.uint32(15)
        h += third[j:j + n] + np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)
        h *= np.uint32(0x2C1B3C6D)
        counts += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    return counts


def counts_of(data: bytes) -> np.ndarray:
    return triplet_counts(data if len(data) >= WINDOW else data.ljust(WINDOW, b"\0"))


def encoded(counts: np.ndarray, data: bytes) -> str:
    ranked = np.sort(counts)
    q1, q2, q3 = (int(ranked[k * BUCKETS // 4 - 1]) for k in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = np.packbits(np.stack([codes >> 1, codes & 1], axis=1).astype(np.uint8).ravel()).tobytes()
    ratios = (q1 * 15 // max(q3, 1)) << 4 | q2 * 15 // max(q3, 1)
    check = hashlib.blake2b(data, digest_size=1).digest()[0]
    size = min(255, int(np.log(len(data) + 1) * 12))
    return bytes([check, size, ratios]).hex() + body.hex()


def fingerprint(text: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    return encoded(counts_of(data), data)


_STEPS = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])
_BYTES = np.array([[sum(int(_STEPS[a >> s & 3, b >> s & 3]) for s in (0, 2, 4, 6)) for b in range(256)]
                   for a in range(256)], np.uint8)


def difference(a: str, b: str) -> int:
    """Difference score of two digests, at most `BOUND`."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    score = int(x[0] != y[0])
    apart = abs(x[1] - y[1])
    score += apart if apart <= 4 else 4 + 3 * (apart - 4)
    for shift in (0, 4):
        gap = abs((x[2] >> shift & 15) - (y[2] >> shift & 15))
        score += gap if gap <= 1 else 4 * (gap - 1)
    left, right = np.frombuffer(x, np.uint8, offset=3), np.frombuffer(y, np.uint8, offset=3)
    return min(BOUND, score + int(_BYTES[left, right].sum()))


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / BOUND


# ---------------------------------------------------------------- Spark side

def _range(key, splits: list[int]):
    """How many of the sorted splits are at most the key: a binary search inside the plan."""
    if not splits:
        return F.lit(0)
    sizes = [1 << k for k in range(len(splits).bit_length() - 1, -1, -1)]
    table, n = F.lit(splits), len(splits)
    return F.aggregate(F.lit(sizes), F.lit(0), lambda low, size: F.when(
        (low + size <= n) & (F.element_at(table, F.least(low + size, F.lit(n))) <= key), low + size).otherwise(low))


def _dealt(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(part, copy, key, id, text): rows by range, with the head of the range that follows at the end of each."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"),
                       F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-2 ** 63)).alias("key"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cuts = rows.select("key").approxQuantile("key", [k / parts for k in range(1, parts)], 0.25 / parts)
    splits = sorted({int(x) for x in cuts if x > -2 ** 63})
    rows = rows.withColumn("part", _range(F.col("key"), splits))
    heads = sorted(((r["part"], r["key"]) for r in rows.groupBy("part").agg(F.max("key").alias("key")).collect()),
                   reverse=True)
    follows = [(head[1], heads[k - 1][0]) for k, head in enumerate(heads)]     # the first head ends the last range
    if not follows:
        return rows.select("part", F.lit(False).alias("copy"), "key", "id", "text")
    # One pair of numbers per range, of which there are at most `parts`.
    pairs = F.broadcast(docs.sparkSession.createDataFrame(follows, "key long, part int"))
    copies = rows.drop("part").join(pairs, "key").select("part", F.lit(True).alias("copy"), "key", "id", "text")
    return rows.select("part", F.lit(False).alias("copy"), "key", "id", "text").unionByName(copies)


def _compared(batches, id_type):
    held, out = None, []

    def finish(own, following):
        _, key, text, data, counts, print_ = own
        n = len(text)
        cut = n - n // 3
        head = text[:cut].encode("utf-8", "surrogatepass")
        edited = head + following[2][:n // 3].encode("utf-8", "surrogatepass")
        from_ = max(0, len(head) - WINDOW + 1)
        if len(edited) >= WINDOW and len(data) >= WINDOW:
            # Counts add up over windows: leave the old tail's, add the new one's.
            changed = counts - triplet_counts(data[from_:]) + triplet_counts(edited[from_:])
        else:
            changed = counts_of(edited)
        edited_print = encoded(changed, edited)
        out.append((key, n, hashlib.sha256(edited).hexdigest(), print_, edited_print,
                    likeness(print_, edited_print), likeness(print_, following[5])))

    def flushed():
        columns = list(zip(*out)) or [[] for _ in range(7)]
        out.clear()
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in batches:
        for part, copy, key, text in zip(*(batch.column(c).to_pylist() for c in ("part", "copy", "id", "text"))):
            if copy and (held is None or held[0] != part):
                continue                        # a further row with the head's id: the range is complete
            data = text.encode("utf-8", "surrogatepass")
            counts = counts_of(data)
            row = (part, key, text, data, counts, encoded(counts, data))
            if held is not None:
                finish(held, row)
            held = None if copy else row
            if len(out) >= 512:
                yield flushed()
    yield flushed()


def with_next(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: its digest, that of its edited text, and both likenesses.

    The edited text has its last third replaced by the beginning of the next document in descending id order.
    """
    dealt = _dealt(docs, doc_id, text).repartition("part").sortWithinPartitions(
        "part", "copy", F.desc("key"), F.desc(F.xxhash64("text")))
    kind = docs.schema[doc_id].dataType
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    return dealt.mapInArrow(
        lambda it: _compared(it, id_type), f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, "
        "fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """doc_id and fingerprint of every row."""
    def made(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], pa.string())],
                names=["doc_id", "fingerprint"])

    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(made, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint string")
