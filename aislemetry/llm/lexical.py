"""Ranked lexical search: accumulators of short lists beside skipping over long ones.

`Index` cuts documents into segments of at most `SEGMENT_DOCS` documents, each with its own postings (term hash ->
ordinals and counts), written as Parquet in the shared folder. Ordinals follow doc_id, so equal scores keep that order.
Counts over all documents (N, L, df) come from the segments; every segment is then searched for a block of items:

1. term at a time: the postings of an item's short lists are multiplied out and summed into accumulators, sorted by
   ordinal, with one bound per window of `WINDOW` ordinals. The best of them give the first threshold;
2. document at a time: windows are visited in document order with the accumulators as one more bounded list beside the
   long lists. A window whose bounds add up to less than the threshold, which rises on the way, is skipped in all lists;
3. the best `top` of every segment meet in one window per item, which Spark limits before the shuffle too.

Skipping loses nothing: bounds are exact maxima of the integer scores, and windows that tie are visited.

Items are taken in blocks of `ITEM_BLOCK`; a block's terms and weights are all that is sent to the tasks.

Defined results: null texts and texts without terms are no documents (they count for nothing and are never found); items
without a known term give no rows; a null item id or doc_id is an id like others (doc_id last among equal scores);
repeated rows are documents of their own; doc_id may have any orderable type; other columns are ignored.
"""
from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislemetry.llm.common import SLICE_BYTES, Words, buffers, mix, texts
from aislemetry.session import shared_dir

TOP = 20
SEGMENT_DOCS = 4_096        # documents of a segment; an ordinal fits 16 bits
SEGMENT_BYTES = 16 << 20
WINDOW = 64                 # ordinals that are skipped together
SHORT = 1 / 32              # a list is short if it holds at most this share of the segment's documents
STRIP = 32                  # windows scored at once; the threshold rises between strips
ITEM_BLOCK = 1_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BLANK = np.ones(256, bool)
_BLANK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_K = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- segments

class _Segment:
    """Postings of the documents added so far; documents without terms are left out."""

    def __init__(self):
        self.ids, self.lengths, self.hashes, self.rows, self.counts, self.n, self.bytes = [], [], [], [], [], 0, 0

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        words = Words(_LOWER[data], offsets, _BLANK)
        some = words.count > 0
        place = np.cumsum(some) - 1 + self.n
        if len(words.start):
            _, at, n = np.unique(mix(words.hash + words.row.astype(np.uint64) * _K), return_index=True, return_counts=True)
            self.hashes.append(words.hash[at])
            self.rows.append(place[words.row[at]].astype(np.int32))
            self.counts.append(n.astype(np.int32))
        self.ids.append(ids.filter(pa.array(some)))
        self.lengths.append(words.count[some])
        self.n += int(some.sum())
        self.bytes += len(data)

    def row(self, id_type) -> pa.RecordBatch:
        ids = pa.concat_arrays([a.cast(id_type) for a in self.ids])
        order = pc.array_sort_indices(ids).to_numpy()
        ordinal = np.empty(len(order), np.int32)
        ordinal[order] = np.arange(len(order), dtype=np.int32)
        hashes, rows, counts = (np.concatenate(x) if x else np.zeros(0, np.uint64)
                                for x in (self.hashes, self.rows, self.counts))
        at = ordinal[rows.astype(np.int64)]
        by = np.lexsort((at, hashes))
        hashes, at, counts = hashes[by], at[by], counts[by]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        lengths = np.concatenate(self.lengths)[order]
        packed = [_packed(hashes[first]), _packed(np.append(first, len(hashes))), _packed(at.astype(np.uint16)),
                  _packed(counts.astype(np.uint16 if counts.max(initial=0) < 1 << 16 else np.int32)), _packed(lengths)]
        return pa.RecordBatch.from_arrays(
            [pa.array([len(order)], pa.int64()), pa.array([int(lengths.sum())], pa.int64()),
             pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids.take(pa.array(order))),
             *[pa.array([x], pa.binary()) for x in packed]],
            ["n_docs", "n_terms", "ids", "hashes", "starts", "ordinals", "counts", "lengths"])


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


_PARTS = [T.StructField(c, T.BinaryType()) for c in ("hashes", "starts", "ordinals", "counts", "lengths")]


def segments(docs: DataFrame, text="text") -> DataFrame:
    """One row per segment: n_docs, n_terms, ids, and packed postings."""
    rows = docs.select(F.col("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType()),
                           T.StructField("ids", T.ArrayType(id_type)), *_PARTS])

    def run(batches):
        current, kind = _Segment(), None
        for batch in batches:
            ids = batch.column("doc_id")
            kind = ids.type
            data, offsets = buffers(texts(batch.column("text")))
            row, rows = 0, len(ids)
            while row < rows:
                end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
                end = min(max(row + 1, end), row + SEGMENT_DOCS - current.n)
                current.add(ids.slice(row, end - row), data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row])
                if current.n >= SEGMENT_DOCS or current.bytes >= SEGMENT_BYTES:
                    if current.n:
                        yield current.row(kind)
                    current = _Segment()
                row = end
        if current.n:
            yield current.row(kind)

    return rows.mapInArrow(run, schema)


# ---------------------------------------------------------------- one segment

def item_terms(text: str | None) -> Counter:
    """Term hashes of an item and how often each stands in it."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    words = Words(_LOWER[raw], np.array([0, len(raw)]), _BLANK)
    return Counter(words.hash.tolist())


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def scale(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document; in Python integers where 64 bits might not do."""
    if len(lengths) and 25 * int(lengths.max()) * n_docs >= 1 << 62:
        return np.array([75 + 25 * int(n) * n_docs // n_terms for n in lengths], np.int64)
    return 75 + 25 * lengths * n_docs // max(1, n_terms)


class Searcher:
    """Lists, gains and bounds of one segment; lists are read once however many items use them."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.n = row["n_docs"]
        self.hashes = np.frombuffer(row["hashes"], np.uint64)
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.ordinals = np.frombuffer(row["ordinals"], np.uint16)
        kind = np.uint16 if len(row["counts"]) == 2 * len(self.ordinals) else np.int32
        self.counts = np.frombuffer(row["counts"], kind)
        self.m = scale(np.frombuffer(row["lengths"], np.int64), n_docs, n_terms)
        self.windows = -(-self.n // WINDOW)
        self._lists: dict[int, tuple | None] = {}
        self._bounds: dict[int, tuple] = {}

    def list(self, term: int):
        """(ordinals, gains) of a term in this segment, None without one."""
        if term not in self._lists:
            k = int(np.searchsorted(self.hashes, np.uint64(term)))
            if k == len(self.hashes) or int(self.hashes[k]) != term:
                self._lists[term] = None
            else:
                at = self.ordinals[self.starts[k]:self.starts[k + 1]].astype(np.int64)
                tf = self.counts[self.starts[k]:self.starts[k + 1]].astype(np.int64)
                self._lists[term] = at, 1_000_000_000 * tf // (1000 * tf + 12 * self.m[at])
        return self._lists[term]

    def bounds(self, term: int, top: int):
        """(best gain per window, first posting of each window, the gain that `top` postings reach) of a long list."""
        if term not in self._bounds:
            at, gain = self._lists[term]
            edge = np.searchsorted(at, np.arange(self.windows + 1) * WINDOW)
            reach = int(np.partition(gain, len(gain) - top)[len(gain) - top]) if len(gain) >= top else 0
            self._bounds[term] = _window_best(at, gain, self.windows), edge, reach
        return self._bounds[term]

    def search(self, terms: dict[int, int], top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """(ordinals, scores) of the best documents; `terms` are weights with repeats multiplied in."""
        lists = [(t, w, self.list(t)) for t, w in terms.items() if w > 0 and self.list(t) is not None]
        short = [(w, x) for _, w, x in lists if len(x[0]) <= SHORT * self.n]
        long_ = [(t, w, x) for t, w, x in lists if len(x[0]) > SHORT * self.n]

        # Term at a time: one bounded iterator out of all short lists.
        acc_at, acc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if short:
            at = np.concatenate([x[0] for _, x in short])
            gain = np.concatenate([w * x[1] for w, x in short])
            order = np.argsort(at, kind="stable")
            at, gain = at[order], gain[order]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            acc_at, acc = at[first], np.add.reduceat(gain, first)
        acc_edge = np.searchsorted(acc_at, np.arange(self.windows + 1) * WINDOW)
        bound = _window_best(acc_at, acc, self.windows)
        limit = int(np.partition(acc, len(acc) - top)[len(acc) - top]) if len(acc) >= top else 0
        streams = [(1, acc_at, acc, acc_edge)]
        for t, w, (at, gain) in long_:
            best, edge, reach = self.bounds(t, top)
            bound = bound + w * best
            limit = max(limit, w * reach)
            streams.append((w, at, gain, edge))

        # Document at a time over the windows that may still matter.
        open_ = np.flatnonzero((bound >= limit) & (bound > 0))
        found_at, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in range(0, len(open_), STRIP):
            strip = open_[k:k + STRIP]
            strip = strip[bound[strip] >= limit]
            if not len(strip):
                continue
            slot = np.full(self.windows, -1, np.int64)
            slot[strip] = np.arange(len(strip))
            score = np.zeros(len(strip) * WINDOW, np.int64)
            for w, at, gain, edge in streams:
                take = _ranges(edge[strip], edge[strip + 1])
                here = at[take]
                score[slot[here // WINDOW] * WINDOW + here % WINDOW] += w * gain[take]
            hit = np.flatnonzero((score > 0) & (score >= limit))
            found_at = np.concatenate([found_at, strip[hit // WINDOW] * WINDOW + hit % WINDOW])
            found = np.concatenate([found, score[hit]])
            if len(found) >= top:
                best = np.lexsort((found_at, -found))[:top]
                found_at, found = found_at[best], found[best]
                limit = max(limit, int(found[-1]))
        best = np.lexsort((found_at, -found))[:top]
        return found_at[best], found[best]


def _window_best(at, gain, windows):
    best = np.zeros(windows, np.int64)
    if len(at):
        w = at // WINDOW
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        best[w[first]] = np.maximum.reduceat(gain, first)
    return best


def _ranges(low, high):
    """All whole numbers of the ranges [low, high)."""
    n = high - low
    total = np.cumsum(n)
    return np.repeat(high - total, n) + np.arange(total[-1] if len(total) else 0)


# ---------------------------------------------------------------- Spark side

class Index:
    """Segments in a shared folder and the counts over all of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.segments = spark.read.parquet(f"{self.folder}/segments")
        sums = self.segments.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
        self.n_docs, self.n_terms = sums.d or 0, sums.t or 0

    @classmethod
    def build(cls, docs: DataFrame, folder: str | None = None, text="text") -> Index:
        spark = docs.sparkSession
        folder = folder or shared_dir(spark, "lexical")
        segments(docs, text).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/segments")
        return cls(spark, folder)

    def frequencies(self, terms: set[int]) -> dict[int, int]:
        """Documents per term, for the terms of one block of items."""
        wanted = np.array(sorted(terms), np.uint64)

        def run(batches):
            for batch in batches:
                for raw, starts in zip(batch.column("hashes"), batch.column("starts")):
                    hashes = np.frombuffer(raw.as_py(), np.uint64)
                    size = np.diff(np.frombuffer(starts.as_py(), np.int64))
                    at = np.minimum(np.searchsorted(hashes, wanted), max(0, len(hashes) - 1))
                    hit = np.flatnonzero(hashes[at] == wanted) if len(hashes) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int64)), pa.array(size[at[hit]])], ["k", "df"])

        rows = self.segments.select("hashes", "starts").mapInArrow(run, "k long, df long")
        return {int(wanted[r.k]): r.df for r in rows.groupBy("k").agg(F.sum("df").alias("df")).collect()}

    def _hits(self, queries: list[tuple[int, dict[int, int]]], top: int) -> DataFrame:
        """(k, doc_id, score): the best of every segment for the items of one block, by their number in it."""
        n_docs, n_terms = self.n_docs, self.n_terms
        id_type = self.segments.schema["ids"].dataType.elementType
        schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("doc_id", id_type),
                               T.StructField("score", T.LongType())])

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in ("n_docs", "hashes", "starts", "ordinals", "counts",
                                                                   "lengths")}
                    searcher = Searcher(row, n_docs, n_terms)
                    ids = batch.column("ids")[i].values
                    found = [(k, *searcher.search(terms, top)) for k, terms in queries]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([k for k, _, _ in found], [len(at) for _, at, _ in found]), pa.int64()),
                         ids.take(pa.array(np.concatenate([at for _, at, _ in found]))),
                         pa.array(np.concatenate([s for _, _, s in found]))], ["k", "doc_id", "score"])

        return self.segments.drop("n_terms").mapInArrow(run, schema)

    def rank(self, items: DataFrame, top=TOP, block=ITEM_BLOCK) -> DataFrame:
        """item_id, rank, doc_id, score of the `top` best documents of every item (item_id, text)."""
        kind = items.schema["item_id"].dataType
        out, rows = None, []

        def answered(rows):
            terms = [item_terms(r.text) for r in rows]
            df = self.frequencies(set().union(*terms)) if rows else {}
            weights = {t: weight(self.n_docs, n) for t, n in df.items()}
            queries = [(k, {t: n * weights[t] for t, n in c.items() if t in weights}) for k, c in enumerate(terms)]
            queries = [q for q in queries if q[1]]
            named = self.spark.createDataFrame([(k, r.item_id) for k, r in enumerate(rows)], T.StructType([
                T.StructField("k", T.LongType()), T.StructField("item_id", kind)]))
            best = Window.partitionBy("k").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
            hits = self._hits(queries, top) if queries else self._hits([], top).where("false")
            kept = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            return kept.join(named, "k").select("item_id", "rank", "doc_id", "score")

        for r in items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
            rows.append(r)
            if len(rows) == block:
                part = answered(rows)
                out, rows = part if out is None else out.unionByName(part), []
        if rows or out is None:
            part = answered(rows)
            out = part if out is None else out.unionByName(part)
        return out


def oracle(top=TOP) -> str:
    """DuckDB SQL for the ranking of `benchmark` items over `documents`."""
    upper = "".join(map(chr, range(0x41, 0x5B)))
    terms = (rf"unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), "
             r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term")
    return rf"""
with numbered as (select row_number() over () as r, doc_id, text from documents),
w as (select r, {terms} from numbered),
tf as (select r, term, count(*) as tf from w group by all),
len as (select r, sum(tf) as n from tf group by r),
whole as (select count(*) as n_docs, sum(n) as n_terms from len),
m as (select r, cast(75 + (25 * n * n_docs) // n_terms as bigint) as m from len, whole),
q as (select k, item_id, term, count(*) as times from (
    select k, item_id, {terms} from (select row_number() over () as k, item_id, text from benchmark)) group by all),
df as (select term, count(*) as df from tf where term in (select term from q) group by term),
wt as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as w from df, whole),
s as (select k, item_id, r, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
    from q join wt using (term) join tf using (term) join m using (r) group by all),
ranked as (select k, item_id, doc_id, score,
    row_number() over (partition by k order by score desc, doc_id nulls last) as rank from s join numbered using (r)
    where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= {top}"""
