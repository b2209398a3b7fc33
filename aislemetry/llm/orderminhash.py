"""Near-duplicate classes by Order MinHash and banded alignment.

A text is the sequence of its five-word shingles, each labelled with its occurrence number (first, second, ...), so
every element of a sequence is unique. A text of one to four words is one shingle.

* Sketch: for each hash function the two labelled shingles with the least values are kept *in text order*; such an
  ordered pair collides for two texts about as often as they share content in the same order, which follows edit
  similarity rather than set overlap. Two ordered pairs make a bucket key; there are `BANDS` keys per text.
* Verification: matched shingles further apart than the band that similarity `SIMILARITY` allows cannot lie on an
  acceptable alignment and are dropped; the longest increasing run of the rest is the alignment. With m aligned of
  n1 and n2 shingles the similarity is m / (n1 + n2 - m), and 0.8 or more is a link.
* Classes: connected components of the links, named by their least doc_id.

Exact copies collapse by SHA-256 first, whatever their number. A bucket of up to `SMALL` different texts yields all
its pairs. A larger one links its members to a few centres per round. Members that are still outside the bucket's
largest class are then compared with all mates in other classes, block against block: pairs that have as many shingles
in common as an alignment needs are aligned inside the same task, unless links found there join their classes already.
That filter is exact, so large and small buckets miss the same pairs: those that share no bucket. No pairs of a large
group are written out: its work is in blocks of bounded size, which yield links only.

Defined results: null and empty texts, and texts without a word, are classes of equal texts only; repeated rows and
repeated doc_ids are classified by text; columns of the input are kept, ones that clash with outputs are replaced.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetry.llm.common import Words, buffers, gathered, mix, seeds, slices, texts
from aislemetry.llm.components import components
from aislemetry.session import cut

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 2                    # ordered pairs in one bucket key
KEPT = 2                    # labelled shingles in one ordered pair
SMALL = 8                   # bucket size up to which all pairs are taken
CENTRES = 2                 # centres of a larger bucket in each round
ROUNDS = 2
WIDE, NARROW = 4_000, 20_000  # rows with texts or sketches, and rows of ids, that one task reads
JOIN_ROWS = 200             # pairs of one text that one join key holds
BLOCK = 128                 # members of a block, about
BLOCK_BYTES = 1 << 19       # text in a block, about
COLUMNS = 1 << 14           # different shingles of two blocks that are counted in one pass


def labelled(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labelled shingles in text order, their rows, and shingles per row."""
    at, key = words.windows(SHINGLE)
    row = words.row[at]
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    if len(short):
        first = np.searchsorted(words.row, short)
        whole = np.zeros(len(short), np.uint64)
        for j, factor in enumerate(seeds(SHINGLE, 7)):
            has = words.count[short] > j
            whole[has] += words.hash[first[has] + j] * (factor | np.uint64(1))
        order = np.argsort(np.concatenate([row, short]), kind="stable")
        key, row = np.concatenate([key, mix(whole)])[order], np.concatenate([row, short])[order]
    per_row = np.bincount(row, minlength=words.rows)
    own = key ^ (row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))
    label = np.empty(len(own), np.uint64)
    label[order] = np.arange(len(own)) - begin
    return mix(key + label * np.uint64(0x9E3779B97F4A7C15)), row, per_row


def sketches(words: Words, bands=BANDS, rows=ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have words, their bucket keys [n, bands], 32 bits of each ordered pair [n, bands * rows])."""
    value, row, per_row = labelled(words)
    have = np.flatnonzero(per_row)
    if not len(have):
        return have, np.zeros((0, bands), np.uint64), np.zeros((0, bands * rows), np.uint32)
    start = np.concatenate([[0], np.cumsum(per_row[have])[:-1]])
    owner = np.repeat(np.arange(len(have)), per_row[have])
    one = per_row[have] == 1
    keys = np.zeros((len(have), bands), np.uint64)
    pairs = np.zeros((len(have), bands * rows), np.uint32)
    factors = seeds(bands * rows, 11) | np.uint64(1)
    for j, factor in enumerate(factors):
        h = value * factor
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        low = np.minimum.reduceat(h, start)
        at_low = np.flatnonzero(h == low[owner])
        # Multiplication by odd numbers and the xor shift are bijections and the labelled shingles are unique, so
        # the least value has one position.
        first = at_low[np.searchsorted(at_low, start)]
        h[first] = np.uint64(0xFFFFFFFFFFFFFFFF)
        low2 = np.minimum.reduceat(h, start)
        at_low2 = np.flatnonzero(h == low2[owner])
        second = at_low2[np.searchsorted(at_low2, start)]
        a, b = np.minimum(first, second), np.maximum(first, second)
        pair = mix(value[a] * np.uint64(3) + value[b] * np.uint64(0xC2B2AE3D27D4EB4F))
        pair[one] = value[start[one]]
        pairs[:, j] = pair >> np.uint64(32)
        k = j // rows
        keys[:, k] = mix(keys[:, k] + pair + np.uint64(k + 1))
    return have, keys, pairs


def aligned(a: np.ndarray, b: np.ndarray, similarity=SIMILARITY) -> float:
    """Banded alignment similarity of two labelled sequences; 0 when it cannot reach `similarity`."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    total = n + m
    need = int(np.ceil(similarity * total / (1 + similarity) - 1e-9))
    if min(n, m) < need:
        return 0.0
    if n == m and np.array_equal(a, b):
        return 1.0
    band = total - 2 * need                  # more unaligned shingles than this are too many
    order = np.argsort(b)
    at = np.searchsorted(b[order], a)
    at[at == m] = 0
    hit = b[order][at] == a
    i, j = np.flatnonzero(hit), order[at[hit]]
    near = np.abs(i - j) <= band
    j = j[near]
    if len(j) < need:
        return 0.0
    if np.all(np.diff(j) > 0):
        length = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        length = len(tails)
    return length / (total - length) if length >= need else 0.0


# ---------------------------------------------------------------- Spark side

def _sketched(batches, bands, rows):
    for batch in batches:
        column = texts(batch.column("text"))
        shas = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in column.to_pylist()]
        buckets: list = [None] * batch.num_rows
        sketch: list = [None] * batch.num_rows
        for row, data, offsets in slices(batch):
            have, keys, pairs = sketches(Words(data, offsets), bands, rows)
            for i, key, pair in zip(have.tolist(), keys.view(np.int64), pairs):
                buckets[row + i], sketch[row + i] = key, pair.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(shas, pa.binary()), pa.array(buckets, pa.list_(pa.int64())),
             pa.array(sketch, pa.binary())], names=["doc_id", "sha", "buckets", "sketch"])


def _sequences(column: pa.Array) -> list[np.ndarray]:
    data, offsets = buffers(texts(column))
    value, _, per_row = labelled(Words(data, offsets))
    return np.split(value, np.cumsum(per_row)[:-1])


def _verified(batches, similarity):
    for batch in batches:
        a, b = batch.column("text_a"), batch.column("text_b")
        good = np.zeros(batch.num_rows, bool)
        for k in range(0, batch.num_rows, 64):
            left, right = _sequences(a.slice(k, 64)), _sequences(b.slice(k, 64))
            good[k:k + 64] = [aligned(x, y, similarity) > 0 for x, y in zip(left, right)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")],
                                         names=["a", "b"]).filter(pa.array(good))


def _with_text(pairs: DataFrame, load: DataFrame, distinct: DataFrame, side: str) -> DataFrame:
    """Join the text of one side; a text with many pairs is dealt over several keys, `load` tells how many."""
    spread = (distinct.join(load, distinct["rep"] == load[side], "inner")
              .select(F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"), side,
                      F.col("text").alias(f"text_{side}")))
    return pairs.withColumn("__part", F.col(f"__part_{side}")).join(spread, [side, "__part"]).drop("__part")


def links(pairs: DataFrame, distinct: DataFrame, similarity=SIMILARITY) -> DataFrame:
    """Those (a, b) of `pairs` whose texts align. Both loads are counted on the bare ids, before any text is there."""
    load = {side: pairs.groupBy(side).agg(F.ceil(F.count("*") / F.lit(JOIN_ROWS)).cast("int").alias("__parts"))
            for side in ("a", "b")}
    dealt = pairs
    for side, other in (("a", "b"), ("b", "a")):
        dealt = dealt.join(load[side], side).withColumn(
            f"__part_{side}", F.pmod(F.xxhash64(other), F.col("__parts")).cast("int")).drop("__parts")
    full = _with_text(_with_text(dealt, load["a"], distinct, "a"), load["b"], distinct, "b")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(
        lambda it: _verified(it, similarity), "a long, b long")


def _plain(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def _sha(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256))


def _texts_of(wanted: DataFrame, plain: DataFrame) -> DataFrame:
    """(rep, text) for the wanted (rep, sha, least). The id in the key keeps copies of one text apart."""
    owner = plain.select("doc_id", _sha().alias("sha"), "text")
    return (owner.join(wanted, (owner["sha"] == wanted["sha"]) & owner["doc_id"].eqNullSafe(wanted["least"]))
            .select("rep", "text").dropDuplicates(["rep"]))


def classes(docs: DataFrame, doc_id="doc_id", text="text", similarity=SIMILARITY, bands=BANDS, rows=ROWS,
            small=SMALL) -> DataFrame:
    """(sha, least, n_same, rep, class_id) of every different text.

    `sha` is the text's SHA-256, `least` its least doc_id, `n_same` the rows that share both, `rep` the number it has
    in links: `least`, or a hash where that is null or shared by different texts.
    """
    plain = _plain(docs, doc_id, text)
    sketched = plain.mapInArrow(lambda it: _sketched(it, bands, rows), "doc_id long, sha binary, buckets array<long>, "
                                 "sketch binary")
    by_id = sketched.groupBy("sha", "doc_id").agg(F.count("*").alias("n"), F.first("buckets").alias("buckets"),
                                              F.first("sketch").alias("sketch"))
    groups = gathered(by_id.groupBy("sha").agg(
        F.min("doc_id").alias("least"), F.min_by("n", F.coalesce("doc_id", F.lit(2 ** 63 - 1))).alias("n_same"),
        F.first("buckets").alias("buckets"), F.first("sketch").alias("sketch")), WIDE)
    clash = groups.groupBy("least").agg(F.count("*").alias("n"), F.min("sha").alias("first")).where("n > 1")
    clash = gathered(clash.select(F.col("least").alias("l"), "first"), NARROW)
    groups = groups.join(clash, F.col("least").eqNullSafe(F.col("l")), "left").withColumn(
        "rep", F.when(F.col("least").isNotNull() & (F.col("first").isNull() | (F.col("first") == F.col("sha"))),
                      F.col("least")).otherwise(F.xxhash64("sha"))).drop("l", "first")
    keyed = groups.select("rep", F.posexplode_outer("buckets").alias("band", "bucket")).where("bucket is not null")
    size = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    mates = gathered(keyed.select("rep", "band", "bucket").join(size, "bucket"), NARROW)
    reps = mates.select("rep").distinct()
    distinct = gathered(_texts_of(groups.join(reps, "rep", "left_semi").select("rep", "sha", "least"), plain), WIDE)

    few = mates.where(F.col("n") <= small).select("bucket", "rep")
    pairs = (few.alias("x").join(few.alias("y"), "bucket")
             .where("x.rep < y.rep").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())
    pairs = gathered(pairs, NARROW)
    found = gathered(links(pairs, distinct, similarity), NARROW)
    many = mates.where(F.col("n") > small).select("bucket", "band", "rep")
    if many.take(1):
        label, tried = None, pairs
        for turn in range(ROUNDS):
            fresh = gathered(_centre_pairs(many, label, turn).join(tried, ["a", "b"], "left_anti"), NARROW)
            found = _known(label, found).unionByName(links(fresh, distinct, similarity))
            tried = tried.unionByName(fresh)
            label = components(found)
        found = _known(label, found).unionByName(
            _apart(many, label, groups.select("rep", "sketch"), distinct, bands, rows, similarity))
    label = components(found)
    return (groups.drop("buckets", "sketch").join(label, groups["rep"] == label["node"], "left").drop("node")
            .withColumn("class_id", F.coalesce("component", "rep")).drop("component"))


def _known(label: DataFrame | None, found: DataFrame) -> DataFrame:
    """Edges that stand for all links so far: the classes once there are any, else the links themselves."""
    if label is None:
        return found
    return label.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _labels(many: DataFrame, label: DataFrame | None) -> DataFrame:
    if label is None:
        return many.withColumn("component", F.col("rep"))
    return many.join(label, many["rep"] == label["node"], "left").select(
        "bucket", "band", "rep", F.coalesce("component", "rep").alias("component"))


def _centre_pairs(many: DataFrame, label: DataFrame | None, turn: int) -> DataFrame:
    """Members of large buckets against a few centres of their bucket, where the classes still differ.

    The first centre is the least id, which most buckets of one group share; the others vary with the bucket. Both
    come from aggregates, so no bucket meets in one task.
    """
    now = _labels(many, label)
    if turn == 0:
        picks = now.groupBy("bucket").agg(F.min("rep").alias("c"))
    else:
        picks = now.groupBy("bucket").agg(F.array_distinct(F.array(
            *[F.min_by("rep", F.xxhash64("rep", F.lit(turn * CENTRES + k))) for k in range(CENTRES)])).alias("c")) \
            .select("bucket", F.explode("c").alias("c"))
    if label is None:
        centres = picks.withColumn("own", F.col("c"))
    else:
        own = label.select(F.col("node").alias("c"), F.col("component").alias("own"))
        centres = picks.join(own, "c", "left").withColumn("own", F.coalesce("own", "c"))
    return (now.join(centres, "bucket").where("component <> own")
            .select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct())


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each sequence of `a` has in common with each of `b`; elements of a sequence are unique."""
    key, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    own = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    left = own < len(a)
    wanted = np.flatnonzero((np.bincount(at[left], minlength=len(key)) > 0)
                            & (np.bincount(at[~left], minlength=len(key)) > 0))
    place = np.full(len(key), -1)
    place[wanted] = np.arange(len(wanted))
    place = place[at]
    common = np.zeros((len(a), len(b)), np.float32)
    # Counts stay whole numbers below 2^24 in one pass; the sum is rounded to them.
    for begin in range(0, len(wanted), COLUMNS):
        inside = (place >= begin) & (place < begin + COLUMNS)
        seen = np.zeros((len(a) + len(b), min(COLUMNS, len(wanted) - begin)), np.float32)
        seen[own[inside], place[inside] - begin] = 1
        common += seen[:len(a)] @ seen[len(a):].T
    return np.rint(common).astype(np.int64)


def _aligned_blocks(batches, bands, rows, similarity):
    """Links between two blocks: members in different classes whose shingles suffice and whose texts align.

    A pair is looked at in the first band that it shares. One link joins two classes; further ones are not sought.
    """
    for batch in batches:
        for k in range(batch.num_rows):
            left, right = batch.column("left")[k].values, batch.column("right")[k].values
            x, y = (np.frombuffer(b"".join(side.field("sketch").to_pylist()), np.uint32).reshape(len(side), -1)
                    for side in (left, right))
            bucketed = (x[:, None, :] == y[None, :, :]).reshape(len(x), len(y), bands, rows).all(3)
            own_x, own_y = left.field("component").to_numpy(), right.field("component").to_numpy()
            open_ = (bucketed.argmax(2) == batch.column("band")[k].as_py()) & (own_x[:, None] != own_y)
            rows_x, rows_y = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
            if not len(rows_x):
                continue
            seq_x = _sequences(left.field("text").take(pa.array(rows_x)))
            seq_y = _sequences(right.field("text").take(pa.array(rows_y)))
            own_x, own_y = own_x[rows_x], own_y[rows_y]
            total = np.add.outer([len(s) for s in seq_x], [len(s) for s in seq_y])
            # Aligned shingles are common ones, so a pair with fewer than `aligned` needs cannot link.
            need = np.ceil(similarity * total / (1 + similarity) - 1e-9)
            i, j = np.nonzero(open_[np.ix_(rows_x, rows_y)] & (shared(seq_x, seq_y) >= need))
            linked = np.zeros(len(i), bool)
            for n, (p, q) in enumerate(zip(i.tolist(), j.tolist())):
                if own_x[p] != own_y[q] and aligned(seq_x[p], seq_y[q], similarity) > 0:
                    linked[n] = True
                    gone, stays = own_x[p], own_y[q]
                    own_x[own_x == gone] = stays
                    own_y[own_y == gone] = stays
            a, b = left.field("rep").to_numpy()[rows_x[i[linked]]], right.field("rep").to_numpy()[rows_y[j[linked]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _apart(many: DataFrame, label: DataFrame, sketch: DataFrame, distinct: DataFrame, bands: int, rows: int,
           similarity: float) -> DataFrame:
    """Links of bucket mates in different classes, one side outside the bucket's largest class."""
    length = distinct.select("rep", F.octet_length("text").alias("size"))
    now = gathered(_labels(many, label).join(length, "rep"), NARROW)
    sizes = now.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    largest = F.max_by("size", F.struct("n", "component"))
    main = sizes.groupBy("bucket").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"),
        F.greatest(F.ceil((F.sum("n") - F.max("n")) / F.lit(BLOCK)),
                   F.ceil((F.sum("size") - largest) / F.lit(BLOCK_BYTES))).alias("blocks_out"),
        F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(BLOCK_BYTES))).alias("blocks"),
        F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    open_ = gathered(now.drop("size").join(main, "bucket"), NARROW)
    detail = distinct.join(sketch, "rep")
    member = F.collect_list(F.struct("rep", "component", "sketch", "text"))

    def blocks(side, number, name):
        # Blocks by a hash of the member, so they come from no single task.
        block = F.pmod(F.xxhash64("rep"), F.col(number)).alias("block")
        return side.join(detail, "rep").groupBy("bucket", "band", block).agg(member.alias(name)).drop("block")

    left = blocks(open_.where("component <> main"), "blocks_out", "left")
    both = left.join(blocks(open_, "blocks", "right").drop("band"), "bucket").select("band", "left", "right")
    return both.mapInArrow(lambda it: _aligned_blocks(it, bands, rows, similarity), "a long, b long").distinct()


def label_documents(docs: DataFrame, doc_id="doc_id", text="text", keep=None, **options) -> DataFrame:
    """The `keep` columns (default: all) of every row of `docs` with `class_id`, the least doc_id of its class."""
    names = [c for c in (keep or docs.columns) if c != "class_id"]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _sha(text).alias("sha"))
    found = classes(docs, doc_id, text, **options).select("sha", "class_id")
    return own.join(found, "sha").select("row.*", "class_id")


def one_per_class(docs: DataFrame, doc_id="doc_id", text="text", **options) -> DataFrame:
    """The documents with one row of each class: the text of the least `rep`, which is the least doc_id.

    Texts move once, to meet the list of winners. Only rows that repeat both id and text go through a further
    de-duplication.
    """
    found = classes(docs, doc_id, text, **options)
    winners = cut(found.where(F.col("rep") == F.col("class_id")).select("sha", "least", "n_same"))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _sha(text).alias("own"),
                         F.col(f"`{doc_id}`").cast("long").alias("id"))

    def met(side):
        return tagged.join(side, (tagged["own"] == side["sha"]) & tagged["id"].eqNullSafe(side["least"]))

    once = met(winners.where("n_same = 1")).select("row.*")
    again = met(winners.where("n_same > 1")).dropDuplicates(["sha"]).select("row.*")
    return once.unionByName(again)
