"""Source divergence audit by count-level bitmaps.

For every language the terms in at least `MIN_DOCS` of its documents are kept. A group is a (language, source) or a
whole language; a term that occurs c times in a group has the integer likelihood p = 1 + floor(10^9 (c + 1) / (N + V)),
N the group's kept occurrences and V the language's kept terms, so p depends on the group and on c alone. Two groups
differ by f = floor((p - q)^2 / q), summed over all kept terms.

Terms get ids by blocks of about `BLOCK` (a hash picks the block, so no task sees a whole vocabulary). Per block, group
and count one sparse bitset of term ids is stored, as 64-bit words. The joint cells (count here, count there) of two
groups are the set bits of the AND of two words; each is multiplied by f. Zeros have no bitsets: with n the terms of the
block and J the joint cells,

    sum f = sum J (f(a,b) - f(a,0) - f(0,b) + f(0,0)) + sum n_a f(a,0) + sum n_b f(0,b) + (n - n_A - n_B) f(0,0)

Blocks are summed. Sources are dealt to tiles of `TILE`; a task holds one block of two tiles, so its size has a bound.
All arithmetic is in integers; sums wrap at 64 bits in between and are exact as long as a result fits.

Defined results: null text, lang and source count as ''; repeated rows count each; a group without terms still has its
rows; a language without kept terms gives value 0 for every pair; one source alone has no pairs; other columns are
ignored; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislemetry.llm.common import SLICE_BYTES, Words, buffers, mix, texts
from aislemetry.session import cut

MIN_DOCS = 3
SCALE = 1_000_000_000       # fixed value: unit of p
TOP_TERMS = 200             # fixed value: ranks of the term part
BLOCK = 2_048               # term ids of a block, on average
TILE = 64                   # sources of a tile
COUNT_BYTES = 12 << 20      # text that is counted before its sums leave a task
BROADCAST_GROUPS = 100_000  # groups are broadcast up to this many rows, joined by (lang, source) beyond

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BLANK = np.ones(256, bool)
_BLANK[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_K = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- counting

def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as one text array."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    near = np.int32 if len(data) < 1 << 31 else np.int64
    at = np.repeat((starts - offsets[:-1]).astype(near), sizes)
    at += np.arange(offsets[-1], dtype=near)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)),
                                            pa.py_buffer(np.ascontiguousarray(data[at])))


def parts_of(batches, limit=COUNT_BYTES):
    """Parts of Arrow batches with at most `limit` bytes of text, one row at least."""
    for batch in batches:
        offsets = buffers(texts(batch.column("text")))[1]
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def counted(batches):
    """Occurrences and documents per (lang, source, term) of every part of the Arrow batches."""
    for batch in parts_of(batches):
        data, offsets = buffers(texts(batch.column("text")))
        data = _LOWER[data]
        keys = pa.table({"lang": batch.column("lang"), "source": batch.column("source")})
        pairs: dict = {}
        group = np.array([pairs.setdefault(k, len(pairs)) for k in zip(
            keys["lang"].to_pylist(), keys["source"].to_pylist())], np.int32)
        near = np.int32 if len(data) < 1 << 31 else np.int64
        found, row, rows = [], 0, len(offsets) - 1
        while row < rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
            low = offsets[row]
            words = Words(data[low:offsets[end]], offsets[row:end + 1] - low, _BLANK)
            if len(words.start):
                # One entry per (row, term): its first place and how often it stands there.
                _, at, n = np.unique(mix(words.hash + words.row.astype(np.uint64) * _K), return_index=True,
                                     return_counts=True)
                limit = offsets[words.row[at] + row + 1] - low
                after = np.append(words.start[1:], len(words.inside))[at]
                found.append((words.hash[at], group[words.row[at] + row], n.astype(np.int32), (words.start[at] + low).astype(near),
                              (np.minimum(after, limit) + low).astype(near)))
            row = end
        if not found:
            continue
        hashes, groups, n, starts, ends = map(np.concatenate, zip(*found))
        del found, words
        key = mix(hashes ^ mix(groups.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sums, size = np.add.reduceat(n[order].astype(np.int64), first), np.diff(np.append(first, len(order)))
        at = order[first]
        del key, order, hashes
        groups, starts = groups[at], starts[at].astype(np.int64)
        ends = _trimmed(data, starts, ends[at].astype(np.int64))
        names = list(pairs)
        yield pa.RecordBatch.from_arrays([
            pa.array([names[g][0] for g in groups], pa.string()), pa.array([names[g][1] for g in groups], pa.string()),
            _gathered(data, starts, ends).cast(pa.string()), pa.array(sums), pa.array(size)],
            ["lang", "source", "term", "n", "docs"])


def _trimmed(data, starts, ends):
    """Ends of the words without the blanks that follow them."""
    blanks = np.flatnonzero(_BLANK[data])
    if not len(blanks):
        return ends
    at = np.minimum(np.searchsorted(blanks, starts), len(blanks) - 1)
    return np.where((blanks[at] >= starts) & (blanks[at] < ends), blanks[at], ends)


def cells(docs: DataFrame, min_docs=MIN_DOCS) -> DataFrame:
    """lang, source, term, n and lang_n of every kept term that occurs in the group; `head` marks one row per term."""
    raw = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = raw.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    sums = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    return (sums.withColumns({"lang_docs": F.sum("docs").over(whole), "lang_n": F.sum("n").over(whole),
                              "head": F.row_number().over(whole.orderBy("source")) == 1})
            .where(F.col("lang_docs") >= min_docs).drop("docs", "lang_docs"))


# ---------------------------------------------------------------- integer formulas

def likelihood(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), in decimals where 64 bits do not hold the product."""
    wide = (count + 1).cast("decimal(20,0)") * F.lit(SCALE)
    return F.when(count < 9_000_000_000, _div((count + 1) * SCALE, total)).otherwise(
        _div(wide, total.cast("decimal(20,0)"))) + 1


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of two longs."""
    return F.call_function("div", a, b)


def difference(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


# ---------------------------------------------------------------- bitsets

def sources(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every occurring (lang, source) with n_total, n_terms (of the language), lang_total and its tile."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("head").alias("n_terms"))
    every = Window.partitionBy("lang")
    return (groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("own", F.lit(0).cast("long")).alias("n_total"),
        F.coalesce("n_terms", F.lit(0).cast("long")).alias("n_terms"),
        F.coalesce("lang_total", F.lit(0).cast("long")).alias("lang_total"),
        _div(F.row_number().over(every.orderBy("source")).cast("long") - 1, F.lit(TILE)).alias("tile"))
        .withColumn("tiles", F.max("tile").over(every) + 1)
        .withColumn("blocks", F.greatest(F.lit(1).cast("long"), _div(F.col("n_terms") + (BLOCK - 1), F.lit(BLOCK)))))


def bitsets(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, block, n_block, source, n, word, bits: which terms of the block occur n times in the source."""
    in_block = Window.partitionBy("lang", "block")
    ids = (kept.join(groups.select("lang", "source", "blocks"), ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
           .withColumn("id", F.dense_rank().over(in_block.orderBy("term")) - 1)
           .withColumn("n_block", F.max("id").over(in_block).cast("long") + 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("id", F.lit(64)).cast("int"))
    return ids.groupBy("lang", "block", "n_block", "source", "n", _div(F.col("id").cast("long"), F.lit(64)).alias("word")
                       ).agg(F.bit_or(one).alias("bits"))


def _block_sums(source, zero, at, word, p, bits, n_block):
    """Sum of f over one block for all ordered pairs of sources, as a matrix.

    zero: p of a term that does not occur, per source; at, word, p, bits: one entry per stored word of a bitset.
    """
    size = np.bitwise_count(bits).astype(np.int64)
    held = np.zeros(len(source), np.int64)
    np.add.at(held, at, size)
    empty = _f(zero[:, None], zero[None, :])
    total = (n_block - held[:, None] - held[None, :]) * empty
    strip = max(1, (1 << 20) // max(1, len(source)))
    for a in range(0, len(at), strip):
        s = slice(a, a + strip)
        np.add.at(total, at[s], size[s, None] * _f(p[s, None], zero[None, :]))
        np.add.at(total.T, at[s], size[s, None] * _f(zero[None, :], p[s, None]))
    order = np.argsort(word, kind="stable")
    at, word, p, bits = at[order], word[order], p[order], bits[order]
    bounds = np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), len(word)) if len(word) else [0]
    for low, high in zip(bounds[:-1], bounds[1:]):
        strip = max(1, (1 << 20) // (high - low))
        for a in range(low, high, strip):
            i, j = np.nonzero(bits[a:min(a + strip, high), None] & bits[None, low:high])
            i, j = i + a, j + low
            joint = np.bitwise_count(bits[i] & bits[j]).astype(np.int64)
            zi, zj = zero[at[i]], zero[at[j]]
            np.add.at(total, (at[i], at[j]), joint * (
                _f(p[i], p[j]) - _f(p[i], zj) - _f(zi, p[j]) + empty[at[i], at[j]]))
    return total


def _pair_sums(pdf):
    """Partial pair sums of one (lang, block, tile, tile)."""
    import pandas as pd
    source, at = np.unique(pdf["source"].to_numpy(object).astype(str), return_inverse=True)
    p, bits = pdf["p"].to_numpy(np.int64), pdf["bits"].to_numpy(np.int64).view(np.uint64)
    none = pdf["n"].to_numpy() == 0
    zero, tile = np.zeros(len(source), np.int64), np.zeros(len(source), np.int64)
    zero[at[none]], tile[at[none]] = p[none], pdf["tile"].to_numpy(np.int64)[none]
    some = ~none
    total = _block_sums(source, zero, at[some], pdf["word"].to_numpy(np.int64)[some], p[some], bits[some],
                        int(pdf["n_block"].max()))
    a, b = int(pdf["one"].iloc[0]), int(pdf["two"].iloc[0])
    wanted = (tile[:, None] != tile[None, :]) if a != b else ~np.eye(len(source), dtype=bool)
    i, j = np.nonzero(wanted)
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "source": source[i], "item": source[j], "value": total[i, j]})


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value."""
    sets = cut(bitsets(kept, groups).join(groups, ["lang", "source"]).withColumn(
        "p", likelihood(F.col("n"), F.col("n_total") + F.col("n_terms"))))
    sizes = sets.groupBy("lang", "block").agg(F.max("n_block").alias("n_block"))
    zeros = (groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .join(sizes, ["lang", "block"], "left")
             .withColumns({"n": F.lit(0).cast("long"), "word": F.lit(0).cast("long"), "bits": F.lit(0).cast("long"),
                           "n_block": F.coalesce("n_block", F.lit(0).cast("long")),
                           # Where a language has no kept term the block is empty and any p will do.
                           "p": likelihood(F.lit(0).cast("long"), F.greatest(
                               F.lit(1).cast("long"), F.col("n_total") + F.col("n_terms")))}))
    columns = ["lang", "block", "n_block", "source", "n", "word", "bits", "p", "tile", "tiles"]
    both = sets.select(columns).unionByName(zeros.select(columns))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    dealt = both.withColumn("other", other).withColumns({
        "one": F.least("tile", "other"), "two": F.greatest("tile", "other")}).drop("other", "tiles")
    parts = dealt.groupBy("lang", "block", "one", "two").applyInPandas(
        _pair_sums, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def over_used(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a term more likely here than in the language), value."""
    rows = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        likelihood(F.col("n"), F.col("n_total") + F.col("n_terms")).alias("p"),
        likelihood(F.col("lang_n"), F.col("lang_total") + F.col("n_terms")).alias("q"))
    return rows.where("p > q").select("lang", "source", "item", difference(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_docs=MIN_DOCS, top_terms=TOP_TERMS) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    kept = cut(cells(docs, min_docs))
    groups = cut(sources(docs, kept))
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")

    def ranked(rows, part):
        return rows.withColumn("rank", F.row_number().over(best)).select(
            "lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    return ranked(pairs(kept, groups), "pair").unionByName(
        ranked(over_used(kept, groups), "term").where(F.col("rank") <= top_terms))


def oracle(min_docs=MIN_DOCS, top_terms=TOP_TERMS) -> str:
    """DuckDB SQL for `audit` over documents, by a dense table of counts."""
    upper = "".join(map(chr, range(0x41, 0x5B)))
    return rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
        translate(coalesce(text, ''), '{upper}', '{upper.lower()}') as body from documents),
w as (select r, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as lang_n from w group by all having count(distinct r) >= {min_docs}),
c as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select lang, count(*) as n_terms, sum(lang_n) as lang_total from kept group by all),
t as (select lang, source, sum(n) as n_total from c group by all),
dense as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, coalesce(t.n_total, 0) as n_total, v.n_terms,
        k.lang_n, v.lang_total
    from g join kept k on k.lang = g.lang join v on v.lang = g.lang left join t on t.lang = g.lang and t.source = g.source
    left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (select lang, source, term, n, cast(1 + {SCALE}::hugeint * (n + 1) // (n_total + n_terms)::hugeint as bigint) as p,
        cast(1 + {SCALE}::hugeint * (lang_n + 1) // (lang_total + n_terms)::hugeint as bigint) as q from dense),
two as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select a.lang, a.source, b.source as item, cast(coalesce(two.value, 0) as bigint) as value
    from g a join g b on a.lang = b.lang and a.source <> b.source
    left join two on two.lang = a.lang and two.source = a.source and two.item = b.source),
term as (select lang, source, term as item, (p - q) * (p - q) // q as value from p where n > 0 and p > q),
ranked as (select lang, source, 'pair' as part, item, value,
        row_number() over (partition by lang, source order by value desc, item) as rank from pair
    union all select lang, source, 'term', item, value,
        row_number() over (partition by lang, source order by value desc, item) from term)
select lang, source, part, item, value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= {top_terms}"""
