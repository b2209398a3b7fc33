"""Operators for training text against brute force, round trips and held-out accuracy, with odd rows everywhere."""
import base64
import hashlib
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from aislemetry.llm import (bpe, compression, digest, langid, lstm_crf, mixing, orderminhash, pii, quality, queries,
                            token_rollup, toxicity)
from aislemetry.llm.common import Words
from aislemetry.llm.components import components

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class_id string, rate string"
PROSE = ("the rain fell on the old roof and nobody in the house heard it until morning came with a grey light over "
         "fields where two men had walked all night carrying a letter that neither of them could read aloud")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, columns that clash with outputs."""
    long = " ".join(f"w{k * 7919 % 10007}" for k in range(30_000))
    rows = [(1, PROSE, "en", "a", 9, "x", "y"), (2, PROSE, "en", "a", 9, "x", "y"), (2, PROSE, "en", "a", 9, "x", "y"),
            (3, None, None, None, None, None, None), (4, "", "de", "a", 0, "x", "y"), (None, "ab", "en", None, 2, "x", "y"),
            (None, None, None, None, None, None, None), (5, long, "en", "b", 1, "x", "y"),
            (6, PROSE.replace("morning", "evening"), "en", "a", 9, "x", "y"), (7, " \n\t ", "en", "a", 4, "x", "y"),
            (7, "x" * 5000, "en", "a", 5000, "x", "y"), (8, "ünï çödé +1 (722) 555-6978 a.b@c.de", "fr", "a", 9, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA)


def marks(spark, rows=((1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (6, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_digest(spark, odd):
    rows = digest.with_next(odd).collect()
    assert len(rows) == odd.count()
    order = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy(
        F.coalesce("doc_id", F.lit(-2 ** 63)).desc(), F.xxhash64(F.coalesce("text", F.lit(""))).desc()).collect()
    want = Counter()
    for k, row in enumerate(order):
        n, following = len(row["text"]), order[(k + 1) % len(order)]["text"]
        edited = row["text"][:n - n // 3] + following[:n // 3]
        a, b, c = (digest.fingerprint(t) for t in (row["text"], edited, following))
        want[(row["doc_id"], n, hashlib.sha256(edited.encode()).hexdigest(), a, b, digest.likeness(a, b),
              digest.likeness(a, c))] += 1
    assert Counter(map(tuple, rows)) == want
    assert digest.with_next(odd.limit(0)).count() == 0
    assert digest.likeness(*[digest.fingerprint(PROSE)] * 2) == 1.0
    assert {r["fingerprint"] for r in digest.fingerprints(odd.where("text is null")).collect()} == {digest.fingerprint("")}


def held_out_accuracy(spark, found, mark, base, held):
    docs = found.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert docs
    return sum(r["predicted"] == r[mark] for r in docs) / len(docs)


def test_quality(spark, odd):
    found = queries.QUERIES["op2_fourier_quality"](spark, "/root/testdata/sf0.01").cache()
    assert found.where("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    assert held_out_accuracy(spark, found, "quality", 3, 1) > 0.93
    assert quality.score(odd, marks(spark)).count() == odd.count()
    assert {r["score"] for r in quality.score(odd, marks(spark, [])).collect()} == {0.5}
    assert quality.score(odd.limit(0), marks(spark)).count() == 0
    assert quality.pooled([1, 3, 2, 5], [1, 1, 1, 1]) == [1, 2.5, 2.5, 5]


def test_normal_equations_match_one_matrix(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random((200, len(quality.NAMES))), rng.random(200)
    kernel = quality.Kernel(x.mean(0), x.std(0), features=6)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(5)
    cells = rows.mapInArrow(lambda it: quality._sums(it, kernel), "i int, j int, v double").groupBy("i", "j").agg(
        F.sum("v").alias("v")).collect()
    f = kernel(x)
    for r in cells:
        want = f[:, r["i"]] @ (y if r["j"] < 0 else f[:, r["j"]])
        assert abs(r["v"] - want) < 1e-6


def best_segments(s, off=0):
    """Ruzzo and Tompa's definition: the best segment, then what is left and right of it."""
    best = None
    for i in range(len(s)):
        total = 0
        for j in range(i, len(s)):
            total += s[j]
            if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                best = (i, j, total)
    if best is None:
        return []
    return best_segments(s[:best[0]], off) + [(best[0] + off, best[1] + off)] + best_segments(
        s[best[1] + 1:], off + best[1] + 1)


def test_segments_match_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(400):
        s = [-0.35 if rng.random() < 0.6 else round(float(rng.uniform(0.1, 2)), 4) for _ in range(rng.integers(0, 13))]
        at = [k for k, x in enumerate(s) if x > 0]
        assert [(a, b) for a, b, _ in toxicity.segments(at, [s[k] for k in at])] == best_segments(s)


def test_toxicity(spark, odd):
    found = queries.QUERIES["op3_toxic_segments"](spark, "/root/testdata/sf0.01").cache()
    assert held_out_accuracy(spark, found, "toxic", 5, 0) > 0.93
    for labels in (marks(spark), marks(spark, [])):
        rows = toxicity.score(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(odd.limit(0), marks(spark)).count() == 0


def test_mixing(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = mixing.mix(docs, labels, keep=("doc_id",)).collect()
    assert len(rows) == docs.count()
    p, t = np.array([r["p"] for r in rows]), np.array([r["n_tokens"] for r in rows], float)
    r = np.array([r["rate"] for r in rows])
    assert np.allclose(p.sum(1), 1) and (r >= 0).all()
    # Projected gradient by itself, document by document, to convergence.
    want = np.array([mixing.TARGET[d] for d in mixing.DOMAINS])
    x = np.ones(len(t))
    for _ in range(20_000):
        e = (p * (t * x)[:, None]).sum(0) / t.sum() - want
        x = np.maximum(0, x - (p @ e + mixing.RIDGE * (x - 1)) / (1 + mixing.RIDGE))
    reached = ((p * (t * r)[:, None]).sum(0) / t.sum() - want, (p * (t * x)[:, None]).sum(0) / t.sum() - want)
    assert np.abs(reached[0]).sum() < np.abs(reached[1]).sum() + 0.02
    again = {x["doc_id"]: x["copies"] for x in mixing.mix(docs, labels, keep=("doc_id",)).collect()}
    assert again == {x["doc_id"]: x["copies"] for x in rows}
    mixed = mixing.apply(docs, labels)
    assert mixed.columns == docs.columns
    assert Counter(x["doc_id"] for x in mixed.collect()) == Counter({k: v for k, v in again.items() if v})
    for frame in (odd, odd.limit(0)):
        for own in (marks(spark), marks(spark, [])):
            assert mixing.mix(frame, own).count() == frame.count()


def test_mixing_totals_are_those_of_the_optimum(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    mixed = mixing.mix(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), keep=("doc_id",)).cache()
    rows = mixed.collect()
    p, r = np.array([r["p"] for r in rows]), np.array([r["rate"] for r in rows])
    w = np.array([r["n_tokens"] for r in rows], float)
    w /= w.sum()
    want = np.array([mixing.TARGET[d] for d in mixing.DOMAINS])
    x = y = np.ones(len(w))
    for k in range(40_000):
        new = np.maximum(0, y - (p @ (p.T @ (w * y) - want) + mixing.RIDGE * (y - 1)) / (1 + mixing.RIDGE))
        y, x = new + (k % 300) / (k % 300 + 3) * (new - x), new
    near = 1.01 * mixing.PART * min(mixing.TARGET.values())
    assert np.abs(p.T @ (w * r) - p.T @ (w * x)).max() < near
    told = {t["domain"]: t for t in mixing.totals(mixed).collect()}
    assert np.allclose([told[d]["reached"] for d in mixing.DOMAINS], p.T @ (w * r))
    assert np.allclose([told[d]["target"] for d in mixing.DOMAINS], want)


def test_mixing_posteriors_are_exact(spark):
    model = {"lexicon": [], "prior": [-0.1, -5.0, -3.0, -6.0],
             "logs": {f: [[-0.3 * (d + 1) * b for b in range(len(e) + 1)] for d in range(4)]
                      for f, e in mixing.EDGES.items()}}
    docs = spark.createDataFrame([(PROSE,), ("a b",), ("# $ %",), (None,), ("x" * 3000,)], "text string")
    stat = mixing.statistics(F.col("text"), [])
    rows = docs.select(stat.alias("s"), mixing.posterior(mixing.membership(F.col("text"), model)["bins"], model).alias(
        "p")).collect()
    for row in rows:
        bins = {f: sum(row["s"][f] >= x for x in e) for f, e in mixing.EDGES.items()}
        e = np.exp([model["prior"][d] + sum(model["logs"][f][d][b] for f, b in bins.items()) for d in range(4)])
        assert np.allclose(row["p"], e / e.sum(), rtol=1e-9)


def test_langid(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(docs).where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.95
    rows = langid.predict(odd).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (3, 4))
    assert texts[4] == "" and langid.predict(odd.limit(0)).count() == 0


def test_rollup(spark, odd, tmp_path):
    ledger = token_rollup.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.commit("a", token_rollup.counts(odd, "words-1"))
    assert not ledger.commit("a", token_rollup.counts(odd, "words-1"))
    own = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals(["a", "a"]).collect()}
    want: Counter = Counter()
    for r in odd.collect():
        want[r["source"], r["lang"], "d"] += 1
        want[r["source"], r["lang"], "t"] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert own == {k[:2]: (want[(*k[:2], "d")], want[(*k[:2], "t")]) for k in want}
    ledger.commit("b", token_rollup.revised(odd, "words-1", "pieces-2"))
    assert {r["version"] for r in ledger.totals(["a", "b"]).collect()} == {"pieces-2"}
    ledger.commit("c", token_rollup.counts(odd, "pieces-2", -1))
    assert ledger.totals(["a", "b", "c"]).count() == 0
    ledger.compact(["a", "b"], "ab")
    assert sorted(map(tuple, ledger.totals(["ab"]).collect()), key=str) == sorted(
        map(tuple, ledger.totals(["a", "b"]).collect()), key=str)
    with pytest.raises(ValueError):
        ledger.commit("../x", token_rollup.counts(odd, "words-1"))


def test_rollup_of_many_keys_is_not_one_task(spark, tmp_path):
    many = spark.range(4000).selectExpr("id as doc_id", "'a b c' as text", "'en' as lang", "concat('s', id) as source")
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        ledger = token_rollup.Ledger(spark, str(tmp_path / "wide"))
        ledger.commit("a", token_rollup.counts(many, "words-1"))
    finally:
        spark.conf.set(setting, before)
    assert len(spark.read.parquet(ledger._path("a")).inputFiles()) > 1
    assert ledger.totals(["a"]).where("n_docs = 1 and n_tokens = 3").count() == 4000


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen: Counter = Counter()
    out = []
    for k in range(max(1, len(words) - 4) if words else 0):
        s = tuple(words[k:k + 5])
        seen[s] += 1
        out.append((s, seen[s]))
    return out


def brute_classes(rows):
    texts = sorted({t or "" for _, t in rows})
    seqs = [shingles(t) for t in texts]
    owner = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = set(seqs[i]), set(seqs[j])
            if a and b and len(a & b) / len(a | b) >= 0.8:
                owner = [owner[j] if o == owner[i] else o for o in owner]
    ids: dict = {}
    for d, t in rows:
        ids.setdefault(owner[texts.index(t or "")], []).append(d)
    return ids


def test_order_minhash(spark, odd):
    rng = np.random.default_rng(4)
    rows, base = [], [f"t{x}" for x in rng.integers(0, 900, 400)]
    for k in range(60):
        words = list(base) if k < 40 else [f"u{x}" for x in rng.integers(0, 900, 120)]
        for at in rng.integers(0, len(words), 3):
            words[at] = f"e{k}-{at}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, rows[50][1]) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got: dict = {}
    for r in orderminhash.label_documents(docs).collect():
        got.setdefault(r["class_id"], []).append(r["doc_id"])
    assert {k: sorted(v) for k, v in got.items()} == {min(v): sorted(v) for v in brute_classes(rows).values()}
    kept = orderminhash.one_per_class(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(got)
    labelled = orderminhash.label_documents(odd).collect()
    assert len(labelled) == odd.count()
    by_text = {}
    for r in labelled:
        by_text.setdefault(r["text"] or "", set()).add(r["class_id"])
    assert all(len(v) == 1 for v in by_text.values())
    one = orderminhash.one_per_class(odd)
    assert one.columns == odd.columns and one.count() == len({x for v in by_text.values() for x in v})
    assert orderminhash.label_documents(odd.limit(0)).count() == 0


def test_blocks_lose_no_link(spark):
    """Chains of short texts, each at similarity 0.8 to 0.85 with its neighbours only, compared in blocks alone."""
    rng = np.random.default_rng(8)
    texts, chain = [], []
    for words, n in ((13, 900), (16, 400)):                   # 9 and 12 shingles: 8 / 10 and 11 / 13 in common
        stream = [f"{words}w{x}" for x in rng.integers(0, 1 << 40, n + words)]
        texts += [" ".join(stream[k:k + words]) for k in range(n)]
        chain += [words] * n
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    _, keys, pairs = orderminhash.sketches(Words(data, np.cumsum([0, *map(len, texts)])))
    many = spark.createDataFrame([(int(x), band, k) for k, own in enumerate(keys.view(np.int64))
                                  for band, x in enumerate(own)], "bucket long, band int, rep long")
    many = many.join(many.groupBy("bucket").count().where("count > 1"), "bucket").select("bucket", "band", "rep")
    label = spark.range(len(texts)).selectExpr("id as node", "id as component")
    sketch = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(pairs)], "rep long, sketch binary")
    distinct = spark.createDataFrame([*enumerate(texts)], "rep long, text string")
    found = orderminhash._apart(many, label, sketch, distinct, orderminhash.BANDS, orderminhash.ROWS, 0.8).collect()
    assert {tuple(r) for r in found} == {(k, k + 1) for k in range(len(texts) - 1)
                                         if chain[k] == chain[k + 1] and (keys[k] == keys[k + 1]).any()}


def test_shared_counts():
    rng = np.random.default_rng(9)
    a, b = ([np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in sizes] for sizes in ((0, 5, 40), (1, 30)))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert orderminhash.shared(a, b).tolist() == want
    assert orderminhash.shared([], b).shape == (0, 2)


def test_alignment():
    a = np.arange(100, dtype=np.uint64)
    assert orderminhash.aligned(a, a) == 1.0
    assert abs(orderminhash.aligned(a, np.delete(a, [3, 50])) - 0.98) < 1e-9
    assert orderminhash.aligned(a, a[::-1]) == 0.0 and orderminhash.aligned(a, a[:70]) == 0.0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


@pytest.fixture(scope="module")
def tables():
    return bpe.Tables(queries.tokenizer_file())


def test_bpe_matches_the_library(spark, odd, tables):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(queries.tokenizer_file())
    library.no_truncation()
    library.no_padding()
    rng = np.random.default_rng(3)
    parts = ["th", "e", " ", "in", "ERT", "é", "ß", "Σ", "'s", "12", "!", "<|endoftext|>", "\n", "́", "\U00016ea5", "Ᲊ"]
    texts = ["".join(rng.choice(parts, n)) for n in [0, 5, 30, 30, 300]] + [PROSE, "ab" * 4000]
    coder = bpe.Encoder(tables)
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        ids, shown = coder.encode(text)
        own = np.frombuffer(ids, "<u4").tolist()
        assert own == want and shown == library.decode(want, skip_special_tokens=False)
        decoder = bpe.Decoder(tables)
        assert "".join(decoder.feed([i]) for i in own) + decoder.finish() == shown
    rows = bpe.encode(odd, queries.tokenizer_file(), wanted=("n_tokens", "ids", "decoded")).collect()
    assert len(rows) == odd.count()
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert any(r["decoded"].strip() == PROSE for r in rows)
    assert bpe.encode(odd.limit(0), queries.tokenizer_file()).count() == 0


def test_bpe_digest_is_of_decoded_ids(tables, monkeypatch):
    texts = ["", PROSE, (PROSE + " <|endoftext|> ") * 300, "ab" * 4000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["__text"])
    shared = SimpleNamespace(value=tables)

    def digests():
        bpe._coders.clear()
        return [d for out in bpe._coded([batch], shared, "own", ("n_tokens", "ids_sha256", "decoded_sha256"))
                for d in zip(*[out.column(c).to_pylist() for c in out.schema.names])]

    coder = bpe.Encoder(tables)
    want = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
            for i, t in map(coder.encode, texts)]
    assert digests() == want
    feed = bpe.Decoder.feed
    monkeypatch.setattr(bpe.Decoder, "feed", lambda self, ids: feed(self, ids[:-1]))
    assert [a[2] != b[2] for a, b in zip(digests(), want)] == [False, True, True, True]
    bpe._coders.clear()


def test_words_merged_together_equal_single_ones(tables):
    rng = np.random.default_rng(11)
    parts = ["th", "e", "in", "g", "er", "a", "on", "s", "tion", "é", "字", "!", "7", "the", "aa"]
    words = ["".join(rng.choice(parts, n)) for n in rng.integers(1, 12, 500)] + ["a", "aaaaaaaaa", "\x1c"]
    raw = [w.encode() for w in words]
    symbols = bpe.byte_symbols()
    want = []
    for w in raw:
        run = [symbols[b] for b in w]
        run[-1] += bpe.END
        want.append(np.array([tables.ids[x] for x in bpe.merge(run, tables.ranks)], "<u4").tobytes())
    assert bpe.merge_words(raw, tables) == want and bpe.merge_words(raw[:1], tables) == want[:1]


def test_bpe_forgets_and_reads_in_slices(tables, monkeypatch):
    rng = np.random.default_rng(12)
    odd = ["", " ", "ab" * 1500, PROSE, "é" * 700, "one <|endoftext|> two", "x" * 129 + " y", "!?" * 300, "Σ'S 1\x1c2"]
    texts = ["".join(rng.choice([*"abcdefgh  ", "é", "\n", "'s", "9"], 400)) for _ in range(40)] + odd + odd
    want = [bpe.Encoder(tables).encode(t)[0] for t in texts]
    for name, value in (("CACHE", 60), ("SLICE", 50), ("PART", 64)):
        monkeypatch.setattr(bpe, name, value)
    coder, got, held = bpe.Encoder(tables), [], []
    for ids in coder.runs(texts):
        if ids is None:
            got.append(b"".join(held))
            held = []
        else:
            held.append(ids)
        assert len(coder.known) + len(coder.older) <= 300
    assert got == want and not held


def test_transducer_is_stable(tables):
    rng = np.random.default_rng(5)
    word = list("".join(rng.choice(["th", "e", "in", "g", "er", "a", "on", "s", "tion"], 2500)))
    stream = bpe.Transducer(tables.ranks, tables.lookahead, 400)
    got = []
    for k in range(0, len(word), 37):
        got += stream.feed(word[k:k + 37])
        assert len(stream.held) <= 400 + tables.lookahead
    got += stream.finish()
    assert got == bpe.merge([*word[:-1], word[-1] + bpe.END], tables.ranks)


def test_compression(spark, odd):
    rows = compression.measure(odd, keep=("doc_id", "text")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
        marked = {k + j for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for j in range(5)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(marked))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(marked) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert {r["kept"] for r in rows if r["text"] == PROSE} == {True}
    assert compression.accept(odd).columns == odd.columns and compression.accept(odd.limit(0)).count() == 0
    lines = spark.createDataFrame([(1, "a b\n\na b\n c #\na b")], "doc_id long, text string")
    row = compression.measure(lines).first()
    assert (row["n_dup_lines"], row["n_symbols"]) == (2, 1)


TALES = ("Вечером над рекой поднялся туман, и старый паромщик долго не решался отчалить от берега. На "
         "другой стороне его ждали трое путников: учитель из соседней деревни, девушка с корзиной яблок и "
         "молчаливый солдат, который возвращался домой после долгой службы. Никто из них не знал, что "
         "мост, о котором говорили весной, уже начали строить выше по течению.",
         "Το πρωί ο ψαράς βρήκε τη βάρκα του γεμάτη νερό και κάθισε στην προκυμαία χωρίς να μιλά. Η "
         "γυναίκα του έφερε ψωμί, ελιές και λίγο τυρί, ενώ τα παιδιά μάζευαν κοχύλια κοντά στο παλιό "
         "φρούριο. Όταν φύσηξε ο βοριάς, όλοι κατάλαβαν πως το ταξίδι θα έπρεπε να περιμένει ώς την "
         "επόμενη εβδομάδα.",
         "아침 일찍 시장에 나간 할머니는 생선 두 마리와 배추 세 포기를 사서 천천히 집으로 돌아왔다. 골목 끝에서 만난 우체부는 바다 건너 사는 손자가 보낸 편지를 건네주었고, "
         "할머니는 안경을 찾느라 한참 동안 마루를 뒤졌다. 저녁이 되자 이웃들이 모여 함께 국을 끓이며 오래된 노래를 불렀다.")


def base64_lines(rng, n):
    text = base64.b64encode(rng.bytes(n)).decode()
    return "\n".join(text[k:k + 76] for k in range(0, len(text), 76))[:n]


def verdicts(spark, texts):
    rows = compression.measure(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    return [r["kept"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_compression_bands_part_prose_from_noise(spark):
    rng = np.random.default_rng(12)
    sizes = sorted({x for below, *_ in compression.BANDS for x in (below - 1, below) if x < 1 << 20} | {1500, 30_000})
    printable = [chr(c) for c in range(32, 127)]
    noise = [base64_lines(rng, n) for n in sizes for _ in range(5)]
    noise += ["".join(rng.choice(printable, n)) for n in sizes for _ in range(5)]
    assert not any(verdicts(spark, noise))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars > 3000 and lang is not null").collect()
    clean = [r["text"] for r, kept in zip(docs, verdicts(spark, [r["text"] for r in docs])) if kept]
    assert len(clean) > 0.5 * len(docs)
    prose = [t[:n] for t in clean for n in sizes if 128 <= n <= 3000]
    prose += [t.encode()[:n].decode(errors="ignore") for t in TALES for n in (160, 200, 260, 330, 380)]
    assert np.mean(verdicts(spark, prose)) > 0.98 and all(verdicts(spark, TALES))


def test_compression_chunks_see_noise_inside_prose(spark):
    rng = np.random.default_rng(13)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars > 6000 and lang is not null").collect()
    texts = [r["text"] for r in docs]
    clean = [t for t, kept in zip(texts, verdicts(spark, texts)) if kept]
    assert len(clean) > 0.5 * len(texts)
    mixed = [t[:8000 * k] + "\n" + base64_lines(rng, 4500) + "\n" + t for t in clean for k in (0, 1)]
    assert not any(verdicts(spark, mixed))
    row = compression.measure(spark.createDataFrame([(1, clean[0][:4096])], "doc_id long, text string")).first()
    assert row["chunk_low"] < row["chunk_high"]


def test_pattern_spans_match_plain_patterns():
    rng = np.random.default_rng(6)

    def digits(t):
        return re.sub(r"[^0-9]", "", t)

    for _ in range(4000):
        t = "".join(rng.choice(list("ab1234567.@+- ()%.@..11"), rng.integers(0, 40)))
        want = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
                 if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
                 if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        want += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
        assert pii.pattern_spans(t) == want


def test_crf_gradients_and_decoding():
    p = {k: v.astype(np.float64) for k, v in lstm_crf.init(8, 3, 4, 5).items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 8, (5, 3)), rng.integers(0, 3, (5, 3))
    _, grad = lstm_crf.loss_and_gradients(p, x, y)
    for k in p:
        at = tuple(rng.integers(0, n) for n in p[k].shape)
        ends = []
        for sign in (1, -1):
            q = {**p, k: p[k].copy()}
            q[k][at] += sign * 1e-3
            ends.append(lstm_crf.loss_and_gradients(q, x, y)[0])
        assert abs((ends[0] - ends[1]) / 2e-3 - grad[k][at]) < 1e-3
    from itertools import product
    score = lstm_crf.emissions(p, x)
    path = lstm_crf.viterbi(p, score, np.array([5, 5, 3]))
    for b, n in enumerate((5, 5, 3)):
        best = max(product(range(3), repeat=n), key=lambda s: p["S"][s[0]] + sum(score[t, b, s[t]] for t in range(n))
                   + sum(p["T"][s[t], s[t + 1]] for t in range(n - 1)))
        assert tuple(path[:n, b]) == best


def test_personal_data(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.learn(docs)
    hidden = {"phone": "call 1 (722) 555-6978 for the roof", "card": "he paid with 4799567889864505 10.0.0.1 today"}
    found = pii.find(model, list(hidden.values()))
    assert all(base or added for base, added in found)
    for frame in (odd, odd.limit(0)):
        assert pii.report(frame).count() == frame.count()
    rows = {r["doc_id"]: r for r in pii.report(odd, model=None).collect()}
    assert (rows[8]["n_email"], rows[8]["n_phone"]) == (1, 1)
    assert rows[8]["base_sha256"] == hashlib.sha256(rows[8]["spans"].encode()).hexdigest()
    masked = pii.redact(odd, model=None)
    assert masked.columns == odd.columns
    assert masked.where("doc_id = 8").first()["text"] == "ünï çödé <PHONE> <EMAIL>"
    assert masked.where("text is null").count() == 2


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op12_hybrid_search", "op13_bitmap_divergence")])
def test_query_is_whole(spark, name):
    n = queries.QUERIES[name](spark, SMALL).count()
    assert n == spark.read.parquet(f"{SMALL}/documents.parquet").count() or name == "op6_token_rollup" and n


def test_mixing_statistics_see_capitals_and_any_case(spark):
    docs = spark.createDataFrame([("AB cd\tEf gh",), ("RUDE word Rude rude",), ("",), (None,)], "text string")
    rows = [r["s"] for r in docs.select(mixing.statistics(F.col("text"), ["rude", "word"]).alias("s")).collect()]
    assert [r["capitals"] for r in rows] == [3 / 11, 5 / 19, 0.0, 0.0]
    assert [r["told"] for r in rows] == [0.0, 2.0, 0.0, 0.0] and [r["words"] for r in rows] == [4, 4, 0, 0]
    labelled = spark.createDataFrame([(i % 2, "VILE end" if i % 2 else "mild end") for i in range(12)], "domain int, body string")
    assert mixing.lexicon_of(labelled, 5) == ["vile"]
