"""License templates, hybrid search and the divergence audit against brute force and their oracles."""
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from aislemetry.llm import divergence, langid, lexical, licenses, quality, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, places string, k long"
MIT = next(t for t in licenses.TEMPLATES if t.label == "mit-text")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, l, s, 1, "clash", "clash", 7) for i, t, l, s in rows], SCHEMA)


def plain(markup, chosen="original"):
    """Wording of a template with its optional parts and a filler for every region."""
    markup = re.sub(r"<<\s*(begin|end)Optional.*?>>", "", markup)
    return re.sub(r'<<var;[^>]*?match="(.*?)">>',
                  lambda m: "anybody here" if m[1].startswith(".") else m[1].split("|")[0], markup)


def duck(spark, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas() if df.count() else df.toPandas().astype(object))
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


# ---------------------------------------------------------------- licenses

ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "CC\nBY  cc-by", "en", "a"),
       (4, "CC\nBY  cc-by", "en", "a"), (None, "Released under the MIT  License.", "de", None),
       (5, "the GNU, General public: LICENSE gnu general public license", "en", "b"), (6, "mit", "en", "b"),
       (7, "ünï apache lıcense APACHE LICENSE", "fr", "b")]


def test_report_matches_its_oracle(spark):
    long = " ".join(f"w{k}" for k in range(30_000)) + " " + plain(MIT.markup) + " end"
    rows = ODD + [(8, long, "en", "a")] + [(100 + k, plain(t.markup), "en", "a") for k, t in enumerate(licenses.TEMPLATES)]
    docs = docs_of(spark, rows)
    cols, want = duck(spark, licenses.oracle(), documents=docs.select("doc_id", "text").withColumn(
        "doc_id", F.coalesce("doc_id", F.lit(-1))))
    got = licenses.report(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).select(*cols)
    key = repr
    assert sorted(([None if v != v else v for v in r] for r in map(tuple, got.collect())), key=key) == sorted(
        ([None if v is not None and v != v else v for v in r] for r in want), key=key)
    by_id = {r.doc_id: r for r in got.collect()}
    for k, t in enumerate(licenses.TEMPLATES):
        assert t.label in by_id[100 + k].labels.split(","), t.label
    assert by_id[8].labels == "mit-text" and by_id[4].n_base == 2 and (by_id[4].first_word, by_id[4].last_word) == (0, 2)
    assert by_id[7].base_labels == "apache" and by_id[7].first_word == 3 and by_id[6].score == 0.0
    assert licenses.report(docs.limit(0)).collect() == []


def test_mandatory_wording_is_exact():
    a = licenses.Automaton(MIT.markup)
    words = licenses.words_of(plain(MIT.markup))
    assert a.longest(words, 0, len(words)) == len(words)
    kinds = [licenses.parse(MIT.markup)[i][0] for i in range(5)]
    assert kinds == ["word"] * 5
    for i in random.Random(5).sample(range(len(words)), 60):
        changed = [*words[:i], "zzz", *words[i + 1:]]
        dropped = [*words[:i], *words[i + 1:]]
        # Only words of replaceable regions and optional parts may differ.
        free = {"anybody", "here", "including", "the", "next", "paragraph"}
        if words[i] not in free:
            assert a.longest(changed, 0, len(changed)) == -1 and a.longest(dropped, 0, len(dropped)) == -1


def brute(nodes, words, at):
    """All ends of parsed nodes from word `at`, by plain recursion."""
    ends = {at}
    for node in nodes:
        after = set()
        for e in ends:
            if node[0] == "word":
                after |= {e + 1} if words[e:e + 1] == [node[1]] else set()
            elif node[0] == "optional":
                after |= {e} | brute(node[1], words, e)
            elif node[0] == "either":
                after |= {e + len(w) for w in node[1] if words[e:e + len(w)] == w}
            else:
                after |= {e + n for n in range(node[1], node[2] + 1) if e + n <= len(words)}
        ends = after
    return ends


def test_automata_match_brute_force():
    rng = random.Random(11)
    markups = ['a b <<beginOptional>>c <<beginOptional>>d<<endOptional>><<endOptional>> a',
               'a <<var;name="x";match=".{0,3}">> b', 'b <<var;name="x";match="a b|c|a">> <<var;name="y";match=".{2,4}">> a',
               'a <<beginOptional>><<var;name="x";match=".+">><<endOptional>> b <<beginOptional>>a<<endOptional>>',
               '<<beginOptional>>a<<endOptional>> b c', '<<var;name="x";match="a|b">> c <<var;name="x";match=".*">> c']
    for markup in markups:
        nodes, a = licenses.parse(markup), licenses.Automaton(markup)
        for _ in range(400):
            words = [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
            at = rng.randrange(len(words))
            ends = {e for e in brute(nodes, words, at) if e > at}
            assert a.longest(words, at, len(words)) == max(ends, default=-1), (markup, words, at)


@pytest.mark.parametrize("markup", ["", "<<beginOptional>>a<<endOptional>>", 'a <<var;name="x";match=".+">>',
                                    '<<var;name="x";match=".+">> a', "a <<beginOptional>> b", "a <<endOptional>>",
                                    "a <<var;name=x>> b", 'a <<var;match="[0-9]+">> b', 'a <<var;match=".{3,1}">> b'])
def test_bad_templates_are_refused(markup):
    with pytest.raises(ValueError):
        licenses.Automaton(markup)


def test_passages_carry_their_words(spark):
    text = "Foo bar. " + plain(MIT.markup) + " Licensed under CC BY-NC 4.0."
    got = licenses.passages(docs_of(spark, [(1, text, "en", "a")])).collect()
    words = licenses.words_of(text)
    spans = {r.label: words[r.first_word:r.end_word] for r in got}
    assert spans["mit-text"] == licenses.words_of(plain(MIT.markup)) and spans["cc-by"] == ["cc", "by"]
    assert spans["cc-by-nc-notice"] == ["licensed", "under", "cc", "by", "nc", "4", "0"]
    own = licenses.report(docs_of(spark, [(1, "x NO Copying y", "en", "a")]),
                          (licenses.Template("no-copy", 0.3, "no copying"),)).first()
    assert (own.labels, own.n_base, own.score) == ("no-copy", 0, 0.3)


# ---------------------------------------------------------------- hybrid search

def prose(rng, n):
    return " ".join(f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(n))


def ranked_brute(rows, items, top):
    """The scores by their definition, one document at a time."""
    cut = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = [(i, Counter(cut.findall((t or "").translate(licenses._A_TO_Z)))) for i, t in rows]
    terms = [(i, c) for i, c in terms if c]
    n_docs, n_terms = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        q = Counter(cut.findall((text or "").translate(licenses._A_TO_Z)))
        scores = []
        for i, c in terms:
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) *
                    ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in q.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment_docs", [7, 150, 8_192])
def test_search_matches_brute_force(spark, monkeypatch, segment_docs):
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", segment_docs)
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", "a") for i in rng.sample(range(1000), 500)]
    rows += [(2000, rows[0][1].upper(), "en", "a"), (2001, rows[0][1], "en", "a"), (2001, rows[0][1], "en", "a"),
             (2002, None, None, None), (2003, "", "en", "a"), (2004, "!?", "en", "a"), (None, rows[1][1], "en", "a"),
             (2005, "t1 " * 70_000, "en", "a"), (2006, "ümlaut É t5", "fr", "b")]
    items = [(i, prose(rng, 12)) for i in range(25)] + [(100, None), (101, ""), (102, "unknown words"), (103, rows[0][1]),
                                                        (104, "ÜMLAUT ümlaut É"), (None, "t1 t1 t2"), (103, "t3")]
    docs = docs_of(spark, rows).repartition(3)
    found = lexical.Index.build(docs).rank(spark.createDataFrame(items, "item_id long, text string"), top=5, block=11)
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == ranked_brute(
        [r[:2] for r in rows], items, 5)


def test_search_of_empty_tables(spark):
    docs = docs_of(spark, [(1, "a b c", "en", "a")])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.Index.build(docs.limit(0)).rank(items).collect() == []
    assert lexical.Index.build(docs.where("false")).rank(items.limit(0)).collect() == []
    assert lexical.Index.build(docs).rank(items.limit(0)).collect() == []
    named = lexical.Index.build(docs.withColumn("doc_id", F.lit("x"))).rank(items).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in named] == [(1, 1, "x")]


def test_windows_are_skipped():
    """A rare term's accumulators close most windows of a common one, and the best stay the same."""
    rng = np.random.default_rng(2)
    n = 4_000
    segment = lexical._Segment()
    import pyarrow as pa
    texts = [("common " * int(rng.integers(1, 4))) + ("rare " * 3 if i % 97 == 0 else f"w{i} ") * 2 for i in range(n)]
    raw = [t.encode() for t in texts]
    segment.add(pa.array(range(n)), np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    batch = segment.row(pa.int64())
    row = {c: batch.column(c)[0].as_py() for c in batch.schema.names}
    s = lexical.Searcher(row, n, row["n_terms"])
    rare, common = (next(iter(lexical.item_terms(w))) for w in ("rare", "common"))
    terms = {rare: 4000, common: 3}
    at, score = s.search(terms, 20)
    whole = np.zeros(n, np.int64)
    for t, w in terms.items():
        ordinals, gain = s.list(t)
        whole[ordinals] += w * gain
    best = np.lexsort((np.arange(n), -whole))[:20]
    assert at.tolist() == best.tolist() and score.tolist() == whole[best].tolist()
    visited = []
    original = lexical._ranges
    try:
        lexical._ranges = lambda low, high: visited.append(int((high - low).sum())) or original(low, high)
        s.search(terms, 20)
    finally:
        lexical._ranges = original
    assert sum(visited) < n


# ---------------------------------------------------------------- divergence

def audit_brute(rows, min_docs, top):
    cut = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(l or "", s or "", Counter(cut.findall((t or "").translate(licenses._A_TO_Z)))) for _, t, l, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, c in mine for t in c)
        kept = {t for t, n in seen.items() if n >= min_docs}
        groups, whole = defaultdict(Counter), Counter()
        for _, s, c in mine:
            groups[s].update({t: n for t, n in c.items() if t in kept})
            whole.update({t: n for t, n in c.items() if t in kept})

        def p(c, t):
            return 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s, c in groups.items():
            pair = [(o, sum((p(c, t) - p(oc, t)) ** 2 // p(oc, t) for t in kept)) for o, oc in groups.items() if o != s]
            term = [(t, (p(c, t) - p(whole, t)) ** 2 // p(whole, t)) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            for part, found, n in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(found[:n])]
    return sorted(out)


@pytest.mark.parametrize("block, tile", [(2_048, 64), (8, 2)])
def test_audit_matches_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    rng = random.Random(8)

    def text(n):
        return " ".join("abcdefgh"[int(rng.paretovariate(0.8)) % 8] * (1 + int(rng.paretovariate(0.8)) % 12)
                        for _ in range(n)).title()

    rows = [(i, text(rng.randint(0, 40)), rng.choice(["en", "en", "de"]), f"s{min(9, int(rng.paretovariate(0.6)))}")
            for i in range(260)]
    rows += [(900, None, "en", "none"), (901, "", None, None), (902, "x1x ünï", None, "a"), (903, "only once", "xx", "b"),
             (904, "only twice", "xx", "c"), (905, "x1x Ünï", None, "a"), (906, "ünï\nünï", None, "b"),
             (907, rows[0][1], "en", "copy"), (907, rows[0][1], "en", "copy"), (908, "ab " * 30_000, "en", "long"),
             (909, "q", "yy", "alone")]
    docs = docs_of(spark, rows).repartition(3).withColumn("term", F.lit("clash")).withColumn("n", F.lit(1))
    got = divergence.audit(docs, top_terms=15).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == audit_brute(rows, 3, 15)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_likelihood_is_exact_at_any_size(spark):
    cases = [(0, 1), (5, 7), (6, 7), (10 ** 14, 3 * 10 ** 14 + 1), (8 * 10 ** 15 - 2, 8 * 10 ** 15 - 1), (0, 9 * 10 ** 15)]
    df = spark.createDataFrame(cases, "c long, total long")
    got = [r.p for r in df.select(divergence.likelihood(F.col("c"), F.col("total")).alias("p")).collect()]
    assert got == [1 + 10 ** 9 * (c + 1) // total for c, total in cases]


def test_audit_joins_without_products(spark):
    docs = docs_of(spark, [(i, "a b c", "en", f"s{i % 3}") for i in range(9)])
    plan = divergence.audit(docs)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# ---------------------------------------------------------------- earlier operators

def test_a_lone_letter_is_a_text(spark):
    rows = [(i, "the house and the garden " * 5, "en", "a") for i in range(40)] + [
        (100 + i, "das haus und der garten " * 5, "de", "a") for i in range(40)]
    rows += [(900, "a", None, None), (901, "Z", None, None), (902, "7", None, None), (903, "", None, None), (904, "\u00e9", None, None)]
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs_of(spark, rows)).collect()}
    assert {got[i] for i in (900, 901, 904)} <= {"en", "de"} and got[902] == got[903] == "und"


def test_every_learning_row_is_calibrated(spark, monkeypatch):
    """Raw scores beyond the bins count in the outermost ones."""
    seen = []
    pooled = quality.pooled
    monkeypatch.setattr(quality, "pooled", lambda y, n: seen.append(sum(n)) or pooled(y, n))
    monkeypatch.setattr(quality, "STEPS", 10)
    measured = quality.measure(docs_of(spark, [(i, "word " * (i + 1), "en", "a") for i in range(60)]), "text", "doc_id")
    marks = spark.createDataFrame([(i, 50.0 if i == 0 else float(i % 2)) for i in range(60)], "doc_id long, y double")
    quality.learn(measured, marks)
    assert seen == [60]


def test_significant_passages_are_returned_and_add_up(spark):
    rng = random.Random(12)
    clean = [f"word{k}" for k in range(300)]
    bad = ["vilé", "scum", "filth", "rot", "pest"]

    def text(parts):
        return ". ".join(" ".join(rng.choice(bad if toxic else clean) for _ in range(n)) for toxic, n in parts)

    rows, marks = [], []
    for i in range(400):
        toxic = i % 2
        rows.append((i, text([(False, 40), (bool(toxic), 6), (False, 40)]), "en", "a"))
        marks.append((i, toxic))
    two = text([(False, 60), (True, 8), (False, 300), (True, 7), (False, 60)])
    rows += [(1000, two, "en", "a"), (1001, None, None, None), (1002, "", "en", "a"), (1003, text([(False, 200)]), "en", "a")]
    docs, labels = docs_of(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.passages(docs, labels).where("doc_id >= 1000").orderBy("start").collect()
    assert [r.doc_id for r in got] == [1000, 1000]
    for r in got:
        part = two[r.start:r.end]
        assert set(part.split()) <= set(bad) and len(part.split()) == r.end_word - r.first_word and r.expected <= 0.05
    scores = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert scores[1000].n_passages == 2 and scores[1000].predicted == 1 and scores[1003].predicted == 0
    assert scores[1001].n_passages == scores[1002].n_passages == 0


def test_rarer_together_than_alone():
    assert toxicity.together([7.0]) == 7.0 and toxicity.together([7.0, 1.0]) == 7.0
    both = toxicity.together([7.0, 6.0])
    assert both == 13.0 - math.log(13.0) + math.log(2.0) > 7.0
    assert toxicity.together([6.0, 7.0, 8.0]) > both


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want.fetchall()))


def test_personal_data_sample_is_the_same_from_any_share(spark, monkeypatch):
    """Looking at a share of the hashes first picks the windows that looking at all of them picks."""
    from aislemetry.llm import lstm_crf, pii
    seen = []
    monkeypatch.setattr(lstm_crf, "train", lambda model, symbols, tags, steps: seen.append(
        sorted((s.tobytes(), t.tobytes()) for s, t in zip(symbols, tags))))
    docs = docs_of(spark, [(i, f"call +1 ({i:03d}) 555-{i:04d} or mail a{i}@b{i}.org about 10.0.{i % 200}.7 now", "en", "a")
                           for i in range(400)])
    for spare in (1e9, 8, 1, 1e-9):
        monkeypatch.setattr(pii, "SPARE", spare)
        pii.learn(docs, sample=20)
    assert len(seen) == 4 and all(s == seen[0] for s in seen) and len(seen[0]) == 20
