"""The corpus pipeline, stage by stage, over odd rows and an empty table, against brute force."""
import random
import re

import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from aislemetry.llm import compression, mixing
from aislemetry.llm.queries import tokenizer_file

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINES = ("the rain fell on the old roof and nobody in the house heard it until morning came with a grey light",
         "fields lay open where two men had walked all night carrying a letter that neither of them could read aloud",
         "when the boats returned at dusk every window along the harbour was lit and somebody had begun to sing",
         "a clerk wrote the names of the missing in a long blue book which he closed before the widow could look",
         "my brother kept bees behind the school and sold the honey to travellers who never asked about its price")


WORDS = sorted({w for line in LINES for w in line.split()})


def prose(k):
    """A text of its own for every k, in sentences of a dozen words."""
    rng = random.Random(k)
    return "\n".join(" ".join(rng.sample(WORDS, 12)).capitalize() + "." for _ in range(7))


def rows():
    plain = [(k, prose(k), "en", f"s{k % 3}", len(prose(k))) for k in range(40)]
    near = [(500 + k, prose(k) + " Indeed.", "en", "copy", 1) for k in range(5)]
    exact = [(600 + k, prose(k), "de", "copy", None) for k in range(5)] + [(3, prose(3), "en", "s0", len(prose(3)))]
    mail = [(700, prose(70) + " Write to jane.roe@example.com or +1 (722) 555-6978 today.", "en", "mail", 1)]
    odd = [(800, None, None, None, None), (801, "", "en", "a", 0), (802, " \n\t ", "en", "a", 4), (803, "x" * 5000, "en", "a", 5000),
           (804, "same words again " * 400, "en", "a", 1), (None, prose(90), None, None, None),
           (805, "\n".join(prose(k) for k in range(200, 400)), "en", "long", 1)]
    return plain + near + exact + mail + odd


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[list(out)[-1]], SMALL).write.parquet(f"{folder}/{name}")
        out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stage_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "mask_personal_data", "mix_sources", "tokenize"]
    for name in names[:-1]:
        assert stages[name].columns == stages["documents"].columns, name


def test_quality_keeps_what_its_verdict_says(stages):
    kept = [r for r in compression.measure(stages["documents"], keep=("doc_id", "text")).collect() if r.kept]
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == texts(stages["quality_rules"])
    ids = {r.doc_id for r in stages["quality_rules"].collect()}
    assert ids >= {*range(40), 700, 805, None} and not ids & {800, 801, 802, 803, 804}


def test_one_document_of_every_group_stays(stages):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}

    before, after = stages["quality_rules"].collect(), stages["near_dedup"].collect()
    groups = []
    for r in sorted(before, key=lambda r: (r.doc_id is None, r.doc_id)):
        s = shingles(r.text)
        mine = next((g for g in groups if len(s & g[0]) / len(s | g[0]) >= 0.8), None)
        if mine is None:
            groups.append((s, [r.doc_id]))
        else:
            mine[1].append(r.doc_id)
    assert len(after) == len(groups)
    assert sorted((r.doc_id for r in after), key=repr) == sorted((g[1][0] for g in groups), key=repr)


def test_personal_data_is_masked_and_nothing_else(stages):
    before = dict(texts(stages["near_dedup"]))
    after = stages["mask_personal_data"].collect()
    assert len(after) == len(before)
    for r in after:
        if r.doc_id == 700:
            assert "jane.roe" not in r.text and "555" not in r.text and r.text.startswith(prose(70))
        elif r.doc_id in range(40):
            assert r.text == before[r.doc_id]
        assert r.n_chars == len(r.text)


def test_documents_stand_as_often_as_their_rate_says(spark, stages):
    docs = stages["mask_personal_data"]
    mixed = mixing.mix(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), keep=("doc_id",))
    want = {r.doc_id: r.copies for r in mixed.collect() if r.copies}
    got = {r.doc_id: r["count"] for r in stages["mix_sources"].groupBy("doc_id").count().collect()}
    assert got == want


def test_tokens_are_the_librarys(stages):
    tok = tokenizers.Tokenizer.from_file(tokenizer_file())
    source: dict = {}
    for r in stages["mix_sources"].collect():
        source.setdefault(r.doc_id, r.text)
    out = stages["tokenize"].collect()
    assert len(out) == stages["mix_sources"].count()
    for r in out:
        ids = tok.encode(source[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)


def test_empty_table_passes_every_stage(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0, name


def test_extra_columns_survive(spark):
    """Columns that clash with the operators' own names pass through unharmed."""
    extra = {"sha": "x", "class_id": "y", "rate": "z", "copies": "c", "kept": "k", "row": "r", "text_a": "t", "ids": "i"}
    docs = spark.createDataFrame([r for r in rows() if r[0] in range(6)], SCHEMA).withColumns(
        {k: F.lit(v) for k, v in extra.items()})
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SMALL)
        assert set(extra) <= set(docs.columns), name
        first = docs.first()
        assert {k: first[k] for k in extra} == extra, name
