"""Each stage of the pipeline against a plain version, on rows with nulls, blanks, repeats, copies and leaks; empty tables; other columns."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from test_llm import MODEL, brute_dedup, grams

import corpus_pipeline as cp

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(30)
    english, german = (["the", "and", "of", "with", "that", "from"], ["der", "und", "nicht", "mit", "auch", "sich"])
    out = []
    for i in range(60):
        words, lang = ((english, "en"), (german, "de"))[i % 2]
        text = "\n".join(" ".join([*rng.choices(words, k=6), *(f"{lang}{rng.randrange(400)}x" for _ in range(4))]) for _ in range(rng.randint(2, 12)))
        out.append((i, text, lang, "s", len(text)))
    passage = "\n".join(f"shared line number {k} with several plain words in it" for k in range(8))
    out[10] = (10, out[10][1] + "\n" + passage, "en", "s", 0)
    out[12] = (12, passage + "\n" + out[12][1], "en", "s", 0)
    out.append((60, out[4][1].replace("x", "y", 1), "en", "s", 0))
    out.append((61, out[5][1], "de", "t", 0))
    out += [(62, None, None, None, None), (63, "", "en", None, 0), (64, " \n ", "en", "s", 3), (65, "12345 !!", "en", "s", 8), out[7], (None, "the null id and that of the others", "en", "s", 0)]
    item = "a benchmark question about seven different unlikely things and their answers"
    out.append((66, "the text that holds " + item + " and more of the text", "en", "s", 0))
    return out, item


@pytest.fixture
def folder(spark, tmp_path):
    found, item = rows()
    spark.createDataFrame(found, DOC).withColumns({"key": F.lit(1), "cut": F.lit("x"), "__order": F.lit(None).cast("int")}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    import sentencepiece

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stage = dict(cp.STAGES)
    kept = stage["language_id"](spark, docs, folder).cache()
    assert kept.columns == columns and not {62, 63, 64, 65} & {r.doc_id for r in kept.collect()} and kept.where("doc_id = 7").count() == 2

    before = sorted(((r.doc_id if r.doc_id is not None else 10**9, r.text) for r in kept.collect()))
    unique = list(dict.fromkeys(before))
    want = brute_dedup([t for _, t in unique], 50)
    want = {unique[i][0]: t for i, t in want.items()}
    lines = stage["line_dedup"](spark, kept, folder).cache()
    got = {r.doc_id if r.doc_id is not None else 10**9: r.text for r in lines.collect()}
    assert got == want and lines.columns == columns and "shared line" in got[10] and "shared line" not in got[12]

    ids = sorted(got)
    label = {i: i for i in ids}
    for _ in ids:
        for i, j in itertools.combinations(ids, 2):
            a, b = grams(got[i]), grams(got[j])
            if a and b and len(a & b) / len(a | b) >= 0.6:
                label[i] = label[j] = min(label[i], label[j])
    near = stage["ngram_join"](spark, lines, folder).cache()
    assert {r.doc_id if r.doc_id is not None else 10**9 for r in near.collect()} == {i for i in ids if label[i] == i} and label[60] == 4

    clean = stage["decontamination"](spark, near, folder).cache()
    assert {r.doc_id for r in near.collect()} - {r.doc_id for r in clean.collect()} == {66} and clean.columns == columns

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    coded = {r.doc_id: (r.ids, r.round_trip) for r in stage["sentencepiece"](spark, clean, folder).collect()}
    assert coded == {r.doc_id: (model.encode(r.text), True) for r in clean.collect()}
    whole = {r.doc_id: (r.ids, r.round_trip) for r in cp.run(spark, folder).collect()}
    assert whole == coded


def test_each_stage_takes_nulls_and_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in cp.STAGES:
        assert stage(spark, docs, folder).count() > 0, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
