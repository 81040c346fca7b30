"""Commits that survive a restart, replays, damaged files, stems, searches of many queries."""

import io
import random
import zipfile

import pytest

from papyra.functions.stemmer import stem
from papyra.operators import index as ix
from papyra.operators.search import search
from papyra.sources.parsers import epub_text
from papyra.streaming.realtime import RealtimeIndex, index_stream

BOOK = "ordinal long, book_id string, text string"


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "content string, metadata string")


@pytest.mark.parametrize("profile", ["none", "pt"])
def test_commit_is_durable(spark, tmp_path, profile):
    path, log = str(tmp_path / "i"), str(tmp_path / "log")
    ix.save_index(ix.build_index(spark.createDataFrame([(0, "1", "os livros velhos")], BOOK), profile=profile), path)
    own = RealtimeIndex(spark, None, log, path, profile)
    own.add(docs(spark, ("outros livros novos", '{"book_id": "1"}'), ("casas brancas", '{"book_id": "2"}')))
    assert {r.book_id for r in own.search(asked(spark, "novos casas")).collect()} == {"1", "2"}
    if profile == "pt":
        assert {r.book_id for r in own.search(asked(spark, "casa")).collect()} == {"2"}
    assert own.flush("commit") == 2
    again = RealtimeIndex(spark, None, log, path, profile)
    assert sorted((r.doc_id, r.book_id) for r in again.search(asked(spark, "novos casas velhos")).collect()) == [(0, "1"), (1, "2"), (2, "1")]
    again.add(docs(spark, ("mais casas", None)))
    assert again.search(asked(spark, "mais")).count() == 1 and again.flush("discard") == 1 and again.search(asked(spark, "mais")).count() == 0


def test_commit_that_stopped_halfway(spark, tmp_path, monkeypatch):
    path, log = str(tmp_path / "i"), str(tmp_path / "log")
    ix.save_index(ix.build_index(spark.createDataFrame([(0, "1", "old words")], BOOK)), path)
    own = RealtimeIndex(spark, None, log, path)
    own.add(docs(spark, ("new words", None)))
    from papyra.streaming import realtime

    def fails(*_):
        raise RuntimeError

    with monkeypatch.context() as m:
        m.setattr(realtime, "clear_log", fails)
        with pytest.raises(RuntimeError):
            own.flush("commit")
    again = RealtimeIndex(spark, None, log, path)
    assert again.search(asked(spark, "words")).count() == 2 and again.flush() == 0
    fs_marker = tmp_path / "i" / "chunks" / "batch=torn"
    fs_marker.mkdir()
    assert ix.load_index(spark, path).chunks.count() == 2


def test_stream_can_be_opened_and_replayed(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, text in enumerate(("first fox", "second fox")):
        spark.createDataFrame([(i, str(i), text)], BOOK).coalesce(1).write.mode("append").parquet(source)
        for checkpoint in ("a", "b") if i == 0 else ("a",):  # another checkpoint: the batch runs again
            index_stream(spark, source, BOOK, out, str(tmp_path / checkpoint)).awaitTermination()
    own = ix.load_index(spark, out)
    assert own.stats.first().n == 2 and sorted(r.doc_id for r in search(own, asked(spark, "fox")).collect()) == [0, 1]
    assert {r.term: r.df for r in own.vocab.collect()} == {"first": 1, "second": 1, "fox": 2}
    with pytest.raises(FileNotFoundError):
        ix.load_index(spark, str(tmp_path / "none"))


def test_damaged_books():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("CH1.HTML", "<body>" + "words of a page " * 200 + "</body>")
    whole = buffer.getvalue()
    assert epub_text(whole).startswith("words of a page")
    rng = random.Random(27)
    for _ in range(150):
        damaged = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            damaged[rng.randrange(len(damaged))] = rng.randrange(256)
        found = epub_text(bytes(damaged[: rng.choice([len(damaged), rng.randrange(len(damaged))])]))
        assert found is None or isinstance(found, str)


def test_stems_by_hand():
    """From the published rules, on words without accents."""
    golden = {
        "texto": "text", "para": "par", "analise": "analis", "informacao": "informaca", "responsavel": "responsavel", "livros": "livr", "casas": "cas",
        "rapidamente": "rapid", "felicidade": "felic", "biologia": "biolog", "beleza": "belez", "trabalhadores": "trabalh", "cantavamos": "cantav",
        "cantamos": "cant", "partir": "part", "guerra": "guerr", "sangue": "sang", "doce": "doc", "importante": "import", "frequencia": "frequenc",
        "acoes": "aco", "possivel": "possivel", "cantassemos": "cantass", "solucao": "soluca", "brasileira": "brasileir", "artistas": "artist", "os": "os", "e": "e",
    }
    assert {w: stem(w) for w in golden} == golden


def test_many_queries_agree_with_joined_postings(spark):
    rng = random.Random(28)
    words = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(1, 30))) for _ in range(300)]
    own = ix.build_index(spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], BOOK))
    plain = ix.SearchIndex(own.chunks, own.postings, own.vocab, own.stats)
    q = spark.createDataFrame([(i, " ".join(rng.choices(words + ["zzzz", "abq"], k=rng.randint(0, 5)))) for i in range(120)] + [(None, "aa ab")], "qid long, text string")
    one, two = (sorted(map(str, search(x, q, 7).select("qid", "rank", "doc_id", "score").collect())) for x in (own, plain))
    assert one == two and len(one) > 500
