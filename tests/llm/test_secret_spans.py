"""Spans of any length against all spans tried, contexts of any length, words of the corpus."""

import random

import pytest

from papyra.llm import secret_scan as sc


def tried(value, longest=None):
    best = [0.0]
    for j in range(1, len(value) + 1):
        costs = []
        for i in range(j):
            for kind in ("word", "date", "repeat", "walk", "brute"):
                span = value[i:j]
                if kind == "repeat":
                    c = min((tried_cost(span[:u], longest) + sc.math.log10(len(span) // u) for u in range(1, len(span) // 2 + 1) if span[:u] * (len(span) // u) == span), default=None)
                    c = None if longest and len(span) > longest else c
                else:
                    c = sc.span_cost(kind, span, longest)
                if c is not None:
                    costs.append(best[i] + c + (sc.JOIN if i else 0))
        best.append(min(costs))
    return best[-1]


KNOWN = {}


def tried_cost(value, longest):
    if (value, longest) not in KNOWN:
        KNOWN[value, longest] = tried(value, longest)
    return KNOWN[value, longest]


@pytest.mark.parametrize("longest", [None, 7])
def test_random(longest):
    rng = random.Random(25)
    for _ in range(60):
        v = "".join(rng.choices(["ab", "abc", "a", "qwe", "rty", "1", "password", "!"], k=rng.randint(1, 9)))
        assert sc.guess_cost(v, longest)[0] == pytest.approx(tried(v, longest)), v
    for v in ("ab" * 40 + "x", "k3" + "abcabc" * 8, "x" + "qwertyuiop" * 4, "aaaaaaabaaaaaaab", "asdfgfdsasdfgfdsa" * 2):
        cost, spans = sc.guess_cost(v, longest)
        assert cost == pytest.approx(tried(v, longest)) and [a for a, _, _ in spans[1:]] == [b for _, b, _ in spans[:-1]]


def test_long_values():
    assert sc.guess_cost("*" * 256, None)[0] == pytest.approx(1 + sc.math.log10(256))
    unit = "k8Qz71mWx02LpTr5Vb9NcD"
    assert sc.guess_cost(unit * 2, None)[0] == pytest.approx(sc.guess_cost(unit, None)[0] + sc.JOIN)
    assert sc.guess_cost("ab" * 4000, None)[0] < 6 and sc.guess_cost("ab" * 4000)[0] > 10
    walk = "qwertyuiop" + "oiuytrewq" + "wertyuiop"
    assert sc.guess_cost(walk * 5, None)[0] < 12


def test_contexts():
    assert list(sc.contexts("token_" + "a" * 40 + " = s3cr3tvalue99x"))[0][2] == "s3cr3tvalue99x"
    assert list(sc.contexts("password=Xk9,vQ2;Lm!8aZr4, next"))[0][2] == "Xk9,vQ2;Lm!8aZr4"
    assert list(sc.contexts("Authorization: Bearer abc.def-123"))[0][1:] == ("bearer", "abc.def-123")
    assert not list(sc.contexts("the bearer")) and not list(sc.contexts("token ="))


def test_words_of_the_corpus(spark):
    rows = [(i, f"we need understanding and internationalization, my token = internationalization and password: zqvxkjwpyh{i % 2}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = sc.corpus_ranks(docs)
    assert "internationalization" in ranks and "zqvxkjwpyh" not in ranks and ranks["password"] == sc.RANK["password"]
    got = sc.scan_secrets(docs, longest=None).collect()
    assert {(r.word, r.secret) for r in got} == {("token", False), ("password", True)} and len(got) == 20
