"""Each operator against a brute-force version, and on nulls, empty tables, ties, repeats, long texts and clashing columns."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import decontaminate as dc
from papyra.llm import hmm, jaccard_join, language_id, license_scan, line_dedup, secret_scan, token_counts, va_search
from papyra.llm.components import components
from papyra.llm.jaccard_join import drop_similar, jaccard_classes, jaccard_pairs
from papyra.llm.pieces import decode_pieces, encode_pieces, pieces

TOK = "/opt/tokenizers"
MODEL = f"{TOK}/piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    """Texts, or (doc_id, text)."""
    rows = [(t if isinstance(t, tuple) else (i, t)) + ("en", "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def odd(spark):
    """Columns whose names clash with those the operators make, and a null in each."""
    return docs(spark, [(None, None), (None, "some words here"), (1, ""), (1, "some words here"), (1, "some words here"), (2, " \n ")]).withColumns({c: F.lit(None).cast("int") for c in ("o", "k", "__order", "__key", "__cut", "__guess", "key", "cut")})


# 1 secret scan


def brute_cost(value):
    best = {0: 0.0}
    for j in range(1, len(value) + 1):
        found = []
        for i in range(j):
            for kind in ("word", "date", "repeat", "walk", "brute"):
                c = secret_scan.span_cost(kind, value[i:j])
                if c is not None:
                    found.append(best[i] + c + (secret_scan.JOIN if i else 0))
        best[j] = min(found)
    return best[len(value)]


@pytest.mark.parametrize("value", ["password1990", "qwertyP4ssw0rd", "abcabcabc", "2020-01-31x", "zzzzzz", "x", "Tr0ub4dor&3", "asdfghaaaa"])
def test_guess_cost(value):
    cost, spans = secret_scan.guess_cost(value)
    assert cost == pytest.approx(brute_cost(value))
    assert spans[0][0] == 0 and spans[-1][1] == len(value) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_guess_cost_random():
    rng = random.Random(2)
    for _ in range(60):
        v = "".join(rng.choices("ab12qwe-", k=rng.randint(1, 9)))
        assert secret_scan.guess_cost(v)[0] == pytest.approx(brute_cost(v))


def test_secret_rows(spark):
    got = secret_scan.scan_secrets(docs(spark, ['token = "8f3a9c1e77bd42aa8f3b"', "password: hunter2", "no context", None, "", "api_key=" + "ab" * 4000, "token ="])).collect()
    assert {(r.doc_id, r.secret) for r in got} == {(0, True), (1, False), (5, True)}
    assert all("8f3a" not in str(r.spans) for r in got) and next(r for r in got if r.doc_id == 5).length == 8000
    assert secret_scan.scan_secrets(odd(spark)).count() == 0 and secret_scan.scan_secrets(odd(spark).limit(0)).count() == 0


# 2 token counts


def test_token_counts(spark, tmp_path):
    vocabulary, cache = f"{TOK}/byte_bpe_50k.tiktoken", str(tmp_path / "cache")
    texts = ["a b c", "a b c\r\n", "", "  ", None, "<|endoftext|>", "é" * 3000, "é" * 10, "x\ny"]
    d = docs(spark, texts)
    first = {r.doc_id: (r.n_tokens, r.cached) for r in token_counts.count_tokens(d, cache, vocabulary).collect()}
    for i, t in enumerate(texts):
        assert first[i] == ((None, None) if t is None else (token_counts.count_one(token_counts.normalise(t), vocabulary), False))
    assert first[0][0] == first[1][0] and first[2][0] == first[3][0] == 0
    assert spark.read.parquet(cache).count() == 6
    more = docs(spark, [*texts, "new text"])
    second = {r.doc_id: (r.n_tokens, r.cached) for r in token_counts.count_tokens(more, cache, vocabulary).collect()}
    assert second[0] == (first[0][0], True) and second[9][1] is False and spark.read.parquet(cache).count() == 7
    spark.read.parquet(cache).limit(3).write.mode("append").parquet(cache)
    assert token_counts.count_tokens(more, cache, vocabulary).count() == 10
    assert token_counts.tokenizer_digest(vocabulary) != token_counts.tokenizer_digest(vocabulary, "2") != token_counts.tokenizer_digest(MODEL)
    assert token_counts.count_tokens(odd(spark), str(tmp_path / "o"), vocabulary).count() == 6
    assert token_counts.count_tokens(odd(spark).limit(0), str(tmp_path / "e"), vocabulary).count() == 0


# 3 SentencePiece


def test_pieces_match_the_model():
    import sentencepiece

    model, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces(MODEL)
    rng = random.Random(3)
    texts = ["", " ", "a", "  two  spaces\n\nlines\t.", "naïve café ☃ 漢字", "x" * 3000, "The quick brown fox, 1999!"] + ["".join(rng.choices("abcdeé ,.\n0☃", k=rng.randint(0, 80))) for _ in range(150)]
    ids, counts = own.encode(texts)
    at = np.cumsum(counts) - counts
    assert [ids[a : a + n].tolist() for a, n in zip(at, counts)] == [model.encode(t) for t in texts]
    assert own.decode(ids, counts) == texts


def test_pieces_rows(spark):
    found = encode_pieces(docs(spark, ["a word", None, "", "▁"]), MODEL)
    got = {r.doc_id: r for r in found.collect()}
    assert got[1].ids is None and got[1].round_trip is None and got[2].ids == [] and got[0].round_trip and got[3].round_trip
    assert {r.doc_id: r.text for r in decode_pieces(found, MODEL).collect()} == {0: "a word", 1: None, 2: "", 3: " "}
    assert encode_pieces(odd(spark), MODEL).count() == 6 and encode_pieces(odd(spark).limit(0), MODEL).count() == 0


# 4 n-gram Jaccard join


def grams(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def near_texts(seed=4):
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        w = rng.choices("abcdefghij", k=rng.randint(1, 40))
        for _ in range(5):
            v = list(w)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = rng.choice("klmn")
            out.append(" ".join(v))
    return out


def brute_links(texts, threshold):
    return {(i, j): len(a & b) / len(a | b) for (i, a), (j, b) in itertools.combinations(enumerate(map(grams, texts)), 2) if a and b and len(a & b) / len(a | b) >= threshold}


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_jaccard(spark, threshold):
    texts = near_texts() + [None, "", "..", "long one " * 3000 + "a", "long one " * 3000 + "b"]
    texts[17:19] = texts[3], texts[3]
    want = brute_links([t or "" for t in texts], threshold)
    sets = [grams(t or "") for t in texts]
    found = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard_pairs(docs(spark, texts), threshold=threshold).collect()}
    assert all(found[p] == pytest.approx(want[p]) for p in found)
    same = {i: [j for j in range(len(texts)) if sets[j] == sets[i]] for i in range(len(texts))}
    every = {tuple(sorted((x, y))) for a, b in found for x in same[a] for y in same[b] if x != y}
    assert every == want.keys() and not any(a != same[a][0] for a, _ in found)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(docs(spark, texts), threshold=threshold).collect()}
    label = list(range(len(texts)))
    for _ in texts:
        for i, j in want:
            label[i] = label[j] = min(label[i], label[j])
    assert got == {i: (label[i], sum(i in p for p in want)) for i in range(len(texts))}


def test_jaccard_cells(spark, monkeypatch):
    """A cluster of many blocks of members, and suffixes of more than 255 n-grams in a range."""
    monkeypatch.setattr(jaccard_join, "_BLOCK", 3)
    rng = random.Random(20)
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(w if rng.random() > 0.02 else f"x{rng.randrange(99)}" for w in base) for _ in range(60)]
    texts = list(dict.fromkeys(texts))
    n = len(texts)
    long = [f"v{i}" for i in range(4000)]
    texts += [" ".join(long), " ".join([*long[:-3], "other"]), " ".join(long[:2600])]
    want = brute_links(texts, 0.6)
    assert {(r.doc_a, r.doc_b) for r in jaccard_pairs(docs(spark, texts)).collect()} == want.keys()
    assert (n, n + 1) in want and (n, n + 2) in want and len(want) > 300


def test_jaccard_cases(spark):
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard_classes(odd(spark)).collect())
    assert got == [("1", "1", 0), ("1", "1", 1), ("1", "1", 1), ("2", "2", 0), ("None", "1", 1), ("None", "None", 0)]
    assert [(r.doc_a, r.doc_b) for r in jaccard_pairs(odd(spark)).collect()] == [(1, None)]
    assert jaccard_classes(odd(spark).limit(0)).count() == 0


def test_drop_similar(spark):
    texts = near_texts(5)
    sets = list(map(grams, texts))
    parent = list(range(len(texts)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    assert sorted(r.doc_id for r in drop_similar(docs(spark, texts)).collect()) == [i for i in range(len(texts)) if root(i) == i]
    kept = drop_similar(odd(spark))
    assert kept.columns == odd(spark).columns and sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect()) == [(1, ""), (1, "some words here"), (1, "some words here"), (2, " \n ")]
    assert drop_similar(odd(spark).limit(0)).count() == 0 and jaccard_pairs(odd(spark).limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    assert dict(components(spark.createDataFrame(chain, "x long, y long")).collect()) == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


# 5 line dedup


def brute_dedup(texts, least):
    """Kept text by place: a line goes if a run that holds it, of ``least`` words, occurs earlier."""
    lines = [line_dedup._line_texts(t) if t else [] for t in texts]
    seen, gone = {}, [set() for _ in texts]
    for i, ls in enumerate(lines):
        for a in range(len(ls)):
            n = 0
            for b in range(a + 1, len(ls) + 1):
                n += len(ls[b - 1].split())
                if n >= least:
                    if seen.setdefault(tuple(ls[a:b]), (i, a)) != (i, a):
                        gone[i].update(range(a, b))
    out = {}
    for i, t in enumerate(texts):
        if t is None:
            out[i] = None
            continue
        left = "".join(t[a:b] for j, (a, b) in enumerate(line_dedup.split_lines(t)) if j not in gone[i])
        if not gone[i]:
            out[i] = t
        elif left.rstrip():
            out[i] = left.rstrip()
    return out


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("abcdef", k=rng.choice([1, 1, 2, 3, 9]))) for _ in range(14)]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(0, 25))) for _ in range(30)]
    texts += [texts[3], texts[3], None, "", "  "]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts), 8).collect()}
    assert got == brute_dedup(texts, 8)


def test_line_dedup_cases(spark):
    d = odd(spark)
    assert line_dedup.dedup_lines(d).count() == 6 and line_dedup.dedup_lines(d).columns == d.columns and line_dedup.dedup_lines(d.limit(0)).count() == 0
    long = "\n".join(f"word{i} other" for i in range(20000))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, [long, "start here\n" + long, "x\ny"])).collect()}
    assert got == {0: long, 1: "start here", 2: "x\ny"}
    once = "\n".join(f"line number {i}" for i in range(20))
    got = line_dedup.dedup_lines(docs(spark, [f"{once}\nbetween\n{once}"])).first().text
    assert got == f"{once}\nbetween"
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(d, 0)


# 6 LM scoring


def small_model(states=3, symbols=5, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model({}, norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def paths(model, seq):
    for p in itertools.product(range(len(model.start)), repeat=len(seq)):
        x = model.start[p[0]] * model.emit[seq[0], p[0]]
        for t in range(1, len(seq)):
            x *= model.move[p[t - 1], p[t]] * model.emit[seq[t], p[t]]
        yield p, x


def test_forward_and_counts():
    model = small_model()
    seqs = [[0, 1, 4], [2], [3, 3, 0, 1, 2], [4, 0]]
    ids, lengths = np.array(sum(seqs, [])), np.array(list(map(len, seqs)))
    assert hmm.forward(model, ids, lengths) == pytest.approx([math.log(sum(x for _, x in paths(model, s))) for s in seqs])
    starts, moves, gamma, total = hmm.expected(model, ids, lengths)
    s2, m2, g2 = np.zeros(3), np.zeros((3, 3)), np.zeros((len(ids), 3))
    at = 0
    for s in seqs:
        z = sum(x for _, x in paths(model, s))
        for p, x in paths(model, s):
            s2[p[0]] += x / z
            for t in range(len(s)):
                g2[at + t, p[t]] += x / z
                if t:
                    m2[p[t - 1], p[t]] += x / z
        at += len(s)
    assert np.allclose(starts, s2) and np.allclose(moves, m2) and np.allclose(gamma, g2)


def test_lm_training(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the dog runs.", "a cat sleeps.", "one bird sings!"]) for _ in range(30)) for _ in range(40)] + [None, "", "?? ,,", "x" * 50000]
    d = docs(spark, texts)
    model, _, history = hmm.fit(d.repartition(3), states=3, rounds=5, min_share=1e-3)
    assert all(b >= a - 1e-3 * abs(a) for a, b in zip(history, history[1:])) and history[-1] > history[0]
    again = hmm.fit(d.coalesce(1), states=3, rounds=5, min_share=1e-3)[0]
    assert np.allclose(model.emit, again.emit) and np.allclose(model.move, again.move)
    got = {r.doc_id: r for r in hmm.score(d, states=3, rounds=5, min_share=1e-3).collect()}
    for i, t in enumerate(texts):
        ids, n = model.symbols(t or "")
        assert got[i].n_symbols == len(ids) and got[i].log_likelihood == pytest.approx(hmm.forward(model, ids, n).sum() if len(n) else 0)
    assert got[40].per_symbol is None and got[41].per_symbol is None and got[0].per_symbol > got[42].per_symbol
    assert hmm.score(odd(spark)).count() == 6 and hmm.score(odd(spark).limit(0)).count() == 0


def test_lm_vocabulary_grows(spark):
    """Twice the words, twice the symbols; a pooled word has a share of its class."""
    sizes = []
    for n in (40_000, 80_000):
        d = docs(spark, [" ".join(f"w{i}" for i in range(at, at + 1000)) for at in range(0, n, 1000)] * 2 + ["onceab twiceab thriceab."])
        model, _, _ = hmm.fit(d, states=2, rounds=1)
        sizes.append(len(model.words))
    assert sizes == [40_000, 80_000]
    rare = np.array([w in model.words for w in ("onceab", "twiceab", "thriceab", ".")])
    assert not rare.any() and model.types[hmm.rare_class("onceab")] == 3
    total = model.emit[hmm.CLASSES :].sum(axis=0) + (model.emit[: hmm.CLASSES] * np.maximum(model.types, 1)[:, None]).sum(axis=0)
    assert np.allclose(total, 1) and (model.emit[hmm.rare_class("onceab")] < 2 / 160_000).all()


def test_lm_training_converges(spark):
    """Two kinds of words in turn: a model whose states are trained knows which comes, a bit a symbol less than word frequencies say."""
    rng = random.Random(16)
    d = docs(spark, [" ".join(f"{'ab'[j % 2]}{rng.randrange(8)}" for j in range(40)) for _ in range(60)])
    model, _, history = hmm.fit(d, states=2)
    n = 60 * 40
    assert history[-1] / n == pytest.approx(-math.log(8), abs=0.05) and history[-1] - history[-4] < 1e-4 * abs(history[-1])


# 7 decontamination


def brute_leaks(texts, items, radius, threshold):
    bench = dc.Benchmark(items, radius, threshold)
    found = set()
    for d, t in enumerate(texts):
        w = dc.words_of(t)
        for k, (item, iw) in enumerate(bench.items):
            for p in range(len(w) - len(iw) + 1):
                win = w[p : p + len(iw)]
                if (dc.simhash(win) ^ dc.simhash(iw)).bit_count() <= radius and bench.similarity(win, k) >= threshold:
                    found.add((d, item))
    return found


def test_decontaminate(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 8, 20, 20])))) for i in range(12)] + [(12, None), (13, ""), (14, "w1 w2 w3 w4 w5 w6"), (14, "w1 w2 w3 w4 w5 w6")]
    texts = []
    for _ in range(40):
        w = rng.choices(vocab, k=rng.randint(0, 60))
        leak = items[rng.randrange(12)][1].split()
        if len(leak) > 6 and rng.random() < 0.5:
            leak[rng.randrange(len(leak))] = "changed"
        at = rng.randrange(len(w) + 1)
        texts.append(" ".join(w[:at] + leak + w[at:]) if rng.random() < 0.7 else " ".join(w))
    texts += [None, ""]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs(spark, texts), bench, 11, 0.5).collect()}
    assert got == brute_leaks(texts, items, 11, 0.5) and got
    kept = {r.doc_id for r in dc.drop_leaks(docs(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in got}
    assert dc.drop_leaks(odd(spark), bench).count() == 6 and dc.drop_leaks(docs(spark, texts), bench.limit(0)).count() == len(texts) and dc.find_leaks(odd(spark).limit(0), bench).count() == 0


def test_block_index_is_exact():
    rng = np.random.default_rng(8)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    q = prints[:50] ^ (np.uint64(1) << rng.integers(0, 64, 50, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 50, dtype=np.uint64))
    a, b = dc.BlockIndex(prints, 5).within(q)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i in range(50) for j in range(300) if (int(q[i]) ^ int(prints[j])).bit_count() <= 5}


# 8 license scan


def test_rules_find_their_names():
    s = license_scan.scanner()
    assert len(s.rules) > 300 and all(r.keywords and all(k == k.lower() and " " not in k for k in r.keywords) for r in s.rules)
    cases = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "This work is licensed under the GNU General Public License,\n * version 3.": "GPL-3.0-only", "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "under the Mozilla Public License, v. 2.0": "MPL-2.0",
    }
    for text, name in cases.items():
        assert [r.license for _, _, r in s.scan(text)] == [name], text
    assert not s.scan("er geht mit dem Hund, apache helicopters and lesser gnu herds") and not s.scan("")


def test_gate_hides_nothing():
    """Rules without the keyword gate find the same, on texts put together from what the rules look for."""
    s = license_scan.scanner()
    rng = random.Random(9)
    bits = ["MIT License", "GNU GPL v2", "or later", "version 3", "Apache", "2.0", "CC BY-SA 4.0", "SPDX-License-Identifier: ", "MIT", "LGPL-2.1", "public domain", "released into the", "All rights reserved", "Copyright (c) 2001", "plain", "words", "BSD 3-clause"]
    for _ in range(300):
        t = " ".join(rng.choices(bits, k=rng.randint(1, 8)))
        every = [(m.start(), m.end(), r) for r in s.rules for m in r.pattern.finditer(t) if m.end() > m.start()]
        found = s.scan(t)
        assert found == license_scan.resolve(every)
        for (a, b, r), (c, d, o) in itertools.combinations(found, 2):
            assert not (a <= c and d <= b) and not (c <= a and b <= d)


def test_license_rows(spark):
    got = license_scan.scan_licenses(docs(spark, ["x " * 50000 + "MIT License", None, "", "MIT License", "MIT License"])).collect()
    assert sorted((r.doc_id, r.start) for r in got) == [(0, 100000), (3, 0), (4, 0)]
    assert license_scan.scan_licenses(odd(spark)).count() == 0 and license_scan.scan_licenses(odd(spark).limit(0)).count() == 0


# 9 exact top-k


def test_top_k(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(150, 6)), rng.normal(3, 0.1, size=(60, 6))]).astype(np.float32)
    x[20:24] = x[19]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, []), (302, [float("nan")] * 6), (303, [None] * 6), (304, [1.0, 2.0]), (305, [1.0, 2.5])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in va_search.top_k(d.repartition(3), 5).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.neighbor_id, r.distance)
    y = x.astype(np.float64)
    for i in range(len(x)):
        dist = np.round(np.sqrt(((y - y[i]) ** 2).sum(axis=1)), 9)
        order = [j for j in np.lexsort((np.arange(len(x)), dist)) if j != i][:5]
        assert [got[i][r][0] for r in range(1, 6)] == order and [got[i][r][1] for r in range(1, 6)] == pytest.approx(dist[order])
    assert set(got) == {*range(len(x)), 304, 305} and got[304] == {1: (305, 0.5)}
    same = spark.createDataFrame([(None, [1.0]), (1, [1.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    assert sorted((str(r.vec_id), r.rank, str(r.neighbor_id)) for r in va_search.top_k(same).collect()) == [("1", 1, "1"), ("1", 1, "1"), ("1", 2, "None"), ("1", 2, "None"), ("None", 1, "1"), ("None", 2, "1")]
    assert va_search.top_k(d.limit(0)).count() == 0


def brute_nearest(x, i, k):
    d = np.round(np.sqrt(((x.astype(np.float64) - x[i].astype(np.float64)) ** 2).sum(axis=1)), 9)
    return [(int(j), d[j]) for j in np.lexsort((np.arange(len(x)), d)) if j != i][:k]


def test_top_k_asked(spark, monkeypatch):
    """Some queries, several blocks of queries and parts of the file, more candidates than are read at first, ids in any order, other columns."""
    for name, n in (("ROWS", 16), ("QUERIES", 4), ("GROUP", 3), ("STEP", 6)):
        monkeypatch.setattr(va_search, name, n)
    rng = np.random.default_rng(14)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    x[50:60] = x[40]
    rows = [(int(i), v.tolist(), 0, 0.0) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rid int, low double").repartition(3)
    got = {}
    for r in va_search.top_k(d, 4, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.neighbor_id, r.distance)
    assert set(got) == set(range(0, 400, 10))
    for i, found in got.items():
        assert [found[r] for r in range(1, 5)] == [(j, pytest.approx(s)) for j, s in brute_nearest(x, i, 4)]
    assert va_search.top_k(d, 4, F.lit(None).cast("boolean")).count() == 0


def test_bounds_hold_and_save_reads():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 7)).astype(np.float32)
    grid = va_search.Grid(np.zeros(7), np.ones(7))
    code = grid.cells(x)
    real = np.sqrt(((x[:50, None].astype(float) - x[None]) ** 2).sum(-1))
    boxes = np.sqrt([[grid.gaps(a[None], c[None])[0] for c in code] for a in x[:50]])
    assert (boxes <= real + 1e-12).all()
    scan = va_search.Scan(np.arange(50), x[:50], grid, 3)
    off = np.linalg.norm(x - grid.middles(code), axis=1)
    for at in (0, 200):
        scan.add(np.arange(at, at + 200), off[at : at + 200], code[at : at + 200])
    q, rid, low = scan.left()
    np.fill_diagonal(real, np.inf)
    assert (low <= real[q, rid]).all() and len(q) < 50 * 400 / 2 and (scan.top.max(axis=1) >= np.sort(real, axis=1)[:, 2]).all()
    pairs = set(zip(q.tolist(), rid.tolist()))
    assert all((i, int(j)) in pairs for i in range(50) for j in np.argsort(real[i])[:3])


# 10 language ID


def test_language_id(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    test = d.where("doc_id % 4 = 0")
    model = language_id.train(d.where("doc_id % 4 <> 0"))
    rows = test.where("length(text) > 100").select("text", "lang").collect()
    p = model.probabilities([r.text for r in rows])
    right = np.mean([model.languages[i] == r.lang for i, r in zip(p.argmax(axis=1), rows)])
    assert right > 0.95 and model.heldout_accuracy > 0.9 and 0.05 <= model.temperature <= 5
    assert (model.weights == 0).mean() > 0.3
    got = language_id.identify_languages(d.limit(0))
    assert got.count() == 0 and language_id.keep_identified(d.limit(0)).count() == 0


def test_language_cases(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd(spark).select("doc_id", "text", "lang", "source", "n_chars").withColumn("lang", F.lit(None).cast("string")))
    got = [r for r in language_id.identify_languages(d).collect() if r.lang is None]
    assert sorted(r.accepted for r in got if r.language is None) == [False] * 3
    kept = language_id.keep_identified(odd(spark))
    assert kept.columns == odd(spark).columns


def test_ftrl_separates():
    rng = np.random.default_rng(12)
    x, y = [], []
    for _ in range(300):
        c = int(rng.integers(2))
        i = np.unique(rng.integers(c * 100, c * 100 + 120, 20))
        x.append((i, np.full(len(i), 1 / np.sqrt(len(i)))))
        y.append(c)
    w, b = language_id.ftrl(x[:200], np.array(y[:200]), 2)
    assert np.mean([(v @ w[i] + b).argmax() == c for (i, v), c in zip(x[200:], y[200:])]) > 0.9


# pipeline and contract


def test_pipeline(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "sentencepiece"]
    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns = d.columns
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, d, SF).cache()
        assert after.columns == columns and 0 < after.count() <= d.count(), name
        d = after
    ids = {r.doc_id for r in d.collect()}
    found = cp.run(spark, SF).collect()
    assert {r.doc_id for r in found} == ids and all(r.round_trip for r in found)
    leaks = dc.find_leaks(d, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert leaks.count() == 0
