"""Scores of operators 6 and 7 against plain Python, and long texts in segments."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from matloom.llm import quality, simhash, toxicity

from .helpers import awkward, documents, words

ODD = ["", " \n ", "ONE one", "a a a b\nb b", "#1 $2 || ~~ {x}", "ÄÖÜ Éa ß ǅ", "x\n\nx\ny. y! 12%", "tab\there\r\nthere", "ab ab abc ab\nab", "word" * 500]


def statistics(text):
    t = text or ""
    n, w, lines = max(len(t), 1), [x for x in re.split("[ \t\r\n]+", t) if x], [x for x in t.split("\n") if x]
    each = re.split("[ \n]", t)
    count = lambda chars: sum(t.count(c) for c in chars) / n
    import regex

    return {
        "log_chars": math.log1p(len(t)), "chars_per_word": len(t) / max(len(w), 1), "words_per_line": len(w) / max(len(lines), 1),
        "distinct_words": len(set(w)) / max(len(w), 1), "repeated_words": sum(a == b != "" for a, b in zip(each, each[1:])) / max(len(w), 1),
        "distinct_lines": len(set(lines)) / max(len(lines), 1), "symbols": count("#$%&*+<=>@[]^_{|}~"), "pipes": count("|"), "exclamations": count("!"),
        "digits": count("0123456789"), "sentence_ends": count("."), "upper": len(regex.findall(r"\p{Lu}", t)) / n,
    }


def test_statistics_by_plain_python(spark):
    texts = [t for _, t in awkward(31)] + ODD
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in quality.with_statistics(documents(spark, rows), "text", "q_").collect()}
    for i, t in rows:
        for name, value in statistics(t).items():
            assert got[i]["q_" + name] == pytest.approx(value), (name, t)


def test_quality_scores_by_plain_python(spark):
    rng = random.Random(32)
    rows = [(i, words(rng, 40) if i % 2 else "| ".join(words(rng, 3) for _ in range(12))) for i in range(200)] + [(300 + i, t) for i, t in enumerate(ODD)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    docs = documents(spark, rows).drop("score")
    model = quality.fit_quality(docs, labels)
    assert model.rules
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    for i, t in rows:
        s = statistics(t)
        total = model.bias + sum(w for rule, w in model.rules if all(s[n] <= cut if low else s[n] > cut for n, low, cut in rule))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)))


def brute_toxicity(positive, unlabelled, prior):
    """Features, then the non-negative risk's minimum by the same steps, with dense matrices and plain loops."""
    feats = lambda t: [f for w in sorted(set(re.findall(r"[^\W\d_]+", (t or "").lower()))) for f in (w, *(w[:n] + "*" for n in (4, 5, 6, 7) if len(w) >= n))]
    docs = [[feats(t) for t in kind] for kind in (positive, unlabelled)]
    n_p, n_u = len(positive), len(unlabelled)
    z = {}
    for f in {f for d in docs[0] for f in d}:
        a, b = (sum(f in d for d in kind) for kind in docs)
        p, u = a / n_p, b / n_u
        score = (p - u) / math.sqrt((p * (1 - p) + 1 / n_p) / n_p + (u * (1 - u) + 1 / n_u) / n_u)
        if a >= 3 and score > 1 + math.log10(n_p):
            z[f] = score
    names = sorted(z, key=lambda f: (-z[f], f))
    x = [np.array([[d.count(f) for f in names] + [1] for d in kind], float) for kind in docs]
    w, m, v = np.zeros(len(names) + 1), 0, 0
    w[-1] = math.log(prior / (1 - prior))
    for step in range(1, 401):
        fp, fu = x[0] @ w, x[1] @ w
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        risk = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g = (x[1] * su[:, None]).mean(0) - prior * (x[0] * sp[:, None]).mean(0)
        g = g + prior * (x[0] * (sp - 1)[:, None]).mean(0) if risk >= 0 else -g
        g[:-1] += 5e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return lambda t: 1 / (1 + math.exp(-(w[-1] + sum(w[names.index(f)] for f in feats(t) if f in names)))), names


def test_toxicity_scores_by_plain_python(spark):
    rng = random.Random(33)
    bad = ["grumbling", "snarl", "vile", "nasty"]
    rows = [(i, words(rng, 20) + (" " + " ".join(rng.sample(bad, 2)) if i % 4 == 0 else "")) for i in range(240)] + [(400 + i, t) for i, t in enumerate(ODD)] + [(None, "vile"), (7, rows_text(rng))]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(240)] + [(None, 1)], "doc_id bigint, toxic int")
    import zlib

    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 != 2
    least = {}
    for i, t in rows:  # of repeated ids the text whose words come first
        if fold(i):
            key = " ".join(sorted(set(re.findall(r"[^\W\d_]+", (t or "").lower()))))
            least[i] = min(least.get(i, (key, t)), (key, t))
    toxic = [i for i in range(240) if fold(i) and i % 8 == 0]
    prior = len(toxic) / sum(fold(i) for i in range(240))
    score, names = brute_toxicity([least[i][1] for i in toxic], [least[i][1] for i in sorted(least)], prior)
    model = toxicity.fit_toxicity(docs, labels)
    assert set(model.weights) == set(names) and len(names) >= 4
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in toxicity.score_toxicity(docs, model).collect())
    expected = sorted((i is None, i or 0, score(t)) for i, t in rows)
    assert np.allclose([g[2] for g in got], [x[2] for x in expected], atol=1e-6) and [g[:2] for g in got] == [x[:2] for x in expected]


def rows_text(rng):
    return words(rng, 10)


def test_long_texts_in_segments(monkeypatch):
    rng = random.Random(34)
    texts = [words(rng, n).encode() for n in (1, 3, 50, 4000)] + [None, b"", b"   ", b"x" * 5000, b"a " * 3000, b"one two\tthree\nfour"]
    whole = [simhash.folded(pa.array(texts, pa.binary()), 4, 42, k, k > 1) for k in (1, 4)]
    for size in (1, 7, 100):
        monkeypatch.setattr(simhash, "SEGMENT", size)
        for k, (n, fp) in zip((1, 4), whole):
            got = simhash.folded(pa.array(texts, pa.binary()), 4, 42, k, k > 1)
            assert (got[0] == n).all() and (got[1] == fp).all()
