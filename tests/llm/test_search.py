import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from versewise.llm import search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def brute(docs, items, k=50):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in tf), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        rows = []
        for i, c in tf:
            n = c.total()
            score = 0
            for t in words & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + (50 * n * n_docs) // total
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(rows)[:k])]
    return Counter(out)


@pytest.fixture()
def items(spark):
    return lambda rows: spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "item_id long, text string, term string, score string")


def found(spark, docs, items, d, q, **kw):
    return Counter(tuple(r) for r in S.search(docs(d), items(q), **kw).select("item_id", "rank", "doc_id", "score").collect())


def corpus(seed, n, vocab=60):
    r = random.Random(seed)
    words = [r.choice(["w", "Ä", "x"]) + str(int(vocab * r.random() ** 3)) for _ in range(5 * vocab)]
    return [(i * 3 % 1009, " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("lot", [7, 1 << 15])
def test_against_all_scores(spark, docs, items, monkeypatch, lot):
    monkeypatch.setattr(S, "LOT", lot)
    d = corpus(1, 500) + [(None, "w1 x2"), (2000, None), (2001, ""), (2002, " \x00!?"), (2003, "W1 w1 É é Ａ ÀB b1_c2"), (5000, "w3 " * 30_000)]
    q = [(i, t) for i, t in corpus(2, 12)] + [(50, None), (51, ""), (52, "nothing has this"), (53, "w1 É e"), (None, "x1 w2"), (54, "w1"), (54, "x2 w1"),
                                            (55, " ".join(f"w{i}" for i in range(60)))]
    assert found(spark, docs, items, d, q) == brute(d, q)
    assert found(spark, docs, items, d, q, k=3, pairs=20) == brute(d, q, 3)


def test_ties_go_to_the_smaller_id(spark, docs, items):
    d = [(i, "same words here") for i in range(200, 0, -1)] + [(500, "other")]
    got = found(spark, docs, items, d, [(1, "words same")])
    assert got == brute(d, [(1, "words same")]) and {r[2] for r in got} == set(range(1, 51))


def test_a_copy_of_most_rows(spark, docs, items):
    d = [(i, "the common passage of many rows") for i in range(1000)] + corpus(3, 100)
    q = [(1, "the common passage"), (2, "w1 common"), (3, "x1 w2 w3 w4")]
    assert found(spark, docs, items, d, q) == brute(d, q)


def test_no_accumulators_after_the_bound():
    r = np.random.default_rng(0)
    n = 3000
    rare, common = r.choice(n, 80, replace=False), np.arange(n)
    terms_ = [np.array(([0] if i in set(rare.tolist()) else []) + [1], "<u4").tobytes() for i in common]
    tf = [np.ones(len(t) // 4, "<u4").tobytes() for t in terms_]
    index = S.Index(np.full(n, 20, np.int64), terms_, tf, 2, n, 20 * n)
    weight = S.weights(np.array([80, n]), n)
    places, scores = S.scored(index, np.array([0, 1]), weight)
    assert sorted(places.tolist()) == sorted(rare.tolist())  # the common term made none
    assert (scores == weight[0] * index.share[0] + weight[1] * index.share[-1]).all()  # but updated all


def test_nothing(spark, docs, items):
    assert found(spark, docs, items, [], [(1, "a")]) == Counter()
    assert found(spark, docs, items, [(1, "a")], []) == Counter()
    assert found(spark, docs, items, [(1, None)], [(1, None)]) == Counter()
