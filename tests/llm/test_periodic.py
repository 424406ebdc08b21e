import hashlib
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from versewise.llm import periodic as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=6, power=4):
    """Every stretch that repeats with a distance and can't be extended, if the distance is its smallest period."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            s, n = i - q, j - i + q
            if j > i and n >= max(least, power * q) and not any(w[s + d:s + n] == w[s:s + n - d] for d in range(1, q)):
                out.append((s, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


repeating = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 40)).map(lambda t: (t[0] * 40)[:t[1]])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(0, 3), max_size=12), repeating), max_size=5), st.sampled_from([(6, 4), (2, 2), (4, 3)]))
def test_runs_against_every_distance(parts, limits):
    w = sum(parts, [])
    assert P.runs(w, *limits) == brute(w, *limits) == P.runs(w, *limits, cut=False)


def test_long_and_very_regular():
    assert P.runs([0] * 50_000) == [(0, 50_000, 1)]
    a = [0]
    b = [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert P.runs(b, 2, 3) == P.runs(b, 2, 3, cut=False) and P.runs(b) == []  # Fibonacci words hold no fourth power
    w = list(range(5000)) * 4
    assert P.runs(w) == [(0, 20_000, 5000)]


def plain(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_query_against_plain_python(docs, prose):
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "b " * 40 + "c", prose(300, 1), prose(60, 2) * 5, "x y " * 30 + prose(50, 3) + " u v w" * 9,
             "a\x0ba\x0ca\x1ca a a a a a", "é É " * 8, "a b c d a b c d a b c d a b c d", "p q p q p q p q r r r r r r r r", prose(200, 4, vocab=3), "日本 " * 7]
    rows = [(i, texts[i % len(texts)] if i % 3 else prose(i, i)) for i in range(220)]
    got = P.summary(P.periodic_runs(P.with_planted(docs(rows)))).drop("n_words").collect()
    assert sorted(map(tuple, got)) == sorted(plain(*r) for r in rows)
    assert sum(r["n_runs"] > 0 for r in got) > 20


def test_spans_and_collapsed_text(docs):
    row = P.periodic_runs(docs([(1, "start  one two one two one two one two\nend")])).first()
    assert row["runs"] == [(1, 8, 2)] and row["collapsed"] == "start one two end" and row["n_words"] == 10


def test_nulls_repeats_and_nothing(docs):
    rows = [(None, "a " * 9), (1, None), (2, "la " * 9), (2, "la " * 9), (2, "")]
    got = P.summary(P.periodic_runs(docs(rows))).collect()
    assert sorted((r["doc_id"] or 0, r["n_runs"]) for r in got) == [(0, 1), (1, 0), (2, 0), (2, 1), (2, 1)]
    assert P.with_planted(docs(rows)).count() == 5
    assert P.summary(P.periodic_runs(P.with_planted(docs([])))).collect() == []


@pytest.mark.parametrize("n", [1, 2, 5, 17])
def test_made_periodic(n):
    for i in range(400):
        w = [str(k).encode() for k in range(n)]
        h = zlib.crc32(str(i).encode())
        a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
        assert P.made_periodic(i, w) == ([w[k] if k < a else w[a + (k - a) % p] for k in range(n)] if h % 10 == 0 else w)
