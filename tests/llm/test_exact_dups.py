import hashlib
import re
from collections import Counter, defaultdict

import pytest

from versewise.llm import common, exact_dups as X


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append((i is None, i or 0))
    keep, out, seen = {t: min(g) for t, g in groups.items()}, [], set()
    for i, t in norm:
        null, k = keep[t]
        first = (i is None, i or 0) == keep[t] and t not in seen
        if first:
            seen.add(t)
        out.append((i, None if null else k, len(groups[t]), first, hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out)


def corpus(prose):
    same = prose(30, 5)
    rows = [(i, same) for i in range(900, 600, -1)] + [(i, prose(3 + i % 7, i % 90)) for i in range(400)]
    return rows + [(None, same), (None, "alone"), (None, "alone"), (901, None), (902, ""), (903, " "), (904, "\t \n"), (905, "a b"), (906, "a b"),
                   (907, " a b"), (908, "a\x0b\x0cb"), (909, "A b"), (910, "x y " * 60_000), (911, "x\ny\t" * 60_000), (5, same), (5, same)]


@pytest.mark.parametrize("run", [50, 1 << 18])
def test_against_plain_groups(docs, prose, monkeypatch, run):
    monkeypatch.setattr(X, "RUN", run)
    rows = corpus(prose)
    got = Counter(tuple(r) for r in X.duplicates(docs(rows)).collect())
    assert got == brute(rows)


def test_every_number_of_rounds_and_a_join_without_broadcast(docs, prose, monkeypatch):
    rows = corpus(prose)
    monkeypatch.setattr(X, "PLACE", 10)
    monkeypatch.setattr(common, "HOT", 1)
    assert Counter(tuple(r) for r in X.duplicates(docs(rows).repartition(13)).collect()) == brute(rows)


def test_equal_digests_are_verified():
    a = [(7, b"x", False, 3, 0, 1), (7, b"y", False, 1, 1, 1), (7, b"y", False, 2, 2, 4), (8, b"y", True, 0, 3, 1)]
    assert list(X.distinct(a)) == [a[0], (7, b"y", False, 1, 1, 5), a[3]]
    assert list(X.unpacked(X.packed([(1, b"r" * 24, True, -5, 9, 2)]))) == [(1, b"r" * 24, True, -5, 9, 2)]


def test_an_exchange_takes_each_entry_towards_its_place():
    entries = [(k << 55, b"", False, k, k, 1) for k in range(512)]
    place = {e[0]: 77 for e in entries}
    for digit in range(3):
        for p in set(place.values()):
            for to, source, block in X.exchange([e for e in entries if place[e[0]] == p], p, digit, 3):
                for e in X.unpacked(block):
                    place[e[0]] = to
    assert all(p == d >> 55 for d, p in place.items())


def test_kept_rows(docs):
    d = docs([(3, "a  b"), (1, "a b"), (1, "a b"), (2, "c"), (None, "c"), (None, "d")])
    out = X.deduplicated(d)
    assert out.columns == d.columns and sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == [(0, "d"), (1, "a b"), (2, "c")]


def test_nothing(docs):
    assert X.duplicates(docs([])).collect() == []
