from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from versewise.llm import near_dups
from versewise.llm.vectors import words_of


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.lists(st.integers(0, 5), min_size=1, max_size=60)), min_size=1, max_size=5))
def test_alignment_is_exact(pairs):
    got = near_dups.linked([(np.array(a, "<u4"), np.array(b, "<u4")) for a, b in pairs])
    assert got.tolist() == [distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9) for a, b in pairs]


def test_wide_bands():
    r = np.random.default_rng(2)
    a = r.integers(0, 1000, 1500).astype("<u4")
    moved = np.concatenate([a[150:], a[:150]])   # 150 out, 150 in: within a fifth
    far = np.concatenate([a[200:], a[:200]])     # beyond it
    assert near_dups.linked([(a, moved), (a, far)]).tolist() == [True, False]
    assert near_dups.banded([a], [moved], 400)[0] == 300


def test_sketches_keep_order():
    w = words_of(" ".join(f"w{i}" for i in range(200)))
    assert (near_dups.sketches(w) == near_dups.sketches(w.copy())).all()
    halves = np.concatenate([w[100:], w[:100]])
    agree = (near_dups.sketches(w) == near_dups.sketches(halves)).mean()
    assert 0 < agree < 0.6  # nearly the same shingles, in another order


def brute(rows):
    """Components over all pairs with the same test of the words."""
    words = defaultdict(list)
    for i, t in rows:
        if i is not None:
            words[i].append(words_of(t).astype("<u4"))
    root = {i: i for i in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(sorted(words), 2):
        if any(len(x) and len(y) and near_dups.linked([(x, y)])[0] for x in words[a] for y in words[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in words}


def edit(text, n, seed):
    w, r = text.split(), np.random.default_rng(seed)
    for k in range(n):
        at = int(r.integers(0, len(w)))
        kind = k % 3
        if kind == 0:
            w[at] = f"new{seed}x{k}"
        elif kind == 1:
            w.insert(at, f"ins{seed}x{k}")
        elif len(w) > 5:
            w.pop(at)
    return " ".join(w)


def test_against_all_pairs(docs, prose):
    base = [prose(n, n) for n in (12, 40, 90, 200, 400)]
    rows, k = [], 100
    for b, t in enumerate(base):
        for e in range(8):
            rows.append((k, edit(t, max(0, len(t.split()) * e // 250), 10 * b + e)))
            k += 1
    passage = prose(60, 77)
    rows += [(300 + i, prose(120, 500 + i) + " " + passage + " " + prose(100, 600 + i)) for i in range(20)]
    rows += [(400 + i, base[2].upper()) for i in range(5)] + [(410, None), (411, ""), (412, " \n"), (413, "one two"), (414, "one  two"), (415, "three")]
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(docs(rows)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, 0.2])
def test_lone_pairs_are_found(docs, rate):
    """One original and one copy, edited up to the link's limit, words replaced, put in and left out."""
    r, rows, pairs = np.random.default_rng(int(100 * rate)), [], 0
    for n in (10, 20, 31, 36, 50, 100, 400):
        for _ in range(12):
            a = [f"w{x}" for x in r.integers(0, 10 ** 9, n)]
            b = list(a)
            for at in sorted(r.choice(n, int(n * rate), False).tolist(), reverse=True):
                b[at:at + 1] = [[f"e{r.integers(0, 10 ** 9)}"], [a[at], f"e{r.integers(0, 10 ** 9)}"], []][int(r.integers(0, 5)) % 3]
            rows += [(2 * pairs, " ".join(a)), (2 * pairs + 1, " ".join(b))]
            pairs += 1
    words = [words_of(t).astype("<u4") for _, t in rows]
    near = near_dups.linked([(words[2 * k], words[2 * k + 1]) for k in range(pairs)])
    assert near.sum() > 0.8 * pairs
    got = {x["doc_id"]: x["class_id"] for x in near_dups.classes(docs(rows)).collect()}
    assert [k for k in range(pairs) if near[k] != (got[2 * k + 1] == 2 * k)] == []
    assert all(got[2 * k] == 2 * k for k in range(pairs))


@pytest.mark.parametrize("n", [5, 6, 10, 20, 31, 32, 39, 40, 100, 1000])
def test_evenly_spread_edits_leave_shared_sketches(n):
    """The edits that leave fewest shingles: one word in five."""
    r, hits = np.random.default_rng(n), 0
    for _ in range(100):
        a = r.integers(0, 1 << 62, n).astype(np.uint64)
        b = a.copy()
        b[2::5][:n // 5] += np.uint64(1)
        hits += len(np.intersect1d(near_dups.sketches(a), near_dups.sketches(b))) > 0
    assert hits >= 88


@pytest.mark.parametrize("block", [512, 4])
def test_links_beyond_the_leader_are_found(docs, prose, monkeypatch, block):
    """A bucket whose smallest node is near to none, with two families in it."""
    one = np.arange(1, near_dups.SKETCHES + 1, dtype=np.uint64)
    monkeypatch.setattr(near_dups, "sketches", lambda w: one)
    monkeypatch.setattr(near_dups, "BLOCK", block)
    a, b = prose(100, 1), prose(100, 2)
    rows = [(0, prose(100, 3))] + [(1 + i, edit(a, i % 4, i)) for i in range(9)] + [(50 + i, edit(b, i % 4, i)) for i in range(9)]
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(docs(rows)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("share", [0.5, 0.7])
def test_pairs_in_a_large_bucket_are_found(docs, prose, monkeypatch, share):
    """Texts that share a passage and little else make large buckets; the pairs among them that are near."""
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    r = np.random.default_rng(int(10 * share))
    passage = [f"p{x}" for x in range(int(100 * share))]
    rows, pairs = [], []
    for k in range(150):
        own = [f"w{x}" for x in r.integers(0, 10 ** 6, 100 - len(passage))]
        at = int(r.integers(0, len(own) + 1))
        a = own[:at] + passage + own[at:]
        rows.append((2 * k, " ".join(a)))
        if k % 2 == 0:
            b = list(a)
            for x in r.choice(100, int(r.integers(2, 19)), False):
                b[x] = f"e{k}x{x}"
            rows.append((2 * k + 1, " ".join(b)))
            pairs.append(2 * k)
    open_ = []
    compare = near_dups.dealt_anew
    monkeypatch.setattr(near_dups, "dealt_anew", lambda large, kmers: (open_.append(large.count()), compare(large, kmers))[1])
    got = {x["doc_id"]: x["class_id"] for x in near_dups.classes(docs(rows)).collect()}
    assert open_ and open_[0] > 100
    found = sum(got[a] == got[a + 1] == a for a in pairs)
    assert found >= 0.95 * len(pairs)
    assert all(got[i] == i for i, _ in rows if i not in {p + 1 for p in pairs})


def test_links_that_hang_on_a_passage_are_found(docs, monkeypatch):
    """Texts of a large bucket that are linked though they have but two lone words in common beside the passage."""
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    passage = [f"p{x}" for x in range(78)]
    rows = [(0, " ".join(passage + [f"lead{x}" for x in range(120)]))]
    for k in range(30):
        own = [f"a{k}x{x}" for x in range(22)]
        other = [w if x in (6, 15) else f"b{k}x{x}" for x, w in enumerate(own)]
        rows += [(2 * k + 1, " ".join(passage + own)), (2 * k + 2, " ".join(passage + other))]
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(docs(rows)).collect()}
    assert got == brute(rows) and all(got[2 * k + 2] == 2 * k + 1 for k in range(30))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 2), st.integers(0, 30)), max_size=14),
       st.dictionaries(st.integers(0, 30), st.integers(1, 50)))
def test_prefixes_of_linked_texts_meet(a, edits, often):
    """Whatever is known of the words' numbers."""
    b = list(a)
    for at, kind, w in edits:
        b[at:at + (kind > 0)] = [w] * (kind < 2)
    a, b = np.array(a, np.uint64), np.array(b, np.uint64)
    known = {int(near_dups.labelled(np.array([w], np.uint64), 1)[0]): n for w, n in often.items()}
    words, times = np.array(sorted(known), np.uint64), np.array([known[w] for w in sorted(known)], np.int64)
    if len(b) and near_dups.linked([(a, b)])[0]:
        assert len(np.intersect1d(near_dups.prefix(a, words, times), near_dups.prefix(b, words, times)))


def test_remains_have_what_the_head_lacks():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 1 << 62, 50).astype(np.uint64), r.integers(0, 1 << 62, 40).astype(np.uint64)
    both = np.concatenate([a, b])
    assert (near_dups.remains(both, a) == b).all() and len(near_dups.remains(a, both)) == 0
    assert (near_dups.picks_of(b) == near_dups.picks_of(b[::-1])).all() and len(set(near_dups.picks_of(b).tolist())) == near_dups.AGAIN
    assert (near_dups.picks_of(a[:0]) == near_dups.picks_of(np.zeros(0, np.uint64))).all()


def block_links(rows):
    return near_dups.block_links(*[rows[c].tolist() for c in ("node", "label", "side", "words", "buckets")], rows["bucket"].iloc[0])


def test_block_links_are_those_of_all_pairs(prose):
    import pandas as pd
    texts = [edit(prose(60, s), k, 7 * s + k) for s in range(4) for k in (0, 2, 6, 12)]
    words = [words_of(t).astype("<u4") for t in texts]
    rows = pd.DataFrame({"node": range(16), "label": range(16), "side": [i % 2 for i in range(16)], "words": [w.tobytes() for w in words],
                         "buckets": [[5, 9]] * 16, "bucket": 5})
    joined = lambda links: {frozenset(x) for x in links}
    every = {frozenset((i, j)) for i, j in combinations(range(16), 2) if near_dups.linked([(words[i], words[j])])[0]}
    found = joined(block_links(rows))
    assert found and found <= {p for p in every if len({i % 2 for i in p}) == 2}
    assert block_links(rows.assign(bucket=9)) == []      # left to the smaller bucket
    one = joined(block_links(rows.assign(side=0)))

    def parts(links):
        root = list(range(16))
        for _ in range(16):
            for a, b in map(sorted, links):
                root[b] = root[a] = min(root[a], root[b])
        return root
    assert parts(one) == parts(every)


def test_block_links_of_very_long_texts():
    """One word over 65 535 times, nearly all of the text."""
    import pandas as pd
    a = np.full(90_000, 7, "<u4")
    b = a.copy()
    b[::1000] = np.arange(100, 190)
    rows = pd.DataFrame({"node": [1, 2], "label": [1, 2], "side": [0, 0], "words": [a.tobytes(), b.tobytes()],
                         "buckets": [[5]] * 2, "bucket": 5})
    assert block_links(rows) == [(1, 2)]


def test_block_links_of_a_node_with_two_texts(prose):
    import pandas as pd
    one, two, near = [words_of(t).astype("<u4").tobytes() for t in (prose(60, 1), prose(60, 2), edit(prose(60, 2), 3, 5))]
    for texts in ((one, two), (two, one)):
        rows = pd.DataFrame({"node": [1, 1, 1, 2], "label": [1, 1, 1, 2], "side": 0, "words": [*texts, texts[0], near],
                             "buckets": [[5]] * 4, "bucket": 5})
        assert block_links(rows) == [(1, 2)]


def test_long_chains_are_one_class(spark):
    n = 71
    labels = spark.createDataFrame([(i, i) for i in range(n)], "node long, label long")
    links = spark.createDataFrame([((7 * i) % n, (7 * i + 7) % n) for i in range(n - 1)], "a long, b long")
    got = near_dups.merged(labels, links, "t").collect()
    assert {r["label"] for r in got} == {0} and len(got) == n


@pytest.mark.parametrize("rows", [[], [(None, "a b c"), (None, "a b c"), (3, "a b c"), (3, "a b c"), (3, "other words here"), (2, "Other Words here"), (9, None)]])
def test_nulls_and_repeats(docs, rows):
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in near_dups.classes(docs(rows)).collect())
    assert got == ([(0, 0), (0, 0), (2, 2), (3, 2), (3, 2), (3, 2), (9, 9)] if rows else [])
    d = docs(rows)
    left = near_dups.kept(d)
    assert left.columns == d.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == ([0, 0, 2, 9] if rows else [])
