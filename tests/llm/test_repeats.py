import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from versewise.llm import repeats


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8, unique=True))
def test_suffix_sort_finds_repeats(parts):
    got = repeats.repeated_starts([(p, len(p) - 5) for p in parts], 6)
    seen = Counter(p[i:i + 6] for p in parts for i in range(len(p) - 5))
    assert [g.tolist() for g in got] == [[i for i in range(len(p) - 5) if seen[p[i:i + 6]] > 1] for p in parts]


def test_two_stage_order():
    raw = np.frombuffer(np.random.default_rng(4).integers(97, 100, 500).astype(np.uint8).tobytes() + b"\0" * 31, np.uint8)
    got = repeats.two_stage(raw, np.ones(501, bool), 30).tolist()
    keys = [raw[i:i + 30].tobytes() for i in got]
    assert sorted(got) == list(range(501)) and keys == sorted(keys)


def test_equal_strings_have_equal_anchors():
    r = np.random.default_rng(0)
    common = r.integers(97, 123, 500).astype(np.uint8)
    x = np.concatenate([r.integers(97, 123, 700).astype(np.uint8), common, r.integers(97, 123, 90).astype(np.uint8)])
    a, b = repeats.contexts(common), repeats.contexts(x)
    assert set(a[2].tolist()) <= set(b[2].tolist())
    assert b[1].sum() == len(x) - 399 and (b[0] + b[1] == np.append(b[0][1:], len(x) - 399)).all()


def brute(rows, length=400):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[i:i + length] for _, b in raws for i in range(len(b) - length + 1))
    out = []
    for i, b in raws:
        hit = np.zeros(len(b) + 2, np.int8)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                hit[k + 1:k + 1 + length] = 1
        rest = bytes(x for x, h in zip(b, hit[1:]) if not h)
        out.append((i, len(b), int(hit.sum()), int((np.diff(hit) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return Counter(out)


def corpus(prose):
    long, shared = prose(900, 1), prose(120, 2)
    rows = [(1, long), (2, long[:2000] + " changed " + long[2000:]), (3, prose(80, 3) + shared), (4, shared + "é" + prose(90, 4)), (5, prose(70, 5) + shared + prose(70, 6)),
            (6, shared[:399]), (7, shared[:400]), (8, "ab" * 700), (9, "z" * 900), (10, prose(300, 7) * 2), (11, None), (12, ""), (None, long), (13, "日本語テキスト" * 40),
            (14, "\0" * 500), (2, prose(200, 8)), (2, prose(200, 8)), (15, prose(4000, 9))]
    return rows


@pytest.mark.parametrize("hot", [4000, 1])
def test_against_every_string(docs, prose, monkeypatch, hot):
    rows = corpus(prose)
    monkeypatch.setattr(repeats, "BATCH", 4000)
    d = docs(rows)
    if hot == 1:
        every = repeats.marks
        monkeypatch.setattr(repeats, "marks", lambda docs, text_col, length: every(docs, text_col, length, hot=1))
    got = repeats.repeats(d).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute(rows) and all(r["n_kept"] == r["n_bytes"] - r["n_removed"] for r in got)


def test_cut_texts(docs, prose):
    rows = corpus(prose)
    d = docs(rows)
    got = repeats.without_repeats(d)
    assert got.columns == d.columns
    by = {r["doc_id"]: r["text"] for r in got.collect() if r["doc_id"] not in (2, None)}
    assert by[11] is None and by[12] == "" and by[15] == rows[-1][1] and by[1] == "" and by[9] == ""
    assert by[3] == prose(80, 3) and by[4] == "é" + prose(90, 4) and by[6] == rows[5][1]


def test_nothing(docs):
    assert repeats.repeats(docs([])).collect() == []
    assert repeats.without_repeats(docs([])).collect() == []
