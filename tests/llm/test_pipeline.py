"""Each stage against what its operator's plain counterpart says of its own input."""
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.llm.test_near_dups import brute as classes
from tests.llm.test_repeats import brute as repeats
from tests.llm.test_tokens import check_packing
from versewise.llm import near_dups, repeats as R
from versewise.llm.common import DOC_COLUMNS, documents, stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [documents(spark, SF)]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out.append(stage(f(spark, out[-1], SF), f"test-{k}"))
    return [s.collect() for s in out]


def test_shape(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-dedup", "suffix-array dedup", "mixing", "best-fit packing"]
    for s in steps[:5]:
        assert list(s[0].asDict()) == DOC_COLUMNS


def test_quality_keeps_what_is_labelled_good(steps):
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    kept = {r["doc_id"] for r in steps[1]}
    good = [r["doc_id"] for r in labels if r["quality"] == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good) and len(kept) < len(steps[0])


def test_one_of_each_class_stays(steps):
    of = classes([(r["doc_id"], r["text"]) for r in steps[1]])
    assert sorted(r["doc_id"] for r in steps[2]) == sorted(set(of.values()))


def test_repeats_are_cut(steps):
    want = {i: (n, lost) for i, n, lost, _, _ in repeats([(r["doc_id"], r["text"]) for r in steps[2]], corpus_pipeline.PASSAGE_BYTES)}
    for r in steps[3]:
        n, lost = want[r["doc_id"]]
        assert n - lost <= len(r["text"].encode()) <= n - lost + 6 * (lost > 0) * 10 and r["n_chars"] == len(r["text"])


def test_mix_takes_documents_up_to_twice(steps):
    before, after = {r["doc_id"]: r for r in steps[3]}, Counter(r["doc_id"] for r in steps[4])
    assert set(after) <= set(before) and max(after.values()) <= 2
    words, taken = Counter(), Counter()
    for i, r in before.items():
        n = len(r["text"].split())
        words[r["source"]] += n
        taken[r["source"]] += n * after[i]
    assert 1.2 * sum(words.values()) < sum(taken.values()) < 1.8 * sum(words.values())


def test_pieces_hold_the_texts(steps):
    times = Counter(r["doc_id"] for r in steps[4])
    text = {r["doc_id"]: r["text"] for r in steps[4]}
    once, seen = [], defaultdict(int)
    for r in sorted(steps[5], key=lambda r: (r["doc_id"], r["piece"])):
        if not seen[r["doc_id"], r["piece"]]:
            once.append(r)
        seen[r["doc_id"], r["piece"]] += 1
    assert all(n == times[i] for (i, _), n in seen.items())
    by_seq = defaultdict(int)
    for r in steps[5]:
        by_seq[r["sequence_id"]] += r["length"]
    assert max(by_seq.values()) <= 1024
    single = [dict(r.asDict(), sequence_id=k, offset=0) for k, r in enumerate(once)]
    check_packing(single, text)


def test_operators_are_those_of_the_stages():
    assert corpus_pipeline.near_dups is near_dups and corpus_pipeline.repeats is R


def test_empty_documents(spark, docs):
    d = docs([])
    for _, f in corpus_pipeline.STAGES:
        d = f(spark, d, SF)
        assert d.collect() == []


def test_odd_documents(spark, docs):
    d = docs([(1, None), (1, None), (None, ""), (3, "a few words here"), (3, "a few words here"), (None, "some more words")])
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        d = stage(f(spark, d, SF), f"odd-{k}")
    assert {r["doc_id"] for r in d.collect()} <= {3, None}
