import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from versewise.llm import packing, token_store
from versewise.llm.common import scratch
from versewise.llm.encode import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
ENC = Encoder(PATH)
ODD = ["", " ", "a  b", "\n\n x", "it's  ok 's", "foo \n bar\t baz ", " lead", "trail ", "x  y  z", "<|endoftext|> hi",
       "a <|endoftext|> b", "日本 語  テ", "don't  you'll\r\n ok", "1 2  3,4 $$$ a$$$ 'tis", None, "\n", "a\nb", "\nab c", "\x1c a \x1c"]


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab's \n\t .1éß<|>"), max_size=30))
def test_encoder_equals_the_library(text):
    assert np.frombuffer(ENC.encode_all([text])[0], "<u4").tolist() == ids_of(text)


def test_encoder_forgets_without_changing_results():
    small = Encoder(PATH, keep=3)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encode_all(ODD)] == [ids_of(t) for t in ODD]


@pytest.mark.parametrize("bits", [1, 3, 8, 15, 16, 17, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype("<u4")
    raw = token_store.pack_bits(ids, bits)
    assert len(raw) == (1001 * bits + 7) // 8
    assert (token_store.unpack_bits(raw, bits, 1001) == ids).all()


def test_bits_for():
    assert [token_store.bits_for(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def test_store_round_trip_and_random_access(spark, docs, prose):
    rows = [(i * 37 % 101, t) for i, t in enumerate([*ODD, *[prose(n, n) for n in (1, 50, 700, 3000)]])]
    out = scratch(spark, "ids")
    manifest = token_store.write_ids(docs(rows), out, PATH, block=64, shard_ids=2000)
    got = {r["doc_id"]: r for r in token_store.read_ids(manifest).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = np.array([*ids_of(t), 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    shards = manifest.collect()
    assert len(shards) > 1
    shard = token_store.Shard(shards[0]["path"])
    every = shard.ids(0, shard.n_ids)
    for a, b in [(0, 1), (63, 65), (5, 5), (100, shard.n_ids), (shard.n_ids - 1, shard.n_ids)]:
        assert (shard.ids(a, b) == every[a:b]).all()


def test_store_of_nulls_repeats_and_nothing(docs):
    rows = token_store.token_ids(docs([(None, "b"), (2, "a"), (2, "a"), (2, None)]), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == [(0, 2), (2, 1), (2, 2), (2, 2)]
    assert min(r["start"] for r in rows if r["doc_id"] is None) == 0
    assert token_store.token_ids(docs([]), PATH).collect() == []


def check_packing(rows, text):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 1024
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, t in text.items():
        ids, at = np.array([*ids_of(t), 2], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r["piece"]):
            assert r["start"] == at and (r["piece"] == 0 or r["length"] == 1024)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return len(seqs)


def test_packing(docs, prose):
    text = {i: prose(n, i) for i, n in enumerate(np.random.default_rng(5).integers(1, 900, 120).tolist())}
    text |= {500: None, 501: "", 502: prose(4000, 7)}
    rows = packing.pack(docs(list(text.items())), PATH, with_ids=True)
    n = check_packing(rows.collect(), text)
    total = sum(len(ids_of(t)) + 1 for t in text.values())
    assert n <= 1.05 * total / 1024 + 1
    seqs = packing.sequences(rows).collect()
    assert len(seqs) == n and sum(len(s["ids"]) for s in seqs) == 4 * total


def test_packing_of_nulls_repeats_and_nothing(docs):
    rows = packing.pack(docs([(None, "b"), (2, "a"), (2, "a"), (2, None)]), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 2), (2, 1), (2, 2), (2, 2)]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 4
    assert packing.pack(docs([]), PATH).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=20))
def test_plan_uses_every_piece_once(histogram):
    made = packing.plan(histogram, 32)
    used = Counter()
    for parts, times in made:
        assert times > 0 and sum(parts) <= 32
        for p in parts:
            used[p] += times
    assert used == Counter(histogram)
    # no worse than plain best fit
    gaps = []
    for x in sorted(Counter(histogram).elements(), reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((32 if fit is None else fit) - x)
    assert sum(n for _, n in made) <= len(gaps)


def test_exact_fills():
    assert sorted(packing.plan_with({10: 4, 6: 4}, 16, 3)) == [((10, 6), 4)]
    assert packing.plan_with({10: 2, 4: 2, 2: 2}, 16, 3) == [((10, 4, 2), 2)]
    assert packing.plan_with({8: 3, 4: 3, 3: 3, 1: 3}, 16, 3)[0] == ((8, 8), 1)
    assert packing.plan_with({9: 2, 4: 2, 2: 2, 1: 2}, 16, 3) == [((9, 4, 2, 1), 2)]
