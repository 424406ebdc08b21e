import hashlib
import re

import xxhash

from versewise.llm import fingerprints as fp


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def winnow(text, k=fp.K, window=fp.WINDOW):
    w = re.findall(r"[^\x20\x09-\x0D]{1,%d}" % fp.LONGEST, text)
    if not w:
        return [], []
    def chain(parts):
        # what stands beyond the end adds nothing
        h = 42
        for x in parts:
            h = xxhash.xxh64_intdigest(x, seed=h)
        return h

    pairs = [chain(x.encode() for x in w[i:i + 2]) for i in range(len(w))]
    hashes = [signed(chain(p.to_bytes(8, "little") for p in pairs[i:i + k - 1:2])) for i in range(max(1, len(w) - k + 1))]
    at = []
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i:i + window]
        j = i + min(range(len(part)), key=lambda j: (part[j] & fp.LOW, -j))
        if j not in at:
            at.append(j)
    return [hashes[i] for i in at], at


def alike(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def written(hashes, at):
    if not at:
        return ""
    return " ".join(f"{h & (1 << 64) - 1:X}" for h in hashes) + ";" + " ".join(str(p - q) for p, q in zip(at, [0, *at]))


def test_against_plain_winnowing(docs, prose):
    rows = [(i * 7 % 40, prose(n, i)) for i, n in enumerate([0, 1, 3, 5, 6, 15, 16, 20, 21, 40, 200, 900])]
    rows += [(60 + i, prose(n, 60 + i)) for i, n in enumerate([400, 2, 60, 3, 11, 12, 13, 14, 30, 9, 10])]
    rows += [(80 + i, "x" * n) for i, n in enumerate([200, 43, 44, 45, 46, 47, 14, 15, 16, 30])] + [(95, "a \t b" * 500), (96, "語" * 9000), (97, prose(20_000, 97))]
    rows += [(50, None), (51, ""), (52, "ä" * 100), (53, prose(200, 10)), (54, "a a a a a a a a a a a a a a a a a a a a a a a a")]
    text = {i: t or "" for i, t in rows}
    order = sorted(text, reverse=True)
    got = {r["doc_id"]: r for r in fp.edited_comparison(docs(rows)).collect()}
    assert set(got) == set(text)
    for i, x in text.items():
        follow = text[order[(order.index(i) + 1) % len(order)]]
        edited = x[:len(x) - len(x) // 3] + follow[:len(x) // 3]
        (a, at), (b, bt), (c, _) = winnow(x), winnow(edited), winnow(follow)
        r = got[i]
        assert r["n_chars"] == len(x) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == written(a, at) and r["edited_fingerprint"] == written(b, bt)
        assert r["near_edited"] == alike(a, b) and r["near_next"] == alike(a, c)


def test_match_guarantee(docs, prose):
    common = prose(fp.K + fp.WINDOW - 1, 99)
    rows = [(1, prose(50, 1) + " " + common + " " + prose(30, 2)), (2, prose(9, 3) + " " + common + " " + prose(70, 4))]
    a, b = [set(r["fp"]["hash"]) for r in fp.fingerprints(docs(rows)).collect()]
    assert a & b


def test_short_texts_share_with_their_edited_form(docs):
    import numpy as np
    r = np.random.default_rng(4)
    rows = [(i, " ".join("".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), r.integers(4, 8))) for _ in range(5 + i % 46))) for i in range(138)]
    got = {x["doc_id"]: x for x in fp.edited_comparison(docs(rows)).collect()}
    assert [i for i, _ in rows if not 0.1 < got[i]["near_edited"] < 1] == []


def test_passage_in_unspaced_texts(docs):
    import numpy as np
    r = np.random.default_rng(5)
    run = lambda n: "".join(chr(0x4E00 + x) for x in r.integers(0, 2000, n))
    common = run(fp.K + fp.WINDOW - 1)
    a, *others = [set(x["fp"]["hash"]) for x in fp.fingerprints(docs([(i, run(100 + i) + common + run(90)) for i in range(33)])).collect()]
    assert all(a & b for b in others)


def test_single_null_repeated_and_empty(docs):
    one = fp.edited_comparison(docs([(3, "a b c d e f g h i")])).collect()
    assert one[0]["near_next"] == 1.0
    rows = fp.edited_comparison(docs([(None, "one two three"), (1, "x y z"), (1, "x y z"), (1, None), (2, None)])).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 1, 1, 2]
    assert fp.edited_comparison(docs([])).collect() == []


def test_ranges_by_binary_search(spark):
    from pyspark.sql import functions as F
    for n in (0, 1, 2, 3, 7, 8, 100):
        cuts = sorted({x * 37 % 211 for x in range(n)}, reverse=True)
        got = spark.range(-1, 213).select("id", fp.range_of(F.col("id"), cuts).alias("r")).collect()
        assert all(r["r"] == sum(r["id"] < c for c in cuts) for r in got)


def test_no_python_in_the_plan(docs):
    plan = fp.edited_comparison(docs([(1, "a b c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
