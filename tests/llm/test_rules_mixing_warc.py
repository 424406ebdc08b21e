import base64
import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from versewise.llm import mixing, quality_rules, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_rules(text):
    t = text or ""
    w = WORD.findall(t)
    wins = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if wins[tuple(w[i:i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_rules_against_plain_python(docs, prose):
    texts = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x " * 30, prose(9, 1), prose(300, 2), prose(300, 3, vocab=6),
             "one line\none line\n\none line\r\n" + prose(20, 4), "# * $ % & | < >" * 4, "日本語 " * 12, "a\x0bb\x0cc\x1cd", prose(2000, 5, vocab=40)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in quality_rules.judge(quality_rules.ledger(docs(rows))).collect()}
    for i, t in rows:
        r, want = got[i], plain_rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (i, r, want)
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_rules_policies_and_ablation(docs, prose):
    led = quality_rules.ledger(docs([(1, prose(50, 1)), (2, "one two"), (2, "one two"), (None, "HE SAID NO AND THEN HE SAID IT TWICE MORE FOR US"),
                                     (4, " ".join(f"w{i}$$$" for i in range(50)))]))
    kept = {v: {r["doc_id"] for r in quality_rules.judge(led, v).collect() if r["kept"]} for v in quality_rules.POLICIES}
    assert kept == {1: {1, None, 4}, 2: {1, None}, 3: {1}}
    got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality_rules.ablation(led).collect()}
    assert got["symbols"] == (1, 1) and got["no_lower_case"] == (1, 1) and got["too_short"] == (2, 2)


def test_rules_empty_and_native(docs):
    led = quality_rules.ledger(docs([]))
    assert led.collect() == []
    assert "Python" not in led._jdf.queryExecution().executedPlan().toString()


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out = 1.5 * sum(sizes.values()), {}
    free = dict(weight)
    while free:
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            del free[s]
    return out


def test_mixing(spark, docs, prose):
    rows = [(i, prose(3 + i % 40, i), "en", f"s{(i * i) % 7}" if i % 11 else None) for i in range(400)]
    rows += [(900, None, "en", "s1"), (901, "", "en", "zz"), (None, prose(5, 1), "en", "s2"), (17, prose(20, 17), "en", "s3")]
    d = docs(rows)
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), Counter(), {}
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    for i, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    for i, t, _, s in rows:
        r = next(x for x in by_id[i] if x["source_size"] == sizes[s] and x["size"] == len(WORD.findall(t or "")))
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 45
    # the rows that the mix returns are those it counts
    rows_taken = Counter()
    for r in mixing.mixed(d).collect():
        rows_taken[r["source"]] += len(WORD.findall(r["text"]))
    assert rows_taken == +taken
    assert mixing.mixed(d).columns == d.columns


def test_mixing_of_nothing(docs):
    assert mixing.mix(docs([])).collect() == []
    got = mixing.mix(docs([(1, None), (2, "")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


@pytest.fixture()
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, digest string, keeper string").repartition(3)
    return make


def test_archive(pages):
    rows = [(i, f"http://www.h{i % 5}.example.com/p?q={i % 3}", f"<p>é{i % 17}</p>" * (i % 9)) for i in range(120)]
    rows += [(500, None, None), (501, "", ""), (502, "http://[bad", "x\r\n\r\ny"), (None, "http://a.b", "<p>é1</p>"), (503, "http://ü.de/a b", "same"),
             (503, "http://ü.de/a b", "same")]
    got = warc.archive(pages(rows)).collect()
    assert len(got) == len(rows)
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    left = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    for i, _, h in rows:
        raw = (h or "").encode()
        first = i == best[h or ""]
        want = (i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else best[h or ""])
        assert left[want] > 0, want
        left[want] -= 1


def test_history_is_in_global_order(pages, spark):
    from versewise.llm.common import pick, scratch
    rows = [(i, "http://hot.example.com/" if i % 3 else f"http://x{i % 13}.example.org/{i % 7}", str(i % 19)) for i in range(300)]
    p = pick(pages(rows), page_id="page_id", url="url", html="html", timestamp="page_id")
    index = warc.merge_runs(warc.write_archives(p, scratch(spark, "warc")), per_range=40)
    got = [(r["url_key"], r["timestamp"], r["page_id"]) for r in sorted(index.collect(), key=lambda r: (r["range"], r["position"]))]
    assert got == sorted((warc.url_key(u), i, i) for i, u, _ in rows)
    assert index.select("range").distinct().count() > 3


def test_very_long_rows(docs, pages, prose):
    long = prose(150_000, 1)
    got = warc.archive(pages([(1, "u", long), (2, "v", "x"), (3, "w", long)])).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"]) for r in got) == [(1, len(long), "revisit"), (2, 1, "response"), (3, len(long), "response")]
    r = quality_rules.judge(quality_rules.ledger(docs([(1, long)]))).first()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_rules(long)
    sizes = {x["doc_id"]: (x["size"], x["taken"]) for x in mixing.mix(docs([(1, long, "en", "a"), (2, "few words", "en", "b")])).collect()}
    assert sizes[1][0] == 150_000 and sizes[2][0] == 2


def test_min_bytes_and_nothing(pages):
    got = warc.archive(pages([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), min_bytes=3).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in got) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]
    assert warc.archive(pages([])).collect() == []


def test_loser_tree():
    runs = [[1, 4, 9], [], [2, 4], [0], [3, 3, 3, 10], [5]]
    assert list(warc.loser_tree_merge(runs, lambda x: x)) == sorted(sum(runs, []))
    assert list(warc.loser_tree_merge([], lambda x: x)) == []
    assert list(warc.loser_tree_merge([[1, 2]], lambda x: x)) == [1, 2]


@pytest.mark.parametrize("name", ["op5_quality_rules", "quality_ablation", "op8_mixing", "op10_warc"])
def test_sql(spark, name):
    from versewise.llm import queries
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    f, sql = queries.QUERIES[name]
    df = f(spark, sf)
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
