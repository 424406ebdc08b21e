"""MinHash near-dedup (3) by order MinHash, with banded alignment.

Texts are sequences of lower-case words; equal sequences are one node. A node's
shingles are labelled by their occurrence; each of ``SKETCHES`` hash functions
picks the ``PICKS`` smallest and keeps them in text order (Marcais et al. 2019),
so that a sketch agrees only if shingles and their order do. Nodes that share a
sketch are candidates; two are linked if a banded alignment of their words
leaves at least 0.8 of the longer one unedited. Classes are the connected
components of the links.

Shingles are short enough that a fifth of the words edited, wherever, leaves
some: 3 words, 2 in texts of under ``SHORT``; texts that can be linked to one on
the other side of it have both kinds. The search is still a sample: a link
whose nodes share a part J of their shingles is missed with a chance of about
(1 - J^2)^64, under 0.1 % with random edits of a fifth (J about 0.34), about
2 % if they are evenly spread over a long text (J = 0.25), the worst case, and
some 5 % at the shortest texts that can be linked, of 5 words.

A bucket of nodes with one sketch isn't expanded into pairs: first all are
compared with its smallest node; a bucket whose nodes are then in one class is
done, as the copies of one text are. In the others all pairs of different
classes are compared in one group, from which only links leave; most, that share
a passage and little else, are told apart by their word counts. A bucket
that is too large for a group, as of a passage that stands in very many texts, is
dealt anew: what its smallest node has (its word pairs) is taken out of all
nodes, and those whose remains share one of ``AGAIN`` sketches of a single word
pair are candidates still. Texts that are linked though they share such a passage
are alike beside it: if it makes up a part p of them, 1 - 0.2 / (1 - p) of the
rest is unedited. Each node makes ``AGAIN`` rows, whatever the size of its
bucket, and each round takes out what was common, for ``ROUNDS`` of them. That
is a sample that joins most classes at little cost. What large buckets then hold
of several classes is compared by an exact filter (prefix filtering, Chaudhuri et
al. 2006): linked texts of n words or more have all but n / 5 of them in common,
so in any one order of the words they share one of the first n / 5 + 1 of each;
words that few of the texts have come first. No pair of a large bucket is left out.

Nulls, empty texts, repeats: a text without words is a class of its own; a
document with a null id has a null class and isn't compared; rows that share an
id are one document, linked by any of its texts, and a row each is returned;
very long texts are compared whole; of equally small shingles any set of the
smallest is the same set; extra columns, whatever their names, are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versewise.llm.common import join_counted, pick, stage
from versewise.llm.vectors import BASE, mixed, windows, words_of

SKETCHES, PICKS, SIMILAR = 64, 2, 0.8
#: Words of a shingle, in texts of under SHORT words and in others.
SHINGLES, SHORT = (2, 3), 32
#: Nodes and words of a block, numbers into which words are hashed to bound what two texts share.
BLOCK, BLOCK_WORDS, COUNTS = 2048, 1 << 22, 1024
#: Sketches of what is left of a node of a large bucket, and how often such buckets are dealt anew.
AGAIN, ROUNDS = 32, 6
#: Words known as frequent when those of a text are put in order: of a task, of all tasks. They tell
#: how many nodes share a word of a prefix, never which pairs are found.
FREQUENT, KNOWN = 4096, 1 << 15
FAR = np.int32(1 << 29)
LAST = np.uint64((1 << 64) - 1)
_RANDOM = np.random.default_rng(3)
_SALT = _RANDOM.integers(0, 1 << 63, SKETCHES, np.uint64)
_ODD = _RANDOM.integers(0, 1 << 63, SKETCHES, np.uint64) * np.uint64(2) + np.uint64(1)


def occurrences(h: np.ndarray) -> np.ndarray:
    """Which occurrence of its value each element is, from 0."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    at = np.arange(len(h))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]]), at, 0))
    out = np.empty(len(h), np.uint64)
    out[order] = (at - first).astype(np.uint64)
    return out


def labelled(words: np.ndarray, shingle: int) -> np.ndarray:
    """The shingles, each told apart from its equals by its occurrence."""
    kmers = windows(words, shingle)
    return mixed(kmers + mixed(occurrences(kmers) + np.uint64(1)))


def sketches(words: np.ndarray) -> np.ndarray:
    """``SKETCHES`` 64-bit numbers for each length of shingles that the text has:
    each of the picked shingles in text order."""
    # a text of under SHORT words can be linked to one of under SHORT / SIMILAR
    kinds = [SHINGLES[0]] * (SIMILAR * len(words) < SHORT) + [SHINGLES[1]] * (len(words) >= SHORT)
    return np.concatenate([sketches_of(words, k) for k in kinds])


def sketches_of(words: np.ndarray, shingle: int) -> np.ndarray:
    label = labelled(words, shingle)
    picks, n = min(PICKS, len(label)), len(label)
    chosen = np.empty((SKETCHES, picks), np.int64)
    step = max(1, (1 << 21) // n)  # bounds the block of a very long text
    for m in range(0, SKETCHES, step):
        rank = (label[None] ^ _SALT[m:m + step, None]) * _ODD[m:m + step, None]  # all different, as the labels are
        at = np.arange(len(rank))
        for j in range(picks):
            chosen[m:m + step, j] = rank.argmin(axis=1)
            rank[at, chosen[m:m + step, j]] = LAST
    chosen.sort(axis=1)
    out = np.arange(1, SKETCHES + 1, dtype=np.uint64) + np.uint64(shingle << 32)
    for j in range(picks):
        out = out * BASE + label[chosen[:, j]]
    return mixed(out)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (16 bytes of the word sequence; null without words), words
    (32-bit hashes as binary), n and the sketches."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("words", pa.binary()), ("n", pa.int64()),
                        ("sketches", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            ids, texts = b["doc_id"].to_pylist(), b["text"]
            for at in range(0, len(ids), 512):
                out = []
                for i, t in zip(ids[at:at + 512], texts.slice(at, 512).to_pylist()):
                    w = words_of(t)
                    if not len(w):
                        out.append((i, None, None, 0, None))
                        continue
                    out.append((i, hashlib.blake2b(w.tobytes(), digest_size=16).digest(), w.astype("<u4").tobytes(), len(w),
                                sketches(w).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, key binary, words binary, n long, sketches array<long>")


def banded(a: list[np.ndarray], b: list[np.ndarray], band: int) -> np.ndarray:
    """Edit distances of the pairs over alignments that stay within ``band`` of
    the diagonal: upper bounds, exact up to ``band``. Rows of all pairs are
    filled at once; a pair too far apart in length gets FAR."""
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    top, width = int(n.max(initial=0)), 2 * band + 1
    left = np.zeros((len(a), top), np.int64)
    right = np.full((len(a), top + width), -2, np.int64)
    for p, (x, y) in enumerate(zip(a, b)):
        left[p, :len(x)] = x
        y = y[:top + width - band]
        right[p, band:band + len(y)] = y
    ramp = np.arange(width, dtype=np.int32)
    row = np.broadcast_to(np.where(ramp >= band, ramp - band, FAR).astype(np.int32), (len(a), width)).copy()
    out = np.full(len(a), FAR, np.int32)

    def note(i):
        for p in np.nonzero((n == i) & (np.abs(m - n) <= band))[0]:
            out[p] = row[p, m[p] - n[p] + band]
    note(0)
    ends = set(n.tolist())
    for i in range(top):
        new = row + (right[:, i:i + width] != left[:, i:i + 1])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        if i + 1 in ends:
            note(i + 1)
    return out


def linked(pairs: list[tuple[np.ndarray, np.ndarray]], similar: float = SIMILAR) -> np.ndarray:
    """Whether the edit distance leaves ``similar`` of the longer sequence."""
    out, todo = np.zeros(len(pairs), bool), []
    for k, (x, y) in enumerate(pairs):
        longer = max(len(x), len(y))
        most = int(longer * (1 - similar) + 1e-9)
        if abs(len(x) - len(y)) > most:
            continue
        short = min(len(x), len(y))
        diff = np.nonzero(x[:short] != y[:short])[0]
        if not len(diff):
            out[k] = longer - short <= most
            continue
        x, y = x[diff[0]:], y[diff[0]:]
        short = min(len(x), len(y))
        diff = np.nonzero(x[::-1][:short] != y[::-1][:short])[0]
        cut = int(diff[0]) if len(diff) else short
        x, y = x[:len(x) - cut], y[:len(y) - cut]
        if not len(x) or not len(y):
            out[k] = max(len(x), len(y)) <= most
            continue
        ux, cx = np.unique(x, return_counts=True)
        uy, cy = np.unique(y, return_counts=True)
        _, i, j = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
        if max(len(x), len(y)) - np.minimum(cx[i], cy[j]).sum() <= most:  # words in common bound the distance from below
            todo.append((k, x, y, most))
    band = 16
    while todo:
        todo.sort(key=lambda t: len(t[1]))
        later, at = [], 0
        while at < len(todo):
            # a lot of pairs of like length, bounded in cells
            size = len(todo[at][1])
            end = at + 1
            while end < len(todo) and len(todo[end][1]) <= 1.3 * size + 16 and (end - at) * (2 * band + 1) < 60_000 \
                    and (end - at) * (len(todo[end][1]) + 2 * band) < 4_000_000:
                end += 1
            lot = todo[at:end]
            got = banded([t[1] for t in lot], [t[2] for t in lot], band)
            for t, d in zip(lot, got.tolist()):
                if d <= t[3]:
                    out[t[0]] = True
                elif band < t[3]:
                    later.append(t)
            at = end
        todo, band = later, band * 4
    return out


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes those that are linked. ``texts``: node, words."""
    x = texts.select(F.col("node").alias("a"), F.col("words").alias("wa"), F.col("n").alias("na"))
    y = texts.select(F.col("node").alias("b"), F.col("words").alias("wb"), F.col("n").alias("nb"))
    near = F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb") - 1e-9

    def run(batches):
        for lot in batches:
            for at in range(0, lot.num_rows, 1024):
                part = lot.slice(at, 1024)
                yes = linked([(np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4"))
                              for p, q in zip(part["wa"].to_pylist(), part["wb"].to_pylist())])
                yield pa.RecordBatch.from_arrays([part["a"].filter(pa.array(yes)), part["b"].filter(pa.array(yes))], names=["a", "b"])

    rows = pairs.join(x, "a").join(y, "b").where(near).select("a", "b", "wa", "wb")
    return rows.mapInArrow(run, "a long, b long")


def block_links(node: list[int], label: list[int], side: list[int], words: list[bytes], buckets: list[list[int]], here: int,
                similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Links between nodes of different labels in a group of the bucket
    ``here``: of two blocks (sides) across them, of one within it. A pair that
    shares several buckets belongs to the smallest number of them. A node may
    have several texts, a row each: all of them are compared."""
    rows = list({(x, w): k for k, (x, w) in enumerate(zip(node, words))}.values())
    node, label, buckets = [node[k] for k in rows], [label[k] for k in rows], [set(buckets[k]) for k in rows]
    if len(set(label)) == 1:
        return []
    side = np.array([side[k] for k in rows])
    words = [np.frombuffer(words[k], "<u4") for k in rows]
    n = np.array([len(w) for w in words])
    root = {x: x for x in label}
    # no count is cut off: they are bounds from above
    count = np.zeros((len(words), COUNTS), np.uint32 if n.max() > 65535 else np.uint16)
    for i, w in enumerate(words):
        count[i] = np.bincount(w % COUNTS, minlength=COUNTS)
    two = len(set(side.tolist())) > 1
    rough = count.reshape(len(words), COUNTS // 8, 8).sum(2, dtype=np.uint32) if len(words) > 64 else count

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, todo = [], []

    def settle():
        lot = [(i, j) for i, j in todo if find(label[i]) != find(label[j])]
        todo.clear()
        for (i, j), yes in zip(lot, linked([(words[i], words[j]) for i, j in lot], similar)):
            if yes:
                out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
                root[find(label[i])] = find(label[j])

    for i in range(len(words)):
        rest = np.nonzero(side != side[i])[0] if two else np.arange(len(words))
        rest = rest[rest > i]
        longer = np.maximum(n[rest], n[i])
        rest = rest[np.minimum(n[rest], n[i]) >= similar * longer - 1e-9]
        # hashed counts bound the words in common from above, and so the distance from below
        for bound in (rough, count) if len(words) > 64 else (count,):
            shared = np.minimum(bound[rest], bound[i]).sum(1, dtype=np.int64)
            rest = rest[shared >= similar * np.maximum(n[rest], n[i]) - 1e-9]
        for j in rest.tolist():
            if label[i] != label[j] and here == min(buckets[i] & buckets[j]):
                todo.append((i, j))
        if len(todo) >= 2048:
            settle()
    settle()
    return out


def remains(kmers: np.ndarray, lead: np.ndarray) -> np.ndarray:
    return kmers[~np.isin(kmers, lead)]


def picks_of(kmers: np.ndarray) -> np.ndarray:
    """``AGAIN`` numbers: of each hash function the smallest of the word pairs.
    Nodes of which nothing is left have the same."""
    kmers = np.unique(kmers) if len(kmers) else np.zeros(1, np.uint64)
    out = np.empty(AGAIN, np.uint64)
    for m in range(AGAIN):
        rank = (kmers ^ _SALT[m]) * _ODD[m]
        out[m] = kmers[rank.argmin()]
    return mixed(out + np.arange(1, AGAIN + 1, dtype=np.uint64))


def dealt_anew(large: DataFrame, kmers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Large buckets (bucket, node, label) by the remains of their nodes
    (bucket, node, kmers): the buckets made of them, where nodes of different
    labels are still together, with the same columns, and the remains there."""
    lead = stage(large.groupBy("bucket").agg(F.min("node").alias("node"), F.count("*").alias("size")), "omh-heads")
    head = stage(lead.join(kmers, ["bucket", "node"]).select("bucket", "size", F.col("kmers").alias("head")), "omh-heads")
    # few buckets can hold much of the rows; of each the head's word pairs are sent
    both = join_counted(kmers, head, ["bucket"], "size", kmers.count())
    schema = pa.schema([("bucket", pa.int64()), ("node", pa.int64()), ("kmers", pa.binary()), ("picks", pa.list_(pa.int64()))])

    def cut(batches):
        for b in batches:
            out = []
            for bucket, node, mine, head in zip(*[b[c].to_pylist() for c in ("bucket", "node", "kmers", "head")]):
                left = remains(np.frombuffer(mine, "<u8"), np.frombuffer(head, "<u8"))
                of = np.array([bucket], np.int64).view(np.uint64) * BASE
                out.append((bucket, node, left.tobytes(), (picks_of(left) + of).view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    rest = stage(both.select("bucket", "node", "kmers", "head").mapInArrow(cut, "bucket long, node long, kmers binary, picks array<long>"), "omh-remains")
    spread = rest.select(F.col("bucket").alias("of"), "node", F.explode("picks").alias("bucket")).join(
        large.select(F.col("bucket").alias("of"), "node", "label"), ["of", "node"])
    open_ = stage(spread.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"))
                  .where("lo != hi").select("bucket", "size"), "omh-open")
    new = stage(spread.join(open_, "bucket").select("bucket", "node", "label", "size", "of"), "omh-left")
    big = new.where(F.col("size") > BLOCK)
    rest = big.select("bucket", "node", "of").join(rest.select(F.col("bucket").alias("of"), "node", "kmers"), ["of", "node"]).drop("of")
    return new.drop("of"), rest


def word_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(bucket, node, kmers): the hashes of the word pairs of each node's texts."""
    def pairs(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["bucket"], b["node"], pa.array([windows(np.frombuffer(w, "<u4").astype(np.uint64), 2).tobytes()
                                                                                for w in b["words"].to_pylist()], pa.binary())],
                                             names=["bucket", "node", "kmers"])
    # of rows that share an id and a bucket any text stands for the document here
    one = texts.groupBy("node").agg(F.min("words").alias("words"))
    return nodes.select("bucket", "node").join(one, "node").select("bucket", "node", "words").mapInArrow(pairs, "bucket long, node long, kmers binary")


def prefix(words: np.ndarray, known: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Of the words, labelled by their occurrence, one more than a link may leave
    out: first those that aren't ``known`` (sorted), then those of the fewest ``times``."""
    own = labelled(words, 1)
    at = np.searchsorted(known, own)
    hit = np.append(known, LAST)[at] == own
    order = np.lexsort((own, np.where(hit, np.append(times, 0)[at], 0)))
    return own[order[:int(len(own) * (1 - SIMILAR) + 1e-9) + 1]]


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Labelled words, sorted, and in about how many texts they are: the most
    frequent of each task's, added up; at most ``KNOWN``."""
    def count(batches):
        words, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            own = [labelled(np.frombuffer(w, "<u4").astype(np.uint64), 1) for w in b["words"].to_pylist()]
            one, n = np.unique(np.concatenate(own), return_counts=True) if own else (words[:0], times[:0])
            words, at = np.unique(np.concatenate([words, one]), return_inverse=True)
            times = np.bincount(at, np.concatenate([times, n])).astype(np.int64)
            top = np.argsort(-times, kind="stable")[:1 << 20]
            words, times = words[top], times[top]
        top = np.argsort(-times, kind="stable")[:FREQUENT]
        top = top[times[top] > 1]
        yield pa.RecordBatch.from_arrays([pa.array(words[top].view(np.int64)), pa.array(times[top])], names=["word", "n"])

    rows = texts.select("words").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")) \
        .orderBy(F.col("n").desc(), "word").limit(KNOWN).collect()
    words, times = np.array([r["word"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(words)
    return words[order], times[order]


def prefix_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, label) of different labels: all that are
    linked and few others. With a word that is the first that two texts share, at
    most what stands after it is in common beside it."""
    mine = stage(texts.join(nodes, "node").select("node", "label", "n", "words"), "omh-large")
    known, times = frequent(mine)
    schema = pa.schema([("node", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("picks", pa.list_(pa.int64()))])

    def cut(batches):
        for b in batches:
            picks = [prefix(np.frombuffer(w, "<u4").astype(np.uint64), known, times).view(np.int64) for w in b["words"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["node"], b["label"], b["n"], pa.array(picks, schema.field("picks").type)], schema=schema)

    rows = stage(mine.mapInArrow(cut, "node long, label long, n long, picks array<long>").select("node", "label", "n", F.posexplode("picks").alias("at", "word")),
                 "omh-prefixes")
    shared = rows.groupBy("word").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo != hi")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = stage(rows.join(shared.select("word", blocks.alias("blocks")), "word"), "omh-prefixes")
    # a word that very many nodes share is dealt into blocks, any two of which meet once
    block, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("word", "node", "label", "n", "at", block.alias("block"), other.alias("other"))
    x, y = rows.alias("x"), rows.alias("y")
    longer = F.greatest("x.n", "y.n")
    least = longer - F.floor(longer * (1 - SIMILAR) + 1e-9)  # words in common of linked texts
    near = F.least("x.n", "y.n") >= least
    after = 1 + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) - 1
    met = (F.col("x.word") == F.col("y.word")) & (F.col("x.block") == F.col("y.other")) & (F.col("x.other") == F.col("y.block"))
    return (x.join(y, met & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & near & (after >= least))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())


def several(left: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets whose nodes are in several classes, with their labels."""
    now = left.drop("label").join(labels, "node")
    still = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
    return now.join(still, "bucket")


def compare_open(left: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` after the links of ``left`` (bucket, node, size, label): those
    between nodes of different labels in a bucket."""
    found = compare_blocks(left.where(F.col("size") <= BLOCK), texts)
    large = left.where(F.col("size") > BLOCK)
    if large.isEmpty():
        return merged(labels, stage(found, "omh-links"), "omh")
    kmers = None
    for _ in range(ROUNDS):
        if large.isEmpty():
            break
        if kmers is None:
            # their smallest nodes have been compared with all others
            kmers = stage(word_pairs(large, texts), "omh-pairs")
        else:
            head = stage(large.groupBy("bucket").agg(F.min("node").alias("a")), "omh-heads")
            pairs = large.join(head, "bucket").where("node != a").select("a", F.col("node").alias("b")).distinct()
            labels = merged(labels, stage(verify(pairs, texts), "omh-links"), "omh")
            large = stage(several(large, labels), "omh-large")
        new, kmers = dealt_anew(large.select("bucket", "node", "label"), kmers)
        found = found.unionByName(compare_blocks(new.where(F.col("size") <= BLOCK), texts))
        large, kmers = new.where(F.col("size") > BLOCK), stage(kmers, "omh-remains")
    labels = merged(labels, stage(found, "omh-links"), "omh")
    # the rounds go by samples: what they left apart is compared by a filter that leaves out no link
    rest = stage(several(left.where(F.col("size") > BLOCK), labels).select("node", "label").distinct(), "omh-rest")
    return merged(labels, stage(verify(prefix_pairs(rest, texts), texts), "omh-links"), "omh")


def compare_blocks(left: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of ``left`` (bucket, node, size, label), all pairs of different
    labels in a bucket compared. A group holds two blocks at most, of about
    ``BLOCK`` nodes or ``BLOCK_WORDS`` words."""
    long = left.join(texts.groupBy("node").agg(F.sum("n").alias("n")), "node")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_WORDS)).cast("int")
    left = left.join(long.groupBy("bucket").agg(blocks.alias("blocks")), "bucket")
    mine = F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int")
    rows = left.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "label", F.col("mine").alias("side"))
    within = left.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))  # at most one a sketch
    rows = rows.join(texts.select("node", "words").join(within, "node"), "node")

    def run(batches):
        # most groups are small: they are told apart here, not given to Python one by one
        key, held = None, []

        def solve():
            links = block_links(*[list(c) for c in zip(*held)], key[0]) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            keys = zip(*[b[c].to_pylist() for c in ("bucket", "i", "j")])
            for k, row in zip(keys, zip(*[b[c].to_pylist() for c in ("node", "label", "side", "words", "buckets")])):
                if k != key:
                    if len(held) > 1:
                        yield solve()
                    key, held = k, []
                held.append(row)
        yield solve()

    # the work isn't in the bytes: the partitions stay as many as the session's
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def merged(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Labels (node, label) after the links (a, b) have joined classes: hook
    each class to the smallest neighbouring label, then jump to the label's
    label, until nothing changes."""
    pair = (links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
            .join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").where("x != y").select("x", "y").distinct())
    edges = stage(pair.union(pair.select("y", "x")).distinct(), name + "-edges")
    if edges.isEmpty():
        return labels
    # over the labels that links touch: label -> root
    roots = stage(edges.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("y")).select("v", F.least("v", "y").alias("root")), name + "-roots")
    while True:
        to = roots.select(F.col("v").alias("y"), F.col("root").alias("r"))
        seen = edges.join(to, "y").groupBy(F.col("x").alias("v")).agg(F.min("r").alias("low"))
        # a root takes the lowest root that any of its members sees
        low = (roots.join(seen, "v").select("root", F.least("root", "low").alias("low"))
               .groupBy("root").agg(F.min("low").alias("low")))
        hooked = roots.join(low, "root").select("v", F.col("low").alias("root"))
        jump = hooked.select(F.col("v").alias("root"), F.col("root").alias("next"))
        new = stage(hooked.join(jump, "root", "left").select("v", F.coalesce("next", "root").alias("root")), name + "-roots")
        same = new.alias("n").join(roots.alias("o"), (F.col("n.v") == F.col("o.v")) & (F.col("n.root") != F.col("o.root"))).isEmpty()
        roots = new
        if same:
            break
    return stage(labels.join(roots.select(F.col("v").alias("label"), "root"), "label", "left")
                 .select("node", F.coalesce("root", "label").alias("label")), name + "-labels")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id: the smallest id of the class (of itself if alone)."""
    sig = stage(signatures(docs, id_col, text_col), "omh")
    with_id = sig.where("doc_id IS NOT NULL")
    # equal word sequences: partial minima, so a text with a third of all rows is no hot group
    # (written, like other sums that are joined back on their key, so that the join reads two
    # plain shuffles and can split a hot key)
    reps = stage(with_id.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("node")), "omh-reps")
    owner = stage(with_id.select("doc_id", "key").join(reps, "key", "left").select("doc_id", F.coalesce("node", "doc_id").alias("node"))
                  .distinct(), "omh-owner")
    nodes = owner.select("node").distinct()
    sketch = with_id.where("key IS NOT NULL").select(F.col("doc_id").alias("node"), "sketches").join(nodes, "node", "left_semi")
    spread = sketch.select("node", F.explode("sketches").alias("bucket")).distinct()
    shared = stage(spread.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("size"))
                   .where("lead != last"), "omh-shared")
    members = stage(spread.join(shared.select("bucket", "lead", "size"), "bucket"), "omh-members")
    needed = members.select("node").distinct()
    texts = stage(with_id.where("key IS NOT NULL").select(F.col("doc_id").alias("node"), "words", "n").join(needed, "node", "left_semi"), "omh-texts")

    # rows that share an id are one document: its texts' nodes are one class
    several = owner.where("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    labels = owner.select("node").union(owner.select(F.col("doc_id").alias("node"))).distinct().withColumn("label", F.col("node"))
    pairs = members.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    links = stage(verify(pairs, texts), "omh-links")
    labels = merged(stage(labels, "omh-labels"), links.union(several), "omh")
    named = members.join(labels, "node")
    open_ = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
    left = stage(named.join(open_, "bucket").select("bucket", "node", "size", "label"), "omh-left")
    labels = compare_open(left, texts, labels)
    found = owner.join(labels, "node").groupBy("doc_id").agg(F.min("label").alias("class_id"))
    return sig.select("doc_id").join(found, "doc_id", "left")


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class: a row of its smallest id (of rows that share
    it the one of least text hash). Rows without an id all stay."""
    of = classes(docs, id_col, text_col).where("doc_id = class_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    key = F.col(f"`{id_col}`")
    one = Window.partitionBy(key).orderBy(F.xxhash64(f"`{text_col}`"))
    rows = (docs.where(key.isNotNull()).join(of, key == F.col("_kept_id"), "left_semi")
            .withColumn("_kept_row", F.row_number().over(one)).where("_kept_row = 1").drop("_kept_row"))
    return rows.unionByName(docs.where(key.isNull()))
