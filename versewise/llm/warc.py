"""WARC archives (10) with an external index merge.

Pages are written as WARC 1.1 records, a gzip member each, one archive a task.
A task sorts its captures by URL key and timestamp: a run. Ranges of the key
space gather the stretches of all runs, and a loser tree merges them, so the
ranges in order are the globally ordered capture history. Records are read
back through that index by archive and offset.

Of records with equal payloads of at least ``min_bytes`` the one with the
largest page id is a response and the others are revisits of it.

Nulls, empty texts, ties, repeats: a null html is an empty payload; captures of
one key, time and page are in the order of their runs; very long pages are
written and read whole; extra columns are not read; a null url has
the empty key; a null page id is smaller than any other; rows that repeat a
page id and payload are each written, and are responses if that id is the
largest; an empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import os
import zlib
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versewise.llm.common import filesystem, let, pick, scratch, stage

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CAPTURE = pa.schema([("run", pa.string()), ("seq", pa.int64()), ("url_key", pa.string()),
                     ("timestamp", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()),
                     ("payload_digest", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
CAPTURE_SQL = ("run string, seq long, url_key string, timestamp long, page_id long, record_type string, "
               "payload_digest string, path string, offset long, length long")


def base32(hex40):
    """Upper-case base32 of a SHA-1 in hex: five hex digits are four letters."""
    def four(k: int):
        v = F.conv(F.substring(hex40, 5 * k + 1, 5), 16, 10).cast("int")
        return let(v, lambda x: F.concat(*[F.substr(F.lit(ALPHABET), F.shiftright(x, s).bitwiseAND(F.lit(31)) + 1, F.lit(1))
                                           for s in (15, 10, 5, 0)]))
    return F.concat(*map(four, range(8)))


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query, lower case."""
    try:
        u = urlsplit(url or "")
        host = (u.hostname or "").lower()
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    labels = host.split(".")
    if labels[0] == "www":
        labels = labels[1:]
    return ",".join(reversed(labels)) + ")" + (u.path or "/").lower() + ("?" + u.query.lower() if u.query else "")


def stamp(seconds: int) -> str:
    return str(np.datetime64(seconds, "s")) + "Z"


def render(page_id: int | None, url: str | None, payload: bytes, seconds: int, digest: str, refers_to: int | None,
           revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            f"WARC-Date: {stamp(seconds)}", f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    return gzip.compress(raw, 1, mtime=0)


def parse(member: bytes) -> dict:
    """Headers of a record and, of a response, its payload; the payload must
    have the digest that the header states."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    body = rest[:int(fields["Content-Length"])]
    fields["payload"] = None
    if fields["WARC-Type"] == "response":
        fields["payload"] = payload = body.partition(b"\r\n\r\n")[2]
        if "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() != fields["WARC-Payload-Digest"]:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return fields


def page_of(urn: str | None) -> int | None:
    number = (urn or "None").strip("<>").rpartition(":")[2]
    return None if number == "None" else int(number)


def loser_tree_merge(runs: list[list], key):
    """Items of sorted runs in order of ``key``: each inner node keeps the loser
    of its match, so that an item costs one path of log2(runs) comparisons."""
    k = len(runs)
    at = [0] * k
    top = lambda r: (0, key(runs[r][at[r]]), r) if at[r] < len(runs[r]) else (1, None, r)
    beats = lambda a, b: a[0] < b[0] or a[0] == b[0] == 0 and a[1:] < b[1:]
    if not k:
        return
    losers: list = [None] * k
    winners: list = [None] * k + [top(r) for r in range(k)]
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else winners[k]
    while best[0] == 0:
        r = best[2]
        yield runs[r][at[r]]
        at[r] += 1
        best, node = top(r), (r + k) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def order(row) -> tuple:
    """URL key, timestamp, page id (null first)."""
    return row[0], row[1], row[2] is not None, row[2] or 0


def decisions(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """payload, its digest and ``keeper``, the page that is the response of all
    records with this payload. The largest id of each digest is summed on the
    map side and written, so that the join back has one row a digest and two plain
    shuffles, and the adaptive skew join can split a hot digest's pages."""
    p = pages.withColumn("html", F.coalesce("html", F.lit("")).cast("binary")).withColumn("sha1", F.sha1("html"))
    best = stage(p.groupBy("sha1").agg(F.max("page_id").alias("keeper")), "warc-keepers")
    small = F.octet_length("html") < min_bytes
    return (p.join(best, "sha1").withColumn("revisit", ~small & ~F.col("page_id").eqNullSafe(F.col("keeper")))
            .withColumn("digest", base32(F.col("sha1"))).drop("sha1"))


def write_archives(pages: DataFrame, out: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html, timestamp in seconds) as archives
    under the folder ``out``; the captures of the sorted runs (staged)."""
    def write(batches):
        fs, base = filesystem(out)
        fs.create_dir(base, recursive=True)
        run, found, at, part = None, [], 0, None
        for b in batches:
            for r in b.to_pylist():
                if run is None:
                    run = os.urandom(8).hex()  # a repeated attempt writes its own archive; only one's captures are kept
                    part = fs.open_output_stream(f"{base}/{run}.warc.gz", compression=None)
                raw = render(r["page_id"], r["url"], r["html"], r["timestamp"], r["digest"], r["keeper"], r["revisit"])
                part.write(raw)
                found.append((url_key(r["url"]), r["timestamp"], r["page_id"], "revisit" if r["revisit"] else "response",
                              r["digest"], f"{out}/{run}.warc.gz", at, len(raw)))
                at += len(raw)
        if run is None:
            return
        part.close()
        found.sort(key=order)
        yield pa.RecordBatch.from_arrays(
            [pa.array([run] * len(found)), pa.array(range(len(found)), pa.int64()),
             *[pa.array(x, f.type) for x, f in zip(zip(*found), list(CAPTURE)[2:])]], schema=CAPTURE)

    rows = decisions(pages, min_bytes).select("page_id", "url", "html", "timestamp", "digest", "keeper", "revisit")
    return stage(rows.mapInArrow(write, CAPTURE_SQL), "warc-runs")


def merge_runs(captures: DataFrame, per_range: int = 100_000) -> DataFrame:
    """Captures with ``range`` and ``position``, their place in it; the two
    order the whole history. Spark deals the captures to ranges of (URL key,
    timestamp, page id), as many as there are lots of ``per_range`` captures,
    by edges that it samples from all partitions; so a range holds about as many,
    whatever the number of runs, of captures or of those of one URL."""
    def merge(batches):
        rows = [r for b in batches for r in zip(*[b[c].to_pylist() for c in CAPTURE.names])]
        if not rows:
            return
        # sorted by run and place in it
        cut = [0, *(k for k in range(1, len(rows)) if rows[k][0] != rows[k - 1][0]), len(rows)]
        merged = loser_tree_merge([rows[a:z] for a, z in zip(cut, cut[1:])], lambda r: (*order(r[2:5]), r[0], r[1]))
        part = TaskContext.get().partitionId()
        for k, lot in enumerate(iter(lambda: list(itertools.islice(merged, 10_000)), [])):
            cols = [*zip(*lot), [part] * len(lot), range(10_000 * k, 10_000 * k + len(lot))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    out = pa.schema([*CAPTURE, ("range", pa.int64()), ("position", pa.int64())])
    ranges = max(1, -(-captures.count() // per_range))
    dealt = captures.repartitionByRange(ranges, "url_key", "timestamp", "page_id").sortWithinPartitions("run", "seq")
    return dealt.mapInArrow(merge, CAPTURE_SQL + ", range long, position long")


def read_records(index: DataFrame) -> DataFrame:
    """The records that an index names, read at their offsets: page_id,
    record_type, payload_digest, refers_to, payload (null for revisits) and
    the index's range and position."""
    schema = pa.schema([("range", pa.int64()), ("position", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()),
                        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches):
        name, file = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["path"] != name:
                    fs, path = filesystem(r["path"])
                    name, file = r["path"], fs.open_input_file(path)
                file.seek(r["offset"])
                f = parse(file.read(r["length"]))
                refers = page_of(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None
                out.append((r["range"], r["position"], page_of(f["WARC-Record-ID"]), f["WARC-Type"],
                            f["WARC-Payload-Digest"].removeprefix("sha1:"), refers, f["payload"]))
                if len(out) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(x, c.type) for x, c in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, c.type) for x, c in zip(zip(*out), schema)], schema=schema)

    # by a number of tasks, as an index row's few bytes say nothing of its record's
    lot = 8 << 20
    tasks = 1 + (index.agg(F.sum("length").alias("n")).first()["n"] or 0) // lot
    by_place = index.repartition(tasks, "path", F.floor(F.col("offset") / lot)).sortWithinPartitions("path", "offset")
    return by_place.mapInArrow(read, "range long, position long, page_id long, record_type string, "
                                     "payload_digest string, refers_to long, payload binary")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            time_col: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write, merge the index, read back through it. Per page: page_id,
    payload_bytes (a revisit's from its response), payload_digest, record_type,
    refers_to, range, position. Without a time the id counts seconds."""
    p = pick(pages, page_id=id_col, url=url_col, html=html_col, timestamp=time_col or id_col)
    p = p.withColumn("timestamp", F.coalesce(F.col("timestamp").cast("long"), F.lit(0)))
    index = stage(merge_runs(write_archives(p, scratch(p.sparkSession, "warc"), min_bytes)), "warc-index")
    back = stage(read_records(index).withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload"), "warc-read")
    # revisits take their size from the response of their digest; sizes are equal within a digest
    sizes = (back.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("stored")))
    return (back.join(sizes, "payload_digest")
            .select("page_id", F.coalesce("payload_bytes", "stored").alias("payload_bytes"), "payload_digest", "record_type",
                    "refers_to", "range", "position"))


def _base32_sql(h: str) -> str:
    letters = " || ".join(f"substr('{ALPHABET}', ((('0x' || substr({h}, {5 * g + 1}, 5))::INT >> {s}) & 31) + 1, 1)"
                          for g in range(8) for s in (15, 10, 5, 0))
    return f"({letters})"


ARCHIVE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_base32_sql('h')} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN NULL ELSE keeper END AS refers_to FROM k
"""
