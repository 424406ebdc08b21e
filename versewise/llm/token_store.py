"""Token-ID output (2): ids packed in the fewest bits of the vocabulary, with
block offsets for vectorised unpacking and random access.

A shard file, little-endian:

    magic "VWIDS001", bits u32, block u32
    payload: blocks of ``block`` ids, each id in ``bits`` bits, lowest bit
             first; a block ends on a whole byte
    footer: u64 byte offset of each block and of the end,
            i64 doc ids, u8 null marks, u64 first id of each document and the end
    trailer: footer position u64, n_blocks u64, n_docs u64, n_ids u64

Shards follow the order of doc_id, so that the number of ids before a shard is
the sum of those before it in the manifest.

Nulls, empty texts, repeats: a null or empty text is a document of the end id
alone; null ids come first; rows that share an id are all kept, in the order of
their texts' hashes. Very long texts are stored whole; extra columns, whatever
their names, are not read. An empty table gives an empty store. The running sum
of ids is over the manifest, a row for some 16 million ids: at 10^14 ids 6
million narrow rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versewise.llm.common import filesystem, pick, scratch, stage, write_once
from versewise.llm.encode import encoder

MAGIC = b"VWIDS001"
BLOCK = 4096
#: Blocks that are collected before they are packed.
LOT = 16
MANIFEST = "path string, first_id long, first_hash long, n_docs long, n_ids long"
ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                  ("ids_crc32", pa.int64())])


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Each id in ``bits`` bits, lowest first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32).astype("<u4")


class ShardWriter:
    """Collects documents of one shard and renders its file."""

    def __init__(self, bits: int, block: int):
        self.bits, self.block = bits, block
        self.docs, self.starts, self.held, self.n_held = [], [0], [], 0
        self.chunks, self.offsets, self.at = [MAGIC + np.array([bits, block], "<u4").tobytes()], [], 16

    def _put(self, ids: np.ndarray) -> None:
        raw = pack_bits(ids, self.bits)
        self.offsets.append(self.at)
        self.chunks.append(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= LOT * self.block:
            self._put_held(self.n_held - self.n_held % self.block)

    def _put_held(self, upto: int) -> None:
        """Pack the first ``upto`` of the ids held, and keep the rest."""
        todo = np.concatenate(self.held)
        for i in range(0, upto, self.block):
            self._put(todo[i:min(i + self.block, upto)])
        self.held, self.n_held = [todo[upto:]], len(todo) - upto

    def render(self) -> list[bytes]:
        if self.n_held:
            self._put_held(self.n_held)
        footer = [np.array([*self.offsets, self.at], "<u8"), np.array([d or 0 for d in self.docs], "<i8"),
                  np.array([d is None for d in self.docs], np.uint8), np.array(self.starts, "<u8")]
        trailer = np.array([self.at, len(self.offsets), len(self.docs), self.starts[-1]], "<u8")
        return [*self.chunks, *[a.tobytes() for a in footer], trailer.tobytes()]


class Shard:
    """Reads a shard file; ``ids(a, b)`` touches only the blocks it needs."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        at, blocks, docs, self.n_ids = map(int, np.frombuffer(self._read(size - 32, 32), "<u8"))
        head = self._read(0, 16)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.bits, self.block = map(int, np.frombuffer(head[8:], "<u4"))
        raw = self._read(at, size - 32 - at)
        cut = np.cumsum([8 * (blocks + 1), 8 * docs, docs])
        self.offsets = np.frombuffer(raw[:cut[0]], "<u8").astype(np.int64)
        marks = np.frombuffer(raw[cut[1]:cut[2]], np.uint8)
        self.docs = [None if m else int(d) for d, m in zip(np.frombuffer(raw[cut[0]:cut[1]], "<i8"), marks)]
        self.starts = np.frombuffer(raw[cut[2]:], "<u8").astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (exclusive) of the shard."""
        if b <= a:
            return np.zeros(0, "<u4")
        x, y = a // self.block, (b - 1) // self.block
        raw = self._read(int(self.offsets[x]), int(self.offsets[y + 1] - self.offsets[x]))
        size = (self.block * self.bits + 7) // 8
        full = [unpack_bits(raw[i * size:(i + 1) * size], self.bits,
                            min(self.block, self.n_ids - (x + i) * self.block)) for i in range(y - x + 1)]
        return np.concatenate(full)[a - x * self.block:b - x * self.block]

    def documents(self, lot: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, first id in the shard, ids) of each document, read in lots of ids."""
        k, n = 0, len(self.docs)
        while k < n:
            end = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + lot, "right")) - 1)
            end = min(end, n)
            base = int(self.starts[k])
            part = self.ids(base, int(self.starts[end]))
            for i in range(k, end):
                yield self.docs[i], int(self.starts[i]), part[self.starts[i] - base:self.starts[i + 1] - base]
            k = end


def write_ids(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id",
              text_col: str = "text", block: int = BLOCK, shard_ids: int = 1 << 24) -> DataFrame:
    """Encode every whole text, append ``end_id``, write shards under the
    folder ``out``; the manifest, a row a shard (staged, so that the files are
    written once whatever reads it).

    Texts are dealt by ranges of the id before they are encoded, so that ids
    are made once, in their final order. A hot id's rows are split by the
    hash of the text."""
    rows = (pick(docs, id=id_col, text=text_col).withColumn("h", F.xxhash64("text"))
            .repartitionByRange("id", "h").sortWithinPartitions("id", "h"))

    def write(batches):
        enc, shard, first = encoder(tokenizer), None, None
        bits = bits_for(max(enc.vocab_size, end_id + 1))
        end = np.array([end_id], "<u4").tobytes()

        def close():
            name = f"{'null' if first[0] is None else first[0]}-{first[1] & (2**64 - 1):016x}.ids"
            path = write_once(out, name, shard.render())
            return pa.RecordBatch.from_pylist([{"path": path, "first_id": first[0], "first_hash": first[1],
                                                "n_docs": len(shard.docs), "n_ids": shard.starts[-1]}],
                                              pa.schema([("path", pa.string()), ("first_id", pa.int64()),
                                                         ("first_hash", pa.int64()), ("n_docs", pa.int64()),
                                                         ("n_ids", pa.int64())]))
        for b in batches:
            ids, hashes, texts = b["id"].to_pylist(), b["h"].to_pylist(), b["text"]
            for at in range(0, len(ids), 256):
                got = enc.encode_all(texts.slice(at, 256).to_pylist())
                for i, raw in enumerate(got, at):
                    if shard is None:
                        shard, first = ShardWriter(bits, block), (ids[i], hashes[i])
                    shard.add(ids[i], np.frombuffer(raw + end, "<u4"))
                    if shard.starts[-1] >= shard_ids:
                        yield close()
                        shard = None
        if shard is not None:
            yield close()

    return stage(rows.mapInArrow(write, MANIFEST), "ids-manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Per document, read back from the shards: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32."""
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_hash")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches):
        for b in batches:
            for path, base in zip(b["path"].to_pylist(), b["base"].to_pylist()):
                lot = []
                for doc_id, start, ids in Shard(path).documents():
                    lot.append((doc_id, base + start, len(ids), zlib.crc32(ids.tobytes())))
                    if len(lot) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*lot)], schema=ROWS)
                        lot = []
                if lot:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*lot)], schema=ROWS)

    # about a shard a task: by a number, as the manifest's few bytes say nothing of the work
    return shards.repartition(max(1, manifest.count()), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the store to the shared folder and read it back."""
    return read_ids(write_ids(docs, scratch(docs.sparkSession, "ids"), tokenizer, end_id))
