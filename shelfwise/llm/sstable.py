"""Token ids in sorted-string-table shards with binary-search lookup.

A shard holds the documents of one key range in ascending order::

    block*      zstd(entry*)          entries with prefix-compressed keys, about 256 KiB raw
    index       zstd(per block: first key 9 B, offset u64, size u32, documents u32, crc32 u32)
    bloom       bit array over the keys
    footer      fixed 72 bytes: places and sizes of index and bloom, counts, id width, magic

    entry       shared key bytes u8, own key bytes u8, those bytes, value size varint, value
    key         0x01 + the id as big-endian 64 bits with the sign flipped; 0x00 alone for null
    value       the ids as little-endian unsigned numbers of the footer's width (2 or 4 bytes)

Shards are written by Spark tasks into the shared folder under names that carry the attempt.
The manifest (a row per shard) comes from the tasks that succeeded, so files of lost or
repeated attempts are never read.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import shared_dir
from shelfwise.llm.encoder import WordEncoder

MAGIC = b"TOKSST02"
#: Characters of text for a shard, at most on average; a smaller corpus is dealt to as many shards as tasks run at once.
SHARD_CHARS, LEAST_CHARS = 1 << 28, 1 << 22
_FOOTER = struct.Struct("<QQQQQQQIIQ")
_INDEX = struct.Struct(">9s QIII")
_NULL = b"\x00"
MANIFEST = "path string, shard int, n_docs long, n_ids long, n_bytes long, first_key long, last_key long"


def key_bytes(key: int | None) -> bytes:
    """Bytes that sort as the ids do, null first."""
    return _NULL if key is None else b"\x01" + ((key + (1 << 63)) & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big")


def key_id(raw: bytes) -> int | None:
    return None if raw == _NULL else int.from_bytes(raw[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bloom_places(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    """Places of each key by double hashing: two 64-bit hashes of different seeds."""
    a = np.array([xxhash.xxh64_intdigest(k, 0) for k in keys], dtype=np.uint64)
    b = np.array([xxhash.xxh64_intdigest(k, 1) for k in keys], dtype=np.uint64) | np.uint64(1)
    return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


class ShardWriter:
    def __init__(self, out, width: int, block_bytes: int = 1 << 18, bits_per_key: int = 10) -> None:
        self.out, self.width, self.block_bytes, self.bits_per_key = out, width, block_bytes, bits_per_key
        self.zip = zstandard.ZstdCompressor(level=1)
        self.at = self.n_docs = self.n_ids = self.in_block = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.block, self.first, self.last = bytearray(), b"", b""

    def add(self, key: bytes, ids: bytes) -> None:
        """Keys must not descend; equal keys are kept side by side."""
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        same = 0
        if self.in_block:
            while same < min(len(key), len(self.last)) and key[same] == self.last[same]:
                same += 1
        else:
            self.first = key
        self.block += bytes((same, len(key) - same)) + key[same:] + _varint(len(ids)) + ids
        self.last, self.in_block = key, self.in_block + 1
        self.keys.append(key)
        self.n_docs += 1
        self.n_ids += len(ids) // self.width
        if len(self.block) >= self.block_bytes:
            self._close_block()

    def _close_block(self) -> None:
        if self.in_block:
            data = self.zip.compress(bytes(self.block))
            self.index.append(_INDEX.pack(self.first.ljust(9, b"\0"), self.at, len(data), self.in_block, zlib.crc32(data)))
            self.out.write(data)
            self.at += len(data)
            self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        self._close_block()
        bits = max(64, len(self.keys) * self.bits_per_key + 7 & ~7)
        hashes = max(1, round(self.bits_per_key * 0.69))
        bloom = np.zeros(bits // 8, dtype=np.uint8)
        for at in range(0, len(self.keys), 65536):
            places = _bloom_places(self.keys[at : at + 65536], bits, hashes).ravel()
            np.bitwise_or.at(bloom, places >> np.uint64(3), np.left_shift(np.uint8(1), (places & np.uint64(7)).astype(np.uint8)))
        index = self.zip.compress(b"".join(self.index))
        footer = _FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), bits, self.n_docs, self.n_ids, hashes, self.width, int.from_bytes(MAGIC, "little"))
        for part in (index, bloom.tobytes(), footer):
            self.out.write(part)
            self.at += len(part)


class ShardReader:
    """Reads a shard through a seekable file; blocks are read one at a time."""

    def __init__(self, file) -> None:
        self.file = file
        end = file.seek(0, 2)
        size = file.tell() if end is None else end
        at, n, bloom_at, bloom_n, self.bits, self.n_docs, self.n_ids, self.hashes, self.width, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != int.from_bytes(MAGIC, "little"):
            raise ValueError("not a token shard")
        self.kind = f"<u{self.width}"
        self.unzip = zstandard.ZstdDecompressor()
        raw = self.unzip.decompress(self._read(at, n))
        self.index = [_INDEX.unpack_from(raw, i) for i in range(0, len(raw), _INDEX.size)]
        self.bloom = self._read(bloom_at, bloom_n)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, n, _, crc = self.index[i]
        data = self._read(at, n)
        if zlib.crc32(data) != crc:
            raise ValueError("damaged block")
        raw, p, key = self.unzip.decompress(data), 0, b""
        while p < len(raw):
            key = key[: raw[p]] + raw[p + 2 : p + 2 + raw[p + 1]]
            p += 2 + raw[p + 1]
            n, shift = 0, 0
            while True:
                byte = raw[p]
                p += 1
                n |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    break
            yield key, raw[p : p + n]
            p += n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, ids in self._block(i):
                yield key_id(key), np.frombuffer(ids, dtype=self.kind)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places([key], self.bits, self.hashes)[0].tolist())

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document with this key: Bloom filter, then binary search of the index."""
        raw = key_bytes(key)
        if not self.index or not self.may_hold(raw):
            return []
        wide = raw.ljust(9, b"\0")
        found = []
        for i in range(max(0, bisect.bisect_left(self.index, wide, key=lambda x: x[0]) - 1), len(self.index)):
            if self.index[i][0] > wide:
                break
            found += [np.frombuffer(ids, dtype=self.kind) for k, ids in self._block(i) if k == raw]
        return found


def _open(uri: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where, path


def shard_count(chars: int, tasks: int) -> int:
    """Shards of SHARD_CHARS, but up to ``tasks`` as long as they have LEAST_CHARS."""
    return max(1, -(-chars // SHARD_CHARS), min(tasks, -(-chars // LEAST_CHARS)))


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> list[dict]:
    """Encode every document, append the end id, write shards by ascending id; return the manifest.

    ``folder`` is a URI that driver and executors share. The manifest has a row per shard, so
    the driver holds as many rows as there are shards. Null ids come first, repeated ids are
    all kept (ordered by text), a null text counts as empty. An empty table writes no shard.
    Further columns aren't read. A shard is streamed: a task holds one block and the keys, and
    the number of shards follows the text's length, so the keys of a shard are bounded too.
    """
    n = shards or shard_count(docs.select(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder.of(tokenizer)
        end = int(end_id).to_bytes(encoder.width, "little")
        task = TaskContext.get()
        writer = out = first = last = None
        for frame in frames:
            for raw_id, is_null, text in zip(frame["id"].tolist(), frame["none"].tolist(), frame["text"].tolist(), strict=True):
                if writer is None:
                    where, base = _open(folder)
                    where.create_dir(base, recursive=True)
                    name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.sst"
                    out = where.open_output_stream(f"{base}/{name}")
                    writer = ShardWriter(out, encoder.width)
                last = None if is_null else raw_id
                first = last if writer.n_docs == 0 else first
                writer.add(key_bytes(last), encoder.packed(text) + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pd.DataFrame({"path": [f"{folder.rstrip('/')}/{name}"], "shard": [task.partitionId()], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids], "n_bytes": [writer.at], "first_key": pd.array([first], dtype="Int64"), "last_key": pd.array([last], dtype="Int64")})

    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(n, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    rows = rows.select(F.coalesce("key", F.lit(0).cast("long")).alias("id"), F.col("key").isNull().alias("none"), "text")
    found = [r.asDict() for r in rows.mapInPandas(run, MANIFEST).collect()]
    return sorted(found, key=lambda r: r["shard"])


def _based(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    base, rows = 0, []
    for r in manifest:
        rows.append((r["path"], r["shard"], base))
        base += r["n_ids"]
    df = spark.createDataFrame(rows, "path string, shard int, base long")
    return df.repartition(max(1, len(rows)), "shard")


def read_shards(spark: SparkSession, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files; a task per shard."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, base in zip(frame["path"], frame["base"], strict=True):
                where, name = _open(path)
                with where.open_input_file(name) as file:
                    rows: list[tuple] = []
                    for key, ids in ShardReader(file).scan():
                        wide = ids.astype("<u4")
                        rows.append((key, base, len(wide), zlib.crc32(wide), *([wide.astype("<i8")] if with_ids else [])))
                        base += len(wide)
                        if len(rows) >= (64 if with_ids else 20_000):
                            yield _frame(rows)
                            rows = []
                    if rows:
                        yield _frame(rows)

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
        return out.assign(doc_id=pd.array(out["doc_id"], dtype="Int64"))

    return _based(spark, manifest).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def lookup(keys: DataFrame, manifest: list[dict], key_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the documents with the keys asked for; keys without a document give no row.

    A key goes to the shards whose range holds it (binary search over the manifest); a task
    opens each of its shards once and reads only the blocks that the index names.
    """
    ranged = [r for r in manifest if r["last_key"] is not None]
    firsts = [r["first_key"] if r["first_key"] is not None else -(1 << 63) for r in ranged]

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key in frame["key"].tolist():
                at = max(0, bisect.bisect_left(firsts, key) - 1)
                while at < len(ranged) and firsts[at] <= key:
                    if key <= ranged[at]["last_key"]:
                        rows.append((key, ranged[at]["path"]))
                    at += 1
            yield pd.DataFrame(rows, columns=["key", "path"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, file, reader = None, None, None
        for frame in frames:
            rows = []
            for key, at in zip(frame["key"].tolist(), frame["path"], strict=True):
                if at != path:
                    if file is not None:
                        file.close()
                    where, name = _open(at)
                    path, file = at, where.open_input_file(name)
                    reader = ShardReader(file)
                rows += [(key, ids.astype("<i8")) for ids in reader.get(key)]
            yield pd.DataFrame(rows, columns=["doc_id", "ids"])
        if file is not None:
            file.close()

    asked = keys.select(F.col(key_col).cast("long").alias("key")).filter("key is not null").distinct()
    routed = asked.mapInPandas(route, "key long, path string")
    return routed.repartition("path").sortWithinPartitions("path", "key").mapInPandas(read, "doc_id long, ids array<long>")


def op10_token_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from shelfwise.llm.common import table

    folder = f"{shared_dir(spark).rstrip('/')}/token-shards-{uuid.uuid4().hex}"
    manifest = write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(spark, manifest)
