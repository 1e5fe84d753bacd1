"""Sorted-string-table shards of token ids, keyed by document identifier.

A range partition of the identifiers is one file, of one shard or several one after the other. A shard is, in this order
(integers are little-endian unless said otherwise):

* header: ``SLT2``, then unsigned 64-bit: range partition, number within it, tokens before this shard in its partition;
* data blocks of about ``BLOCK`` bytes. An entry is three variable-length integers (bytes shared with the previous
  key, further key bytes, value bytes), the further key bytes and the value. A block's first entry shares nothing.
  A value is the ids as unsigned 16- or 32-bit integers;
* sparse index: for each block its first key, offset, length and crc32;
* Bloom filter over the keys, 10 bits a key and 7 probes;
* footer: offsets of index and filter from the shard's start, numbers of blocks, entries, tokens and filter bits, the bytes of an
  id, the shard's length, and ``SLT2`` with a line feed, which Spark's text writer adds. So a file is read from its end.

A key is one byte (0 for a null id, else 1) and the id plus 2**63 as big-endian 64-bit integer, so byte order is id
order. Files are written by Spark's own committer and read as binary files, so they may lie in any store. The manifest, a table beside
them, tells every shard's file, place and least and greatest key; :class:`Table` looks documents up by it with a few seeks.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .cached_encoder import encoder
from .common import text_of

BLOCK, SHARD = 64 << 10, 16 << 20
#: Bytes of text to a range partition, unless a table has more of it than ``MOST`` partitions hold.
PARTITION, MOST = 24 << 20, 100_000
MAGIC = b"SLT2"
_HEAD, _INDEX, _FOOT = struct.Struct("<4s3Q"), struct.Struct("<9sQLL"), struct.Struct("<6QBQ4s")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def table_key(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def _doc_id(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + k * b & (1 << 64) - 1) % bits for k in range(7)]


class ShardWriter:
    """Builds one shard in memory from keys in ascending order."""

    def __init__(self, partition: int, number: int, before: int, width: int):
        self.data = bytearray(_HEAD.pack(MAGIC, partition, number, before))
        self.index, self.keys, self.width, self.tokens = [], [], width, 0
        self.block, self.first, self.last = bytearray(), b"", b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if len(self.block) >= BLOCK:
            self._close()
        if not self.block:
            self.first, self.last = key, b""
        shared = 0
        while shared < len(self.last) and self.last[shared] == key[shared]:
            shared += 1
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids)

    def _close(self) -> None:
        if self.block:
            self.index.append((self.first, len(self.data), len(self.block), zlib.crc32(self.block)))
            self.data += self.block
            self.block = bytearray()

    def size(self) -> int:
        return len(self.data) + len(self.block)

    def finish(self) -> bytes:
        """The file's bytes but for the final line feed."""
        self._close()
        index_at = len(self.data)
        for entry in self.index:
            self.data += _INDEX.pack(*entry)
        bits = max(64, 10 * len(self.keys) + 7 & ~7)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = len(self.data)
        self.data += bloom
        self.data += _FOOT.pack(index_at, bloom_at, len(self.index), len(self.keys), self.tokens, bits, self.width, len(self.data) + _FOOT.size, MAGIC)
        return bytes(self.data)


def foot_of(end: bytes) -> tuple:
    """The footer's fields from a shard's last bytes, the line feed included."""
    if len(end) < _FOOT.size + 1 or end[-1:] != b"\n":
        raise ValueError("not a whole shard")
    *foot, magic = _FOOT.unpack_from(end, len(end) - 1 - _FOOT.size)
    if magic != MAGIC:
        raise ValueError("not a shard")
    return tuple(foot)


def shards_in(content: bytes) -> list[tuple[int, memoryview]]:
    """The shards of a file, each with its offset."""
    data, out, end = memoryview(content).cast("B"), [], len(content)
    while end:
        length = foot_of(bytes(data[max(0, end - 1 - _FOOT.size) : end]))[-1] + 1
        if length > end:
            raise ValueError("not a whole shard")
        out.append((end - length, data[end - length : end]))
        end -= length
    return out[::-1]


class Shard:
    """Reads one shard through ``read(offset, size)``, or from its bytes; a lookup reads footer, index, filter and blocks alone."""

    def __init__(self, source, size: int | None = None):
        if size is None:
            content = memoryview(source).cast("B")
            size, source = len(content), lambda at, n: content[at : at + n]
        self.read, self.size = source, size
        index_at, self.bloom_at, blocks, self.entries, self.tokens, self.bits, self.width, length = foot_of(bytes(source(max(0, size - 1 - _FOOT.size), _FOOT.size + 1)))
        head = _HEAD.unpack(bytes(source(0, _HEAD.size)))
        if length + 1 != size or head[0] != MAGIC:
            raise ValueError("not a whole shard")
        self.partition, self.number, self.before = head[1:]
        index = bytes(source(index_at, blocks * _INDEX.size))
        self.index = [_INDEX.unpack_from(index, k * _INDEX.size) for k in range(blocks)]

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, crc = self.index[k]
        block = memoryview(self.read(at, size))
        if zlib.crc32(block) != crc:
            raise ValueError("a block is damaged")
        key, at = b"", 0
        while at < size:
            shared, at = _read_varint(block, at)
            more, at = _read_varint(block, at)
            length, at = _read_varint(block, at)
            key = key[:shared] + bytes(block[at : at + more])
            at += more
            yield key, np.frombuffer(block[at : at + length], "<u2" if self.width == 2 else "<u4")
            at += length

    def last_key(self) -> bytes:
        key = b""
        for key, _ in self._block(len(self.index) - 1):
            pass
        return key

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self._block(k):
                yield _doc_id(key), ids

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The id arrays of a document: Bloom filter, binary search in the index, then one block, or more for repeated ids."""
        key = table_key(doc_id)
        bloom = self.read(self.bloom_at, self.bits // 8)
        if not all(bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        k = max(0, bisect_left(self.index, (key,)) - 1)
        out: list[np.ndarray] = []
        while k < len(self.index) and self.index[k][0] <= key:
            out += [ids for found, ids in self._block(k) if found == key]
            k += 1
        return out


def _writer(path: str, end_id: int, width: int, shard_bytes: int):
    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end, partition = encoder(path), np.array([end_id], np.uint32), TaskContext.get().partitionId()
        number, before, now = 0, 0, None
        done = lambda s: pa.RecordBatch.from_arrays([pa.array([s.finish()], pa.binary())], ["data"])
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if now is None:
                    now = ShardWriter(partition, number, before, width)
                now.add(table_key(doc_id), np.concatenate([np.frombuffer(tool.encode(text.as_py()), "<u4"), end]))
                if now.size() >= shard_bytes:
                    before, number = before + now.tokens, number + 1
                    yield done(now)
                    now = None
        if now is not None:
            yield done(now)

    return shards


def write_tables(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2, shard_bytes: int = SHARD, partition_bytes: int = PARTITION, manifest: bool = True) -> None:
    """Encode every whole text, append ``end_id`` and write shards of about ``shard_bytes`` to ``folder``/shards, and the
    ``manifest`` of them to ``folder``/manifest.

    Entries ascend by id, null first; repeated ids follow in the order of their texts' hashes. Null and
    empty texts are entries with the end id alone. ``width`` is the bytes of an id, 2 or 4; a ``ValueError`` says that the vocabulary
    or the end id doesn't fit. A range of ids that holds many rows is cut by the texts' hashes and row numbers too. An empty table
    gives no shard.
    """
    largest = max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), default=0)
    if width not in (2, 4) or not 0 <= end_id < 1 << 8 * width or largest >= 1 << 8 * width:
        raise ValueError(f"ids up to {max(largest, end_id)} don't fit in {width} bytes")
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(MOST, -(-volume // partition_bytes)))
    rows = rows.repartitionByRange(parts, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    rows.mapInArrow(_writer(tokenizer, end_id, width, shard_bytes), "data binary").select(F.col("data").cast("string").alias("value")).write.text(f"{folder}/shards")
    if manifest:
        _files(docs.sparkSession, folder).mapInArrow(_listed, _MANIFEST).write.parquet(f"{folder}/manifest")


_MANIFEST = "file string, at long, size long, part long, number long, before long, first_key binary, last_key binary, entries long, tokens long"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/shards").select("path", "content")


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            found = [(at, s.size, s.partition, s.number, s.before, s.index[0][0], s.last_key(), s.entries, s.tokens) for at, data in shards_in(content.as_buffer()) for s in [Shard(data)]]
            columns = [pa.array([path] * len(found), pa.string())]
            for k, values in enumerate(zip(*found, strict=True)):
                columns.append(pa.array(values, pa.binary() if k in (5, 6) else pa.int64()))
            if found:
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _MANIFEST.split(", ")])


class Table:
    """Looks documents up in the shards of a folder: the manifest names the few shards whose keys enclose an id, and of these only the
    footer, index, filter and blocks in question are read, through the store's own file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.manifest = spark, spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")

    def _reader(self, file: str, at: int):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(file)

        def read(offset: int, size: int) -> bytes:
            stream = place.getFileSystem(conf).open(place)
            try:
                stream.seek(at + offset)
                return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)) if size else b""
            finally:
                stream.close()

        return read

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The id arrays of a document, in order; more than one for a repeated id, none for an unknown one."""
        key = bytearray(table_key(doc_id))
        found = self.manifest.where((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).orderBy("part", "number").select("file", "at", "size").collect()
        return [ids for r in found for ids in Shard(self._reader(r["file"], r["at"]), r["size"]).lookup(doc_id)]


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            for _, data in shards_in(content.as_buffer()):
                shard = Shard(data)
                rows, at = [], shard.before
                for doc_id, ids in shard:
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([shard.partition] * len(rows), pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_tables(spark: SparkSession, folder: str) -> DataFrame:
    """One row per entry of the shards in ``folder``: ``part`` (range partition), ``doc_id``, ``at`` (tokens before
    it in its partition), ``n_tokens`` and ``ids_crc32`` (of the ids as unsigned 32-bit integers)."""
    return _files(spark, folder).select("content").mapInArrow(_entries, "part long, doc_id long, at long, n_tokens long, ids_crc32 long")


def starts(entries: DataFrame) -> DataFrame:
    """``entries`` (from :func:`read_tables`) with ``start``, the ids of all documents before each one. The driver sees
    one sum per range partition, at most ``MOST``."""
    totals = entries.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    bases, at = [], 0
    for r in totals:
        bases.append((r["part"], at))
        at += r["n"]
    bases = entries.sparkSession.createDataFrame(bases, "part long, base long")
    return entries.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
