"""Token ids in sorted-string-table shards: prefix-compressed blocks, a sparse block index, a Bloom filter and a footer.

A shard, all integers little-endian unless said otherwise:

    data blocks | index | Bloom filter | footer

A block holds entries in key order: varint bytes shared with the key before, varint bytes of the rest of the key, varint
ids, the rest of the key, the ids. The first entry of a block shares nothing. A key is 0 for a null identifier, or 1 and
the identifier as 8 big-endian bytes with its sign bit turned, so that keys sort as identifiers do. The index holds for
each block its first key (9 bytes), offset (u64) and length (u32). The footer of 48 bytes: index offset, Bloom offset,
entries, ids (u64 each), blocks, Bloom bits (u32 each), bytes of an id (u32: 2 or 4), magic.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, shared_dir, text_of, written
from .tokens import encoder

BLOCK, MAGIC, BLOOM_BITS, BLOOM_HASHES = 64 << 10, b"GRNT", 10, 7
#: Bytes of text, and documents, that a shard holds about; its writer keeps the keys of its documents for the Bloom filter.
SHARD_BYTES, SHARD_ROWS = 32 << 20, 250_000
_FOOTER, _INDEX = struct.Struct("<QQQQIIIxxxx"), struct.Struct("<9sQI")


def key_of(doc: int | None) -> bytes:
    return b"\0" * 9 if doc is None else b"\1" + (doc + (1 << 63)).to_bytes(8, "big")


def doc_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bits(key: bytes, size: int) -> list[int]:
    one, two = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(one + k * two) % size for k in range(BLOOM_HASHES)]


class Writer:
    """Writes entries, given in key order, to an open binary file."""

    def __init__(self, file, width: int):
        self.file, self.width, self.at, self.ids, self.index, self.keys = file, width, 0, 0, [], []
        self.block, self.last, self.first = bytearray(), b"", b""

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: packed, `width` bytes each."""
        if len(self.block) >= BLOCK:
            self._end_block()
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids) // self.width) + key[shared:] + ids
        self.last = key
        self.ids += len(ids) // self.width
        self.keys.append(key)

    def _end_block(self) -> None:
        self.file.write(bytes(self.block))
        self.index.append((self.first, self.at, len(self.block)))
        self.at += len(self.block)
        self.block = bytearray()

    def end(self) -> None:
        if self.block:
            self._end_block()
        index = b"".join(_INDEX.pack(*x) for x in self.index)
        size = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray(-(-size // 8))
        for key in self.keys:
            for bit in _bits(key, size):
                bloom[bit >> 3] |= 1 << (bit & 7)
        self.file.write(index + bytes(bloom) + _FOOTER.pack(self.at, self.at + len(index), len(self.keys), self.ids, len(self.index), size, self.width) + MAGIC)


class Reader:
    """Reads a shard from an open binary file that can seek: all entries in order, or one key by binary search."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - _FOOTER.size - 4)
        tail = file.read()
        if tail[-4:] != MAGIC:
            raise ValueError("no shard: its last bytes aren't the magic ones")
        index, self.bloom_at, self.entries, self.ids, blocks, self.bits, self.width = _FOOTER.unpack(tail[:-4])
        file.seek(index)
        self.index = list(_INDEX.iter_unpack(file.read(blocks * _INDEX.size)))
        self.bloom = file.read(-(-self.bits // 8))

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, length = self.index[k]
        self.file.seek(at)
        data, at, key = self.file.read(length), 0, b""
        while at < length:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n * self.width]
            at += n * self.width

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self._block(k)

    def get(self, doc: int | None) -> list[bytes]:
        """The packed ids of every entry with this identifier."""
        key = key_of(doc)
        if not self.index or any(not self.bloom[b >> 3] & 1 << (b & 7) for b in _bits(key, self.bits)):
            return []
        found, k = [], max(0, bisect.bisect_left(self.index, key, key=lambda x: x[0]) - 1)
        while k < len(self.index) and self.index[k][0] <= key:
            found += [ids for x, ids in self._block(k) if x == key]
            k += 1
        return found


def _store(uri: str):
    """The file system and path of a URI, as executors reach it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _narrow(ids: bytes, width: int) -> bytes:
    import numpy as np

    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def _wide(ids: bytes, width: int) -> bytes:
    import numpy as np

    return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids


def _width(tokens, end_id: int) -> int:
    return 2 if tokens.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4


def write_shards(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None, shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Encodes every whole text, appends end_id, and writes shards in ascending doc_id order, null ones first.

    Texts are brought into order and encoded where their shard is written, so that they cross the disk once. There are as
    many shards as hold about `shard_bytes` of text or `shard_rows` documents each. Returns the manifest: shard, uri,
    entries, ids, first (the least doc_id). Rows with one doc_id come in the order in which they are read, and may fill
    several shards; null text counts as empty. A shard gets its name only when it is whole, so a task that is run again
    leaves one. Empty table: no shards. Other columns are left.
    """
    folder = folder or shared_dir(docs.sparkSession)
    schema = "shard int, uri string, entries long, ids long, first long"
    from pyspark.sql.types import StructType

    out = arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        shard, store, writer, first = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part, tokens = batch.slice(at, 2048), encoder(path)
                if writer is None:
                    width = _width(tokens, end_id)
                    store, base = _store(folder)
                    store.create_dir(base)
                    name, draft = f"{base}/shard-{shard:06d}.sst", f"{base}/_draft-{shard:06d}-{uuid.uuid4().hex}"
                    file = store.open_output_stream(draft)
                    writer, first = Writer(file, width), part.column(0)[0].as_py()
                end = end_id.to_bytes(width, "little")
                for doc, ids in zip(part.column(0).to_pylist(), tokens.encode(part.column(1))):
                    writer.add(key_of(doc), _narrow(ids, width) + end)
        if writer:
            writer.end()
            file.close()
            store.move(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, f"{folder}/shard-{shard:06d}.sst", len(writer.keys), writer.ids, first), out)], schema=out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.monotonically_increasing_id().alias("row"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_of()).cast("long")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    shards = max(1, -(-size.bytes // shard_bytes), -(-size.n // shard_rows))
    rows = rows.repartitionByRange(shards, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    return written(rows.select("doc_id", "text").mapInArrow(run, schema), "manifest", folder)


def read_shards(manifest: DataFrame, columns: str, rows) -> DataFrame:
    """rows(doc_id, start, ids packed as u32) for each entry of the shards; start: ids of all entries before it. There are as
    many tasks as shards."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(columns)
    out = arrow_schema(schema)
    # One row for each shard: shards hold many documents, so this window is short.
    placed = manifest.withColumn("start", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch["uri"].to_pylist(), batch["start"].to_pylist()):
                store, name = _store(uri)
                with store.open_input_file(name) as file:
                    reader, made = Reader(file), []
                    for key, ids in reader:
                        made.append(rows(doc_of(key), start, _wide(ids, reader.width)))
                        start += len(ids) // reader.width
                        if len(made) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)
                            made = []
                    if made:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    return placed.repartition(max(1, manifest.count()), "shard").select("uri", "start").mapInArrow(run, schema)


def lookup(uri: str, doc: int | None) -> list[bytes]:
    """The packed ids of a document in one shard: Bloom filter, binary search in the index, then one block."""
    store, name = _store(uri)
    with store.open_input_file(name) as file:
        return Reader(file).get(doc)
