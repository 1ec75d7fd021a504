"""Token ids in wavelet matrices, one compressed file per shard.

A shard holds the ids of consecutive documents in ascending doc_id order.  Its file has
one bit-plane per bit of an id (the highest first; each plane orders what the plane
before it split) and running counts of ones, so one file answers access (the id at a
place), count and rank (occurrences of an id before a place) and select (the place of
an occurrence), and decodes to the ids.

Executors share no folder of their own with anyone, so a file is a row of a Parquet
table in the shared folder: Spark's writer commits it, whatever happens to a task.

Defined cases: a null text has no ids but the end id; an empty one too.  A doc_id may have any
type with an order; null ones sort first; rows with equal doc_id follow each other by a
hash of their texts.  A document is never cut, so a very long one makes a shard longer than
asked.  Extra columns are ignored.  An empty table makes no shard and gives no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, narrow
from .tokens import blocks, encoder, with_end

MAGIC, STEP = b"WVM1", 512  # bits between two running counts
NAMES = ["part", "seq", "local_start", "n_tokens", "doc_ids", "lengths", "data"]
PART_BYTES = 128 << 20  # of text, that a task sorts and encodes


class WaveletMatrix:
    """bits[k]: plane k as 0/1; ones[k]: ones before every STEP-th bit; zeros[k]: zeros in the plane."""

    def __init__(self, n: int, planes: list[np.ndarray], ones: list[np.ndarray]) -> None:
        self.n, self.planes, self.ones = n, planes, ones
        self.zeros = [n - int(o[-1]) for o in ones]

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        x = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, ones = [], []
        for b in reversed(range(width)):
            bit = (x & x.dtype.type(1 << b)) != 0
            packed = np.packbits(bit, bitorder="little")
            planes.append(packed)
            ones.append(cls._running(packed))
            y, zeros = np.empty_like(x), len(x) - int(ones[-1][-1])
            np.compress(~bit, x, out=y[:zeros])
            np.compress(bit, x, out=y[zeros:])
            x = y
        return cls(len(ids), planes, ones)

    @staticmethod
    def _running(packed: np.ndarray) -> np.ndarray:
        each = np.bitwise_count(packed).astype(np.uint32)
        blocks = np.add.reduceat(each, np.arange(0, len(each), STEP // 8)) if len(each) else each
        return np.concatenate([[0], np.cumsum(blocks)]).astype(np.uint32)

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [MAGIC, struct.pack("<QI", self.n, len(self.planes))]
        for plane, ones in zip(self.planes, self.ones):
            for part in (pack(plane.tobytes()), pack(ones.astype("<u4").tobytes())):
                parts += [struct.pack("<Q", len(part)), part]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        unpack = zstandard.ZstdDecompressor().decompress
        n, width = struct.unpack_from("<QI", data, 4)
        at, parts = 16, []
        for _ in range(2 * width):
            (size,) = struct.unpack_from("<Q", data, at)
            parts.append(unpack(data[at + 8 : at + 8 + size]))
            at += 8 + size
        return cls(n, [np.frombuffer(p, np.uint8) for p in parts[::2]], [np.frombuffer(p, "<u4") for p in parts[1::2]])

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3] >> (i & 7)) & 1

    def _rank1(self, k: int, i: int) -> int:
        """Ones before place i of plane k."""
        block, plane = i // STEP, self.planes[k]
        start = block * STEP // 8
        count = int(self.ones[k][block]) + int(np.bitwise_count(plane[start : i >> 3]).sum())
        return count + ((int(plane[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def _select(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit in plane k."""
        before = self.ones[k].astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before)) * STEP, self.n) - before
        block = int(np.searchsorted(before, j, "right")) - 1
        bits = np.unpackbits(self.planes[k][block * STEP // 8 : (block + 1) * STEP // 8], bitorder="little")[: self.n - block * STEP]
        return block * STEP + int(np.flatnonzero(bits == bit)[j - int(before[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(len(self.planes)):
            bit, ones = self._bit(k, i), self._rank1(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token before place i."""
        if token >> len(self.planes):
            return 0
        lo, hi = 0, i
        for k in range(len(self.planes)):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (len(self.planes) - 1 - k) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """Place of the token's j-th occurrence, from 0."""
        if not 0 <= j < self.count(token):
            raise IndexError(j)
        width, lo = len(self.planes), 0
        for k in range(width):
            ones = self._rank1(k, lo)
            lo = self.zeros[k] + ones if token >> (width - 1 - k) & 1 else lo - ones
        place = lo + j
        for k in reversed(range(width)):
            place = self._select(k, 1, place - self.zeros[k]) if token >> (width - 1 - k) & 1 else self._select(k, 0, place)
        return place

    def decode(self) -> np.ndarray:
        width = len(self.planes)
        x = np.zeros(self.n, np.uint16 if width <= 16 else np.uint32)
        for k in reversed(range(width)):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            y, zeros = np.empty_like(x), self.zeros[k]
            x[zeros:] |= x.dtype.type(1 << (width - 1 - k))
            y[np.flatnonzero(~bit)] = x[:zeros]  # by places: faster than by masks
            y[np.flatnonzero(bit)] = x[zeros:]
            x = y
        return x.astype(np.uint32)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, shard_tokens: int = 1 << 19, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The table of shard files, written; tokenizer: path of a file that is on every machine."""
    docs = narrow(docs, doc_id=doc_id, text=text)
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    order = ["doc_id", F.xxhash64("text")]  # equal ids are put in order too, and may be parted
    docs = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        width = (enc.size - 1).bit_length()
        keys, lengths, arrays, held, seq, start = [], [], [], 0, 0, 0

        def flush():
            data = WaveletMatrix.build(np.concatenate(arrays), width).to_bytes()
            ids, n = pa.concat_arrays(keys), np.concatenate(lengths)
            one = [pa.array([0, len(ids)], pa.int32()), ids], [pa.array([0, len(n)], pa.int32()), pa.array(n, pa.int64())]
            plain = [pa.array([x], k) for x, k in ((part, pa.int32()), (seq, pa.int32()), (start, pa.int64()), (held, pa.int64()))]
            return pa.RecordBatch.from_arrays([*plain, *(pa.ListArray.from_arrays(*x) for x in one), pa.array([data], pa.binary())], NAMES)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in blocks(texts):
                tokens, cuts = with_end(*enc.encode(texts.slice(a, b - a)), end_id)
                i = 0
                while i < b - a:  # up to the document that fills the shard
                    j = min(b - a, int(np.searchsorted(cuts, cuts[i] + shard_tokens - held)))
                    keys.append(ids.slice(a + i, j - i)), lengths.append(np.diff(cuts[i : j + 1])), arrays.append(tokens[cuts[i] : cuts[j]])
                    held += int(cuts[j] - cuts[i])
                    i = j
                    if held >= shard_tokens:
                        yield flush()
                        keys, lengths, arrays, seq, start, held = [], [], [], seq + 1, start + held, 0
        if held:
            yield flush()

    schema = f"part int, seq int, local_start long, n_tokens long, doc_ids array<{kind.simpleString()}>, lengths array<long>, data binary"
    return materialize(docs.mapInArrow(write, schema), "wavelet-shards")


def with_starts(shards: DataFrame) -> DataFrame:
    """Adds `start`, the number of ids in all shards before.  One row per written partition is put in order."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return shards.join(offsets, "part").withColumn("start", F.col("before") + F.col("local_start"))


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                start, data = batch.column(0)[k].as_py(), batch.column(3)[k].as_py()
                lengths = batch.column(2)[k].values.to_numpy()
                x = WaveletMatrix.from_bytes(data).decode().astype("<u4").tobytes()
                cuts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                at = (4 * cuts).tolist()
                view = memoryview(x)
                crc = [zlib.crc32(view[a:b]) for a, b in zip(at[:-1], at[1:])]
                columns = [batch.column(1)[k].values, pa.array(start + cuts[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    return with_starts(shards).select("start", "doc_ids", "lengths", "data").mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """part, seq and count of a token per shard, read from the planes without decoding."""

    def look(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pylist(
                [{"part": r["part"], "seq": r["seq"], "n": WaveletMatrix.from_bytes(r["data"]).count(token)} for r in rows],
                schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int64())]),
            )

    return shards.select("part", "seq", "data").mapInArrow(look, "part int, seq int, n long")
