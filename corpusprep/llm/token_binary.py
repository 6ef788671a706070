"""Operator 3: token ids as binary files of shuffled byte planes.

Documents are range-partitioned and sorted by their key; every task encodes
its range and cuts the stream of ids into chunks of a fixed number of ids. A
chunk is transposed into planes (all lowest bytes, then all second bytes, ...;
or the same by bits) and each plane is compressed by itself with zstandard:
the high planes of token ids are nearly constant and shrink to almost nothing.

File format (a folder of Parquet files written by Spark, hence committed
atomically and safe against lost executors), one row per chunk:

``shard, chunk``   position of the chunk: shards in key order, chunks within
``first, n_ids``   chunk index: ids of the shard before the chunk, ids in it
``planes``         array of zstandard frames, lowest plane first
``width``          8 (byte planes) or 1 (bit planes)
``rows, keys, at, count, more``  the documents' slices in the chunk: row number
                   in the shard, key, offset inside the document, ids, and
                   whether the document goes on in the next chunk

The index columns are read without the planes (column pruning).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.llm.bpe_boundary import encoder, text_slices
from corpusprep.llm.common import table

CHUNK_IDS = 1 << 16
ID_BYTES = 4
LEVEL = 3


def to_planes(ids: np.ndarray, bits: bool = False, level: int = LEVEL) -> list[bytes]:
    """Compressed planes of an array of unsigned 32-bit ids."""
    by_byte = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, ID_BYTES)
    z = zstandard.ZstdCompressor(level=level)
    planes = (np.ascontiguousarray(by_byte[:, k]) for k in range(ID_BYTES))
    if not bits:
        return [z.compress(p) for p in planes]
    return [z.compress(np.packbits((p >> b) & 1).tobytes()) for p in planes for b in range(8)]


def from_planes(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    """The ids back from their planes."""
    z = zstandard.ZstdDecompressor()
    ids = np.zeros(n, "<u4")
    by_byte = ids.view(np.uint8).reshape(-1, ID_BYTES)
    for k in range(ID_BYTES if n else 0):       # one plane at a time
        raw = [np.frombuffer(z.decompress(p), np.uint8) for p in (planes[8 * k:8 * k + 8] if bits else planes[k:k + 1])]
        by_byte[:, k] = sum(np.unpackbits(x, count=n) << np.uint8(b) for b, x in enumerate(raw)) if bits else raw[0]
    return ids


def crc32_join(a: int, b: int, length: int) -> int:
    """crc32 of two strings in a row from their own values and the length of
    the second (a's register is shifted over ``length`` zero bytes by squaring
    the one-zero-bit operator, as a polynomial over GF(2))."""
    def times(p, q):        # product modulo the reflected crc32 polynomial
        r = 0
        for i in range(32):
            if p >> (31 - i) & 1:
                r ^= q
            q = (q >> 1) ^ (0xEDB88320 if q & 1 else 0)
        return r

    power, square, n = 1 << 31, 1 << 23, length     # x^0 and x^8
    while n:
        if n & 1:
            power = times(power, square)
        square = times(square, square)
        n >>= 1
    return times(power, a) ^ b


def _chunk_schema(key: T.DataType) -> T.StructType:
    ints = T.ArrayType(T.LongType())
    return T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("chunk", T.LongType()),
        T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("width", T.IntegerType()), T.StructField("planes", T.ArrayType(T.BinaryType())),
        T.StructField("rows", ints), T.StructField("keys", T.ArrayType(key)),
        T.StructField("at", ints), T.StructField("count", ints),
        T.StructField("more", T.ArrayType(T.BooleanType()))])


def write(docs: DataFrame, path: str, vocab: str, key: str = "doc_id", text: str = "text",
          end_id: int = 2, chunk_ids: int = CHUNK_IDS, bits: bool = False) -> None:
    """Encode ``docs`` and write them to the folder ``path`` in ascending ``key``
    order (null first, equal keys by hash and text; a null text counts as empty, every
    document ends with ``end_id``). One range shuffle of key and text; the
    encoder runs once, above it."""
    schema = _chunk_schema(docs.schema[key].dataType)
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t"), F.col("t").asc_nulls_first()]
    ranged = (docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
              .repartitionByRange(F.col("k").asc_nulls_first(), F.xxhash64("t"))
              .sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id()))

    def run(batches):
        enc = encoder(vocab)
        end = np.array([end_id], "<u4").tobytes()
        held: list[bytes] = []          # ids not yet in a chunk
        spans: list[tuple] = []         # their (row, key, offset, count)
        size = row = chunk = first = 0
        shard = 0

        def flush(last):
            """Chunks of the ids held so far; what fills no chunk stays."""
            nonlocal held, spans, size, chunk, first
            ids = np.frombuffer(b"".join(held), "<u4")
            done, i = 0, 0
            while size - done >= (1 if last else chunk_ids):
                n = min(chunk_ids, size - done)
                part, room = [], n
                while room:
                    r, k, at, c = spans[i]
                    take = min(c, room)
                    part.append((r, k, at, take, take < c))
                    room -= take
                    if take < c:
                        spans[i] = (r, k, at + take, c - take)
                    else:
                        i += 1
                out = [shard, chunk, first, n, 1 if bits else 8, to_planes(ids[done:done + n], bits),
                       *(list(x) for x in zip(*part))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) for v, f in zip(out, arrow)], names=schema.names)
                chunk, first, done = chunk + 1, first + n, done + n
            held, spans, size = [ids[done:].tobytes()], spans[i:], size - done

        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for b in batches:
            if b.num_rows:
                shard = b.column(2)[0].as_py()
            for start, texts in text_slices(b.column(1)):
                keys = b.column(0).slice(start, len(texts)).to_pylist()
                for k, ids in zip(keys, enc.encode_batch(texts)):
                    n = len(ids) // 4 + 1
                    held += [ids, end]
                    spans.append((row, k, 0, n))
                    size += n
                    row += 1
                if size >= 8 * chunk_ids:
                    yield from flush(False)
        yield from flush(True)

    ranged.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(path)


def shard_bases(spark: SparkSession, path: str) -> DataFrame:
    """(shard, base): ids of all shards before each shard. One row per shard:
    bounded by the number of write tasks."""
    totals = (spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
              .orderBy("shard").collect())
    out, base = [], 0
    for r in totals:
        out.append((r["shard"], base))
        base += r["n"]
    return spark.createDataFrame(out, "shard int, base long")


def read_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Read a folder back: per document ``key``, ``start`` (ids of all documents
    before it), ``n_tokens`` and ``ids_crc32`` of all its ids. Chunks are read
    independently; a document that spans several has its slices' checksums
    joined in order. Documents with equal keys stay apart."""
    chunks = spark.read.parquet(path)
    kt = chunks.schema["keys"].dataType.elementType
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("row", T.LongType()),
        T.StructField(key, kt), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("pos", T.LongType()), T.StructField("crc", T.LongType()),
        T.StructField("whole", T.BooleanType())])

    def slices(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for b in batches:
            for i in range(b.num_rows):
                c = {n: b.column(n)[i].as_py() for n in b.schema.names}
                raw = from_planes(c["planes"], c["n_ids"], c["width"] == 1).tobytes()
                ends = np.cumsum(c["count"])
                begins = ends - c["count"]
                crc = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(begins.tolist(), ends.tolist())]
                pos = (c["first"] + begins).tolist()
                whole = [not a and not m for a, m in zip(c["at"], c["more"])]
                cols = [[c["shard"]] * len(crc), c["rows"], c["keys"], c["at"], c["count"], pos, crc, whole]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(cols, arrow)], names=schema.names)

    parts = table(chunks.mapInArrow(slices, schema), "slices")
    base = F.broadcast(shard_bases(spark, path))
    start = (F.col("base") + F.col("pos")).alias("start")
    whole = parts.filter(F.col("whole")).join(base, "shard").select(
        key, start, F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))

    @F.pandas_udf("long")
    def joined(s):
        def one(slices):
            crc = 0
            for p in slices:
                crc = crc32_join(crc, int(p["crc"]), ID_BYTES * int(p["n"]))
            return crc
        return s.map(one)

    # only documents that span chunks meet again
    spread = (parts.filter(~F.col("whole")).groupBy("shard", "row")
              .agg(F.first(key).alias(key), F.min("pos").alias("pos"), F.sum("n").alias("n_tokens"),
                   F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("slices"))
              .join(base, "shard").select(key, start, "n_tokens", joined("slices").alias("ids_crc32")))
    return whole.unionByName(spread)
