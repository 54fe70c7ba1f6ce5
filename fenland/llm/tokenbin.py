"""Training-order materialisation of token ids (operator 8).

Texts are dealt to groups by a hash of id and text and stand in their order there, so that the result is the same however
the input is split. A group is a token stream cut into sequences of one length. A keyed Feistel permutation with
cycle-walking gives the i-th sequence its global slot; each task writes a range of adjacent shards. A shard is a file of
fixed-stride records in slot order, so that slot s lies in shard s // per_shard at byte (s % per_shard) * stride, and
reading on from any slot is sequential. The manifest is stored beside the shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fenland.functions.tables import shuffles_dropped

from .common import new_folder, scratch, text_key, written
from .files import Replaced, opened
from .kernel import U, blocks, heads, mix
from .tokens import EOS, encoder

LENGTH, PER_SHARD, KEY, ROUNDS = 2048, 2048, 20231, 6
#: Documents of a group on average; at most so many groups, beyond which they grow; at most so many tasks that write shards,
#: beyond which each writes several adjacent ones.
GROUP, GROUPS, TASKS = 4000, 100_000, 50_000
MANIFEST = "shard long, first_slot long, n_sequences long, bytes long"


def packer() -> pa.Codec:
    """Ids travel packed, each sequence by itself, until their shard is written."""
    return pa.Codec("zstd", 3)


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n-1: a balanced Feistel network on the next even number of bits, walked until below n."""
    half = U(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (U(1) << half) - U(1)
    x = x.astype(U)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> half, x[todo] & mask
        for r in range(ROUNDS):
            salt = int(mix(np.array([(key * 0x9E3779B97F4A7C15 + r + 1) % 2**64], U))[0])
            left, right = right, left ^ (mix(right + U(salt)) & mask)
        x[todo] = (left << half) | right
        todo = x >= U(n)
    return x.astype(np.int64)


def sequences(batches: Iterator[pa.RecordBatch], path: str | None, length: int) -> Iterator[pa.RecordBatch]:
    """part, ordinal, n_tokens, packed ids (unsigned 16-bit): each part's token stream in pieces; its last one is padded."""
    part, ordinal, rest, codec = None, 0, np.zeros(0, np.uint16), packer()

    def rows(ids: np.ndarray, n: list[int]) -> pa.RecordBatch:
        data = [codec.compress(ids[i * length : (i + 1) * length].astype("<u2").tobytes(), asbytes=True) for i in range(len(n))]
        k = len(n)
        return pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int64()), pa.array(range(ordinal, ordinal + k), pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["part", "ordinal", "n_tokens", "packed"])

    def padded() -> pa.RecordBatch:
        return rows(np.concatenate([rest, np.full(length - len(rest), EOS, np.uint16)]), [len(rest)])

    encode = encoder(path)
    for batch in batches:
        for b in blocks(batch, "text"):
            ids, offsets = encode.encoded(b.column("text"), EOS)
            if ids.max() > 65535:
                raise ValueError("ids above 65535 do not fit 16 bits")
            of = b.column("part").to_numpy()
            first = heads(of)
            for p, a, z in zip(of[first].tolist(), offsets[first].tolist(), [*offsets[first[1:]].tolist(), len(ids)], strict=True):
                if p != part:
                    if len(rest):
                        yield padded()
                    part, ordinal, rest = p, 0, np.zeros(0, np.uint16)
                rest = np.concatenate([rest, ids[a:z].astype(np.uint16)])
                if full := len(rest) // length:
                    yield rows(rest, [length] * full)
                    ordinal, rest = ordinal + full, rest[full * length :]
    if len(rest):
        yield padded()


def with_slots(batches: Iterator[pa.RecordBatch], starts: np.ndarray, n: int, key: int, per_shard: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slot = feistel(starts[b.column("part").to_numpy()] + b.column("ordinal").to_numpy(), n, key)
        yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot), b.column("n_tokens"), b.column("packed")], ["shard", "slot", "n_tokens", "packed"])


def write_shards(batches: Iterator[pa.RecordBatch], folder: str, per_shard: int, length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slot -> a file for each shard; shard, first slot, sequences, bytes."""
    system, base = opened(folder)
    now, file, n, codec = None, None, 0, packer()

    def closed() -> pa.RecordBatch:
        file.close()
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (now, now * per_shard, n, file.size)], ["shard", "first_slot", "n_sequences", "bytes"])

    for b in batches:
        for shard, slot, packed in zip(b.column("shard").to_pylist(), b.column("slot").to_pylist(), b.column("packed").to_pylist(), strict=True):
            if shard != now:
                if file:
                    yield closed()
                now, n, file = shard, 0, Replaced(system, base, f"shard-{shard:08d}.bin")
            if slot != shard * per_shard + n:
                raise ValueError(f"slot {slot} does not follow in shard {shard}")
            file.write(codec.decompress(packed, decompressed_size=2 * length, asbytes=True))
            n += 1
    if file:
        yield closed()


def read_shards(batches: Iterator[pa.RecordBatch], folder: str, length: int, from_slot: int = 0) -> Iterator[pa.RecordBatch]:
    """Shard rows -> slot, shard, byte_offset, ids, read in order from from_slot on."""
    system, base = opened(folder)
    stride = 2 * length
    for b in batches:
        for shard, first, n in zip(*(b.column(c).to_pylist() for c in ("shard", "first_slot", "n_sequences")), strict=True):
            skip = max(0, from_slot - first)
            if skip >= n:
                continue
            with system.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
                if f.size() != n * stride:
                    raise ValueError(f"shard {shard} has {f.size()} bytes, not {n * stride}")
                f.seek(skip * stride)
                for at in range(skip, n, 256):
                    k = min(256, n - at)
                    data = f.read(k * stride)
                    yield pa.RecordBatch.from_arrays([pa.array(range(first + at, first + at + k), pa.int64()), pa.array([shard] * k, pa.int64()), pa.array(range(at * stride, (at + k) * stride, stride), pa.int64()), pa.array([data[i * stride : (i + 1) * stride] for i in range(k)], pa.binary())], ["slot", "shard", "byte_offset", "ids"])


def materialise(docs: DataFrame, folder: str, text: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, path: str | None = None, doc_id: str = "doc_id") -> DataFrame:
    """Writes all texts as shards into folder; returns the manifest: shard, first_slot, n_sequences, bytes.

    Every text is followed by id 2; null and empty texts are that id alone. Only the last sequence of a group is padded.
    An empty table writes no shard. Null ids are an id like another; repeated rows are written each, those equal in id and
    text in one group, one after another. Columns besides the two named are not read. The driver gathers the number of
    sequences of each group, of which there are at most GROUPS at any size. Written again, a folder has the same shards.
    """
    spark = docs.sparkSession
    content = F.col(text).cast("string")
    slim = docs.select(F.col(doc_id).cast("string").alias("id"), content.alias("text"), *text_key(content))
    groups = min(GROUPS, max(1, docs.count() // GROUP))
    part = F.pmod(F.xxhash64(F.lit(key), "id", "key1"), F.lit(groups)).cast("int").alias("part")
    ordered = slim.select(part, "id", "key1", "key2", "text").repartitionById(groups, "part").sortWithinPartitions("part", "id", "key1", "key2").select("part", "text")
    with scratch(spark):
        table = written(ordered.mapInArrow(partial(sequences, path=path, length=length), "part long, ordinal long, n_tokens long, packed binary"), "sequences")
        starts = np.zeros(groups + 1, np.int64)
        for of, count in table.groupBy("part").count().collect():
            starts[of + 1] = count
        starts = np.cumsum(starts)
        n = int(starts[-1])
        slots = table.mapInArrow(partial(with_slots, starts=starts, n=n, key=key, per_shard=per_shard), "shard long, slot long, n_tokens long, packed binary")
        shards = max(1, -(-n // per_shard))
        each = -(-shards // TASKS)
        dealt = slots.repartitionById(-(-shards // each), F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("slot")
        with shuffles_dropped(spark):
            dealt.mapInArrow(partial(write_shards, folder=folder, per_shard=per_shard, length=length), MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest_of(spark, folder)


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest that stands beside the shards, in this session or a later one."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, length: int = LENGTH, from_slot: int = 0) -> DataFrame:
    """slot, shard, byte_offset, ids of all slots from from_slot on, from the files."""
    manifest = manifest_of(spark, folder).where(F.col("first_slot") + F.col("n_sequences") > from_slot)
    shards = manifest.count()
    each = max(1, -(-shards // TASKS))
    dealt = manifest.repartitionById(max(1, -(-shards // each)), F.floor(F.col("shard") / each).cast("int"))
    return dealt.mapInArrow(partial(read_shards, folder=folder, length=length, from_slot=from_slot), "slot long, shard long, byte_offset long, ids binary")


def query(docs: DataFrame) -> DataFrame:
    """Writes the shards into the shared folder and returns each slot as read back, with the CRC-32 of its bytes."""
    folder = new_folder(docs.sparkSession, "token-shards")
    materialise(docs, folder)
    return read(docs.sparkSession, folder).select("slot", "shard", "byte_offset", F.crc32("ids").alias("ids_crc32"), (F.length("ids") / 2).cast("long").alias("length"))


def checksum(ids: bytes) -> int:
    return zlib.crc32(ids)
