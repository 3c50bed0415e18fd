"""Token ids in training order: sequences of a fixed stride, read one after the other, from any slot on.

A keyed Feistel permutation with cycle-walking gives every sequence a slot in 0..N-1 without sorting or storing the
order. Slots are dealt by range to partitions, so each partition writes whole shards, in order: binary files that
hold nothing but their sequences, each of one stride, so a sequence lies at a byte that its slot gives. An index beside
them has what is known of each sequence.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runline.llm import packing
from runline.llm.scratch import Scratch, partitions
from runline.llm.words import mix

ROUNDS = 6


def slots(sequence: np.ndarray, n: int, key: int) -> np.ndarray:
    """The place of each of the sequences 0..n-1 in the order of `key`: a permutation of 0..n-1."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))
    out = sequence.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> bits, out[walking] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[walking] = (left << bits) | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def training_order(
    spark: SparkSession,
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    size: int = 1024,
    end_id: int = 0,
    vocabulary: str = "byte_bpe_50k",
    key: int = 20240613,
    shard_size: int = 256,
    partition_bytes: int = 32 << 20,
    then=None,
) -> DataFrame:
    """A row per sequence, in order of `slot` within and across partitions: `slot`, `sequence_id`, `shard`, `position`
    (byte in the shard), `n_tokens`, `ids_of_docs` (documents in the sequence, in order) and `payload`, always
    `size` little-endian unsigned 16-bit ids, padded by `end_id`.

    Sequences are those of packing. Null or empty texts are `end_id` alone; repeated rows count each; an empty table
    gives none; other columns are not read. Ids are longs, ints or strings; texts of any length are encoded whole, in rows of 2^20 ids.
    `then` takes a partition's batches on in the same task, and gives `stride` in place of `payload`.
    """
    encoded = Scratch(spark, "order").stored(packing.encode(docs, id, text, end_id, vocabulary))
    before, total = packing.offsets(encoded)
    n = -(-total // size)
    shards = -(-n // shard_size)
    parts = max(1, min(shards, max(-(-2 * size * n // partition_bytes), partitions(spark))))
    per_part = max(1, -(-shards // parts)) * shard_size  # whole shards in each partition

    kind = encoded.schema["id"].dataType.simpleString()
    kind_of = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def place(batches):
        """A row for all pieces of some batches that go to one partition; their ids are compressed together."""
        zstd = pa.Codec("zstd", compression_level=6)
        for batch in _gathered(batches, 12_000):
            slot = slots(batch.column(1).to_numpy(), n, key)
            order = np.argsort(slot // per_part, kind="stable")
            part = slot[order] // per_part
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(order) else np.zeros(1, np.int64)
            sorted_ = batch.take(pa.array(order))
            blobs = sorted_.column(3).to_pylist()
            lists = [pa.array(slot[order]), sorted_.column(1), sorted_.column(2), pa.array([len(x) for x in blobs], pa.int64()), sorted_.column(0)]
            packed = [zstd.compress(b"".join(blobs[i:j]), asbytes=True) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            bounds = pa.array(cuts.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), *[pa.ListArray.from_arrays(bounds, x) for x in lists], pa.array(packed, pa.binary())], ["part", "slot", "sequence_id", "offset", "size", "id", "ids"])

    placed = packing.cut(spark, encoded, before, size, False, place, f"part int, slot array<long>, sequence_id array<long>, offset array<long>, size array<long>, id array<{kind}>, ids binary")
    dealt = placed.repartitionById(parts, "part")
    names = ["slot", "sequence_id", "shard", "position", "n_tokens", "ids_of_docs", "payload"]
    pad = np.full(size, end_id, "<u2").tobytes()
    schema = pa.schema([(x, pa.int64()) for x in names[:5]] + [("ids_of_docs", pa.list_(kind_of)), ("payload", pa.binary())])

    def assemble(batches):
        """All pieces of a partition (about `partition_bytes`), put in order."""
        zstd, columns, blobs = pa.Codec("zstd"), [[] for _ in range(5)], []
        for batch in batches:
            for k, x in enumerate(columns):
                x.append(batch.column(k + 1).flatten())
            for sizes, packed in zip(batch.column(4), batch.column(6).to_pylist(), strict=True):
                lengths = sizes.values.to_numpy()
                data, ends = zstd.decompress(packed, int(lengths.sum()), asbytes=True), np.cumsum(lengths)
                blobs += [data[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
        if not blobs:
            return
        slot, sequence, offset, _, docs_in = (pa.chunked_array(x).combine_chunks() for x in columns)
        order = np.lexsort((offset.to_numpy(), slot.to_numpy()))
        slot, sequence, docs_in = slot.to_numpy()[order], sequence.to_numpy()[order], docs_in.take(pa.array(order))
        cuts = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1], [True])))
        for low in range(0, len(cuts) - 1, 2048):
            own = cuts[low : low + 2049]
            first = slot[own[:-1]]
            joined = [b"".join([blobs[i] for i in order[a:b]]) for a, b in zip(own[:-1], own[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), docs_in.slice(own[0], own[-1] - own[0]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(first), pa.array(sequence[own[:-1]]), pa.array(first // shard_size), pa.array(2 * size * (first % shard_size)),
                    pa.array(np.array([len(x) // 2 for x in joined], np.int64)), lists, pa.array([x + pad[len(x) :] for x in joined], pa.binary()),
                ],
                schema=schema,
            )

    kinds = f"slot long, sequence_id long, shard long, position long, n_tokens long, ids_of_docs array<{kind}>"
    if then is not None:
        return dealt.mapInArrow(lambda batches: then(assemble(batches)), f"{kinds}, stride long")
    return dealt.mapInArrow(assemble, f"{kinds}, payload binary")


def _gathered(batches, rows: int):
    """(id, sequence_id, offset, ids) of at least so many pieces at once."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch.select(["id", "sequence_id", "offset", "ids"]))
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, n = [], 0
    if n:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _file(shard: int) -> str:
    return f"shard-{shard:010d}.bin"


def _put(folder: str, name: str, data: bytes) -> None:
    """A file that is there whole or not at all: written under another name, then renamed. A repeated attempt writes the same."""
    system, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    system.create_dir(path, recursive=True)
    other = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(other) as out:
        out.write(data)
    system.move(other, f"{path}/{name}")


def _writer(path: str, shard_size: int, per_folder: int):
    """Writes the shards of a partition's batches, and gives their other columns and `stride`."""

    def run(batches):
        shard, parts = None, []

        def close():
            _put(f"{path}/shards/range={shard * shard_size // per_folder}", _file(shard), b"".join(parts))

        for batch in batches:
            kept = [c for c in batch.schema.names if c != "payload"]
            payloads = batch.column("payload").to_pylist()
            for number, payload in zip(batch.column("shard").to_pylist(), payloads, strict=True):
                if number != shard:
                    if parts:
                        close()
                    shard, parts = number, []
                parts.append(payload)
            stride = pa.array([len(x) for x in payloads], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], stride], [*kept, "stride"])
        if parts:
            close()

    return run


def _write_index(rows: DataFrame, path: str, shard_size: int, per_folder: int) -> None:
    rows.write.mode("errorifexists").parquet(f"{path}/index")
    index = rows.sparkSession.read.parquet(f"{path}/index")
    layout = index.agg(F.max("stride").alias("stride"), F.count("*").alias("n_slots"))
    layout.select("stride", "n_slots", F.lit(shard_size).cast("long").alias("shard_size"), F.lit(per_folder).cast("long").alias("per_folder")).write.parquet(f"{path}/layout")


def write_shards(ordered: DataFrame, path: str, shard_size: int = 256, per_folder: int = 1 << 16) -> None:
    """Files `path/shards/range=<first slot // per_folder>/shard-<number>.bin`: the payloads of a shard's slots, in order, and nothing
    else; a sequence lies at `position`. Beside them Parquet: `index`, the other columns, and `layout`, a row with the numbers
    that place a slot.

    ordered: rows of training_order with the same `shard_size`: whole shards in each partition, in order. Tasks write where
    pyarrow can (shared folders, HDFS, S3, GCS). Fails if `path` has an index already. No rows give no files.
    """
    kinds = ", ".join(f"`{c}` {ordered.schema[c].dataType.simpleString()}" for c in ordered.columns if c != "payload")
    _write_index(ordered.mapInArrow(_writer(path, shard_size, per_folder), f"{kinds}, stride long"), path, shard_size, per_folder)


def write_order(spark: SparkSession, docs: DataFrame, path: str, shard_size: int = 256, per_folder: int = 1 << 16, **how) -> None:
    """write_shards of training_order (`how`: its further arguments). The Python process that puts a partition in order writes it too: no
    second one per task, and no payload between them."""
    _write_index(training_order(spark, docs, shard_size=shard_size, then=_writer(path, shard_size, per_folder), **how), path, shard_size, per_folder)


def read_from(spark: SparkSession, path: str, slot: int = 0, shard: int | None = None) -> DataFrame:
    """(slot, shard, position, payload) of the sequences from `slot` on (resumed), or of one shard's, cut out of the binary files.
    Only folders that can hold them are read."""
    layout = spark.read.parquet(f"{path}/layout").first()
    schema = "slot long, shard long, position long, payload binary"
    if not layout.n_slots:
        return spark.createDataFrame([], schema)
    stride, size = layout.stride, layout.shard_size
    first = slot // size if shard is None else shard
    files = spark.read.format("binaryFile").load(f"{path}/shards").where(F.col("range") >= first * size // layout.per_folder)
    if shard is not None:
        files = files.where(F.col("range") == shard * size // layout.per_folder)
    number = re.compile(r"shard-([0-9]+)\.bin$")

    def cut(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, n = int(number.search(name)[1]), len(data) // stride
                at = np.arange(n)
                payload = pa.array([data[k * stride : (k + 1) * stride] for k in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(own * size + at), pa.array(np.full(n, own)), pa.array(at * stride), payload], ["slot", "shard", "position", "payload"])

    rows = files.select("path", "content").mapInArrow(cut, schema).where(F.col("slot") >= slot)
    return rows if shard is None else rows.where(F.col("shard") == shard)
