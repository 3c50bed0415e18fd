"""Concatenate and cut: all documents in a row, in windows of a fixed number of tokens.

Pass 1 encodes every document once and writes its ids, its place within its task and the task's number. Totals of tasks,
summed up, give each task's global offset. Pass 2 reads the ids, adds the offset and cuts where windows end; a document
that crosses a border gives a piece on either side. Nothing is shuffled, and all windows but the last are full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runline.llm.scratch import Scratch
from runline.llm.tokens import ids_of, text_batches

#: Ids in one row of the encoded table; longer documents take several rows.
ROW_IDS = 1 << 20


def encode(docs: DataFrame, id: str, text: str, end_id: int, vocabulary: str) -> DataFrame:
    """(part, place, id, start, doc_tokens, ids): `place` counts tokens of the task before the row, `start` those of the
    document. ids: little-endian unsigned 16-bit, with `end_id` after each document."""

    def run(batches):
        tokenizer, part, place = ids_of(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for own in text_batches(batch, "text"):
                ids, counts = tokenizer.batch(own.column(1))
                ends = np.cumsum(counts)
                with_end = np.insert(ids, ends, end_id).astype("<u2", copy=False)
                del ids
                counts, ends = counts + 1, ends + np.arange(1, len(counts) + 1)
                rows = np.repeat(np.arange(len(counts)), -(-counts // ROW_IDS))
                start = (np.arange(len(rows)) - np.searchsorted(rows, rows)) * ROW_IDS
                low = (ends - counts)[rows] + start
                high = np.minimum(low + ROW_IDS, ends[rows])
                blob = memoryview(with_end).cast("B")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), part, np.int32)),
                        pa.array(place + low),
                        own.column(0).take(pa.array(rows)),
                        pa.array(start),
                        pa.array(counts[rows]),
                        pa.array([bytes(blob[2 * a : 2 * b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["part", "place", "id", "start", "doc_tokens", "ids"],
                )
                place += len(with_end)

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"part int, place long, id {kind}, start long, doc_tokens long, ids binary")


def offsets(encoded: DataFrame) -> tuple[dict[int, int], int]:
    """Tokens before each task's first one, and of all tasks: a number per task goes to the driver, and back."""
    totals = encoded.select("part", (F.col("place") + F.length("ids") / 2).cast("long").alias("end")).groupBy("part").agg(F.max("end").alias("n")).orderBy("part").collect()
    out, before = {}, 0
    for row in totals:
        out[row.part], before = before, before + row.n
    return out, before


#: Rows of encoded texts that are cut at once.
ROWS_AT_ONCE = 1024


def cut(spark: SparkSession, encoded: DataFrame, before: dict[int, int], size: int, wide: bool = True, then=None, schema: str | None = None) -> DataFrame:
    """(id, start, length, doc_tokens, sequence_id, offset, ids) per piece; ids: little-endian, 32 or 16 bits each. `then` takes these
    batches on in the same task, and gives rows of `schema`."""
    sent = spark.sparkContext.broadcast(before)
    width = 4 if wide else 2

    def run(batches):
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            part, place, _, start, _, blobs = batch.columns
            first = place.to_numpy() + np.array([sent.value[p] for p in part.to_pylist()], dtype=np.int64)
            n = pc.binary_length(blobs).to_numpy(zero_copy_only=False).astype(np.int64) // 2
            pieces = (first + n - 1) // size - first // size + 1
            rows = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(rows)) - np.searchsorted(rows, rows)
            low = np.maximum((first[rows] // size + k) * size, first[rows])
            high = np.minimum((first[rows] // size + k + 1) * size, (first + n)[rows])
            out, a, b = [], (low - first[rows]).tolist(), (high - first[rows]).tolist()
            last, blob = -1, b""
            for i, row in enumerate(rows.tolist()):
                if row != last:
                    blob, last = blobs[row].as_py(), row
                    blob = np.frombuffer(blob, "<u2").astype("<u4").tobytes() if wide else blob
                out.append(blob[width * a[i] : width * b[i]])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2).take(take),
                    pa.array(start.to_numpy()[rows] + low - first[rows]),
                    pa.array(high - low),
                    batch.column(4).take(take),
                    pa.array(low // size),
                    pa.array(low % size),
                    pa.array(out, pa.binary()),
                ],
                names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    kind = encoded.schema["id"].dataType.simpleString()
    if then is not None:
        return encoded.mapInArrow(lambda batches: then(run(batches)), schema)
    return encoded.mapInArrow(run, f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack(
    spark: SparkSession,
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    size: int = 1024,
    end_id: int = 0,
    vocabulary: str = "byte_bpe_50k",
) -> DataFrame:
    """Pieces of documents in sequences of `size` tokens: `id`, `start` (ids of the document before the piece),
    `length`, `doc_tokens`, `sequence_id`, `offset` in the sequence, `ids` (little-endian unsigned 32-bit).

    A document is its ids and `end_id`; a null or empty text is `end_id` alone. Only the last sequence can be short.
    Repeated rows are packed each; an empty table gives no pieces; other columns are not read. A document of more than
    ROW_IDS ids may get a further cut at each ROW_IDS.
    """
    encoded = Scratch(spark, "packing").stored(encode(docs, id, text, end_id, vocabulary))
    before, _ = offsets(encoded)
    return cut(spark, encoded, before, size).withColumnRenamed("id", id)
