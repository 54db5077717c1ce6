"""Packing of tokenized documents into training sequences by harmonic classes (operator 11).

A piece of length n lies in the reciprocal class k = capacity // n: k pieces of the class fill a sequence.  Every class
fills its sequences with exactly k pieces, whichever they are, so that nothing has to be searched and workers need not
talk to each other.  A document gives whole sequences first.  What is left of it stays in one piece where k pieces of
its length waste at most `capacity / WASTE` tokens, or where it is short; else a head of exactly capacity // (k + 1)
tokens, which fills its class without waste, is cut off, and the rest is looked at again (some two or three pieces).

Three levels, each over what the one before left open:

1. a task fills sequences of all classes by itself, on its way through the documents: no exchange;
2. its leftovers, fewer than k pieces a class, are numbered across tasks by their class (from a small table of counts a
   task and class) and filled in the same way; the exchange goes by class and sequence, a group has at most k rows;
3. what is open then, fewer than k pieces a class for the whole corpus and so some ten thousand rows at most whatever
   the input, is packed by best fit in decreasing order in one task.

Pieces are written to the shared folder once, after level 1, so that later levels and lost executors see the same ones.

Defined results: a null text is the empty one (its end id alone); a null doc_id stays null and each row is a document of
its own, repeated or not; columns other than doc_id and text are ignored, whatever their names; an empty table gives no rows.
A text is encoded whole, however long, and given on in batches of a few MB.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tankline.llm.common import bound_batches, materialize, slices
from tankline.llm.memory import releasing
from tankline.llm.vocab import Vocabulary, encoder

CAPACITY = 2048
#: A piece stays whole if a full sequence of its like wastes at most 1/WASTE of it, or if it has at most capacity/SHORT tokens.
WASTE, SHORT = 64, 32
#: Bytes of ids given on at once.
BATCH = 4_000_000
#: Sequence numbers of levels 2 and 3 begin here; those of level 1 are partition * 2**32 + count.
POOLED, LAST = 1 << 61, 1 << 62

PIECE = "doc_id {0}, start long, length long, doc_tokens long, ids binary, class int, sequence_id long, offset long, part int, local int"


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    left = n % capacity
    while left:
        k = capacity // left
        if capacity - k * left <= capacity // WASTE or left <= capacity // SHORT:
            out.append(left)
            break
        out.append(capacity // (k + 1))
        left -= out[-1]
    return out


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, best fit in the given order."""
    free: list[tuple[int, int]] = []  # room left and bin, sorted
    bins, offsets, n = [], [], 0
    for size in lengths:
        k = bisect_left(free, (size, -1))
        if k < len(free):
            room, number = free.pop(k)
        else:
            room, number, n = capacity, n, n + 1
        bins.append(number)
        offsets.append(capacity - room)
        insort(free, (room - size, number))
    return bins, offsets


class _Rows:
    """Rows of pieces on their way out."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.rows, self.size = kind, [], 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += 100 + len(row[4])

    def batch(self) -> pa.RecordBatch:
        kinds = [self.kind, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        names = ["doc_id", "start", "length", "doc_tokens", "ids", "class", "sequence_id", "offset", "part", "local"]
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in names]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def filled(docs: DataFrame, shared, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Level 1: all pieces; those of sequences that their task could not fill have no sequence_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        work, tail, number = encoder(shared, False), np.array([end_id], "<u4").tobytes(), part << 32
        waiting: dict[int, list[tuple]] = {}
        out = None
        for batch in batches:
            out = out or _Rows(batch.schema.field(0).type)
            for begin, texts in slices(batch.column(1)):
                for doc_id, ids in zip(batch.column(0).slice(begin, len(texts)).to_pylist(), work(texts), strict=True):
                    ids += tail
                    total, start = len(ids) // 4, 0
                    for n in cut(total, capacity):
                        k = capacity // n
                        own = waiting.setdefault(k, [])
                        own.append((doc_id, start, n, total, ids[4 * start : 4 * (start + n)]))
                        start += n
                        if len(own) == k:
                            at = 0
                            for row in waiting.pop(k):
                                out.add((*row, k, number, at, part, None))
                                at += row[2]
                            number += 1
                            if out.size >= BATCH:
                                yield out.batch()
        if out is not None:
            for k, own in waiting.items():
                for i, row in enumerate(own):
                    out.add((*row, k, None, None, part, i))
            yield out.batch()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    bound_batches(docs.sparkSession)
    return rows.mapInArrow(releasing(run), PIECE.format(rows.schema["doc_id"].dataType.simpleString()))


def pooled(open_pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Level 2: pieces in sequences of k from several tasks, and the fewer than k of each class that stay open."""
    counts = open_pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
    by = Window.partitionBy("class")
    base = counts.select(
        "class", "part", F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(by).alias("total")
    )
    ranked = open_pieces.join(base, ["class", "part"]).withColumn("rank", F.col("base") + F.col("local")).withColumn("bin", F.expr("rank div class"))
    full = (F.col("bin") + 1) * F.col("class") <= F.col("total")
    before = Window.partitionBy("class", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.where(full).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.withColumn("sequence_id", F.lit(POOLED) + F.col("class").cast("long") * F.lit(1 << 45) + F.col("bin")), ranked.where(~full)


def last(rest: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Level 3: the bounded rest, by best fit in decreasing order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        rows = rows.sort_by([("length", "descending"), ("part", "ascending"), ("class", "ascending"), ("local", "ascending")])
        bins, offsets = best_fit(rows.column("length").to_pylist(), capacity)
        rows = rows.drop_columns(["sequence_id", "offset"]).append_column("sequence_id", pa.array([LAST + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        yield from rows.combine_chunks().to_batches()

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema if f.name not in ("sequence_id", "offset"))
    return rest.repartition(1).mapInArrow(run, kind + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids, sequence_id, offset of every piece of every document.

    `ids` are little-endian unsigned 32-bit.  A sequence's pieces lie one after the other from offset 0."""
    columns = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer))
    pieces = materialize(filled(docs, shared, end_id, capacity), "pieces")
    several, rest = pooled(pieces.where("sequence_id is null").drop("sequence_id", "offset"))
    rest = rest.select("doc_id", "start", "length", "doc_tokens", "ids", "class", "part", "local", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    return pieces.where("sequence_id is not null").select(*columns).unionByName(several.select(*columns)).unionByName(last(rest, capacity).select(*columns))


def sequences(packed: DataFrame, pad_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, n_tokens, ids: each sequence's ids, padded to the capacity unless it ends at a power of two."""
    whole = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))), lambda x: x["ids"]))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.unhex(whole).alias("ids"))
    pad = F.lit(int(pad_id).to_bytes(4, "little").hex())
    room = F.when(F.expr("bit_count(n_tokens) = 1"), F.lit(0)).otherwise(F.lit(capacity) - F.col("n_tokens"))
    return rows.withColumn("ids", F.unhex(F.concat(F.hex("ids"), F.repeat(pad, room.cast("int")))))


def digests(packed: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
