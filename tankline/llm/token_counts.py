"""Token counts of whole texts by a two-tier lookup on the map side (operator 5).

Tier one is a compact hash table of the token lengths of frequent pre-tokens (cut
at spaces, see :mod:`tankline.llm.chunks`), broadcast to all workers.  Which ones are
frequent comes from a first pass over all texts: each task counts its own pre-tokens in a bounded summary and gives
on one row, the packed summary of at most `FREQUENT` of them.  Summaries are merged by a tree of tasks, `FAN` at a time, so no pre-token
is ever shuffled and the driver gets one summary.  The table only saves work: tier two encodes
every miss with the tokenizer's library and remembers it in a bounded worker cache.  Both tiers compare whole pre-tokens.

Defined results: null counts as the empty text (0 bytes, 0 tokens); repeated rows
are independent; extra columns are kept by :func:`with_counts`, but for one named n_tokens, which is replaced.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankline.llm.common import append_columns, materialize, slices
from tankline.llm.memory import LONG
from tankline.llm.vocab import Encoder, Vocabulary, encoder
from tankline.llm.words import numbered

#: Pre-tokens in a summary and in the table, those that a task holds meanwhile, and summaries merged by one task.
FREQUENT, HELD, FAN = 65_536, 400_000, 64
SUMMARY = "task long, packed binary"


def pack(counts: dict[str, int]) -> bytes:
    """Pre-tokens (which hold no space) and their counts."""
    names = " ".join(counts).encode("utf-8", "surrogatepass")
    return len(counts).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(np.array(list(counts.values()), "<i8").tobytes() + names)


def unpack(raw: bytes) -> Counter:
    n = int.from_bytes(raw[:4], "little")
    body = zstandard.ZstdDecompressor().decompress(raw[4:])
    return Counter(dict(zip(body[8 * n :].decode("utf-8", "surrogatepass").split(" ") if n else (), np.frombuffer(body[: 8 * n], "<i8").tolist(), strict=True)))


class LengthTable:
    """Frequent pre-tokens and their lengths: their text and two bytes each where it moves, a hash table with whole keys where it is used."""

    def __init__(self, chunks: list[str], lengths: list[int]):
        self.names = " ".join(chunks).encode("utf-8", "surrogatepass")
        self.sizes = np.array(lengths, np.uint16)
        self.key = hashlib.sha256(self.names).hexdigest()

    def lengths(self) -> dict[str, int]:
        return dict(zip(self.names.decode("utf-8", "surrogatepass").split(" ") if len(self.sizes) else (), self.sizes.tolist(), strict=True))


def _most(counts: Counter) -> dict[str, int]:
    return dict(counts.most_common(FREQUENT)) if len(counts) > FREQUENT else counts


def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the task's foremost pre-tokens."""
    from pyspark import TaskContext

    counts: Counter = Counter()
    for batch in batches:
        for _, texts in slices(batch.column(0)):
            distinct, numbers, offsets = numbered(texts, lambda a: pc.split_pattern(a, " "))
            times = np.bincount(numbers, minlength=len(distinct)) - np.bincount(numbers[offsets[:-1]], minlength=len(distinct))
            counts.update({c: n for c, n in zip(distinct.to_pylist(), times.tolist(), strict=True) if n})
            floor = 1
            while len(counts) > HELD:
                counts = Counter({c: n for c, n in counts.items() if n > floor})
                floor += 1
    # one that a task meets once saves nothing; the empty one stands in white-space runs, which are not cut
    some = _most(Counter({c: n for c, n in counts.items() if n > 1 and 0 < len(c) <= LONG}))
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pack(some)], pa.binary())], names=["task", "packed"])


def merged(summaries: pa.Table) -> pa.Table:
    """One summary of several."""
    counts: Counter = Counter()
    for raw in summaries.column("packed"):
        counts.update(unpack(raw.as_py()))
    return pa.table([pa.array([summaries.column("task")[0].as_py()], pa.int64()), pa.array([pack(_most(counts))], pa.binary())], names=["task", "packed"])


def frequent_chunks(texts: DataFrame) -> list[str]:
    """The foremost pre-tokens of all texts, at most `FREQUENT`."""
    found = materialize(texts.mapInArrow(summarize, SUMMARY), "summaries")
    left = found.count()
    while left > FAN:
        left = -(-left // FAN)
        found = materialize(found.groupBy(F.pmod("task", F.lit(left)).alias("part")).applyInArrow(merged, SUMMARY).withColumn("task", F.pmod("task", F.lit(left))), "summaries")
    rows = found.orderBy("task").toArrow()  # at most FAN rows
    return sorted(unpack(merged(rows).column("packed")[0].as_py())) if rows.num_rows else []


def length_table(texts: DataFrame, vocabulary: Vocabulary) -> LengthTable:
    """The table for the frequent pre-tokens of `texts`."""
    chunks = [c for c in frequent_chunks(texts) if not any(x in c for x in vocabulary.specials) and not c[0].isspace()]
    pairs = [(c, n) for c, n in zip(chunks, Encoder(vocabulary, True).chunks(chunks), strict=True) if n < 65_536]
    return LengthTable([c for c, _ in pairs], [n for _, n in pairs])


def with_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns and n_tokens."""
    context = docs.sparkSession.sparkContext
    vocabulary = Vocabulary(path)
    shared = context.broadcast(vocabulary)
    table = context.broadcast(length_table(docs.select(F.col(text).cast("string").alias("text")), vocabulary)) if vocabulary.cut else None

    def kernel():
        work = encoder(shared, True, table)
        return lambda texts: [work(texts)]

    return append_columns(docs, kernel, [T.StructField("n_tokens", T.LongType())], text)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_counts(texts, path).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
