"""Token-id files with one shared zstandard dictionary (operator 2).

The dictionary is trained on the serialized ids of a bounded sample of documents
(those whose hashed ids come first); it changes the size of the files, never what is read
back.  Every document is compressed alone with it.  A shard holds documents in
ascending doc_id order, the documents of a lower shard come before those of a higher one:

    magic | frames, one a document | index | index length, magic

The index keeps the dictionary's SHA-256 and, for each document, id, offset, size and
token count, so that one short document costs two small reads and one decompression.
Documents without doc_id come first; the index tells how many they are.

Encoding happens before the exchange, which therefore moves compressed ids only.  A
task writes its shard under a name of its own attempt and reports it; only reported
shards are read, so lost or repeated attempts do no harm.

Defined results: a null text is the empty one and holds the end id alone; null doc_ids come first and stay null;
equal doc_ids are ordered by their frames; an empty table gives no shard and no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tankline.llm.common import fresh_path, slices
from tankline.llm.files import open_store
from tankline.llm.vocab import Vocabulary, encoder

MAGIC = b"TKIDS1\n\x00"
#: Sample for the dictionary: documents, ids of each, and the dictionary's size in bytes.
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES = 256, 4096, 65_536
LEVEL = 3


def sample_documents(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """At most `most` documents: those whose hashed ids are smallest.  Ids are chosen before texts are read."""
    chosen = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toArrow().column(0).to_pylist()
    return docs.where(F.col("doc_id").isin(chosen)).limit(most)


def train_dictionary(docs: DataFrame, shared) -> bytes:
    """The shared dictionary, or b'' where there is too little to learn from."""

    def ids(batches):
        work = encoder(shared, False)
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([x[: 4 * SAMPLE_IDS] for x in work(texts)], pa.binary())], names=["ids"])

    samples = [x for x in sample_documents(docs).select("text").mapInArrow(ids, "ids binary").toArrow().column(0).to_pylist() if x]
    try:
        return zstandard.train_dictionary(DICT_BYTES, sorted(samples)).as_bytes()
    except zstandard.ZstdError:
        return b""


def compressed(docs: DataFrame, shared, dictionary, end_id: int, borders: list[int]) -> DataFrame:
    """doc_id, n_tokens, frame, shard: each document's ids and the end id, compressed alone; ids above a border are in a later shard."""
    edges = np.array(borders, np.int64)

    def run(batches):
        work = encoder(shared, False)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary.value) if dictionary.value else None)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for begin, texts in slices(batch.column(1)):
                ids = [x + tail for x in work(texts)]
                named = batch.column(0).slice(begin, len(texts))
                shard = np.searchsorted(edges, np.asarray(named.fill_null(np.iinfo(np.int64).min))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [named, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(pack.compress, ids), pa.binary()), pa.array(shard)],
                    names=["doc_id", "n_tokens", "frame", "shard"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, frame binary, shard int")


def write(docs: DataFrame, tokenizer: str, end_id: int, out: str, shards: int | None = None) -> DataFrame:
    """Write shards under `out` and return its manifest: shard, path, n_docs, n_tokens, dictionary."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(Vocabulary(tokenizer))
    trained = train_dictionary(docs, shared)
    dictionary = spark.sparkContext.broadcast(trained)
    digest = hashlib.sha256(trained).hexdigest()
    store, root = open_store(out)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/dictionary-{digest}") as f:
        f.write(trained)
    # shard borders from the ids alone; they only balance the shards
    cuts = docs.select(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 10_000).alias("q")).first()[0] if shards > 1 else None
    borders = sorted(set(cuts or []))
    rows = compressed(docs, shared, dictionary, end_id, [int(b) for b in borders])
    n = len(borders) + 1

    def save(batches):
        from pyspark import TaskContext

        store, root = open_store(out)
        name = number = None
        for batch in batches:
            if batch.num_rows and name is None:
                number = batch.column(3)[0].as_py()
                name = f"{root}/shard-{number:06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
                f = store.open_output_stream(name)
                f.write(MAGIC)
                at, ids, offsets, sizes, counts, nameless = len(MAGIC), [], [], [], [], 0
            for frame in batch.column(2):
                raw = frame.as_buffer()
                offsets.append(at)
                sizes.append(raw.size)
                at += raw.size
                f.write(raw)
            if batch.num_rows:
                ids.append(np.array(batch.column(0).fill_null(0)))
                nameless += batch.column(0).null_count
                counts.append(np.array(batch.column(1)))
        if name is None:
            return
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        head = json.dumps({"dictionary": digest, "docs": len(ids), "nameless": nameless, "ids": "little-endian unsigned 32-bit"}).encode()
        index = struct.pack("<I", len(head)) + head + b"".join(np.asarray(x, "<i8").tobytes() for x in (ids, offsets, sizes, counts))
        f.write(index)
        f.write(struct.pack("<Q", len(index)) + MAGIC)
        f.close()
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([number], pa.int32()), "path": [f"{out}/{name.rsplit('/', 1)[1]}"], "n_docs": [len(ids)], "n_tokens": [int(counts.sum())], "dictionary": [digest]}
        )

    kind = "shard int, path string, n_docs long, n_tokens long, dictionary string"
    rows.repartitionById(n, F.col("shard")).sortWithinPartitions("doc_id", "frame").mapInArrow(save, kind).write.parquet(f"{out}/manifest")
    return spark.read.schema(kind).parquet(f"{out}/manifest")


def read_index(store, name: str) -> tuple[dict, np.ndarray]:
    """A shard's header and its index: rows id, offset, size, n_tokens."""
    with store.open_input_file(name) as f:
        f.seek(f.size() - 8 - len(MAGIC))
        (size,) = struct.unpack("<Q", f.read(8))
        if f.read() != MAGIC:
            raise ValueError(f"{name} is no token file")
        f.seek(f.size() - 8 - len(MAGIC) - size)
        raw = f.read(size)
    (head,) = struct.unpack("<I", raw[:4])
    info = json.loads(raw[4 : 4 + head])
    return info, np.frombuffer(raw[4 + head :], "<i8").reshape(4, info["docs"])


def read_document(out: str, path: str, doc_id: int) -> np.ndarray | None:
    """Ids of one document of a shard, by its index alone."""
    store, name = open_store(path)
    info, index = read_index(store, name)
    k = info["nameless"] + int(np.searchsorted(index[0][info["nameless"] :], doc_id))
    if k >= len(index[0]) or index[0][k] != doc_id:
        return None
    folder, root = open_store(out)
    with folder.open_input_file(f"{root}/dictionary-{info['dictionary']}") as f:
        trained = f.read()
    with store.open_input_file(name) as f:
        f.seek(int(index[1][k]))
        frame = f.read(int(index[2][k]))
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    return np.frombuffer(unpack.decompress(frame), "<u4")


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document, shard by shard."""
    kind = "shard int, path string, n_docs long, n_tokens long, dictionary string"
    manifest = spark.read.schema(kind).parquet(f"{out}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = max(1, manifest.count())

    def load(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                store, name = open_store(shard["path"])
                folder, root = open_store(out)
                with folder.open_input_file(f"{root}/dictionary-{shard['dictionary']}") as f:
                    trained = f.read()
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
                info, (ids, offsets, sizes, counts) = read_index(store, name)
                if info["dictionary"] != shard["dictionary"]:
                    raise ValueError(f"{name} was written with another dictionary")
                starts = shard["base"] + np.cumsum(counts) - counts
                with store.open_input_stream(name) as f:
                    f.read(len(MAGIC))
                    lo = 0
                    while lo < len(ids):
                        hi = lo + 1
                        held = int(counts[lo])
                        while hi < len(ids) and (held := held + int(counts[hi])) < 1_000_000:
                            hi += 1
                        docs = [unpack.decompress(f.read(int(s))) for s in sizes[lo:hi]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[lo:hi], mask=np.arange(lo, hi) < info["nameless"]), pa.array(starts[lo:hi]), pa.array(counts[lo:hi]), pa.array(docs, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"]
                        )
                        lo = hi

    return placed.repartitionById(n, F.col("shard")).mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents, read the files back: doc_id, start, n_tokens, ids_crc32."""
    out = fresh_path(docs.sparkSession, "token-files")
    write(docs, tokenizer, end_id, out)
    return read(docs.sparkSession, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
