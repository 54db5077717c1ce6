"""Shared helpers: reading tables, shared folders, and per-row columns computed in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankline.llm.memory import releasing

#: Text bytes handed to a kernel at once; bounds a worker's memory whatever the batch size.
SLICE_BYTES = 4_000_000

#: The white space that separates words: space, \t, \n, \v, \f, \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch on its way to Python, where the session sets no bound of its own.
BATCH_BYTES = "8m"


def bound_batches(spark: SparkSession) -> None:
    """Batches are bounded by rows alone unless this is set, and texts can be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a new local one where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = getattr(spark.sparkContext, "_tankline_dir", None)
        if not named:
            named = spark.sparkContext._tankline_dir = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a table written to the shared folder, so that lost executors cost no recomputation."""
    path = fresh_path(df.sparkSession, label)
    bound_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(start row, texts) runs of about `most` bytes; null becomes the empty text."""
    begin, size, part = 0, 0, []
    for i, t in enumerate(texts):
        s = t.as_py() or ""
        part.append(s)
        size += len(s)
        if size >= most:
            yield begin, part
            begin, size, part = i + 1, 0, []
    if part:
        yield begin, part


def append_columns(
    df: DataFrame,
    kernel: Callable[[], Callable[..., list[pa.Array]]],
    fields: list[T.StructField],
    text: str = "text",
    also: str | None = None,
) -> DataFrame:
    """All columns of `df` and those that the kernel makes of its text column.

    `kernel` is called once in each task and returns the function that maps a list
    of texts (and one of the values of the column `also`, if named) to one array per field.  A column of `df` with the name of a new field
    is replaced.  No shuffle; memory is bounded by SLICE_BYTES.
    """
    bound_batches(df.sparkSession)
    names = {f.name for f in fields}
    base = df if not names & set(df.columns) else df.drop(*[c for c in df.columns if c in names])
    out = T.StructType(base.schema.fields + fields)
    at = base.columns.index(text)
    beside = None if also is None else base.columns.index(also)
    kinds = [_arrow_type(f.dataType) for f in fields]
    new_names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        for batch in batches:
            for begin, part in slices(batch.column(at)):
                cut = batch.slice(begin, len(part))
                found = work(part) if beside is None else work(part, cut.column(beside).to_pylist())
                made = [a if isinstance(a, pa.Array) else pa.array(a, k) for a, k in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(list(cut.columns) + made, names=list(cut.schema.names) + new_names)

    return base.mapInArrow(releasing(run), out)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
