"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as the words of the query contracts are split.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir. Only a local session, as in tests, may leave that unset: it gets a folder of
    our own, which executors on other machines would not see."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts have 8 MB or so, however long the texts are, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(8 << 20))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def hidden_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in taken:
        name += "_"
    return name


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def slices(batch: pa.RecordBatch, column: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """batch in parts whose texts (or binaries) in a column have about `size` bytes, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    values = batch.column(column)
    if not (pa.types.is_string(values.type) or pa.types.is_binary(values.type)):
        yield batch
        return
    part = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // size
    edges = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, after which a task's memory goes back to the system: Python workers live on for other tasks,
    and what their allocators keep would add up beside the JVM."""

    def outer(batches: Iterator) -> Iterator:
        yield from run(batches)
        import ctypes

        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return outer


def add_by_text(df: DataFrame, fn: Callable[[], Callable[[list], dict]], text: str, new: str, size: int = 8 << 20) -> DataFrame:
    """df with columns worked out from whole texts. fn is called once a task and gives a function from a list of
    texts (None for null) to the new columns, whose types the DDL string new holds; it gets texts of about `size` bytes
    at once. A new column takes the place of one of the same name."""
    added = T.StructType.fromDDL(new)
    names = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in names]
    schema = T.StructType([*kept, *added.fields])
    source = hidden_name(df, "text")
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        score = fn()
        for batch in (part for whole in batches for part in slices(whole, whole.num_columns - 1, size)):
            out = score(batch.column(batch.num_columns - 1).to_pylist())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(out[f.name], to_arrow_type(f.dataType)) for f in added]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias(source)).mapInArrow(lean(run), schema)


def fold(column: str, folds: int = 5):
    """crc32 of the id as text, modulo folds; null ids fall into fold -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def labelled_sample(labels: DataFrame, label: str, per_class: int, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, label) of at most per_class rows of each class outside the held-out fold: those whose ids have the
    smallest hashes. A document with several labels counts with the largest."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    parts = [
        known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)
    ]
    return parts[0].unionByName(parts[1])
