"""Folds over one key's rows in order, for rules whose state depends on the row before."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows of an Arrow batch that a fold gives.
AT_ONCE = 8192


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str | T.StructType) -> DataFrame:
    """(keys, schema) of what fn makes of each key's rows: it gets the other columns as tuples, in order, as an iterator, and
    yields tuples of the schema.

    Rows are shuffled by key and sorted within partitions, and flow through fn as they are read, from one Arrow batch to the
    next: what a key takes in memory is what fn keeps, so a key may have any number of rows. One key is one task's work, as the
    rule demands. Null keys are a key. fn need not read all rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = T.StructType([*[rows.schema[k] for k in keys], *kinds.fields])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        flow = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        made = ((*key, *row) for key, own in itertools.groupby(flow, lambda r: r[:n]) for row in fn(r[n:] for r in own))
        while block := list(itertools.islice(made, AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block, strict=True), arrow, strict=True)], schema=arrow)

    rest = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)
