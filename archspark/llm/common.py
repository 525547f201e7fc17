"""Shared plumbing of the training-data operators.

``annotate`` is the one way a Python worker sees documents: Arrow batches in, Arrow
batches out, no shuffle, rows never leave their partition. Columns of the input other
than the id, the text and those named in ``carry`` are not read at all, so extra columns
(also ones that bear the name of a result column) cannot clash.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: rows of an Arrow batch; with whole texts inside, Spark's own default would be too many
BATCH_ROWS = 512

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch of this session (lowers the setting, never raises it)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


#: what a Python worker remembers between tasks, by operator
_MEMORY: dict[str, dict] = {}


def memory(owner: str) -> dict:
    """What this worker remembers for an operator; what it remembers for any other is dropped.

    Workers are reused by later stages, so without this they would carry the memories of all operators.
    """
    for other in [k for k in _MEMORY if k != owner]:
        del _MEMORY[other]
    return _MEMORY.setdefault(owner, {})


def annotate(docs: DataFrame, make: Callable[[], Callable[[pa.Array], Sequence]], schema: str, *,
             id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``id, *carry, *new columns`` for every row of ``docs``.

    ``make()`` runs once in each task and returns a function from the batch's texts (an Arrow
    string array, nulls kept) to one sequence or Arrow array for each column of ``schema``.
    """
    small_batches(docs.sparkSession)
    keep = [id_col, *(c for c in carry if c != id_col)]
    new = T._parse_datatype_string(schema)
    names = [f.name for f in new.fields]
    if clash := set(names) & set(keep):
        raise ValueError(f"carried columns {sorted(clash)} bear names of result columns; rename them first")
    out = T.StructType([*(docs.schema[c] for c in keep), *new.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = list(to_arrow_schema(new).types)
    read = [F.col(c) for c in keep]
    if text_col not in keep or docs.schema[text_col].dataType != T.StringType():
        read.append(F.col(text_col).cast("string").alias("__text"))
    at = len(keep) if len(read) > len(keep) else keep.index(text_col)

    owner = make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory(owner)
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            found = work(batch.column(at))
            made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=k) for x, k in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, *names])

    return docs.select(*read).mapInArrow(run, out)
