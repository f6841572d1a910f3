"""Helpers shared by the corpus operators.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``, which every executor and the driver can reach, so a
lost executor costs at most the recomputation of one stage. ``clean_up`` of
``tempora.sources.tables`` removes them once the results have been written.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.sources.tables import save

#: Fixed value: the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"

def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    return save(df, name)


def col(name: str) -> Column:
    """A column by its exact name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that stand for a row's id and text; equal rows share them, and no others (each part is null or tells its length)."""

    def part(value: Column) -> Column:
        return F.when(value.isNull(), "n").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.unhex(F.md5(F.concat(part(col(id_col).cast("string")), part(col(text_col)))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_held: dict = {}


def held(key, make):
    """The one large object (such as a tokenizer) that a worker keeps from task to task; another key takes its place."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def text_slices(batch, column: str = "text", limit: int = 1 << 20, holds: bool = False):
    """Cut an Arrow batch into slices of about ``limit`` bytes of text each, and give unused memory back behind it.

    Workers live longer than a stage: unless the operator ``holds`` the large
    object itself, a worker lets go of the one that an earlier stage left.
    """
    if not holds:
        _held.clear()
    sizes = batch.column(column).nbytes // max(1, batch.num_rows) + 1
    step = max(1, limit // sizes)
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)
    trim()


def trim() -> None:
    """Give memory that this process has freed back to the system: several of them share an executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass
