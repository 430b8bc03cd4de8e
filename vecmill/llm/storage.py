"""Intermediate tables of the training-data operators.

Lineage is cut by writing a table into the folder that the cluster names in
``spark.checkpoint.dir``: it is shared by driver and executors, so a lost
executor costs a re-read and not a recomputation.  Only with a local master, and
where that setting is absent (tests, notebooks), a folder of this process is used.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import delete_at_end, delete_now, shared_folder

#: The tables that open ``discarding`` blocks have written, innermost last.
_WRITTEN: list[dict[str, SparkSession]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return a scan of it.

    The table is deleted with the block of ``discarding`` that wrote it, else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vecmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(spark, path)
    if _WRITTEN:
        _WRITTEN[-1][path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table._vecmill_path = path
    return table


@contextlib.contextmanager
def discarding() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that are written within the block at its end, but for those given to the function it yields."""
    own: dict[str, SparkSession] = {}
    _WRITTEN.append(own)

    def keep(table: DataFrame) -> DataFrame:
        spark = own.pop(table._vecmill_path, None)
        if spark is not None and len(_WRITTEN) > 1:
            _WRITTEN[-2][table._vecmill_path] = spark
        return table

    try:
        yield keep
    finally:
        _WRITTEN.pop()
        for path, spark in own.items():
            delete_now(spark, path)


def tidy(run):
    """A function for ``mapInArrow`` that gives freed memory back to the system when its task ends.

    Python workers live on between tasks; what their allocators keep would count beside the next task's own.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Give freed memory back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do without
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Rows of an Arrow batch while tables are written: wide rows need small batches to fit a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sized_broadcast(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """``df``, written out, with a broadcast hint if it has at most ``rows`` narrow rows; else it joins by a shuffle."""
    df = materialize(df, "side")
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bitset(ids: DataFrame, column: str, most_log2_bits: int = 26, hashed: bool = False) -> "Bitset":
    """A one-hash Bloom filter of a long column of a table that has been written.

    It has some sixteen bits for each row, but ``2 ** most_log2_bits`` at most.  It is made by a
    grouped ``bit_or``; what reaches the driver are a word of 16 bytes for each 64 bits (16 MB for
    ``2 ** 26`` bits), whatever the number of ids.  A full filter lets more rows through and never
    drops one.  ``hashed``: the values are evenly distributed hashes, of which the low bits serve.
    """
    log2_bits = min(most_log2_bits, max(16, (16 * ids.count()).bit_length()))
    words = (
        ids.where(F.col(column).isNotNull())
        .select(_slot(F.col(column), log2_bits, hashed).alias("s"))
        .groupBy(F.shiftright("s", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b"))
        .toArrow()
    )
    return Bitset(words["w"].to_numpy(), words["b"].to_numpy(), log2_bits, hashed)


def _slot(x, log2_bits: int, hashed: bool):
    return x.bitwiseAND(F.lit((1 << log2_bits) - 1)) if hashed else F.shiftrightunsigned(F.xxhash64(x.cast("long")), 64 - log2_bits)


class Bitset:
    """Membership test over numpy longs: hashes, or slots that the JVM made of other ids (see ``slot``)."""

    def __init__(self, at, words, log2_bits: int, hashed: bool):
        import numpy as np

        self.table = np.zeros(1 << (log2_bits - 6), dtype=np.int64)
        self.table[at] = words
        self.log2_bits, self.hashed = log2_bits, hashed

    def slot(self, column):
        """The column that ``contains`` tests for ids that are no hashes; add it to the rows before they go to Python."""
        return _slot(column, self.log2_bits, self.hashed)

    def contains(self, slots):
        slots = slots & ((1 << self.log2_bits) - 1)
        return (self.table[slots >> 6] >> (slots & 63)) & 1 == 1
