"""Places that the driver and every executor can read."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.storage import WRITTEN, new_folder, remove, shared_folder, stored

__all__ = ["new_folder", "remove", "scratch", "written"]


#: What a worker keeps from task to task, by operator.
HELD: dict[str, dict] = {}


def released(run: Callable, keep: str = "") -> Callable:
    """A batch function that gives its memory back when it ends: Python workers are used again and idle ones keep what they hold.

    What other operators than ``keep`` have left in the worker goes when it begins.
    """

    def wrapped(batches: Iterator) -> Iterator:
        let_go(keep)  # of this module, as the function itself travels by value
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def let_go(keep: str = "") -> None:
    if left := [k for k in HELD if k != keep and HELD[k]]:
        for k in left:
            HELD[k].clear()
        give_back()


def give_back() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Folders written inside go at the end, but for those that the caller takes out of the list given."""
    before = set(WRITTEN)
    spared: list[str] = []
    try:
        yield spared
    finally:
        remove(spark, [p for p in WRITTEN if p not in before and p not in spared])


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again: cuts lineage, keeps column pruning."""
    return stored(spark, df, name)


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sums_before(totals: DataFrame, key: str, value: str, *, by: str | None = None, span: int = 4096) -> DataFrame:
    """``totals`` (one row per whole-number ``key``, or per ``by`` and ``key``) with ``before``: the sum of ``value`` over all smaller keys.

    Sums of ``span`` keys are added up first, so that no task sorts more than ``span`` rows or a row per ``span`` keys.
    """
    group = [by] if by else []
    cells = totals.withColumn("__cell", F.floor(F.col(key) / span))
    over = cells.groupBy(*group, "__cell").agg(F.sum(value).alias("__all"))
    over = over.select(*group, "__cell", (F.sum("__all").over(Window.partitionBy(*group).orderBy("__cell")) - F.col("__all")).alias("__earlier"))
    inside = F.sum(value).over(Window.partitionBy(*group, "__cell").orderBy(key)) - F.col(value)
    return cells.withColumn("before", inside).join(over, [*group, "__cell"]).withColumn("before", F.col("before") + F.col("__earlier")).drop("__cell", "__earlier")


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small table."""
    shared_folder(spark)
    return df.checkpoint()


#: A key is hot if it holds more than this share of the rows; so at most 200 keys are.
HOT_SHARE = 200


#: Bytes of hot rows that are broadcast at most; more are joined with salted keys instead.
HOT_BYTES = 8 << 20
SALTS = 64


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], count: str, rows: int, how: str = "left", width: Column | None = None) -> DataFrame:
    """Join ``big`` to ``small`` (one row per key; ``count`` holds the key's rows in ``big``) without meeting hot keys in one task.

    Keys with more than one 200th of the ``rows`` are at most 200 rows of ``small`` and are broadcast; the others shuffle.
    Where rows of ``small`` have no fixed size, ``width`` gives their bytes: hot rows of more than ``HOT_BYTES`` together are
    copied under ``SALTS`` salts instead and meet a part of the hot rows of ``big`` each.
    ``how`` is ``inner`` or ``left``; null keys match nothing. Neither side may have columns that begin with ``__hot``.
    """
    extra = [c for c in small.columns if c not in keys and c != count]
    is_hot = F.col(count) * HOT_SHARE > rows
    hot = small.filter(is_hot).select(*keys, F.struct(*extra).alias("__hot"))
    cold = small.filter(~is_hot).select(*keys, *extra)
    if width is not None and (small.filter(is_hot).agg(F.sum(width)).first()[0] or 0) > HOT_BYTES:
        marked = big.join(F.broadcast(hot.select(*keys, F.lit(True).alias("__hot"))), keys, "left")
        salted = marked.filter("__hot").withColumn("__hotsalt", F.floor(F.rand(7) * SALTS).cast("int"))
        copies = hot.withColumn("__hotsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        one = salted.drop("__hot").join(copies, [*keys, "__hotsalt"]).select(*big.columns, "__hot.*")
    else:
        marked = big.join(F.broadcast(hot), keys, "left")
        one = marked.filter("__hot IS NOT NULL").select(*big.columns, "__hot.*")
    two = marked.filter("__hot IS NULL").drop("__hot").join(cold, keys, how).select(*big.columns, *extra)
    return one.unionByName(two)


def crc32_sql(text: str) -> str:
    """DuckDB expression for the CRC-32 of an ASCII string, which DuckDB has no function for."""
    bit = "lambda x, _: xor(x >> 1, 3988292384 * (x & 1))"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]), {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), {byte}), 4294967295)"
