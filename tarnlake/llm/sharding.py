"""Two-pass external shuffle into shards.

Pass one scatters the records over memory-sized buckets by a seeded hash of the whole record. Pass two gathers each
bucket, permutes it with Fisher-Yates and deals the permuted rows out: the global position of a row is its bucket's
offset plus its place there, and position modulo the number of shards is the shard, so that shard sizes differ by one
row at most and slots have no gaps.

The number of buckets follows the bytes of all columns, hence a bucket fits in memory at any scale, and the records
travel once. Equal texts, hot sources and hot keys do not meet in a bucket because the hash covers every column, maps by
their JSON form. Within a bucket rows are put in the order of that hash before they are permuted, and buckets that share a partition
are permuted in the order of their numbers: the same rows get the same places however they were partitioned before, and a task
that runs again gives what it gave.

Defined cases: null columns are hashed as nulls and kept; an empty or null text has size 1; columns of any type, maps
and structures included, travel along; rows equal in every column share a bucket but keep a slot each, and are the only
ties; an empty table gives no rows; columns whose names the operator adds (``shard``, ``slot``) are overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from .shared import sums_before

BUCKET_BYTES = 8 << 20
#: Up to this many buckets their offsets are broadcast (16 bytes each, 1 MB); beyond it they are joined by a shuffle.
BROADCAST_BUCKETS = 65_536


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or (isinstance(kind, ArrayType) and _has_map(kind.elementType))


def _bytes(column: Column, kind: DataType) -> Column:
    """About what a value takes in memory."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, ArrayType) and not isinstance(kind.elementType, (ArrayType, MapType, StructType, StringType, BinaryType)):
        return F.coalesce(F.size(column), F.lit(0)) * 8 + 16
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column.alias("v")))), F.lit(0)) + 16
    return F.lit(8)


def external_shuffle(spark: SparkSession, df: DataFrame, *, shards: int, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of ``df`` plus ``shard int`` and ``slot long``, in a seeded random order."""
    df = df.drop("shard", "slot")
    fields = [(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    width = F.lit(32).cast("long")
    for column, kind in fields:
        width = width + _bytes(column, kind)
    total = df.agg(F.sum(width)).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    mark = F.xxhash64(F.lit(seed), *[F.to_json(F.struct(c.alias("v"))) if _has_map(kind) else c for c, kind in fields])
    # pass one: scatter
    marked = df.select(F.struct(*[c for c, _ in fields]).alias("row"), mark.alias("mark"), F.pmod(mark, F.lit(n)).alias("bucket"))
    sizes = df.select(F.pmod(mark, F.lit(n)).alias("bucket")).groupBy("bucket").count()
    starts = sums_before(sizes, "bucket", "count").select("bucket", F.col("before").alias("first"))
    # pass two: gather a bucket, put it in the order of the marks, permute it, deal it out
    by_mark = lambda a, b: F.when(a["mark"] < b["mark"], -1).when(a["mark"] > b["mark"], 1).otherwise(0)
    gathered = marked.repartition(n, "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("mark", "row")), by_mark).alias("rows"))
    # draws depend on the seed, the partition's number and what was drawn there before, so buckets of a partition come in order
    permuted = gathered.sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    permuted = permuted.join(F.broadcast(starts) if n <= BROADCAST_BUCKETS else starts, "bucket")
    dealt = permuted.select("first", F.posexplode("rows").alias("place", "it"))
    at = F.col("first") + F.col("place")
    return dealt.select("it.row.*", F.pmod(at, F.lit(shards)).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order."""
    df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
