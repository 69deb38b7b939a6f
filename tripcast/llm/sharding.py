"""Two-pass external shuffle into shards, in DataFrame operations only.

Pass one scatters the records by seeded hashes into buckets that fit in memory
(the exchange writes them to disk). Pass two takes one bucket at a time into
memory, shuffles it (Spark's ``shuffle`` is a Fisher-Yates shuffle) and writes
it; the rows come sorted by bucket and are gathered by a sort aggregate, since a hash
aggregate would hold many buckets. Prefix sums of the bucket counts give every record its place in the whole,
and the shards are equal runs of that order: the law is ``rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripcast.durable import stored
from tripcast.llm.arrow import fresh

SHARDS = 8
BUCKET_BYTES = 4 << 20
TASK_BYTES = 64 << 20  # of records, per task of pass two
HOT_SHARE = 4          # an id with more than this part of a bucket is scattered row by row
HOT_IDS = 1_000_000    # bound of the ids broadcast for that
HASH_AGGREGATE = "spark.sql.execution.useObjectHashAggregateExec"
STRIDE = 1_000         # buckets summed together in the first of two prefix sums


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _scattered(
    df: DataFrame, id_column: str, text_column: str, seed: int, buckets: int, total: int, bucket_bytes: int, name: str,
) -> DataFrame:
    """``df`` with its bucket. A record's bucket hangs on its id; only of ids whose
    rows are large together each row goes its own way. There are at most HOT_IDS of those."""
    key, salt = fresh(df, "hot_id", "salt")
    least = max(bucket_bytes // HOT_SHARE, total // HOT_IDS)
    many = (F.count("*") > 1) & (F.sum(record_size(F.col(text_column))) > least)
    hot = stored(df.groupBy(F.col(id_column).alias(key)).agg(many.alias(salt)).filter(salt)
                 .select(key, F.lit(1).alias(salt)), "hot")
    if hot.isEmpty():
        each = df.withColumn(salt, F.lit(0).cast("long"))
    else:
        each = df.join(F.broadcast(hot), df[id_column].eqNullSafe(hot[key]), "left").drop(key)
        each = each.withColumn(salt, F.when(F.col(salt).isNotNull(), F.monotonically_increasing_id()).otherwise(0))
    return each.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), id_column, salt), F.lit(buckets))).drop(salt)


def _offsets(counts: DataFrame, bucket: str, n: str, name: str) -> DataFrame:
    """Rows before each bucket, summed in two levels so that no task sorts all buckets."""
    stride = (F.col(bucket) / STRIDE).cast("long")
    some = counts.withColumn("_stride", stride)
    within = F.sum(n).over(W.partitionBy("_stride").orderBy(bucket)) - F.col(n)
    strides = some.groupBy("_stride").agg(F.sum(n).alias("_total"))
    before = strides.select("_stride", (F.sum("_total").over(W.orderBy("_stride")) - F.col("_total")).alias("_before"))
    return some.withColumn(name, within).join(before, "_stride").select(
        bucket, (F.col(name) + F.col("_before")).alias(name))


def shuffle_into_shards(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = SHARDS,
    seed: int = 17, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All rows and columns of ``df``, shuffled, with ``shard`` (from 0) and
    ``slot`` (gapless from 0 in each shard); columns of these names in ``df``
    are replaced. Shard counts differ by at most one. A task holds one bucket of about
    ``bucket_bytes``, or one larger record.

    The order is fixed by the seed, the ids and the layout of the input. Null
    ids and repeated rows are records like any other, a null text is one of
    size 1, and an empty table gives none. The result is read from storage.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("shard", "slot")])
    bucket, place, row, size, n, start = fresh(df, "bucket", "place", "row", "size", "n", "start")
    total, rows = df.agg(F.sum(record_size(F.col(text_column))), F.count("*")).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    scattered = _scattered(df, id_column, text_column, seed, buckets, total or 0, bucket_bytes, bucket)
    conf = df.sparkSession.conf
    tasks = max(int(conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // TASK_BYTES))
    passed = (
        scattered.repartition(tasks, bucket)
        .sortWithinPartitions(bucket, F.xxhash64(F.lit(seed + 1), id_column))
        .groupBy(bucket).agg(F.collect_list(F.struct(*df.columns)).alias(row))
        .select(bucket, F.posexplode(F.shuffle(row, F.lit(seed))).alias(place, row))
        .select(bucket, place, f"{row}.*"))
    before = conf.get(HASH_AGGREGATE)
    try:
        conf.set(HASH_AGGREGATE, "false")
        written = stored(passed, "shuffled")
    finally:
        conf.set(HASH_AGGREGATE, before)
    counts = stored(written.groupBy(bucket).agg(F.count("*").alias(n)), "counts")
    offsets = _offsets(counts, bucket, n, start)
    base, larger = divmod(rows, shards)
    at = F.col(start) + F.col(place)
    edge = larger * (base + 1)
    shard = F.when(at < edge, F.floor(at / (base + 1))).otherwise(larger + F.floor((at - edge) / max(base, 1)))
    first = F.when(F.col("shard") < larger, F.col("shard") * (base + 1)).otherwise(
        edge + (F.col("shard") - larger) * base)
    return (
        written.join(offsets, bucket).withColumn("shard", shard.cast("int"))
        .withColumn("slot", (at - first).cast("long")).select(*df.columns, "shard", "slot"))


def write_shards(df: DataFrame, folder: str, **options) -> None:
    """The shuffled rows as Parquet, one subfolder a shard, in slot order per file."""
    shuffle_into_shards(df, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
