"""Global ranks without a global window, and quantile mapping built on them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripcast.durable import stored
from tripcast.joins import join_same, small, tasks_for
from tripcast.sources.trips import COORDINATES

_ROW_BITS = 33   # monotonically_increasing_id: partition in the high bits, row in the low 33


def global_rank(df: DataFrame, by: Sequence[str], name: str = "rank") -> DataFrame:
    """Rank every row from 0 in the order of ``by``, which must end in a unique
    id: equal values are then cut by id, so a value held by a third of the rows
    still spreads over many tasks.

    The rows are range-partitioned and sorted; a row's rank is its place in its
    partition plus the sizes of the partitions before. The ranged rows are
    stored in the shared folder, since two passes must see the same partitions
    even after a lost executor.
    """
    ranged = (
        df.repartitionByRange(tasks_for(df.sparkSession, df.count()), *by).sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    fixed = stored(ranged, "ranged")
    part = F.shiftright("_at", _ROW_BITS)
    sizes = fixed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    joined = fixed.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row per task
    return joined.withColumn(name, F.col("_start") + place).drop("_at", "_part", "_start")


def group_positions(
    df: DataFrame, groups: Sequence[str], by: Sequence[str], weight: str | None = None,
    name: str = "position", total: str = "total",
) -> DataFrame:
    """Rows with their place in their group in the order of ``by``, from 0, and the
    group's size. With ``weight``, a column of whole numbers, a row counts that often:
    its place is the weight before it. ``by`` must tell the rows of a group apart.

    All groups are cut by one range partition over group and order, so one ordering
    serves every group and a group of any size spreads over tasks; places are those in
    the partition plus the weight of the group in the partitions before. The ranged
    rows are stored. A null group is a group.
    """
    groups = list(groups)
    tasks = tasks_for(df.sparkSession, df.count())
    ordered = df.repartitionByRange(tasks, *groups, *by).sortWithinPartitions(*groups, *by)
    if weight is None:
        place = F.monotonically_increasing_id()
        ranged = ordered.withColumn("_at", place).withColumn("_part", F.shiftright("_at", _ROW_BITS))
        counted = F.lit(1)
    else:
        tagged = ordered.withColumn("_part", F.spark_partition_id().cast("long"))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tagged.schema)
        ranged = tagged.mapInArrow(_weight_before(weight), f"{fields}, _at long")
        counted = F.col(weight)
    ranged = stored(ranged, "ranged")
    pieces = ranged.groupBy("_part", *groups).agg(
        F.min("_at").alias("_first"), F.sum(counted).cast("long").alias("_here"))
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = stored(pieces.select(
        "_part", *groups, "_first", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"),
        F.sum("_here").over(W.partitionBy(*groups)).alias(total)), "offsets")   # a row per task and per group
    joined = join_same(ranged, small(offsets, offsets.count()), ["_part", *groups])
    return joined.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).select(*df.columns, name, total)


def _weight_before(weight: str):
    """Adds to the rows of a partition the weight of those before them."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = 0
        for batch in batches:
            upto = carried + np.cumsum(batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64))
            before = np.r_[carried, upto[:-1]][:len(upto)]
            carried = int(upto[-1]) if len(upto) else carried
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], names=[*batch.schema.names, "_at"])
    return run


def quantile_map(
    synth: DataFrame, real: DataFrame, column: str, synth_id: str, real_id: str
) -> DataFrame:
    """Replace the i-th smallest synthetic value (from 0) by the real value of
    rank ``floor(i * n_real / n_synth)``; ties go by id. Null where there is no
    real value; null synthetic values stay null."""
    known = real.select(real_id, column).filter(F.col(column).isNotNull())
    targets = global_rank(known, [column, real_id], "_target").select(
        "_target", F.col(column).alias("_real")
    )
    some = global_rank(synth.filter(F.col(column).isNotNull()), [column, synth_id], "_rank")
    n_real, n_synth = targets.count(), some.count()   # both are stored
    product = F.col("_rank").cast("decimal(19,0)") * F.lit(n_real).cast("decimal(19,0)")
    aim = F.floor(product / F.lit(max(n_synth, 1)).cast("decimal(19,0)")).cast("long")
    mapped = some.withColumn("_target", aim).join(small(targets, n_real), "_target", "left").withColumn(
        column, F.col("_real")
    )
    return mapped.select(*synth.columns).unionByName(synth.filter(F.col(column).isNull()))


def quantile_map_coordinates(
    synth: DataFrame, real: DataFrame, synth_id: str, real_id: str
) -> DataFrame:
    """All coordinates mapped. Only ids and values are ranked, the coordinates as rows of
    one table, so each side is put in order once; the mapped values come back to the rows
    in one join on the id, which must be unique. A coordinate that the real side lacks
    becomes null."""
    known = [c for c in COORDINATES if c in real.columns]
    lacking = {c: F.lit(None).cast("double") for c in COORDINATES if c not in known}
    if not known:
        return synth.withColumns(lacking)

    def values(df: DataFrame, id_col: str) -> DataFrame:
        axes = F.array(*[F.struct(F.lit(i).alias("_axis"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(known)])
        long = df.select(F.col(id_col).alias("_id"), F.inline(axes)).filter(F.col("_value").isNotNull())
        return group_positions(long, ["_axis"], ["_value", "_id"], name="_rank", total="_n")

    targets = values(real, real_id).select(
        "_axis", F.col("_rank").alias("_target"), F.col("_value").alias("_real"), F.col("_n").alias("_n_real"))
    sizes = targets.groupBy("_axis").agg(F.max("_n_real").alias("_n_real"))     # a row per coordinate
    tasks = tasks_for(synth.sparkSession, len(known) * max(synth.count(), real.count()))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    aimed = values(synth, synth_id).join(F.broadcast(sizes), "_axis", "left").withColumn(
        "_target", F.floor(exact("_rank") * exact("_n_real") / exact("_n")).cast("long"))
    mapped = aimed.select("_id", "_axis", "_target").repartition(tasks, "_axis", "_target").join(
        targets.drop("_n_real").repartition(tasks, "_axis", "_target"), ["_axis", "_target"], "left").select(
        "_id", "_axis", "_real").repartition(tasks, "_id").groupBy("_id").agg(
        *[F.max(F.when(F.col("_axis") == i, F.col("_real"))).alias(c) for i, c in enumerate(known)])
    rest = synth.drop(*known).repartition(tasks, synth_id).join(mapped, F.col(synth_id) == F.col("_id"), "left")
    return rest.withColumns(lacking).select(*synth.columns)
