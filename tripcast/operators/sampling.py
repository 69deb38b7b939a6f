"""Exact seeded samples per group.

A group's rows are ordered by the digest of (seed, id). Taking the k smallest
of a group needs only one threshold digest per group, found in three narrow
passes: sizes, counts per leading hex digits, and the exact place inside the
one range of digests holding the k-th. The number of digits grows with the
group so that both the counts and that range have about the square root of the
group's rows; no task sees a whole group. The wide rows are then filtered
against the stored thresholds, without being shuffled when the groups are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripcast.durable import stored
from tripcast.functions import hashing, timecols as tc
from tripcast.joins import join_groups, join_same, spread, tasks_for
from tripcast.sources.trips import DROPOFF_ZONE, PICKUP_TIME, PICKUP_ZONE

CHUNK = 65_536   # draws made by one explode


def _lead(n: Column, key: Column) -> Column:
    digits = F.greatest(F.lit(0), F.rint(F.log2(n) / 8)).cast("int")
    return F.substring(key, F.lit(1), digits)


def _lead_counts(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per group and leading digits: how many rows, and how many come before."""
    counts = rows.groupBy(*groups, "_lead").agg(F.count(F.lit(1)).alias("_here"))
    upto = W.partitionBy(*groups).orderBy("_lead").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_here").over(upto), F.lit(0)))


def _stored(plan: DataFrame) -> tuple[DataFrame, int]:
    """A plan has one row per group and is read several times: store it, so the
    rows are counted once, and count the groups to choose the joins by. ``_group`` numbers them."""
    kept = stored(plan.withColumn("_group", F.monotonically_increasing_id()), "plan")
    return kept, kept.count()


def take_exact(df: DataFrame, groups: Sequence[str], plan: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Keep ``keep`` of each group's ``n`` rows, without replacement.

    ``plan`` has one row per group: the group, ``n`` and ``keep``. Groups absent
    from the plan are dropped. Ids must be unique: of rows that share the last
    kept id all stay.
    """
    return _take(df, list(groups), *_stored(plan), id_col, seed)


def _take(df: DataFrame, groups: list[str], plan: DataFrame, count: int, id_col: str, seed: int) -> DataFrame:
    key = hashing.digest(seed, F.col(id_col))
    plan = plan.select(*groups, F.col("n").alias("_n"), F.col("keep").alias("_keep")).filter(F.col("_keep") > 0)
    short = plan.filter(F.col("_keep") < F.col("_n"))
    narrow = df.select(*groups, F.col(id_col).alias("_id"), key.alias("_key"))
    contested = join_groups(narrow, short, groups, count).withColumn(
        "_lead", _lead(F.col("_n"), F.col("_key"))
    )
    edges = stored(join_same(_lead_counts(contested.select(*groups, "_lead"), groups), short, groups).filter(
        (F.col("_before") < F.col("_keep"))
        & (F.col("_keep") <= F.col("_before") + F.col("_here"))
    ).select(*groups, "_lead", "_n", (F.col("_keep") - F.col("_before")).alias("_need")), "edges")
    along = W.partitionBy(*groups).orderBy("_key", "_id")
    cuts = (
        join_groups(contested.select(*groups, "_lead", "_key", "_id"), edges, [*groups, "_lead"], count)
        .withColumn("_place", F.row_number().over(along))
        .filter(F.col("_place") == F.col("_need"))
        .select(*groups, F.col("_key").alias("_cut"), F.col("_id").alias("_cut_id"))
    )
    limits = stored(join_same(plan, cuts, groups, "left"), "limits")
    tagged = join_groups(df.withColumn("_key", key), limits, groups, count)
    below = (F.col("_key") < F.col("_cut")) | (
        (F.col("_key") == F.col("_cut")) & (F.col(id_col) <= F.col("_cut_id"))
    )
    return tagged.filter((F.col("_keep") >= F.col("_n")) | below).select(*df.columns)


def _rank(df: DataFrame, groups: list[str], plan: DataFrame, count: int, id_col: str, seed: hashing.Seed, tasks: int) -> DataFrame:
    """Number each group's rows from 1 in digest order (``_rank``), the work
    being cut by (group, leading digits). The group is told by its number ``_group`` in the plan."""
    sizes = plan.select(*groups, "_group", F.col("n").alias("_n"))
    keyed = join_groups(
        df.withColumn("_key", hashing.digest(seed, F.col(id_col))), sizes, groups, count
    ).withColumn("_lead", _lead(F.col("_n"), F.col("_key"))).repartition(tasks, "_group", "_lead")
    before = _lead_counts(keyed.select("_group", "_lead"), ["_group"])
    along = W.partitionBy("_group", "_lead").orderBy("_key", id_col)
    placed = keyed.withColumn("_place", F.row_number().over(along)).select(*df.columns, "_group", "_lead", "_place")
    return placed.join(before, ["_group", "_lead"]).select(
        *df.columns, "_group", (F.col("_before") + F.col("_place")).alias("_rank"))


def _draw(
    df: DataFrame, groups: list[str], plan: DataFrame, count: int, id_col: str, seed: hashing.Seed, by: Sequence[str] = ()
) -> DataFrame:
    """``draws`` rows per group, drawn independently with replacement: draw j
    takes the row of rank ``floor(u * n) + 1``. The new rows' ids are ``id#j``. The groups
    ``by`` have seeds of their own and are left out of the hash."""
    wanted = plan.filter(F.col("draws") > 0)
    chunks = F.sequence(F.lit(0), F.floor((F.col("draws") - 1) / CHUNK))
    last = F.least(F.col("draws"), (F.col("_chunk") + 1) * CHUNK)
    ticket = hashing.uniform(
        hashing.part_of(seed, "draw"), *[F.col(g) for g in groups if g not in by], F.col("_j"))
    chunked = wanted.select(*groups, "_group", "n", "draws").withColumn("_chunk", F.explode(chunks))
    most = wanted.agg(F.greatest(F.sum("n"), F.sum("draws")).alias("most")).first()["most"] or 0
    tasks = tasks_for(df.sparkSession, most)
    tickets = (
        spread(chunked, *groups, "_chunk")
        .withColumn("_j", F.explode(F.sequence(F.col("_chunk") * CHUNK + 1, last)))
        .select("_group", "_j", (F.floor(ticket * F.col("n")) + 1).alias("_rank"))
    )
    ranked = _rank(df, groups, wanted, count, id_col, seed, tasks).repartition(tasks, "_group", "_rank")
    # the size that Spark sees of the tickets is that of the few rows they are made from: never broadcast them
    drawn = ranked.join(tickets.repartition(tasks, "_group", "_rank").hint("merge"), ["_group", "_rank"])
    new_id = F.concat_ws("#", F.col(id_col).cast("string"), F.col("_j").cast("string"))
    return drawn.withColumn(id_col, new_id).select(*df.columns)


def _resample(
    df: DataFrame, groups: list[str], plan: DataFrame, id_col: str, seed: hashing.Seed, by: Sequence[str] = ()
) -> DataFrame:
    """Take ``keep`` rows and draw ``draws`` more with replacement, per group."""
    plan, count = _stored(plan)
    kept = _text_id(_take(df, groups, plan, count, id_col, seed), id_col)
    return kept.unionByName(_draw(df, groups, plan, count, id_col, seed, by))


def _text_id(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumn(id_col, F.col(id_col).cast("string"))


def equal_frequency(
    synth: DataFrame, real_hours: DataFrame, id_col: str, seed: hashing.Seed, by: Sequence[str] = ()
) -> DataFrame:
    """Exactly as many synthetic rows per hour as real ones (``hour, trips``), in each of
    the sets that the columns ``by`` tell apart; ``seed`` may be one of them.

    Drawn without replacement, unless the hour has too few; hours without
    synthetic rows are skipped. Ids become text, since drawn rows get new ones.
    """
    groups = [*by, "hour"]
    sizes = synth.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    plan = sizes.join(real_hours.select("hour", F.col("trips").alias("goal")), "hour")
    enough = F.col("goal") <= F.col("n")
    plan = plan.withColumns({
        "keep": F.when(enough, F.col("goal")).otherwise(0),
        "draws": F.when(enough, 0).otherwise(F.col("goal")),
    })
    return _resample(synth, groups, plan, id_col, seed, by)


def noisy_counts(sizes: DataFrame, seed: hashing.Seed, share: float = 0.05) -> DataFrame:
    """Goal per hour: the count plus normal noise of ``share`` of it, cut to a
    whole number towards zero, and at least 1."""
    noise = hashing.gaussian(hashing.part_of(seed, "noise"), F.col("hour")) * (F.col("n") * F.lit(share))
    return sizes.withColumn("goal", F.greatest(F.lit(1), F.col("n") + noise.cast("long")))


def perturb_counts(
    df: DataFrame, id_col: str, seed: hashing.Seed, share: float = 0.05, by: Sequence[str] = ()
) -> DataFrame:
    """Drop or duplicate random rows so each hour has its noisy count, in each of the sets
    that ``by`` tells apart (``seed`` may be one of these columns). Rows whose hour is null
    or not one of the 24 go. Ids must be unique in a set."""
    groups = [*by, "hour"]
    df = df.filter(F.col("hour").between(0, tc.HOURS_PER_DAY - 1))
    plan = noisy_counts(df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")), seed, share)
    plan = plan.withColumns({
        "keep": F.least("goal", "n"), "draws": F.greatest(F.lit(0), F.col("goal") - F.col("n")),
    })
    return _resample(df, groups, plan, id_col, seed, by)


def cap_groups(
    synth: DataFrame, real: DataFrame, id_col: str, seed: int, tolerance: float = 0.10,
    groups: Sequence[str] = (PICKUP_ZONE, DROPOFF_ZONE, "hour"),
) -> DataFrame:
    """At most ``ceil((1 + tolerance) * real)`` trips per group; groups the real
    trips lack are dropped. A null zone is a group of its own, matched with
    null; rows without an hour go. Keeps the id, the group and ``trips``."""
    groups = list(groups)
    narrow = synth.select(id_col, *groups, "trips")
    if "hour" in groups:
        narrow = narrow.filter(F.col("hour").isNotNull())
    plan = join_same(
        narrow.groupBy(*groups).agg(
            F.count(F.lit(1)).alias("n"), F.sum("trips").alias("n_synth")),
        real.groupBy(*groups).agg(F.sum("trips").alias("n_real")),
        groups,
    ).filter(F.col("n_real") > 0)
    allowed = F.ceil(F.col("n_real") * F.lit(1.0 + tolerance))
    cut = F.rint(allowed / F.col("n_synth") * F.col("n")).cast("long")
    plan = plan.withColumn("keep", F.when(F.col("n_synth") > allowed, cut).otherwise(F.col("n")))
    return take_exact(narrow, groups, plan, id_col, seed)


def even_days(df: DataFrame, min_trips: Column | int, id_col: str, seed: int, ts: str = PICKUP_TIME) -> DataFrame:
    """Exactly ``min_trips`` rows per day, without replacement; the job fails
    when a day has fewer."""
    goal = min_trips if isinstance(min_trips, Column) else F.lit(min_trips)
    dated = df.withColumn("_day", tc.date_of(F.col(ts)))
    sizes = dated.groupBy("_day").agg(F.count(F.lit(1)).alias("n"))
    short = F.concat(F.lit("too few trips on "), F.col("_day").cast("string"))
    plan = sizes.withColumn(
        "keep", F.when(F.col("n") < goal, F.raise_error(short).cast("long")).otherwise(goal)
    )
    return take_exact(dated, ["_day"], plan, id_col, seed).drop("_day")


def sample_share(df: DataFrame, share: float, id_col: str, seed: int) -> DataFrame:
    """Each row with probability ``share``: a filter, no shuffle."""
    return df.filter(hashing.uniform(seed, F.col(id_col)) < F.lit(share))


def sample_exact_share(df: DataFrame, share: float, id_col: str, seed: int) -> DataFrame:
    """Exactly ``share`` of the rows, rounded half to even."""
    keyed = df.withColumn("_all", F.substring(F.col(id_col).cast("string"), 1, 0))   # one group for all
    plan = keyed.groupBy("_all").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "keep", F.rint(F.col("n") * F.lit(share)).cast("long")
    )
    return take_exact(keyed, ["_all"], plan, id_col, seed).drop("_all")


def sample_pairs(pairs: DataFrame, count: int, columns: Sequence[str], seed: int) -> DataFrame:
    """``count`` of the distinct pairs, all of them when there are fewer. The
    ordered limit keeps only ``count`` rows per task."""
    key = hashing.digest(seed, *[F.col(c) for c in columns])
    return pairs.select(*columns).distinct().orderBy(key, *columns).limit(count)
