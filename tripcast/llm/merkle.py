"""Merkle manifest of a dataset: a leaf per row, a tree per group, a tree over the groups.

Nodes are hexadecimal SHA-256 digests. Every two consecutive nodes of a level become the
digest of their concatenation, a last single one that of itself, until one node is left.

Only every STRIDE-th level is stored. A block of 2^STRIDE nodes under one stored node is
an aligned subtree: proofs are extracted from the top down, one tier of blocks at a time.
Each block regenerates its missing interior nodes from the stored ones below, emits the
siblings of its nodes together with the proof of the block itself, and drops the rest.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripcast.durable import forget, stored
from tripcast.joins import small

STRIDE = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TASK_ROWS = 2_000_000       # rows numbered by one task

NODE = "tree string, at long, total long, node string"
PROOF = "tree string, at long, proof string, steps string, subroot string"


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as its byte count, a colon and its text, or ``-`` for null."""
    def told(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[told(v) for v in values]).cast("binary"), 256)


def folded(node: Column, proof: Column, steps: Column) -> Column:
    """Root that a leaf and its proof lead to: ``R`` and ``L`` say on which side the next
    sibling of the proof stands, ``-`` that there is none."""
    def step(state: Column, side: Column) -> Column:
        sibling = F.substr(proof, state["used"] * 64 + 1, F.lit(64))
        parts = F.when(side == "R", F.concat(state["node"], sibling)).when(
            side == "L", F.concat(sibling, state["node"])).otherwise(state["node"])
        return F.struct(
            F.sha2(parts.cast("binary"), 256).alias("node"),
            (state["used"] + F.when(side == "-", 0).otherwise(1)).alias("used"))
    sides = F.filter(F.split(steps, ""), lambda s: s != "")
    return F.aggregate(sides, F.struct(node.alias("node"), F.lit(0).alias("used")), step, lambda s: s["node"])


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``at``, the place within the ``tree`` from 0, and ``total``, its rows.
    ``rows`` are stored; range partitions and the counts before each give the places."""
    count = rows.count()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // TASK_ROWS))
    place = F.monotonically_increasing_id()
    sorted_rows = stored(
        rows.withColumn("_row", place).repartitionByRange(tasks, "tree", *order, "_row")
        .sortWithinPartitions("tree", *order, "_row").drop("_row").withColumn("_place", place)
        .withColumn("_part", F.shiftright("_place", 33)), "numbered")
    each = sorted_rows.groupBy("_part", "tree").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("tree").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = stored(each.select(
        "_part", "tree", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy("tree")).alias("total")), "offsets")
    joined = sorted_rows.join(small(offsets, offsets.count()), ["_part", "tree"])
    at = F.col("_place") - F.col("_first") + F.col("_before")
    return joined.withColumn("at", at).drop("_part", "_place", "_first", "_before")


def _levels(nodes: list[str], up: int) -> list[list[str]]:
    """The nodes and the ``up`` levels above them."""
    out = [nodes]
    for _ in range(up):
        low = out[-1]
        out.append([sha256("".join(low[i:i + 2]).encode()).hexdigest() for i in range(0, len(low), 2)])
    return out


def _missing(total: int, tier: int, stride: int) -> int:
    """Levels between a block of this tier and the stored node above it: fewer at the top."""
    return min(stride, max(0, (total - 1).bit_length() - tier * stride))


def _ascend(tier: int, stride: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("at").to_pylist(), table.column("node").to_pylist()))
        tree, total = table.column("tree")[0].as_py(), table.column("total")[0].as_py()
        top = _levels([node for _, node in rows], _missing(total, tier, stride))[-1]
        return pa.table({"tree": [tree], "at": [rows[0][0] >> stride], "total": [total], "node": top})
    return run


def _descend(tier: int, stride: int, key: str | None):
    """Proofs of the nodes of a block: siblings within it, then the proof of the block.
    ``key`` is a column of the nodes to hand on."""
    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        order = sorted(range(nodes.num_rows), key=nodes.column("at").to_pylist().__getitem__)
        nodes = nodes.take(pa.array(order, pa.int64()))
        total = nodes.column("total")[0].as_py()
        levels = _levels(nodes.column("node").to_pylist(), _missing(total, tier, stride))
        tail, tail_steps, subroot = (above.column(c)[0].as_py() for c in ("proof", "steps", "subroot"))
        proofs, steps = [], []
        for at in range(nodes.num_rows):
            siblings, sides = [], []
            for level, row in enumerate(levels[:-1]):
                own = at >> level
                if own ^ 1 < len(row):
                    siblings.append(row[own ^ 1])
                    sides.append("L" if own & 1 else "R")
                else:
                    sides.append("-")
            proofs.append("".join(siblings) + tail)
            steps.append("".join(sides) + tail_steps)
        n = nodes.num_rows
        out = {"tree": nodes.column("tree"), "at": nodes.column("at"), "proof": pa.array(proofs, pa.string()),
               "steps": pa.array(steps, pa.string()), "subroot": pa.array([subroot] * n, pa.string())}
        if key:
            out |= {"node": nodes.column("node"), key: nodes.column(key)}
        return pa.table(out)
    return run


def _block(tier_nodes: DataFrame, stride: int) -> list[Column]:
    return [F.col("tree"), F.shiftright("at", stride).alias("block")]


def _tiers(leaves: DataFrame, stride: int) -> list[DataFrame]:
    """The stored levels of all trees, from the leaves up to one node a tree."""
    tiers = [leaves]
    most = leaves.agg(F.max("total")).first()[0] or 0
    while most > 1:
        nodes = tiers[-1].select("tree", "at", "total", "node")
        tiers.append(stored(
            nodes.groupBy(*_block(nodes, stride)).applyInArrow(_ascend(len(tiers) - 1, stride), NODE), "tier"))
        most = -(-most >> stride)
    return tiers


def _proofs(tiers: list[DataFrame], tops: DataFrame, stride: int, key: str | None = None) -> DataFrame:
    """Proofs of the lowest tier; ``tops`` holds those of the trees themselves."""
    above = tops
    for tier in reversed(range(len(tiers) - 1)):
        kept = key if tier == 0 else None
        columns = [*["tree", "at", "total", "node"], *([key] if kept else [])]
        nodes = tiers[tier].select(*columns)
        schema = PROOF + (f", node string, `{key}` {dict(nodes.dtypes)[key]}" if kept else "")
        below = nodes.groupBy(*_block(nodes, stride)).cogroup(above.groupBy("tree", "at")).applyInArrow(
            _descend(tier, stride, kept), schema)
        above = below if tier == 0 else stored(below, "proofs")
    if len(tiers) == 1:     # every tree is one node
        own = tiers[0].select("tree", "at", "node", *([key] if key else []))
        above = own.join(tops, ["tree", "at"]) if key else own.drop("node").join(tops, ["tree", "at"])
    return above


def manifest(
    docs: DataFrame, id_column: str = "doc_id", group_column: str = "lang", columns: Sequence[str] = COLUMNS,
    extra: Column | None = None, stride: int = STRIDE,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``leaf``, ``subroot`` (of its group), ``root``,
    ``proof`` (the siblings from the leaf to the root, 64 digits each, without gaps) and
    ``steps`` (their sides, see ``folded``); ``extra`` is a column of ``docs`` to hand on
    under that name.

    Leaves are ordered by id within a group, a null id first, equal ids by leaf; repeated
    rows have equal leaves and a place each. Groups are ordered by their bytes, the null
    group first, and a text of any length is hashed whole. Values of other types count by
    their text. An empty table gives an empty result. Columns not named take no part.
    """
    group = F.col(group_column).cast("string")
    tree = F.when(group.isNull(), "").otherwise(F.concat(F.lit("+"), group))
    plain = stored(docs.select(
        tree.alias("tree"), leaf([F.col(c) for c in columns]).alias("node"),
        F.struct(F.col(id_column).alias("id"), (F.lit(None).cast("string") if extra is None else extra).alias("extra")).alias("kept")), "leaves")
    leaves = stored(_numbered(plain.withColumn("_id", F.col("kept.id")), "_id", "node").drop("_id"), "tier")
    forget(plain)
    tiers = _tiers(leaves, stride)
    subroots = stored(tiers[-1].select(F.col("tree").alias("group"), "node", F.lit("").alias("tree")), "subroots")
    upper = _tiers(stored(_numbered(subroots, "group"), "tier"), stride)
    root = upper[-1].select("node").first()
    top = docs.sparkSession.createDataFrame([("", 0, "", "", "")], PROOF)
    tops = _proofs(upper, top, stride, "group").select(
        F.col("group").alias("tree"), F.lit(0).cast("long").alias("at"), "proof", "steps", F.col("node").alias("subroot"))
    found = _proofs(tiers, stored(tops, "proofs"), stride, "kept")
    return found.select(
        F.col("kept.id").alias("doc_id"), F.col("node").alias("leaf"), "subroot",
        F.lit(root[0] if root else None).cast("string").alias("root"), "proof", "steps", F.col("kept.extra").alias("extra"))
