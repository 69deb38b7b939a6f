"""Embedding near-dedup, exact top-k and components on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripcast.llm import topk, vectors
from tripcast.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, rep int, cell int, bucket int, weight int, score int"


def vec(i, x):
    return (i, x, 1, 1, 1, 1, 1, 1)


def union(nodes, links):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        low[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [
        (rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)] + [(3, 3)]
    rng.shuffle(links)
    df = spark.createDataFrame(links + [(None, 4)], "a long, b long")
    got = {r.node: r.root for r in components(df, "a", "b").collect()}
    nodes = {n for link in links if link[0] != link[1] for n in link}
    assert got == union(nodes, [x for x in links if x[0] != x[1]])
    assert components(df.limit(0), "a", "b").count() == 0


def test_agreement_is_the_collision_chance():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal(200_000), rng.uniform(0, 1, 200_000)
    for distance in (0.3, 1.4):
        hit = (np.floor(b) == np.floor(a * distance + b)).mean()
        assert abs(hit - vectors.agreement(distance)) < 0.005


def test_tables_reach_their_recall():
    plan = vectors.Tables.sized(50_000)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((4000, 64))
    y -= (x * y).sum(axis=1)[:, None] * x
    y = 0.95 * x + math.sqrt(1 - 0.95 ** 2) * y / np.linalg.norm(y, axis=1)[:, None]
    met = (plan.keys(x) == plan.keys(y)).any(axis=1).mean()
    assert met > 0.995
    assert (plan.keys(x) == plan.keys(x[::-1])).mean() < 0.02


@pytest.mark.parametrize("cell", [2048, 8])
def test_links_match_brute_force(spark, cell):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 16))
    x = np.concatenate([rng.standard_normal((60, 16)), *[c + rng.normal(0, 0.12, (25, 16)) for c in centres]])
    x = np.concatenate([x, x[:5], x[60:70] * 3]).astype(np.float32)
    rows = spark.createDataFrame([vec(i * 7 % 509, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = vectors.near_vectors(rows, cell=cell).toPandas().set_index("vec_id")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    ids = [i * 7 % 509 for i in range(len(x))]
    roots = union(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(close, 1)))])
    for k, i in enumerate(ids):
        assert got.loc[i, "n_links"] == close[k].sum() - 1
        assert got.loc[i, "component_id"] == roots[i] and got.loc[i, "kept"] == (roots[i] == i)


ODD = [vec(1, None), vec(2, []), vec(3, [0.0, 0.0]), vec(4, [1.0, float("nan")]), vec(5, [1.0, None]),
       vec(6, [float("inf"), 1.0]), vec(7, [1.0, 0.0]), vec(8, [2.0, -0.0]), vec(8, [2.0, 0.0]),
       vec(9, [1.0, 0.0, 0.0]), vec(None, [1.0, 0.0]), vec(10, [1e30, 1e20]), vec(11, [3e-42, 0.0])]


def test_near_vectors_odd_rows(frame):
    rows = frame(SCHEMA, *ODD)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(rows).collect())
    alone = [(i, 0, i, True) for i in range(1, 7)]
    assert got[0] == (0, 0, None, False)
    assert [g for g in got if 1 <= g[0] <= 6] == alone
    assert [g for g in got if g[0] in (7, 8, 10, 11)] == [
        (7, 4, 7, True), (8, 4, 7, False), (8, 4, 7, False), (10, 4, 7, False), (11, 4, 7, False)]
    assert (9, 0, 9, True) in got and len(got) == len(ODD)
    assert vectors.near_vectors(rows.limit(0)).count() == 0


def slow_top(rows, asks, k):
    whole = {}
    for i, x in rows:
        whole.setdefault(i, []).append([math.floor(1024 * float(v)) for v in x])
    out = []
    for q in sorted(i for i in whole if asks(i)):
        query = min(whole[q])
        found = sorted((-sum(a * b for a, b in zip(query, w)), i)
                       for i, ws in whole.items() if i != q for w in ws if len(w) == len(query))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return out


@pytest.mark.parametrize("part", [4096, 16])
def test_top_products_match_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(topk, "PART", part)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((300, 8)) * rng.lognormal(0, 1, (300, 1))).astype(np.float32)
    x[40:60] = x[40]
    x[100] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([vec(*r) for r in rows], SCHEMA)
    got = topk.top_products(df, F.col("vec_id") % 10 == 0, k=7).collect()
    assert sorted(tuple(r) for r in got) == slow_top(rows, lambda i: i % 10 == 0, 7)


def test_pruning_keeps_what_may_score(monkeypatch):
    rng = np.random.default_rng(6)
    for _ in range(300):
        part = rng.integers(-2000, 2000, (80, 6)).astype(float) * rng.lognormal(0, 1, (80, 1))
        part = part[np.argsort(-np.linalg.norm(part, axis=1))]
        query = rng.integers(-2000, 2000, 6).astype(float)
        bound = np.quantile(part @ query, rng.uniform(0.5, 1))
        kept = topk.candidates(query, np.linalg.norm(query), bound, part, np.linalg.norm(part, axis=1))
        assert set(np.flatnonzero(part @ query >= bound)) <= set(kept)


def test_top_products_odd_rows(frame):
    rows = frame(SCHEMA, *[r for r in ODD if r[0] != 10], vec(100, [1.0, 2.0]), vec(100, [1.0, 2.0]), vec(200, None))
    got = sorted(tuple(r) for r in topk.top_products(rows, F.col("vec_id") % 100 == 0).collect())
    good = [(3, [0.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]),
            (11, [3e-42, 0.0]), (100, [1.0, 2.0]), (100, [1.0, 2.0])]
    assert got == slow_top(good, lambda i: i % 100 == 0, 10)
    assert topk.top_products(rows.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    huge = frame(SCHEMA, vec(0, [1e12, 1.0]), vec(1, [1e12, 1.0]), vec(2, [-1e12, 1.0]))
    assert [(r.vec_id, r.score) for r in topk.top_products(huge, F.col("vec_id") == 0).collect()] == [
        (1, 2 ** 63 - 1), (2, -(2 ** 63))]
