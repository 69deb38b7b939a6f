"""Compression classifier: which of two zstandard dictionaries shortens a text more.

One dictionary is built from good, one from bad labelled text. A text is cut
into blocks, every block is compressed with either, and the difference of the
total sizes by the byte is the evidence. What a difference is worth hangs on how
far the text shrinks at all (one word over and over leaves nothing to differ
in), so the logistic curve that turns it into a score also has the logarithm of
the size by the byte. The curve is fitted on labelled texts that neither
dictionary has seen.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripcast.llm.arrow import long_rows

DICTIONARY_BYTES = 65_536
LEVEL = 3
BLOCK = 2_048
SAMPLE = 4_000        # labelled texts of each class the dictionaries are built from, at most
ACCEPT = 0.3          # documents that score less are rejected
CALIBRATION = 4_000   # labelled texts the curve is fitted on, at most


def fold(doc_id: Column) -> Column:
    """0 for the documents held out, 1 to 4 for the others."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


class Evidence:
    """Sizes of a text's blocks under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL, block: int = BLOCK):
        self.block = block
        self.compressors = []
        for raw in (good, bad):
            words = zstandard.ZstdCompressionDict(raw)
            words.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(
                dict_data=words, level=level, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[float, float]:
        """Difference of the sizes and logarithm of the smaller one, by the byte."""
        data = (text or "").encode("utf-8", "surrogatepass")
        good, bad = (
            sum(len(c.compress(data[i:i + self.block])) for i in range(0, len(data), self.block))
            for c in self.compressors)
        return (bad - good) / (len(data) + 32), math.log((min(good, bad) + 12) / (len(data) + 32))


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]     # of the difference, of the logarithm, constant

    def scorer(self) -> Callable[[str | None], float]:
        if not self.weights:
            return lambda text: 0.5
        evidence, (w, v, c) = Evidence(self.good, self.bad), self.weights

        def score_of(text: str | None) -> float:
            difference, shrunk = evidence(text)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, w * difference + v * shrunk + c))))
        return score_of


def _dictionary(texts: list[str], size: int) -> bytes:
    blocks = [b for t in texts for d in [t.encode("utf-8", "surrogatepass")]
              for b in (d[i:i + BLOCK] for i in range(0, len(d), BLOCK))]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:      # too little text to choose from: the text itself
        return b"".join(blocks)[-size:]


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[float, ...]:
    """Weights of the columns of ``x`` and the constant of a logistic curve, by
    Newton steps. The targets are drawn in a little (Platt, 1999), so a clean cut
    has finite weights."""
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.c_[x / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(slope, z.T @ (t - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return (*(w[:-1] / scale).tolist(), float(w[-1]))


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    sample: int = SAMPLE, calibration: int = CALIBRATION, size: int = DICTIONARY_BYTES,
) -> Model:
    """Learn from labelled rows that are not held out: folds 2 to 4 build the
    dictionaries, fold 1 the curve. Of each at most ``sample`` texts a class
    and ``calibration`` texts are used, those whose ids have the smallest
    hashes; these bound what the driver holds. Without labels of both classes
    every score is the same.
    """
    marks = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q"))
        .filter(F.col("_id").isNotNull() & F.col("_q").isin(0, 1) & (fold(F.col("_id")) != 0))
        .groupBy("_id").agg(F.min("_q").alias("_q")))
    order = F.xxhash64(F.lit(7), "_id")
    part = F.when(fold(F.col("_id")) == 1, "curve").when(F.col("_q") == 1, "good").otherwise("bad")
    dealt = marks.withColumns({"_part": part, "_o": order})
    chosen = None
    for name, most in (("curve", calibration), ("good", sample), ("bad", sample)):
        some = dealt.filter(F.col("_part") == name).orderBy("_o").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = (
        docs.select(F.col(id_column).alias("_d"), F.coalesce(text_column, F.lit("")).alias("_t"))
        .join(F.broadcast(chosen), F.col("_d") == F.col("_id"))
        .groupBy("_id", "_q", "_part", "_o").agg(F.min("_t").alias("_t")).toPandas().sort_values("_o"))
    of = {k: g for k, g in texts.groupby("_part")}
    if len({"curve", "good", "bad"} & set(of)) < 3:
        return Model(b"", b"", ())
    good, bad = (_dictionary(list(of[k]["_t"]), size) for k in ("good", "bad"))
    evidence = Evidence(good, bad)
    x = np.array([evidence(t) for t in of["curve"]["_t"]])
    return Model(good, bad, fit_curve(x, of["curve"]["_q"].to_numpy()))


def score(docs: DataFrame, model: Model, text_column: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name``, from 0 to 1; null texts score like empty ones, whole texts
    of any length block by block, equal texts the same; an empty table gives none."""
    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scorer()
        for some in texts:
            yield pd.Series([of(t) for t in some], dtype="float64")
    return long_rows(docs).withColumn(name, scored(F.col(text_column)))
