"""Quality: random Fourier features of document statistics, ridge regression from partition sums, isotonic calibration.

The statistics are taken once from each whole text, written, and read by all later steps; labels join those small rows
and not the texts. Each partition adds up its normal equations; a second round of sums leaves a few matrices for the
driver. The calibration is fitted to sums over `BINS` bins of the raw score, so the driver holds a fixed amount however
many rows are labelled. All labelled rows are used.

Defined results: null text counts as the empty text; several labels of one doc_id count as their largest; with labels of
one kind only (or none) every score is their mean (or 0.5); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FEATURES, RIDGE, SEED, BINS, THRESHOLD = 192, 1e-2, 17, 2000, 0.5
SYMBOLS = re.compile(r"[^\w\s.,;:'\"!?()-]")
ENDS = re.compile(r"[^\w\s]{2,}$")


def statistics(text: str | None) -> list[float]:
    """Numbers that tell prose from debris; all of them finite."""
    t = text or ""
    words = t.split()
    n, w = max(1, len(t)), max(1, len(words))
    sizes = np.fromiter(map(len, words), "f8", len(words)) if words else np.zeros(1)
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in t.split("\n") if x.strip()]
    letters = sum(map(str.isalpha, t))
    upper = sum(map(str.isupper, t))
    p = np.fromiter(counts.values(), "f8", len(counts)) / w if counts else np.ones(1)
    return [
        np.log1p(len(t)),
        np.log1p(len(words)),
        sizes.mean(),
        min(sizes.std(), 50.0),
        letters / n,
        upper / max(1, letters),
        sum(map(str.isdigit, t)) / n,
        len(SYMBOLS.findall(t)) / n,
        (t.count("!") + t.count("?")) / n,
        (t.count(".") + t.count(",")) / w,
        len(counts) / w,
        max(counts.values(), default=0) / w,
        1 - len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        sum(1 for x in words if ENDS.search(x)) / w,
        sum(1 for x in words if len(x) == 1 and not x.isalnum()) / w,
        float(-(p * np.log(p)).sum()) / max(1.0, np.log(w + 1)),
        sum(1 for x in words if x[:1].isupper()) / w,
    ]


WIDTH = len(statistics(""))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of statistics)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            x = np.array([statistics(t) for t in b.column("text").to_pylist()], "f4").reshape(-1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, WIDTH), pa.int32()), pa.array(x))], names=["doc_id", "x"])

    common.tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, WIDTH)


def _summed(rows: DataFrame, of) -> np.ndarray | None:
    """Sum over all rows of of(matrix, labels), an array of fixed shape: within partitions, then in a few tasks, then here."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                s = b.slice(at, 4000)
                got = of(_matrix(s.column("x")), s.column("y").to_numpy().astype("f8"))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("f8").tobytes()], pa.binary())], names=["s"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column("s").to_pylist():
                got = np.frombuffer(v, "f8")
                total = got.copy() if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    found = rows.mapInArrow(part, "s binary").repartition(8).mapInArrow(again, "s binary").collect()
    return sum(np.frombuffer(r.s, "f8") for r in found) if found else None


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nearest nondecreasing values."""
    means: list[float] = []
    weights: list[float] = []
    sizes: list[int] = []
    for v, w in zip(value, weight, strict=True):
        means.append(v)
        weights.append(w)
        sizes.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            total = weights[-2] + weights[-1]
            means[-2:] = [(means[-2] * weights[-2] + means[-1] * weights[-1]) / total]
            weights[-2:] = [total]
            sizes[-2:] = [sizes[-2] + sizes[-1]]
    return np.repeat(means, sizes)


class Model:
    def __init__(self, mean, scale, omega, phase, weights=None, steps=None, constant=None):
        self.mean, self.scale, self.omega, self.phase = mean, scale, omega, phase
        self.weights, self.steps, self.constant = weights, steps, constant

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def fit(rows: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """rows: x (statistics), y (0 or 1)."""
    first = _summed(rows, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]))
    draw = np.random.default_rng(SEED)
    omega, phase = draw.normal(size=(WIDTH, features)) / (0.5 * np.sqrt(WIDTH)), draw.uniform(0, 2 * np.pi, features)
    if first is None or not 0 < first[1] < first[0]:
        return Model(0, 1, omega, phase, constant=0.5 if first is None else float(first[1] / first[0]))
    n = first[0]
    mean = first[2 : 2 + WIDTH] / n
    scale = np.sqrt(np.maximum(first[2 + WIDTH :] / n - mean**2, 1e-8))
    model = Model(mean, scale, omega, phase)
    d = features + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.vstack([z.T @ z, (y @ z)[None]]).reshape(-1)

    sums = _summed(rows, normal).reshape(d + 1, d)
    keep = np.full(d, ridge * n / features)
    keep[-1] = 1e-9
    model.weights = np.linalg.solve(sums[:d] + np.diag(keep), sums[d])
    at = lambda x: np.minimum(((model.raw(x) + 0.5) / 2 * BINS).astype(int), BINS - 1)
    bins = _summed(rows, lambda x, y: np.concatenate([np.bincount(at(x), minlength=BINS), np.bincount(at(x), weights=y, minlength=BINS)]))
    size, hit = bins[:BINS], bins[BINS:]
    full = np.flatnonzero(size)
    model.steps = ((full + 0.5) / BINS * 2 - 0.5, isotonic(hit[full] / size[full], size[full]))
    return model


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = common.cut(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null and quality is not null").where(common.fold(F.col("doc_id"), 3) != 1)
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    rows = common.cut(stats.join(labels, "doc_id").select("x", F.when(F.col("y") > 0, 1).otherwise(0).alias("y")))
    model = fit(rows)
    common.drop(rows)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(_matrix(b.column("x"))), pa.float64())], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (common.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
