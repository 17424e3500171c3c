"""Language identification as mixture inference.

Each n-gram of a document is drawn from one of its languages. Expectation-maximisation finds the proportions from the
n-gram likelihoods of the languages; the set of languages is the one of greatest likelihood less half a logarithm of the
number of n-grams for each language but the first; the sets tried are the n likeliest languages of all, for every n up to the
number of languages that half an n-gram at least is expected of. The languages' n-gram frequencies are counted over all training rows.

Defined results: null text, or text without a letter, is `und` with score 0; a language is learned only from rows whose
text and lang are not null; without training rows every document is `und`; repeated rows are told one by one; of languages
of equal share the first by name is told; very long texts are read whole, one at a time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .minhash import mix

U = np.uint64
BUCKETS, ROUNDS = 1 << 14, 15
#: Languages that the driver can hold the n-grams of (64 KB each, as float32); more are an error, not cut off.
MOST_LANGUAGES = 2048


def _letters(code: np.ndarray) -> np.ndarray:
    kinds, at = np.unique(code, return_inverse=True)
    return np.array([chr(c).isalpha() for c in kinds.tolist()], bool)[at] if len(kinds) else np.zeros(0, bool)


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each letter trigram, words padded by one space on each side."""
    joined = "\x00".join((t or "").lower().replace("\x00", " ") for t in texts) + "\x00"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.cumsum(code == 0) - (code == 0)
    letter = _letters(code)
    c = np.where(letter, code, 32).astype(U)
    if len(c) < 3:
        return np.empty(0, "i8"), np.empty(0, "i8")
    mid = letter[1:-1]
    h = mix((c[:-2] << U(42)) ^ (c[1:-1] << U(21)) ^ c[2:])
    return doc[1:-1][mid], (h[mid] % U(BUCKETS)).astype("i8")


def count(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows of docs (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in common.slices(batches, "text"):
            langs = b.column("lang").to_pylist()
            names = sorted(set(langs))
            doc, bucket = ngrams([" ", *b.column("text").to_pylist()])  # the first letter has a neighbour too
            of = np.array([-1, *(names.index(x) for x in langs), -1])[doc]
            for i, name in enumerate(names):
                total[name] = total.get(name, 0) + np.bincount(bucket[of == i], minlength=BUCKETS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    return docs.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-free likelihoods: buckets x languages, as float32."""

    def __init__(self, langs: list[str], likelihood: np.ndarray):
        self.langs, self.likelihood = langs, likelihood

    def _em(self, p: np.ndarray, doc: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log likelihood of each document; p: likelihoods of each (document, n-gram) with count n."""
        share, docs = start, len(start)
        edges = np.searchsorted(doc, np.arange(docs))
        total = np.maximum(np.add.reduceat(np.append(n, 0), np.minimum(edges, len(n))), 1e-9)
        empty = np.diff(np.append(edges, len(n))) == 0
        for _ in range(rounds):
            r = share[doc] * p
            r *= (n / np.maximum(r.sum(1), 1e-30))[:, None]
            new = np.add.reduceat(np.vstack([r, np.zeros((1, r.shape[1]), r.dtype)]), np.minimum(edges, len(n)), axis=0) / total[:, None]
            new[empty] = start[empty]
            moved, share = np.abs(new - share).max(initial=0), new
            if moved < 1e-3:
                break
        fit = n * np.log(np.maximum((share[doc] * p).sum(1), 1e-30))
        ll = np.add.reduceat(np.append(fit, 0), np.minimum(edges, len(n)))
        ll[empty] = 0
        return share, ll

    def proportions(self, texts: list[str | None]) -> np.ndarray:
        """len(texts) x languages; zeros where there is no letter."""
        k = len(self.langs)
        out = np.zeros((len(texts), k))
        if not k or not texts:
            return out
        doc, bucket = ngrams([" ", *texts])
        key, n = np.unique((doc - 1) * BUCKETS + bucket, return_counts=True)
        doc, bucket = key // BUCKETS, key % BUCKETS
        n = n.astype("f4")
        p = self.likelihood[bucket]
        share, _ = self._em(p, doc, n, np.full((len(texts), k), 1 / k, "f4"), ROUNDS)
        order = np.argsort(-share, axis=1, kind="stable")
        grams = np.maximum(np.bincount(doc, weights=n, minlength=len(texts)), 1)
        best, best_value = share, np.full(len(texts), -np.inf)
        # A language that under half an n-gram is expected of cannot pay for itself.
        tried = int((share * grams[:, None] >= 0.5).sum(1).max(initial=1))
        for size in range(1, max(1, tried) + 1):
            allowed = np.zeros_like(share)
            np.put_along_axis(allowed, order[:, :size], 1, axis=1)
            start = (share + 1e-3) * allowed
            start /= start.sum(1, keepdims=True)
            found, ll = self._em(p, doc, n, start.astype("f4"), 1 if size == 1 else ROUNDS // 2)
            value = ll - 0.5 * (size - 1) * np.log(grams)
            better = value > best_value
            best = np.where(better[:, None], found, best)
            best_value = np.where(better, value, best_value)
        has = np.bincount(doc, minlength=len(texts)) > 0
        out[has] = best[has]
        return out

    def told(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        share = self.proportions(texts)
        if not len(self.langs):
            return ["und"] * len(texts), [0.0] * len(texts)
        top = share.argmax(1) if len(texts) else np.empty(0, int)
        value = share.max(1) if len(texts) else np.empty(0)
        return [self.langs[i] if v > 0 else "und" for i, v in zip(top, value, strict=True)], [float(min(1.0, v)) for v in value]


def fit(docs: DataFrame) -> Model:
    """docs: text, lang of the rows to learn from. The driver gets at most BUCKETS numbers a language."""
    rows = docs.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    common.tune(docs.sparkSession)
    counted = common.cut(count(rows))
    if counted.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    found = counted.toPandas()  # BUCKETS rows a language, at most
    common.drop(counted)
    langs = sorted(found["lang"].unique())
    n = np.zeros((BUCKETS, len(langs)))
    if len(langs):
        n[found["bucket"].to_numpy("i8"), found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy("i8")] = found["n"].to_numpy("f8")
    return Model(langs, ((n + 0.5) / (n.sum(0) + 0.5 * BUCKETS)).astype("f4"))


def predict(docs: DataFrame, model: Model, proportions: bool = False) -> DataFrame:
    """docs with lang_pred, score and, if asked for, proportions (map of language to share)."""
    common.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text", 500_000):
            texts = b.column("text").to_pylist()
            lang, score = shared.value.told(texts)
            cols, names = [*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"]
            if proportions:
                maps = [[(x, float(v)) for x, v in zip(shared.value.langs, r, strict=True) if v > 0] for r in shared.value.proportions(texts)]
                cols, names = [*cols, pa.array(maps, pa.map_(pa.string(), pa.float64()))], [*names, "proportions"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    docs = docs.drop("lang_pred", "score", "proportions").withColumn("text", F.col("text").cast("string"))
    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + [T.StructField("proportions", T.MapType(T.StringType(), T.DoubleType()))] * proportions
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(common.fold(F.col("doc_id"), 4) != 2).select("text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (common.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
