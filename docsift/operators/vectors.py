"""Embedders and the vector sink: texts to vectors in Arrow batches, points with a payload, refreshed by what changed.

A sink is a folder of any store that Spark reads: a manifest with the size of its vectors, and points that are only ever added; the
last version of a point counts. An upsert embeds a text only if its digest is not the one stored, so a rerun over unchanged texts
embeds none. What was embedded and written is counted within the write.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from docsift.operators import retrieval as R

#: Texts that an embedder gets at once.
BATCH = 64
#: Points of a task: vectors are sorted by point, so tasks grow in number and not in size.
POINTS = 50_000


class Embedder(Protocol):
    """What embed() and sinks ask of a model. It is made by a function, once a worker, so that it may be large or not picklable."""

    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of words, of length 1; a text without words is the zero vector. Needs no training and no files."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float64)
        for row, text in zip(out, texts, strict=True):
            for word, n in Counter(re.findall("[a-z0-9]+", text.lower())).items():
                digest = hashlib.md5(word.encode()).hexdigest()  # noqa: S324  a hash that SQL has too
                row[int(digest[:8], 16) % self.dimension] += n if digest[8] < "8" else -n
            if norm := np.sqrt((row * row).sum()):
                row /= norm
        return out.astype(np.float32)


_models: dict[str, Embedder] = {}


def _model(name: str, make: Callable[[], Embedder]) -> Embedder:
    if name not in _models:
        _models[name] = make()
    return _models[name]


def embed(rows: DataFrame, text: str, make: Callable[[], Embedder] = HashingEmbedder, vector: str = "vector", name: str = "") -> DataFrame:
    """rows with the vectors of their texts; null for a null or blank text. name: by which a worker keeps the model; one for each kind."""
    name = name or f"{make.__module__}.{make.__qualname__}"
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            found: list[np.ndarray | None] = [None] * b.num_rows
            want = [(i, t) for i, t in enumerate(b.column("_text").to_pylist()) if t and t.strip()]
            for at in range(0, len(want), BATCH):
                model = model or _model(name, make)
                some = want[at : at + BATCH]
                for (i, _), v in zip(some, model.encode([t for _, t in some]), strict=True):
                    found[i] = v
            kept = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.float32()))], names=[*columns, vector])

    return rows.withColumn("_text", F.col(text).cast("string")).mapInArrow(run, StructType([*rows.schema.fields, StructField(vector, ArrayType(FloatType()))]))


def payload(records: DataFrame, dataset: str) -> Column:
    """The ten fields of a point. records: id, code, canonical_id, title, product, standard_kind, family, profile (JSON text or null).

    What a record does not tell its profile may; lists come from the profile alone and are empty if it has none.
    """
    profile = F.try_parse_json("profile")
    of = lambda name: F.nullif(F.try_variant_get(profile, f"$.{name}", "string"), F.lit(""))
    listed = lambda name: F.coalesce(F.try_variant_get(profile, f"$.{name}", "array<string>"), F.array().cast("array<string>"))
    told = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.struct(
        F.col("id").cast("string").alias("standard_id"), F.col("code").alias("standard_code"), F.col("canonical_id").alias("canonical_id"), F.col("title").alias("title"),
        F.coalesce(told("product"), of("canonical_product")).alias("canonical_product"), F.coalesce(told("standard_kind"), of("standard_kind")).alias("standard_kind"), F.coalesce(told("family"), of("family")).alias("family"),
        listed("product_family").alias("product_family"), listed("applications").alias("applications"), F.lit(dataset).alias("source_dataset"),
    )


class VectorSink:
    """Points of one dataset: point_id, vector, payload."""

    def __init__(self, spark: SparkSession, path: str, dataset: str):
        self.spark, self.path, self.dataset = spark, path.rstrip("/"), dataset

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def ensure(self, size: int) -> bool:
        """Makes the collection if it is not there; an error if its vectors have another size. Tells whether it was made."""
        there = self._read("collection")
        if there is None:
            self.spark.createDataFrame([(size, "Cosine")], "size int, distance string").coalesce(1).write.parquet(f"{self.path}/collection")
            return True
        if there.first().size != size:
            raise ValueError(f"{self.path}: vectors of size {there.first().size}, not {size}")
        return False

    def points(self) -> DataFrame | None:
        """The last version of each point of the dataset."""
        found = self._read("points")
        if found is None:
            return None
        found = found.repartition(max(found.rdd.getNumPartitions(), -(-found.count() // POINTS)), "point_id")
        last = found.groupBy("dataset", "point_id").agg(F.max_by(F.struct("digest", "vector", "payload"), "version").alias("p"), F.max("version").alias("version"))
        return last.where(F.col("dataset") == self.dataset).select("point_id", "p.digest", "p.vector", "p.payload", "version")

    def count(self) -> int:
        found = self.points()
        return 0 if found is None else found.count()

    def upsert(self, records: DataFrame, make: Callable[[], Embedder] = HashingEmbedder, name: str = "") -> dict[str, int | list[str]]:
        """records: id, text and what payload() asks. A blank text, or an id that repeats, is an error, and nothing is written then.

        Points of other ids stay. Told: expected, valid_texts, embedded, written, records, errors.
        """
        n, valid, ids = records.agg(F.count("*"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) != ""), F.count_distinct("id")).first()
        report: dict = {"expected": n, "valid_texts": valid, "embedded": 0, "written": 0, "errors": []}
        report["errors"] += [f"{n - valid} records without text"] * (valid < n) + [f"{n - ids} ids repeat"] * (ids < n)
        if report["errors"]:
            return report | {"records": self.count()}
        self.ensure(make().dimension)
        now = records.select(F.col("id").cast("string").alias("point_id"), "text", F.sha2("text", 256).alias("digest"), payload(records, self.dataset).alias("payload"))
        old, version = self.points(), F.lit(1).cast("long")
        if old is None:
            both = now.withColumn("old", F.lit(None).cast("array<float>")).withColumn("version", version)
        else:
            was = old.select(F.col("point_id").alias("p"), F.col("digest").alias("d"), F.col("vector").alias("v"), F.col("payload").alias("q"), F.col("version").alias("n"))
            met = now.join(was, F.col("point_id") == F.col("p"), "left")
            same = F.col("digest").eqNullSafe(F.col("d"))
            both = met.where(~(same & (F.to_json("payload") == F.to_json("q")))).select(*now.columns, F.when(same, F.col("v")).alias("old"), (F.coalesce("n", F.lit(0)) + 1).alias("version"))
        # Only texts whose digest is new go to the model.
        told = embed(both.withColumn("text", F.when(F.col("old").isNull(), F.col("text"))), "text", make, "new", name)
        seen = Observation()
        rows = told.select(F.lit(self.dataset).alias("dataset"), "point_id", "digest", F.coalesce("old", "new").alias("vector"), "payload", "version", F.col("new").isNotNull().alias("fresh"))
        rows.observe(seen, F.count("*").alias("written"), F.count_if("fresh").alias("embedded")).drop("fresh").write.mode("append").parquet(f"{self.path}/points")
        return report | {k: seen.get[k] or 0 for k in ("embedded", "written")} | {"records": self.count()}

    def search(self, queries: DataFrame, k: int, make: Callable[[], Embedder] = HashingEmbedder) -> DataFrame:
        """query_id, point_id, score, rank: the nearest points by cosine. queries: query_id, text; a blank one is an error."""
        if not queries.where(F.trim(F.coalesce("text", F.lit(""))) == "").isEmpty():
            raise ValueError("query must not be empty")
        found = self.points()
        if found is None:
            return self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, point_id string, score double, rank long")
        q = embed(queries.select("query_id", "text"), "text", make, "q").select("query_id", "q")
        return R.dense_topk(found.select(F.col("point_id").alias("doc_id"), F.col("vector").alias("v")), q, k).withColumnRenamed("doc_id", "point_id")
