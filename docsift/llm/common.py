"""What the operators share: cut lineage in the cluster's shared folder, label folds, bounded text batches, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker handles at once.
SLICE_CHARS = 1_000_000


#: Rows of an Arrow batch, for sessions that leave Spark's default (10000): whole texts are long, and a batch is held by the
#: JVM and by the Python worker at once.
ARROW_ROWS = 500


def tune(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset and the master is local (tests), a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(spark.sparkContext, "_docsift_dir", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="docsift-")
            spark.sparkContext._docsift_dir = found
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone; the folder belongs to the cluster
        pass


#: Rows of a table for each file of what is cut from it, and the fewest files.
ROWS_A_FILE, FEWEST_FILES = 10_000, 8


def files_for(rows: int) -> int:
    return max(FEWEST_FILES, rows // ROWS_A_FILE)


def cut(df: DataFrame, old: Iterable[DataFrame] = (), files: int | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read again, so that a lost executor costs no more than the last step.

    old: earlier results of cut() that nothing needs any more; their files go. files: how many at most; on local file systems
    each file makes Hadoop start a process to set its permissions, which counts twice an executor's memory while it forks.
    """
    spark = df.sparkSession
    if files:
        df = df.coalesce(files)
    path = f"{shared_dir(spark)}/docsift/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._docsift_path = path
    atexit.register(_delete, spark, path)
    drop(*old)
    return back


def drop(*old: DataFrame) -> None:
    for x in old:
        if path := getattr(x, "_docsift_path", None):
            _delete(x.sparkSession, path)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def free(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as make it no column of df."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def slices(batches: Iterable[pa.RecordBatch], text: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text; one text longer than the bound is a batch by itself."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        begin, total = 0, 0
        for i, n in enumerate(size):
            if total and total + n > chars:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def components(edges: DataFrame, files: int = FEWEST_FILES, max_rounds: int = 60, old: Iterable[DataFrame] = ()) -> DataFrame:
    """Smallest reachable id of each vertex: columns id, component_id. old: as for cut().

    edges: columns a, b (long). Labels travel along edges and jump to their label's label, so the rounds grow with the
    logarithm of a component's width. Hot vertices are met by partial aggregation and by adaptive skew joins.
    """
    both = cut(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), files=files)
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component_id")), files=files)
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("id").alias("b"), "component_id"), "b")
        near = seen.groupBy(F.col("a").alias("id")).agg(F.min("component_id").alias("m"))
        # Cut before the jump: a stage of one join is one whose hot keys adaptive execution can split.
        step = cut(labels.join(near, "id").select("id", F.least("component_id", "m").alias("l"), F.col("component_id").alias("was")), files=files)
        jump = step.select(F.col("id").alias("l"), F.col("l").alias("ll"))
        new = cut(step.join(jump, "l", "left").select("id", F.least("l", F.coalesce("ll", "l")).alias("component_id"), "was"), old=[step], files=files)
        changed = new.where("component_id <> was").limit(1).count()
        drop(labels)
        labels = new.select("id", "component_id")
        labels._docsift_path = new._docsift_path
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    drop(both, *old)
    return labels
